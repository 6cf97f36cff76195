"""Part of siltstone; see README.md."""
