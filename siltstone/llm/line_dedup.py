"""Lines that repeat across documents (operator 7), in DataFrame functions only.

A text is split at \\n (null or empty: one empty line). A line's key is the line
without the characters [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at
least min_chars code points that at least min_docs documents hold lose all their
lines but those of the smallest doc_id holding the key; the others stay in order.

How it runs: lines are exploded and their keys hashed to 128 bits; one aggregation,
combined before the shuffle, counts the documents of each hash; the lines join the
repeated hashes by a salted key, so a line that a third of all documents hold is
dealt over SALTS tasks; the positions to drop are gathered for each document and
its text is put together again by position.

Cases: null and empty texts have one empty line and stay empty; texts of any length are
split whole, and only hashes and positions of their lines leave their task; lines of
rows with a null doc_id are kept and count for no document; rows that repeat a doc_id
are one document; of equal lines within the smallest doc_id all stay, so there are no
ties; an empty table gives an empty one; extra columns, whatever their names, pass
through unchanged, but those named like the counts that are asked for are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import columns_of

SALTS = 16
BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the short way for texts of ASCII only."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, counts: bool = True) -> DataFrame:
    """docs with text rejoined from the lines kept, with counts also _n_lines and _n_dropped; n_chars follows the text if it is there."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("sum"), F.struct("*").alias("row"))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text").where("doc IS NOT NULL").select("doc", "mark", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc", "mark", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select("doc", "mark", "pos", lower_ascii(F.col("key")).alias("key"))
    lines = lines.select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    if min_docs == 2:
        held = lines.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    else:
        held = lines.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    held = held.select("h1", "h2", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod("doc", F.lit(SALTS)).cast("int"))
    gone = salted.join(held, ["h1", "h2", "salt"]).where("doc > least")
    # the lines of one document only
    gone = gone.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))
    met = rows.join(gone, (F.col("id") == F.col("doc")) & (F.col("sum") == F.col("mark")), "left")
    met = met.select("row", split_lines(F.col("row.text")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.size("gone") == 0, F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda k: F.col("lines")[k]), "\n"))
    met = met.select("row", "lines", "gone", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    own = {"_n_lines": F.size("lines").cast("long"), "_n_dropped": F.size("gone").cast("long")} if counts else {}
    return met.select(*columns_of("row", [c for c in docs.columns if c not in own], **changed), *[c.alias(name) for name, c in own.items()])
