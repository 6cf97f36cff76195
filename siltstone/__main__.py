"""python -m siltstone QUERY FOLDER [OUT]: runs a registered query over a folder of tables and shows its rows, or writes them as Parquet."""

from __future__ import annotations

import sys

from siltstone.plans import catalog
from siltstone.session import session


def main(arguments: list[str]) -> int:
    queries = catalog.queries()
    if len(arguments) not in (2, 3) or arguments[0] not in queries:
        print(__doc__.strip(), "Queries: " + " ".join(sorted(queries)), sep="\n", file=sys.stderr)
        return 2
    spark = session(arguments[0])
    rows = queries[arguments[0]](spark, arguments[1].rstrip("/"))
    if len(arguments) == 3:
        rows.write.mode("errorifexists").parquet(arguments[2])
    else:
        rows.show(50, truncate=80)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
