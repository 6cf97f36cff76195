"""Reports as rows: lines of Markdown, the series that plots show, and the counters of an ingestion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a plotted histogram.
BINS = 20


def markdown(rows: DataFrame, title: str, columns: Sequence[str], order: Sequence[Column | str], digits: int = 4) -> DataFrame:
    """(line, text) of a Markdown table of the rows in an order, under a heading; for summaries, which are small."""
    doubles = {f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")}
    shown = lambda c: F.coalesce(F.format_string(f"%.{digits}f", c) if c in doubles else F.col(c).cast("string"), F.lit("-"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 4).cast("long").alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *[shown(c) for c in columns]), F.lit(" |")).alias("text"))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    top = rows.sparkSession.range(len(head)).select((F.col("id") + 1).alias("line"), F.element_at(F.array(*[F.lit(x) for x in head]), (F.col("id") + 1).cast("int")).alias("text"))
    return top.unionByName(body)


def curve(rows: DataFrame, prefix: str, cuts: Sequence[int], digits: int = 6) -> DataFrame:
    """(series, x, y): the mean of a metric at each cut, as a line plot shows it."""
    sums = rows.agg(*[F.round(F.avg(f"{prefix}{k}"), digits).alias(str(k)) for k in cuts])
    return sums.unpivot([], [F.col(f"`{k}`") for k in cuts], "x", "y").select(F.lit(prefix.rstrip("_")).alias("series"), F.col("x").cast("double").alias("x"), "y")


def bars(rows: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """(series, x, y): the mean of a value for each group, groups as text."""
    return rows.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("x")).agg(F.round(F.avg(value), digits).alias("y")).select(F.lit(value).alias("series"), "x", "y")


def histogram(rows: DataFrame, value: str, bins: int = BINS, digits: int = 6) -> DataFrame:
    """(bin, low, high, n) of bins of equal width over a value's range, the last with its upper edge; empty ones included."""
    ends = rows.agg(F.min(value).alias("least"), F.max(value).alias("most"))
    least, most = ends.select("least").scalar(), ends.select("most").scalar()
    width = (most - least) / bins
    spot = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - least) / width))).otherwise(0).cast("long")
    counted = rows.where(F.col(value).isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select("bin", F.round(least + F.col("bin") * width, digits).alias("low"), F.round(least + (F.col("bin") + 1) * width, digits).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def boxes(rows: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """(group, low, q25, median, q75, high, outliers) of a box plot: whiskers at the outermost values within 1.5 quartile distances."""
    quartiles = rows.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    met = rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).join(F.broadcast(quartiles), F.col("_g").eqNullSafe(F.col(group)))
    reach = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    inner = F.col("_v").between(F.col("_q")[0] - reach, F.col("_q")[2] + reach)
    out = met.groupBy(group).agg(F.min(F.when(inner, F.col("_v"))).alias("low"), F.first("_q").alias("_q"), F.max(F.when(inner, F.col("_v"))).alias("high"), F.count_if(~inner).alias("outliers"))
    edge = lambda c, name: F.round(c, digits).alias(name)
    return out.select(group, edge(F.col("low"), "low"), edge(F.col("_q")[0], "q25"), edge(F.col("_q")[1], "median"), edge(F.col("_q")[2], "q75"), edge(F.col("high"), "high"), "outliers")


def ingestion(files: DataFrame, parents: DataFrame, children: DataFrame, stored: DataFrame, key: str = "file_hash") -> DataFrame:
    """(name, value): files, parents, children, mean children for a file, stored rows, and whether all children are stored (1 or 0)."""
    count = lambda rows, name: rows.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    done = files.select(key).distinct().agg(F.count("*").cast("double").alias("value")).select(F.lit("files").alias("name"), "value")
    counts = reduce(DataFrame.unionByName, [done, count(parents, "parents"), count(children, "children"), count(stored, "stored")])
    wide = counts.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("files", "parents", "children", "stored")])
    wide = wide.withColumns({"children_per_file": F.round(F.coalesce(F.try_divide("children", "files"), F.lit(0.0)), 6), "complete": (F.col("stored") >= F.col("children")).cast("double")})
    return wide.unpivot([], list(wide.columns), "name", "value")
