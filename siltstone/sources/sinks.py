"""Sinks: keyed tables, dead letters, result files, review sheets, configurations."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.vector import check_dimension


def ensure_collection(spark: SparkSession, name: str, dim: int, vector: str = "dense") -> bool:
    """Whether a table of vectors exists; if so, its vectors must have the dimension."""
    if not spark.catalog.tableExists(name):
        return False
    held = spark.table(name).where(F.col(vector).isNotNull()).limit(1)
    check_dimension(held, vector, dim).collect()
    return True


def upsert(rows: DataFrame, name: str, key: str) -> None:
    """Writes rows into a table by key: rows of a known key replace it, so doing it again changes nothing.

    The new table is written in full beside the old one and takes its place, as tables
    of files have no update in place; on a table format with MERGE, use that instead.
    """
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    if not spark.catalog.tableExists(name):
        rows.write.saveAsTable(name)
        return
    kept = spark.table(name).join(rows.select(key), key, "left_anti")
    fresh = f"{name}__new"
    spark.sql(f"DROP TABLE IF EXISTS {fresh}")
    kept.unionByName(rows, allowMissingColumns=True).write.saveAsTable(fresh)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")


def with_dead_letters(rows: DataFrame, good: str, bad: str, error: str = "error") -> tuple[int, int]:
    """Writes rows without an error to one folder and the others to a second, and counts both; no second folder for none."""
    rows.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(good)
    lost = rows.where(F.col(error).isNotNull())
    n = lost.count()
    if n:
        lost.write.mode("overwrite").json(bad)
    return rows.sparkSession.read.parquet(good).count(), n


def retried(write: Callable[[], None], attempts: int = 3, wait: float = 1.0) -> bool:
    """Whether a write went through within the attempts; wait seconds, then twice as long each, lie between them."""
    for turn in range(attempts):
        try:
            write()
            return True
        except Exception:
            if turn + 1 < attempts:
                time.sleep(wait * 2**turn)
    return False


def write_spool(parents: DataFrame, children: DataFrame, path: str) -> int:
    """Parents and children as JSON lines, each with its chunk_type, and how many there are.

    The closing line, which says how many of each were written, follows in a file of its
    own once the others are in place; so a spool without it was cut short.
    """
    spark = parents.sparkSession
    for rows, kind, mode in ((parents, "parent", "overwrite"), (children, "child", "append")):
        rows.select(F.to_json(F.struct(F.lit(kind).alias("chunk_type"), *rows.columns)).alias("value")).write.mode(mode).text(path)
    counts = spark.read.text(path).select(F.get_json_object("value", "$.chunk_type").alias("k")).agg(F.count_if(F.col("k") == "parent").alias("total_parents"), F.count_if(F.col("k") == "child").alias("total_children"))
    n = counts.first()
    end = spark.range(1).select(F.to_json(F.struct(F.lit(True).alias("__complete"), F.lit(n["total_children"]).alias("total_children"), F.lit(n["total_parents"]).alias("total_parents"))).alias("value"))
    end.coalesce(1).write.mode("append").text(path)
    return n["total_parents"] + n["total_children"]


def write_progress(results: DataFrame, path: str, key: str, every: int = 25) -> int:
    """Appends the results that the progress at path lacks, in parts of as many questions as say, and returns how many were added."""
    spark = results.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = resume(results, spark.read.parquet(path).select(key), key) if held else results
    new = new.persist()
    n = new.count()
    if n:
        new.repartitionByRange(max(1, -(-n // every)), key).write.mode("append").parquet(path)
    new.unpersist()
    return n


def save_upload(spark: SparkSession, name: str, content: bytes, folder: str) -> str:
    """Writes an upload into a folder that a file source reads, under its own name without folders; the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{re.split(r'[/\\\\]', name)[-1]}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(content))
    out.close()
    return path.toString()


def json_safe(rows: DataFrame) -> DataFrame:
    """rows with every column that JSON has no type for as text."""
    native = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    return rows.select(*[F.col(f"`{c}`") if t in native or t.startswith(("array<string>", "array<double>", "array<int>", "array<bigint>")) else F.col(f"`{c}`").cast("string").alias(c) for c, t in rows.dtypes])


def write_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def write_results(rows: DataFrame, path: str, columns: list[str] | None = None, kind: str = "json") -> None:
    """Results as JSON, or as CSV with a header and the columns in the order given."""
    chosen = rows.select(*columns) if columns else rows
    (chosen.write.mode("overwrite").json(path) if kind == "json" else chosen.write.mode("overwrite").option("header", True).csv(path))


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def resume(questions: DataFrame, progress: DataFrame, key: str = "id") -> DataFrame:
    """The questions that an earlier run's progress has no result for."""
    return questions.join(progress.select(key), key, "left_anti")


def drop_by_prefix(spark: SparkSession, prefixes: tuple[str, ...] = ("temp", "test"), dry_run: bool = True, database: str | None = None) -> list[str]:
    """Names of the tables of a database, the current one by default, that begin with a prefix; they are dropped unless it is a dry run."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if t.name.lower().startswith(prefixes))
    if not dry_run:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {f'{database}.' if database else ''}{name}")
    return names


def project(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that rows have."""
    return rows.select(*[c for c in columns if c in rows.columns])


def config_json(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """(section, settings): a nested configuration, each section's settings as JSON."""
    import json

    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, default=str)) for k, v in sorted(config.items())], "section string, settings string")
