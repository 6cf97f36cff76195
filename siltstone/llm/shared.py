"""Scratch tables, Bloom filters and connected components that the operators share.

A scratch table is Parquet in the folder that the session names in
``spark.checkpoint.dir``: it cuts lineage, survives lost executors and is
deleted when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectorised import small_batches
from pyspark.sql.types import IntegerType, StructField, StructType

_OWN: dict[str, str] = {}
#: Tables written within each tidy() that is open.
_OPEN: list[list[DataFrame]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a local one of our own only in local mode with the setting unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _OWN[app]


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it ends; only for queries whose result is kept elsewhere."""
    before = spark.conf.get(_FREED, None)
    small_batches(spark)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def scratch(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
    with frugal(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch_path = path
    for made in _OPEN:
        made.append(kept)
    return kept


@contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the scratch tables made within when it ends, but those that the tables given to keep() read."""
    made: list[DataFrame] = []
    needed: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        needed.append(table)
        return table

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.remove(made)
        read = {name.rsplit("/scratch-", 1)[-1].split("/")[0] for table in needed for name in table.inputFiles()}
        gone = [t for t in made if t._scratch_path.rsplit("/scratch-", 1)[-1] not in read]
        discard(*gone)
        for outer in _OPEN:
            outer[:] = [t for t in outer if all(t is not g for g in gone)]


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file of the driver, some megabytes, for all executors: none of them needs the path."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast((path, file.read()))


def columns_of(row: str, columns: list[str], **changed: Column) -> list[Column]:
    """The columns of a struct that carries whole rows, some changed: carried so, no name of theirs can clash with one beside them."""
    return [(changed[c] if c in changed else F.col(row).getField(c)).alias(c) for c in columns]


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rest_of(docs: DataFrame, *without: str) -> tuple[Column, StructField]:
    """The columns of docs but some as one struct named row, and its field: so they go through Python whatever their names."""
    fields = [f for f in docs.schema if f.name not in without]
    row = F.struct(*[named(f.name).alias(f.name) for f in fields]) if fields else F.struct(F.lit(None).cast("int").alias("none"))
    return row.alias("row"), StructField("row", StructType(fields or [StructField("none", IntegerType())]))


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def most_frequent(counted: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """The n rows of counted with the largest counts, ties to the smaller key.

    How many rows have counts of each size, at most a few hundred sizes, tells which are
    out of the question; so tasks hand over little more than n rows in all.
    """
    kept = scratch(counted)
    size = F.floor(8 * F.log2(F.col(count))).cast("int")
    sizes = sorted(((r["s"], r["m"]) for r in kept.groupBy(size.alias("s")).agg(F.count("*").alias("m")).collect()), reverse=True)
    total, least = 0, None
    for s, m in sizes:
        least, total = s, total + m
        if total >= n:
            break
    return (kept if least is None else kept.where(size >= least)).orderBy(F.desc(count), key).limit(n)


class Bloom:
    """A bit set over 64-bit keys, built by aggregation in the cluster and sized by their number.

    It has about BITS bits for each key, between 2**FEWEST and 2**MOST bits in all, so
    it may be broadcast. It only spares work: a key that was added always passes, and
    what passes wrongly is sorted out by the exact step that follows. With more keys than
    2**MOST / BITS more pass wrongly; then that step's work is still in proportion to the
    input.
    """

    BITS, FEWEST, MOST = 12, 20, 28

    def __init__(self, keys: DataFrame):
        """keys: one long column named key."""
        spark = keys.sparkSession
        if not hasattr(keys, "_scratch_path"):
            keys = scratch(keys)
        bits = min(self.MOST, max(self.FEWEST, (self.BITS * keys.count()).bit_length()))
        mask = (1 << bits) - 1
        spots = keys.select(
            F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("spot")
        )
        words = spots.groupBy(F.shiftright("spot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")).alias("set"))
        with frugal(spark):
            words = words.toArrow()
        cells = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
        cells[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
        self.mask, self.cells = mask, spark.sparkContext.broadcast(cells)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """A boolean for each key (int64 or uint64 array)."""
        keys, cells = keys.view(np.uint64), self.cells.value
        out = np.ones(len(keys), bool)
        for spot in (keys & np.uint64(self.mask), (keys >> np.uint64(32)) & np.uint64(self.mask)):
            out &= (cells[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Levels:
    """How often 64-bit keys occur, in quarters of powers of two, in a table of at most 2**BITS bytes.

    Keys that share a cell get the larger level, so it serves to put keys in one order
    everywhere, the rare ones first as a rule.
    """

    BITS = 22

    def __init__(self, counts: DataFrame, count: str):
        """counts: a long column named key and how often the key occurs."""
        cell = F.shiftrightunsigned("key", 8).bitwiseAND((1 << self.BITS) - 1).cast("int")
        level = F.floor(4 * F.log2(F.col(count))).cast("int")
        found = counts.groupBy(cell.alias("cell")).agg(F.max(level).cast("byte").alias("level"))
        with frugal(counts.sparkSession):
            found = found.toArrow()
        cells = np.zeros(1 << self.BITS, np.uint8)
        cells[found["cell"].to_numpy()] = found["level"].to_numpy()
        self.cells = counts.sparkSession.sparkContext.broadcast(cells)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.cells.value[keys.view(np.uint64) >> np.uint64(8) & np.uint64((1 << self.BITS) - 1)]


def _forest(batches):
    """A spanning forest of a partition's edges, each node with the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each round first contracts every partition's edges to a forest, then hangs every
    node below its smallest neighbour and relabels the edges, until none crosses two
    components. Nodes with very many edges only meet partial aggregates.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = scratch(ordered.mapInArrow(_forest, "a long, b long"))
    labels = None
    while not left.isEmpty():
        # b hangs below the smallest a, or below what that hangs below
        hang = left.groupBy("b").agg(F.min("a").alias("p"))
        up = hang.select(F.col("b").alias("n1"), F.col("p").alias("n2"))
        named = scratch(hang.join(up, F.col("p") == F.col("n1"), "left").select(F.col("b").alias("x"), F.coalesce("n2", "p").alias("y")))
        new = named.select(F.col("x").alias("node"), F.col("y").alias("root"))
        labels = new if labels is None else labels.join(named, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root")).unionByName(new)
        for end in ("a", "b"):
            left = left.join(named, F.col(end) == F.col("x"), "left").withColumn(end, F.coalesce("y", end)).select("a", "b")
        left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = scratch(left.mapInArrow(_forest, "a long, b long"))
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    labels = scratch(labels)
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
