"""Exact dense search and similarities of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the corpus takes, and so the rows that are broadcast at once.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a vector that is null or zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def check_dimension(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """vectors, failing where a vector has another length than dim."""
    return vectors.where(F.assert_true(F.size(column) == dim, F.lit(f"{column} must have {dim} components")).isNull())


def _first(found: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k largest numbers, largest first, equal ones in their order."""
    if found.shape[1] <= 4 * k:
        return np.argsort(-found, axis=1, kind="stable")[:, :k]
    edge = -np.partition(-found, k - 1, axis=1)[:, k - 1 : k]
    # those above the edge and, of those on it, the first
    on = found == edge
    need = k - (found > edge).sum(axis=1, keepdims=True)
    chosen = (found > edge) | (on & (np.cumsum(on, axis=1) <= need))
    places = np.nonzero(chosen)[1].reshape(len(found), k)
    return np.take_along_axis(places, np.argsort(-np.take_along_axis(found, places, axis=1), axis=1, kind="stable"), axis=1)


def _block(corpus: DataFrame, key: str, vector: str, asked: pa.Table, query: str, k: int, digits: int) -> DataFrame:
    ids = asked[query].to_numpy()
    matrix = np.stack(asked["_v"].to_pylist()).astype(np.float64)
    lengths = np.linalg.norm(matrix, axis=1)
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix / np.where(lengths > 0, lengths, 1)[:, None]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(keys), 2048):
                part = batch.column(1).slice(lo, 2048)
                x = np.asarray(part.flatten(), np.float64).reshape(len(part), -1)
                size = np.linalg.norm(x, axis=1)
                found = np.round(wanted @ (x / np.where(size > 0, size, 1)[:, None]).T, digits)
                own = keys[lo : lo + 2048]
                order = np.argsort(own, kind="stable")
                best = order[_first(found[:, order], k)]
                rows = np.repeat(np.arange(len(names)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(own[best.ravel()]), pa.array(found[rows, best.ravel()])], names=[query, key, "score"])

    kind = dict(corpus.dtypes)[key]
    return corpus.select(key, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).mapInArrow(scan, f"{query} long, {key} {kind}, score double")


def top_k_cosine(queries: DataFrame, query: str, corpus: DataFrame, key: str, vector: str = "embedding", k: int = 10, digits: int = 6) -> DataFrame:
    """(query, key, score, rank): the k rows of corpus nearest to each query, ties to the smaller key.

    Queries are taken in blocks of QUERY_BLOCK; each block is one pass over the corpus
    by matrix products, with the best k of every batch, then a ranking over batches.
    """
    asked = queries.select(F.col(query).cast("long"), F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b).toArrow()
        if len(part):
            got = _block(corpus, key, vector, part, query, k, digits)
            found = got if found is None else found.unionByName(got)
    if found is None:
        return queries.sparkSession.createDataFrame([], f"{query} long, {key} {dict(corpus.dtypes)[key]}, score double, rank int")
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def alike(left: DataFrame, right: DataFrame, key: str, vector: str, least: float, digits: int = 6) -> DataFrame:
    """(a, b, similarity) of the rows of left and right whose cosine is at least so much, rounded, but for rows with themselves.

    Rows of left are taken in blocks of QUERY_BLOCK; each block is one pass over right by matrix products.
    """
    spark = left.sparkSession
    kind = dict(left.dtypes)[key]
    asked = left.select(key, F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()
        if not len(part):
            continue
        matrix = np.stack(part["_v"].to_pylist()).astype(np.float64)
        shared = spark.sparkContext.broadcast((part[key].combine_chunks(), matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, wanted = shared.value
            for batch in batches:
                for lo in range(0, len(batch), 2048):
                    keys, x = batch.column(0).slice(lo, 2048), batch.column(1).slice(lo, 2048)
                    x = np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
                    score = np.round(wanted @ (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]).T, digits)
                    row, column = np.nonzero(score >= least)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), keys.take(pa.array(column)), pa.array(score[row, column])], names=["a", "b", "similarity"])

        got = right.select(key, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).mapInArrow(scan, f"a {kind}, b {kind}, similarity double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    return found.where("a <> b")
