"""Approximate nearest neighbours by largest inner product (operator 5).

Vectors are product-quantised with a score-aware loss: of a vector's residual, the
part parallel to the vector changes its inner products with the queries that matter
and is penalised ETA times as much as the rest. Subspaces of WIDTH components have
16 codewords each, so a code takes four bits and two codes a byte. Codebooks and the
centres of a coarse partition are fitted on at most SAMPLE vectors (those of the smallest
hashes of their ids); every vector is encoded and belongs to its nearest centre. A query
first scans the parts of the centres with which it has the largest products, as many as
TARGET of the true neighbours of PROBES sampled queries need; where that is most of them, all.
Its table of inner products with all codewords is scanned over the codes of a block;
the RERANK best of each block are ranked exactly, in double precision on the original
vectors, and the best of all blocks are returned.

What codes and parts leave out cannot be among the k nearest, whatever the vectors: a
vector's product differs from that of its codes by at most the query's length times the
length of the vector's residual, so all whose bound reaches the k-th best score so far
are ranked exactly, too; and a part that was not scanned is, unless the product with its
centre and the query's length times the largest distance from that centre stay below it.

How it runs: vectors are dealt by part and a hash of their ids over blocks of about
BLOCK, a row each, once; a part may hold any number of blocks. The query set comes in
turns of at most about ASK bytes; each turn is broadcast,
scans the blocks where they lie, and a task keeps the k best of each query over all its
blocks. So vectors are shuffled once, and what a turn shuffles is at most k rows for each query and task.

Cases: vectors that are null, zero or hold a null or non-finite component, and rows
with a null vec_id, take no part, neither do vectors of another length than that of
the smallest valid vec_id; rows that repeat a vec_id count once (the smallest
vector); equal scores go to the smaller vec_id; fewer candidates than k are all
returned; very long vectors are cut into as many subspaces as they need; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import scratch, small_batches, tidy

WIDTH = 2
CODES = 16
SAMPLE = 16_384
BLOCK = 8192
#: Bytes of queries, in double precision, that a turn takes.
ASK = 32 << 20
RERANK = 160
#: Rows for each centre, the most centres, and how the number of parts to scan is measured.
PART, CENTRES = 4096, 1024
TARGET, PROBES = 0.99, 128
#: Cosine from which on inner products matter; with the dimension it gives the parallel weight.
MATTERS = 0.2


class Codebook:
    """Codewords of every subspace, fitted and assigned with the anisotropic loss."""

    def __init__(self, words: np.ndarray, dim: int):
        self.words, self.dim = words.astype(np.float64), dim
        self.eta = max(1.0, (dim - 1) * MATTERS**2 / (1 - MATTERS**2))

    @staticmethod
    def split(x: np.ndarray) -> np.ndarray:
        """(vectors, subspaces, WIDTH), padded by zeros to an even number of subspaces."""
        pad = -x.shape[1] % (2 * WIDTH)
        x = np.pad(x, ((0, 0), (0, pad))) if pad else x
        return x.reshape(len(x), -1, WIDTH)

    def assign(self, x: np.ndarray, turns: int = 2) -> np.ndarray:
        """Codes by coordinate descent: each subspace in turn takes the codeword of the least loss, given the others."""
        parts = self.split(x.astype(np.float64))
        extra = (self.eta - 1) / np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
        codes = np.zeros(parts.shape[:2], np.uint8)
        along = np.zeros(parts.shape[:2])  # each subspace's part of the residual's product with the vector
        for turn in range(turns + 1):
            for j in range(parts.shape[1]):
                rest = parts[:, j, None, :] - self.words[j][None]
                square, product = (rest**2).sum(axis=2), (rest * parts[:, j, None, :]).sum(axis=2)
                loss = square
                if turn:
                    others = along.sum(axis=1) - along[:, j]
                    loss = square + extra[:, None] * (others[:, None] + product) ** 2
                best = loss.argmin(axis=1)
                codes[:, j], along[:, j] = best, product[np.arange(len(best)), best]
        return codes

    def residual(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The lengths of what codes leave of vectors."""
        parts = self.split(x)
        return np.sqrt(sum(((parts[:, j] - self.words[j][codes[:, j]]) ** 2).sum(axis=1) for j in range(parts.shape[1]))) * (1 + 1e-9)

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 6) -> Codebook:
        parts = cls.split(x.astype(np.float64))
        n, subspaces, _ = parts.shape
        pick = np.random.default_rng(5).integers(0, n, (subspaces, CODES))
        book = cls(np.stack([parts[pick[j], j] for j in range(subspaces)]), x.shape[1])
        extra = (book.eta - 1) / np.maximum((parts**2).sum(axis=(1, 2)), 1e-30)
        for turn in range(rounds):
            codes = book.assign(x, turns=0 if turn < 2 else 1)
            chosen = np.stack([book.words[j][codes[:, j]] for j in range(subspaces)], axis=1)
            along = ((parts - chosen) * parts).sum(axis=2)
            for j in range(subspaces):
                others, p = along.sum(axis=1) - along[:, j], parts[:, j]
                for c in range(CODES):
                    mine = codes[:, j] == c
                    if mine.any():
                        q, w = p[mine], extra[mine]
                        left = np.eye(WIDTH) * len(q) + (q * w[:, None]).T @ q
                        right = q.sum(axis=0) + ((w * (others[mine] + (q**2).sum(axis=1)))[:, None] * q).sum(axis=0)
                        book.words[j, c] = np.linalg.solve(left, right)
                along[:, j] = ((p - book.words[j][codes[:, j]]) * p).sum(axis=1)
        return book

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): inner products with the two codewords that a byte names."""
        parts = self.split(queries.astype(np.float64))
        single = np.einsum("qjw,jcw->qjc", parts, self.words).astype(np.float32)
        return (single[:, 1::2, :, None] + single[:, ::2, None, :]).reshape(len(queries), -1, CODES * CODES)


def nearest(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray, qid: np.ndarray, q: np.ndarray, least: np.ndarray, book: Codebook, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score) of the k best of one block for each query, places and ids ascending; those below the query's least may be left out. left: the lengths of residuals."""
    columns = np.ascontiguousarray(codes.T)
    whole, exact = x.astype(np.float64), q.astype(np.float64)
    size = np.linalg.norm(exact, axis=1)
    # what rounding may change in a product of x.shape[1] terms, for a query of length 1
    fuzz = 4e-16 * (x.shape[1] + 2) * np.linalg.norm(whole, axis=1).max(initial=0)
    out: list[tuple] = []
    keep = min(len(ids), max(RERANK, 8 * k))
    for lo in range(0, len(qid), 64):
        tables = book.tables(q[lo : lo + 64])
        # the same for the sums of single precision
        margins = 2e-7 * (len(columns) + 2) * np.abs(tables).max(axis=2).sum(axis=1)
        for n, table in enumerate(tables, lo):
            found = np.zeros(len(ids), np.float32)
            for t, c in zip(table, columns, strict=True):
                found += t[c]
            if keep < len(ids):
                edge = -np.partition(-found, keep - 1)[keep - 1]
                above, level = np.flatnonzero(found > edge), np.flatnonzero(found == edge)
                rows = np.sort(np.concatenate((above, level[: keep - len(above)])))
            else:
                rows = np.arange(len(ids))
            rows = rows[ids[rows] != qid[n]]
            score = np.einsum("ij,j->i", whole[rows], exact[n])
            if keep < len(ids):
                edge = max(least[n], -np.partition(-score, k - 1)[k - 1] if len(score) >= k else -np.inf)
                more = ~(found + size[n] * left < edge - margins[n - lo])
                more[rows] = False
                more = np.flatnonzero(more & (ids != qid[n]))
                if len(more):
                    near = (whole @ exact[n])[more] if 4 * len(more) > len(ids) else whole[more] @ exact[n]
                    more = more[~(near < edge - size[n] * fuzz)]
                    rows, score = np.concatenate((rows, more)), np.concatenate((score, np.einsum("ij,j->i", whole[more], exact[n])))
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), n), ids[rows[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def valid(vectors: DataFrame, queries: Column) -> DataFrame:
    """(vec_id, v, asked) of the vectors that take part, whatever their length; components of float stay so, others are double."""
    kind = "float" if "float" in vectors.schema["embedding"].dataType.simpleString() else "double"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of the vectors by Lloyd's rounds, drawn and moved alike in every run."""
    at = x[np.random.default_rng(11).choice(len(x), n, replace=False)].astype(np.float64)
    for _ in range(rounds if n > 1 else 1):
        own = closest(x, at)
        count = np.bincount(own, minlength=n)
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=n) for j in range(x.shape[1])], axis=1)
        at = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], at)
    return at


def closest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, the first of equal ones."""
    half = (at**2).sum(axis=1) / 2
    return np.concatenate([(x[lo : lo + 4096] @ at.T - half).argmax(axis=1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then by the smaller id; places without one have id -1 and score -inf at the end."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def probes(good: DataFrame, sample: np.ndarray, sample_ids: np.ndarray, at: np.ndarray, dim: int, k: int) -> int:
    """How many parts a query scans first: as many as hold TARGET of the true neighbours of PROBES sampled queries."""
    if len(at) == 1:
        return 1
    shared = good.sparkSession.sparkContext.broadcast((sample_ids[:PROBES], sample[:PROBES].astype(np.float64), at))

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, centre = shared.value
        held_i, held_s, held_p = (np.full((len(qid), 0), v) for v in (0, 0.0, 0))
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim).astype(np.float64)
            scores = np.where(qid[:, None] == ids[None], -np.inf, q @ x.T)
            both = np.concatenate([held_s, scores], axis=1)
            spots = np.argsort(-both, axis=1, kind="stable")[:, :k]
            held_i = np.take_along_axis(np.concatenate([held_i, np.broadcast_to(ids, scores.shape)], axis=1), spots, axis=1)
            held_p = np.take_along_axis(np.concatenate([held_p, np.broadcast_to(closest(x, centre), scores.shape)], axis=1), spots, axis=1)
            held_s = np.take_along_axis(both, spots, axis=1)
        ok = np.isfinite(held_s)
        rows = np.nonzero(ok)[0]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(held_i[ok].astype(np.int64)), pa.array(held_s[ok].astype(np.float64)), pa.array(held_p[ok].astype(np.int64))], names=["q", "vec_id", "score", "part"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = good.select("vec_id", "v").mapInArrow(true, "q long, vec_id long, score double, part long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "part").toArrow()
    place = (-(sample[:PROBES].astype(np.float64) @ at.T)).argsort(axis=1, kind="stable").argsort(axis=1)
    need = np.sort(place[near["q"].to_numpy(), near["part"].to_numpy()])
    enough = int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))) - 1)]) + 1 if len(need) else 1
    return enough if 2 * enough <= len(at) else len(at)


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that queries holds for."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    with tidy() as keep:
        found = _found(vectors, queries, k)
        if found is None:
            return spark.createDataFrame([], shape)
        best = keep(scratch(found))
    return best.select("query_id", "rank", "vec_id", "score")


def _found(vectors: DataFrame, queries: Column, k: int) -> DataFrame | None:
    spark = vectors.sparkSession
    small_batches(spark)
    good = scratch(valid(vectors, queries))
    size = good.agg(F.min_by(F.size("v"), "vec_id").alias("dim")).first()
    if size["dim"] is None:
        return None
    dim = size["dim"]
    good = good.where(F.size("v") == dim)
    if not good.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        good = scratch(good.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")))
    n = good.count()
    sample = good.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample_ids, drawn = sample["vec_id"].to_numpy(), _matrix(sample["v"].combine_chunks(), dim)
    at = centres(drawn, max(1, min(CENTRES, n // PART, len(drawn))))
    scanned = probes(good, drawn, sample_ids, at, dim, k)
    shared = spark.sparkContext.broadcast((Codebook.fit(drawn), at))
    kind = drawn.dtype.str

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = closest(_matrix(batch.column(1), dim).astype(np.float64), shared.value[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                flat = batch.column(1).slice(r, 1).flatten()
                ids, x = flat.field("vec_id").to_numpy(zero_copy_only=False), _matrix(flat.field("v"), dim)
                book, middle = shared.value
                codes = book.assign(x)
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                whole = x.astype(np.float64)
                left = book.residual(whole, codes)
                radius = np.linalg.norm(whole - middle[batch.column(0)[r].as_py()], axis=1).max()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([radius]), *(pa.array([c.tobytes()], pa.binary()) for c in (ids, x, packed, left))], names=["part", "radius", "ids", "x", "codes", "residual"])

    element = "float" if kind.endswith("f4") else "double"
    rows = scratch(good.select("vec_id", "v", "asked").mapInArrow(parted, f"vec_id long, v array<{element}>, asked boolean, part int"))
    # at most CENTRES rows
    blocks = F.broadcast(rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    dealt = rows.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    packed = dealt.groupBy("part", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows")).select("part", "rows")
    coded = scratch(packed.mapInArrow(index, "part int, radius double, ids binary, x binary, codes binary, residual binary"))
    asked = rows.where("asked").select("vec_id", "v")
    turns = max(1, -(-asked.count() * dim * 8 // ASK))
    found = None
    for turn in range(turns):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(turns)) == turn).toArrow()
        if not len(part):
            continue
        qid, q = part["vec_id"].to_numpy(), _matrix(part["v"].combine_chunks(), dim)
        met = scan(coded, qid, q, shared, scanned, kind, k)
        if scanned < len(at):
            # the other parts, as far as they may hold one nearer than the last of those found
            met = scratch(met)
            last = met.where(F.col("rank") == k).select("query_id", "score").toArrow()
            order = np.argsort(qid)
            floor = np.full(len(qid), -np.inf)
            floor[order[np.searchsorted(qid, last["query_id"].to_numpy(), sorter=order)]] = last["score"].to_numpy()
            met = ranked(met.drop("rank").unionByName(scan(coded, qid, q, shared, scanned, kind, k, floor).drop("rank")), k)
        met = met if turns == 1 else scratch(met)
        found = met if found is None else found.unionByName(met)
    return found


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan(coded: DataFrame, qid: np.ndarray, q: np.ndarray, shared: Broadcast, scanned: int, kind: str, k: int, floor: np.ndarray | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of one turn of queries over the blocks of the parts they scan first; with the scores of a floor, over those of the others that may reach it."""
    whole = q.astype(np.float64)
    at = shared.value[1]
    # a query scans the parts whose centre's product reaches its edge
    edge = np.full(len(q), -np.inf)
    if scanned < len(at):
        for lo in range(0, len(q), 4096):
            edge[lo : lo + 4096] = -np.partition(-(whole[lo : lo + 4096] @ at.T), scanned - 1, axis=1)[:, scanned - 1]
    turn = coded.sparkSession.sparkContext.broadcast((qid, q, edge, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, wanted, first, least), (book, middle) = turn.value, shared.value
        exact = wanted.astype(np.float64)
        size = np.linalg.norm(exact, axis=1)
        ids, scores = np.full((len(names), k), -1, np.int64), np.full((len(names), k), -np.inf)
        for batch in batches:
            for own, radius, raw_ids, raw_x, raw_codes, raw_left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = np.frombuffer(raw_ids, np.int64)
                if np.isfinite(first).any():
                    product = exact @ middle[own]
                    chosen = product >= first - 1e-9
                    if least is not None:
                        most = product + size * radius
                        chosen = ~chosen & ~(most + 1e-9 * (np.abs(product) + size * radius) < np.maximum(least, scores[:, -1]))
                    hit = np.flatnonzero(chosen)
                else:
                    hit = np.arange(len(names))
                x, codes, left = np.frombuffer(raw_x, kind).reshape(len(held), -1), np.frombuffer(raw_codes, np.uint8).reshape(len(held), -1), np.frombuffer(raw_left, np.float64)
                for lo in range(0, len(hit), 4096):
                    some = hit[lo : lo + 4096]
                    reached = scores[some, -1] if least is None else np.maximum(least[some], scores[some, -1])
                    place, near, score = nearest(held, x, codes, left, names[some], wanted[some], reached, book, k)
                    new_i, new_s = np.full((len(some), k), -1, np.int64), np.full((len(some), k), -np.inf)
                    spot = np.arange(len(place)) - np.searchsorted(place, place)
                    new_i[place, spot], new_s[place, spot] = near, score
                    ids[some], scores[some] = _best(np.concatenate([ids[some], new_i], axis=1), np.concatenate([scores[some], new_s], axis=1), k)
        row, column = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[row, column]), pa.array(scores[row, column])], names=["query_id", "vec_id", "score"])

    return ranked(coded.mapInArrow(run, "query_id long, vec_id long, score double"), k)
