"""Near-duplicates among chunks, first one wins (character shingles, seeded MinHash, banded candidates).

A chunk is dropped if an earlier chunk that was itself kept has an estimated similarity
of at least the threshold. That is the first maximal independent set, in the order of
the chunks, of the graph of similar pairs. Banding misses no pair: an estimate of 0.8
leaves at most 25 of 128 places different, which touch at most 25 of 32 bands.

Bands put all texts of one language together, as they share the commonest shingles. So the decision
goes by single places instead, which misses no pair either: two signatures that agree
in m places or more share one of the 128 - m + 1 rarest (place, value) of each, in an order
of rarity that is the same for all. Only those make buckets.

A signature's lowest bits are a sketch of it: where two agree, the bits do, so a pair whose
sketches differ in more bits than places may differ is left out where it is met, before
any signature is read.

Chunks of equal signatures are one class from the start, its earliest chunk standing
for it, so copies cost nothing.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.vectorised import vectorised
from siltstone.session import cut

PERMUTATIONS, BANDS, SHINGLE = 128, 32, 4
ROWS = PERMUTATIONS // BANDS
THRESHOLD = 0.8
#: Undecided members of a bucket up to which its pairs are listed, and the first ones of a larger one that the first turn compares all with.
BUCKET, HEADS = 64, 32
CELLS = 1 << 20


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _words_of(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys as rows of little-endian 32-bit words, their lengths, and the words' and tails' masks."""
    size = np.array([len(k) for k in keys], np.int64)
    width = max(4, int(-(-size.max() // 4) * 4)) if len(size) else 4
    table = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), "<u4").reshape(len(keys), -1)
    spots = np.arange(table.shape[1])
    whole = size[:, None] // 4
    return table, size.astype(np.uint32), spots < whole, (spots == whole) & (size[:, None] % 4 > 0)


def murmur3(keys: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """(keys, seeds): the 32-bit x86 murmur3 of each key for each seed, signed; all keys are hashed at once."""
    table, size, whole, tail = _words_of(keys)
    with np.errstate(over="ignore"):
        mixed = _rotate(table * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = np.repeat(seeds.astype(np.uint32)[None], len(keys), axis=0)
        for k in range(table.shape[1]):
            met = h ^ mixed[:, k, None]
            h = np.where(whole[:, k, None], _rotate(met, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(tail[:, k, None], met, h))
        h ^= size[:, None]
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32)


def shingles(text: str, n: int = SHINGLE) -> set[str]:
    """Lower-cased character n-grams; a shorter text is its one shingle."""
    low = text.lower()
    return {low[k : k + n] for k in range(len(low) - n + 1)} if len(low) >= n else {low}


@vectorised("array<string>")
def shingle_sets(text: pd.Series) -> pd.Series:
    return text.map(lambda t: sorted(shingles(t or "")))


#: Shingles hashed at once, and characters of texts whose shingles are told apart together.
AT_ONCE, TOGETHER = 4096, 1 << 18
_SEEDS = np.arange(PERMUTATIONS, dtype=np.uint32)


def _single(words: np.ndarray) -> np.ndarray:
    """murmur3() of keys of four bytes, given as little-endian words."""
    with np.errstate(over="ignore"):
        mixed = _rotate(words * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        out = np.empty((len(words), PERMUTATIONS), np.uint32)
        for lo in range(0, len(words), AT_ONCE // 8):
            h = _rotate(_SEEDS ^ mixed[lo : lo + AT_ONCE // 8, None], 13)
            h *= np.uint32(5)
            h += np.uint32(0xE6546B64)
            h ^= np.uint32(4)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                h ^= h >> np.uint32(shift)
                h *= np.uint32(factor)
            h ^= h >> np.uint32(16)
            out[lo : lo + AT_ONCE // 8] = h
    return out.view(np.int32)


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The least hash of each text's shingles for each seed.

    Shingles of four ASCII characters are single words, found without strings; those of
    all texts are told apart and hashed at once, as are the others.
    """
    words, rest = [], []
    for t in texts:
        low = t.lower()
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
        if len(points) < SHINGLE:
            words.append(np.zeros(0, np.uint32))
            rest.append({low})
            continue
        plain = points < 128
        whole = plain[:-3] & plain[1:-2] & plain[2:-1] & plain[3:]
        four = points[:-3] | points[1:-2] << np.uint32(8) | points[2:-1] << np.uint32(16) | points[3:] << np.uint32(24)
        words.append(np.unique(four[whole]))
        rest.append({low[k : k + SHINGLE] for k in np.flatnonzero(~whole)})
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    hashed = _single(distinct)
    others = sorted(set().union(*rest))
    number = {s: k for k, s in enumerate(others)}
    more = np.concatenate([np.empty((0, PERMUTATIONS), np.int32), *(murmur3([s.encode("utf-8") for s in others[lo : lo + AT_ONCE]], _SEEDS) for lo in range(0, len(others), AT_ONCE))])
    out, at = [], 0
    for w, r in zip(words, rest, strict=True):
        found = [hashed[place[at : at + len(w)]]] if len(w) else []
        found += [more[[number[s] for s in r]]] if r else []
        out.append(np.minimum.reduce([f.min(axis=0) for f in found]))
        at += len(w)
    return out


@vectorised("array<int>")
def signature(text: pd.Series) -> pd.Series:
    """The least hash of a text's shingles for each of PERMUTATIONS seeds."""
    out: list[np.ndarray] = []
    held: list[str] = []
    size = 0
    for t in text:
        held.append(t or "")
        size += len(held[-1])
        if size > TOGETHER:
            out += signatures(held)
            held, size = [], 0
    out += signatures(held) if held else []
    return pd.Series(out)


def band_keys(signed: DataFrame, key: str) -> DataFrame:
    """(key, band, band_key) of every band."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("signature", b * ROWS + 1, ROWS)).alias("band_key")))
    return signed.select(key, F.explode(bands).alias("_b")).select(key, "_b.band", "_b.band_key")


def _agreeing(pairs: DataFrame, signed: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, agreement) of the pairs whose estimate reaches the threshold."""
    left, right = signed.select(F.col(key).alias("a"), F.col("signature").alias("sa")), signed.select(F.col(key).alias("b"), F.col("signature").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (same / PERMUTATIONS).alias("agreement")).where(F.col("agreement") >= threshold)


def _cell(token):
    """A token's cell in the table of levels, for columns and for arrays alike."""
    return token * 40503 >> 8 if isinstance(token, np.ndarray) else F.shiftright(token * F.lit(40503).cast("long"), 8)


def _levels(firsts: DataFrame) -> np.ndarray:
    """How often the tokens of a cell occur, in quarters of powers of two: CELLS bytes, whatever the number of chunks."""
    token = F.explode(F.transform("signature", lambda v, k: v.cast("long") * PERMUTATIONS + k))
    counts = firsts.select(token.alias("t")).groupBy(F.pmod(_cell(F.col("t")), F.lit(CELLS)).cast("int").alias("cell")).agg(F.floor(4 * F.log2(F.count("*"))).cast("byte").alias("level")).toArrow()
    table = np.zeros(CELLS, np.uint8)
    table[counts["cell"].to_numpy()] = counts["level"].to_numpy()
    return table


def rare_tokens(firsts: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, s, bucket): each chunk's rarest tokens, as many as a similar one must share one of, with its sketch."""
    most = PERMUTATIONS - math.ceil(threshold * PERMUTATIONS - 1e-9) + 1
    levels = firsts.sparkSession.sparkContext.broadcast(_levels(firsts))

    def rare(signature: pd.Series) -> pd.Series:
        table = np.stack(signature.to_list()).astype(np.int64) * PERMUTATIONS + np.arange(PERMUTATIONS)
        order = np.lexsort((table, levels.value[_cell(table) % CELLS]))[:, :most]
        return pd.Series(list(np.take_along_axis(table, order, axis=1)))

    return firsts.select(key, sketch("signature").alias("s"), F.pandas_udf(rare, "array<long>")("signature").alias("_b")).select(key, "s", F.explode("_b").alias("bucket"))


@vectorised("array<long>")
def sketch(signature: pd.Series) -> pd.Series:
    """The lowest bit of each place, in two numbers."""
    bits = np.stack(signature.to_list()).astype(np.int64) & 1
    return pd.Series(list(np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)))


def _may_agree(threshold: float) -> str:
    """Whether a and b, with the sketches s and t, may reach the threshold."""
    return f"a < b AND bit_count(s[0] ^ t[0]) + bit_count(s[1] ^ t[1]) <= {PERMUTATIONS - math.ceil(threshold * PERMUTATIONS - 1e-9)}"


def _shared(keys: DataFrame) -> DataFrame:
    """Buckets that at least two chunks are in."""
    held = keys.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return keys.join(held, "bucket")


def similar_pairs(keys: DataFrame, signed: DataFrame, key: str, threshold: float = THRESHOLD, bucket: tuple[str, ...] = ("band", "band_key")) -> DataFrame:
    """(a, b, agreement) with a < b of all pairs that share a bucket; for buckets of bounded size."""
    named = keys.join(signed.select(key, sketch("signature").alias("s")), key) if "s" not in keys.columns else keys
    other = named.select(F.col(key).alias("b"), F.col("s").alias("t"), *bucket)
    pairs = named.withColumnRenamed(key, "a").join(other, list(bucket)).where(_may_agree(threshold)).select("a", "b").distinct()
    return _agreeing(pairs, signed, key, threshold)


def keep_first(signed: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, kept, duplicate_of) for every row of signed (key, signature), keys in order of arrival.

    While a bucket has more than BUCKET undecided members, a turn compares each large
    bucket's members with its first HEADS, twice as many in each further turn, keeps what has no undecided earlier similar
    one, as far as that is known, and drops what is similar to the kept. Then the remaining pairs are
    listed, and each turn keeps the chunks without an undecided earlier neighbour and
    drops their neighbours. State is written out between turns.
    """
    signed = cut(signed)
    classes = signed.groupBy("signature").agg(F.min(key).alias("_first"))
    firsts = cut(classes.select(F.col("_first").alias(key), "signature"))
    keys = cut(_shared(rare_tokens(firsts, key, threshold)))
    gone: list[DataFrame] = []
    first = HEADS
    while (keys.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0) > BUCKET:
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(key))
        heads = keys.withColumn("_place", place).where(F.col("_place") <= first).select("bucket", F.col(key).alias("a"), "s")
        heads = cut(heads)
        met = keys.withColumnsRenamed({key: "b", "s": "t"}).join(heads, "bucket").where(_may_agree(threshold)).select("a", "b").distinct()
        edges = cut(_agreeing(met, firsts, key, threshold).select("a", "b"))
        # of a chunk that is a head of all its buckets, every earlier neighbour is known
        own = keys.groupBy(F.col(key).alias("a")).agg(F.count("*").alias("_n"))
        known = cut(heads.groupBy("a").agg(F.count("*").alias("_m")).join(own, "a").where("_n = _m").select("a"))
        kept, lost = _decided(edges, known)
        gone.append(lost)
        out = kept.select(F.col("a").alias("_out")).unionByName(lost.select(F.col("b").alias("_out"))).distinct()
        keys = cut(_shared(keys.join(out, F.col(key) == F.col("_out"), "left_anti")))
        first *= 2
    edges = cut(similar_pairs(keys, firsts, key, threshold, ("bucket",)).select("a", "b"))
    every = keys.select(F.col(key).alias("a")).distinct()
    gone.append(_decided(edges, every)[1])
    rows = signed.join(classes, "signature").select(key, "_first")
    least = reduce(DataFrame.unionByName, gone).groupBy("b").agg(F.min("by").alias("by")).withColumnRenamed("b", "_first")
    copy = F.when(F.col(key) != F.col("_first"), F.col("_first"))
    return rows.join(least, "_first", "left").select(key, (F.col("by").isNull() & copy.isNull()).alias("kept"), F.coalesce("by", copy).alias("duplicate_of"))


def _decided(edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a) of the chunks kept and (b, by) of those dropped, by edges (a, b) with a first, where all edges towards the known are there."""
    left, open_ = edges, known
    kept, lost = None, None
    while True:
        # a known one without an undecided earlier neighbour is kept; what it touches goes
        free = cut(open_.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))
        if free.isEmpty():
            break
        hit = cut(left.join(free, "a").groupBy("b").agg(F.min("a").alias("by")))
        kept = free if kept is None else kept.unionByName(free)
        lost = hit if lost is None else lost.unionByName(hit)
        out = free.unionByName(hit.select(F.col("b").alias("a"))).distinct()
        open_ = cut(open_.join(out, "a", "left_anti"))
        gone = hit.select(F.col("b").alias("x"))
        left = left.join(free, "a", "left_anti").join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti")
        left = cut(left)
    if kept is None:
        kind = dict(known.dtypes)["a"]
        empty = known.sparkSession.createDataFrame([], f"a {kind}, b {kind}, by {kind}")
        return empty.select("a"), empty.select("b", "by")
    return kept, lost


def questions_by_hash(rows: DataFrame, question: str, order: str) -> DataFrame:
    """rows with duplicate: whether an earlier question has the same letters and digits."""
    first = rows.groupBy(T.question_hash(F.col(question)).alias("_h")).agg(F.min(order).alias("_first"))
    return rows.withColumn("_h", T.question_hash(F.col(question))).join(first, "_h").withColumn("duplicate", F.col(order) != F.col("_first")).drop("_h", "_first")
