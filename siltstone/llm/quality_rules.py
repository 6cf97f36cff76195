"""Quality rules with a hashed n-gram log-likelihood ratio (operator 2), in DataFrame functions only.

Words are [^\\x20\\x09-\\x0D]+. A document's one- and two-word grams are hashed to
BUCKETS. Two multinomials over the buckets are counted: the raw corpus over all
documents, the trusted target over all those of a given list of ids. A document's score
is the mean over its grams of log p_target - log p_raw, with add-ALPHA smoothing, so its
length cancels out. It is kept if the score reaches the threshold and none of the base
rules failed: fewer than 50 words, or more than half of the words in three-word windows
that the text has twice or more.

The threshold follows from all documents of both lists that pass the base: it is halfway
between the two neighbouring scores that part trusted from rejected ones best, by the sum
of both lists' shares on the right side, the lowest of equally good ones. Without
rejected documents it is the least score of a trusted one.

How it runs: one pass counts the raw corpus, combined before the shuffle to a row
for each bucket and task; another counts the target's documents: a table of at most
2**SPOTS / 64 words of bits, broadcast, drops nearly all others, and only what is left
is shuffled to meet the list of ids, however long that is. The weights, always
BUCKETS rows of 12 bytes, are broadcast to the scoring pass, which explodes each
document's grams, looks up their weights and averages them; a document's grams
never leave its task before they are one row again. Scored rows, without texts, are
written once; the threshold and the result are both taken from them. Listed ids meet
them in a shuffle of ids and scores; the distinct scores are dealt out by ranges of about
RANGE, summed within each and over the ranges before it.

Cases: null, empty and blank texts have no words, fail the base and score 0; texts of any
length are counted and scored whole; an empty list of trusted ids gives every document
the score 0, so that the base alone decides; an id on both lists counts with both; repeated rows count
as often as they occur; scores equal to the threshold are kept; an empty table gives no
rows; extra columns, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import scratch

BUCKETS = 1 << 16
ALPHA = 0.5
#: Bits of the hash that tells documents that can't be trusted ones before the list of ids is met.
SPOTS = 24
#: Distinct scores, about, that one task sorts for the threshold, in MOST_RANGES ranges at most.
RANGE, MOST_RANGES = 1 << 13, 1 << 12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Repeated windows up to which membership is looked up one by one; beyond, windows are sorted.
FEW = 64
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK, -1), "")


def hashed(found: Column) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(found, lambda w: F.xxhash64(w))


def gram_buckets(h: Column) -> Column:
    """The buckets of the one- and two-word grams, from word hashes."""
    pairs = F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), F.slice(pairs, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))


def repeat_words(h: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more, from word hashes."""
    n = F.size(h)

    def covered(flags: Column) -> Column:
        inside = lambda j: F.get(flags, j)
        hit = lambda _, j: F.coalesce(inside(j), F.lit(False)) | F.coalesce(inside(j - 1), F.lit(False)) | F.coalesce(inside(j - 2), F.lit(False))
        return F.size(F.filter(h, hit))

    def by_lookup(windows: Column, again: Column) -> Column:
        return let(F.transform(windows, lambda x: F.array_contains(again, x)), covered)

    def by_sorting(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def spots(s: Column) -> Column:
            twin = lambda e, k: (F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"])
            return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(twin(e, k), F.lit(False))), lambda e: e["i"]))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return let(let(placed, spots), total)

    def counted(windows: Column) -> Column:
        again = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False)))))
        return let(again, lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= FEW, by_lookup(windows, d)).otherwise(by_sorting(windows)))

    windows = F.transform(F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(windows, counted))


def _counts(docs: DataFrame, name: str) -> DataFrame:
    buckets = docs.select(let(hashed(words(F.col("text"))), gram_buckets).alias("b"))
    return buckets.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) whose id is among the distinct ids (_listed)."""
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << SPOTS))
    words = ids.select(spot("_listed").alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("_bits"))
    near = docs.withColumn("_s", spot("doc_id")).join(F.broadcast(words), F.shiftright("_s", 6) == F.col("_word"))
    near = near.where(F.expr("getbit(_bits, CAST(_s & 63 AS INT))") == 1).select(*docs.columns)
    # a semi-join would be pushed below the one before, and every text shuffled
    return near.join(ids.hint("shuffle_merge"), F.col("doc_id") == F.col("_listed")).drop("_listed")


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, weight): the log-likelihood ratio of each of the BUCKETS buckets."""
    ids = trusted.select(F.col("doc_id").alias("_listed")).where("_listed IS NOT NULL").distinct()
    target = _counts(_of_ids(docs.select("doc_id", "text"), ids), "t")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = scratch(every.join(_counts(docs, "r"), "bucket", "left").join(target, "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r")))
    ts, rs = both.agg(F.sum("t")).scalar(), both.agg(F.sum("r")).scalar()
    smooth = lambda part, whole: F.log((part + ALPHA) / (whole + ALPHA * BUCKETS))
    ratio = smooth(F.col("t"), ts) - smooth(F.col("r"), rs)
    return both.select("bucket", F.when(ts > 0, ratio).otherwise(0.0).alias("weight"))


def threshold_of(scored: DataFrame, trusted: DataFrame, rejected: DataFrame | None) -> float:
    """The score that parts the two lists best, of all their documents in scored (doc_id, n_words, n_repeat_words, llr_score)."""
    lists = [(trusted, 1), (rejected, 0)] if rejected is not None else [(trusted, 1)]
    listed = [rows.select(F.col("doc_id").alias("_listed"), F.lit(y).alias("_good")).where("_listed IS NOT NULL").distinct() for rows, y in lists]
    ids = listed[0].unionByName(listed[1]) if len(listed) > 1 else listed[0]
    labelled = scored.where(~_failed()).select("doc_id", F.col("llr_score").alias("x")).join(ids, F.col("doc_id") == F.col("_listed"))
    counted = scratch(labelled.groupBy("x").agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")))
    sums = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.min(F.when(F.col("good") > 0, F.col("x"))).alias("least")).first()
    if not sums["good"] or not sums["bad"]:
        return sums["least"] if sums["good"] else 0.0
    # partitions of ranges are numbered in the order of their scores
    ranges = min(MOST_RANGES, 1 + sums["n"] // RANGE)
    dealt = scratch(counted.repartitionByRange(ranges, "x").withColumn("range", F.spark_partition_id()))
    # no more than MOST_RANGES rows, unless the session has more partitions
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = dealt.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("x").alias("m"))
    earlier = earlier.select("range", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(to) for c, to in (("g", "good_before"), ("b", "bad_before"))], F.max("m").over(up_to).alias("x_before"))
    order = Window.partitionBy("range").orderBy("x")
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.select("range", "x", F.lag("x").over(order).alias("last"), *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in ("good", "bad")])
    below = below.join(F.broadcast(earlier), "range").withColumn("before", F.coalesce("last", "x_before"))
    gain = (F.col("bad_before") + F.col("bad")) / sums["bad"] + (sums["good"] - F.col("good_before") - F.col("good")) / sums["good"]
    return below.select(F.coalesce((F.col("x") + F.col("before")) / 2, "x").alias("edge"), gain.alias("gain")).orderBy(F.desc("gain"), "edge").first()["edge"]


def judge(docs: DataFrame, trusted: DataFrame, rejected: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr_score) for each row of docs; trusted and rejected have doc_id."""
    scored = _scored(docs, scratch(weights(docs, trusted)))
    if threshold is None:
        scored = scratch(scored)
        threshold = threshold_of(scored, trusted, rejected)
    out = scored.withColumn("base_failed", _failed())
    return out.select(*KEYS, "base_failed", (~F.col("base_failed") & (F.col("llr_score") >= threshold)).alias("kept"), "llr_score")


KEYS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _scored(docs: DataFrame, table: DataFrame) -> DataFrame:
    """KEYS and llr_score for each row of docs."""

    def measured(found: Column) -> Column:
        size, chars = F.size(found).cast("long"), F.length(F.array_join(found, "")).cast("long")
        of = lambda h: F.struct(size.alias("n_words"), chars.alias("word_chars"), repeat_words(h).cast("long").alias("n_repeat_words"), gram_buckets(h).alias("buckets"))
        return let(hashed(found), of)

    text = F.coalesce("text", F.lit(""))
    filled = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    again = let(filled, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    rows = docs.select("doc_id", let(words(F.col("text")), measured).alias("m"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), again.cast("long").alias("n_dup_lines"))
    # a row's grams stay in its task, so they are one row again before the shuffle
    grams = rows.select(F.monotonically_increasing_id().alias("_row"), "m.*", "doc_id", "n_symbols", "n_dup_lines").select("_row", *KEYS, F.explode_outer("buckets").alias("bucket"))
    return grams.join(F.broadcast(table), "bucket", "left").groupBy("_row", *KEYS).agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("llr_score")).drop("_row")
