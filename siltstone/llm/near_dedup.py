"""Near-duplicate documents by bottom-k sketches (operator 1).

A document's set holds its distinct five-word shingles, A-Z lower-cased; with fewer
words, the whole sequence is its one shingle; a null, empty or blank text has the
empty set and is linked with nothing. Two documents are linked if their sets'
Jaccard similarity is at least 0.75.

How it runs:

1. One hash function maps every shingle to 64 bits; a document retains its K
   smallest hashes. Documents with equal sets are one class from here on, so a
   group of copies costs one row however large it is.
2. Inverted lists of the retained values hold the classes. Lists of up to LIGHT
   members generate overlapping pairs, at most LIGHT for each entry.
3. The sketch of a pair's union estimates its similarity; pairs far below the
   threshold go (a linked pair stays but for odds of about 1e-8).
4. Exact similarity on whole texts verifies the rest. Links are verified in two
   turns, first each class with its smallest partner, then the pairs that still
   cross two components, since links within a component change nothing.
5. A linked pair whose shared retained values all lie in longer lists has many such
   values on both sides. Those classes (few) are first verified against LEADERS
   members of some long lists, which merges groups of near copies. The other links
   among them, if any, are found on whole sets, not on sketches: a value within one
   component can't link two, so a class needs three quarters of its set in values that
   several components hold; others drop out. What is left meets by prefix filtering, the
   rarest values first: at the first value that two linked sets share, both still hold
   all they share, 3/7 of their sizes' sum. Members are matched by value and size class,
   only where that can hold, and only across components, so that neither a group of near
   copies nor a template with many different fillings is expanded to all pairs.

Verification is exact on whole texts. The sketch's estimate is the one filter that may lose a
link; find(estimate=0) does without it.

Cases: rows with a null doc_id get component null and kept true; rows that repeat a
doc_id share one component, under several texts that of the text with the smallest
hash; texts of any length are hashed whole, one at a time if long; equal similarity
has no ties to settle, as components do not depend on the order of pairs; an empty table gives no
rows; extra columns, whatever their names, are ignored by find() and kept by keep_one().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import Bloom, Levels, components, scratch, small_batches, tidy
from siltstone.llm.texts import grams, steps, word_hashes, words

WORDS = 5
K = 32
LIGHT = 48
#: A pair goes if the union's sketch shares less than this part; 0.75 is expected of a linked one.
ESTIMATE = 0.31
LEADERS = 4
#: Values of its own whose leaders a class meets in a turn.
FEW = 3
PRUNINGS = 2
#: Crossing pairs for each listed value up to which all are verified at once.
CROSSING = 1
#: Values of a bucket, about, in which they are counted.
BUCKET = 1 << 18
#: Size classes for each doubling of a set's size.
STEPS = 16
SALTS = 16


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes (int64) of every text, in order."""
    for lo, hi, data, offsets in steps(column):
        start, end, first = words(data, offsets)
        hashed = word_hashes(data, start, end, lower=True)
        all5 = grams(hashed, WORDS).view(np.int64)
        for k in range(hi - lo):
            a, b = first[k], first[k + 1]
            if b - a >= WORDS:
                yield np.unique(all5[a : b - WORDS + 1])
            elif b > a:
                yield grams(hashed[a:b], int(b - a)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _sketch(batches):
    for batch in batches:
        ids, mark, size, key1, key2, flat, ends = batch.column(0), batch.column(1), [], [], [], [], [0]
        for s in shingle_sets(batch.column(2)):
            size.append(len(s))
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            key1.append(int.from_bytes(digest[:8], "little", signed=True))
            key2.append(int.from_bytes(digest[8:], "little", signed=True))
            flat.append(s[:K])
            ends.append(ends[-1] + len(flat[-1]))
        sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
        columns = [ids, mark, pa.array(size, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), sketch]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "key1", "key2", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, key1, key2, sketch): equal keys are equal sets; mark is the text's hash; the sketch is sorted."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(_sketch, "doc_id long, mark long, n_shingles long, key1 long, key2 long, sketch array<long>")


def _verify(batches):
    """Keeps the pairs whose whole sets have the similarity; texts are hashed once for each run of equal ones."""
    for batch in batches:
        keep, names = [], batch.schema.names
        left, right = batch.column(names.index("text_a")), batch.column(names.index("text_b"))
        for k, (x, y) in enumerate(zip(_each(left), _each(right), strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def _each(column: pa.Array):
    coded = column.dictionary_encode()
    known = list(shingle_sets(coded.dictionary))
    for k in coded.indices.to_pylist():
        yield known[k]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by exact similarity of their whole texts (node, text)."""
    # whole texts are never broadcast
    half = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    full = half.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    # written here, so that no task holds a second Python worker for what is done with the links
    return scratch(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))


def _alike_in_size(a: str, b: str) -> Column:
    return F.expr(f"4 * {a} >= 3 * {b} AND 4 * {b} >= 3 * {a}")


def estimated(pairs: DataFrame, reps: DataFrame, estimate: float) -> DataFrame:
    """The pairs (a, b) whose union's bottom-k sketch shares at least this part."""
    half = pairs.join(reps.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
    full = half.join(reps.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return full.where(shared >= F.size(union) * estimate).select("a", "b")


def _current(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """rows with comp_<column>, the component of each of the columns so far."""
    for c in columns:
        rows = rows.join(labels.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(c) == F.col("_node"), "left")
        rows = rows.withColumn(f"comp_{c}", F.coalesce("_root", c)).drop("_node", "_root")
    return rows


def _least(n: int) -> int:
    """How many values a set of n shares at least with a linked one."""
    return -(-3 * n // 4)


def _packed_into(buckets: int):
    """(b, packed): the values of each batch of classes (node, text, comp) in buckets, each distinct one once with its least and largest component and its count."""

    def packed(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            rows = np.zeros((4, sum(map(len, sets))), np.int64)
            if sets:
                rows[0] = np.concatenate(sets)
                rows[1] = rows[2] = np.repeat(np.asarray(batch.column(2)), [len(s) for s in sets])
                rows[3] = 1
            rows = _summed(rows)
            bucket = (rows[0].view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            parts = np.split(rows[:, order], first[1:], axis=1) if len(names) else []
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["b", "packed"])

    return packed


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (value, least component, largest component, count) with each value once."""
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    if not rows.shape[1]:
        return rows
    first = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
    return np.stack([rows[0, first], np.minimum.reduceat(rows[1], first), np.maximum.reduceat(rows[2], first), np.add.reduceat(rows[3], first)])


def _several(table: pa.Table) -> pa.Table:
    """(key, m) of a bucket's values that several components hold."""
    parts = [np.frombuffer(x, np.int64).reshape(4, -1) for x in table["packed"].to_pylist()]
    rows = _summed(np.concatenate(parts, axis=1))
    rows = rows[:, rows[1] != rows[2]]
    return pa.table({"key": pa.array(rows[0]), "m": pa.array(rows[3])})


def held_by_several(classes: DataFrame, total: int) -> DataFrame:
    """(key, m): the values that several components of classes (node, text, comp) hold, and how many classes do.

    Values travel packed and combined in each batch; with some BUCKET of them in a
    bucket, what one task merges is bounded by that and the number of batches.
    """
    buckets = max(16, -(-total // BUCKET))
    return classes.mapInArrow(_packed_into(buckets), "b long, packed binary").groupBy("b").applyInArrow(_several, "key long, m long")


def _alive_through(several: Bloom):
    """Keeps the classes with enough values that may link them to another component."""

    def alive(batches):
        for batch in batches:
            keep = [int(several.has(s).sum()) >= _least(len(s)) for s in shingle_sets(batch.column(1))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return alive


def _listed_through(several: Bloom, rarity: Levels):
    """(v, rest, node, n, comp, live): each class with the rarest of its live values, as many as a linked one must meet.

    Rest counts the live values from v on, v itself included: all that two sets still
    share at the first listed value in which they meet. The order of values is the same
    for all classes, so that first value exists and comes early in both.
    """

    def listed(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for node, s, comp in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                live = s[several.has(s)]
                live = live[np.lexsort((live, rarity.of(live)))]
                first = live[: max(0, len(live) - _least(len(s)) + 1)]
                rest = len(live) - np.arange(len(first))
                for column, x in zip(out, (first, rest, *(np.full(len(first), y) for y in (node, len(s), comp, len(live)))), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in out], names=["v", "rest", "node", "n", "comp", "live"])

    return listed


def pruned(classes: DataFrame, total: int) -> tuple[DataFrame, Bloom, Levels]:
    """The classes (node, text, comp), of about total values, that may still be linked to another component, the values that may link them, and how many hold these.

    A value that one component alone holds can't; classes with too few others go, and
    with them what only they held, for PRUNINGS turns. The Bloom filter lets some values
    pass wrongly, which keeps classes in but never leaves a link out.
    """
    for _ in range(PRUNINGS):
        shared = scratch(held_by_several(classes, total))
        several = Bloom(shared.select("key"))
        classes = scratch(classes.mapInArrow(_alive_through(several), "node long, text string, comp long"))
    return classes, several, Levels(shared, "m")


def picked(lists: DataFrame, turn: int) -> DataFrame:
    """The rows of lists (v, node, n, comp, live) for FEW values of each class, the first in an order of values drawn for the turn.

    The order is the same for all, so classes that share most of their values pick the same.
    """
    few = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("v", F.lit(turn)).alias("lot"), "v"))), 1, FEW)
    # a class has at most K listed values or the places of its set's first quarter
    return lists.groupBy("node", "n", "comp", "live").agg(few.alias("e")).select("node", "n", "comp", "live", F.explode("e.v").alias("v"))


def led(picks: DataFrame, turn: int) -> DataFrame:
    """(a, b): the members of picks (v, node, n, comp, live) with the leaders of their values, unless in one component or too unlike in size.

    A value has LEADERS leaders, each the most central member, the one with the largest
    live part of its set, of a random half of those who picked it: a class that is linked
    to any member of a group of near copies is as a rule linked to such a one.
    """
    half = lambda k: F.pmod(F.xxhash64("node", F.lit(turn * LEADERS + k)), F.lit(2))
    lots = [F.min(F.struct((half(k) - F.col("live") / F.col("n")).alias("lot"), "node", "n", "comp")) for k in range(LEADERS)]
    leaders = picks.groupBy("v").agg(F.array_distinct(F.array(*lots)).alias("l")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    member = picks.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(leaders, ["v", "salt"])
    met = member.select(F.col("node").alias("x"), F.col("n").alias("na"), F.col("comp").alias("c"), F.explode("l").alias("l")).where("x <> l.node AND c <> l.comp")
    met = met.select(F.least("x", "l.node").alias("a"), F.greatest("x", "l.node").alias("b"), "na", F.col("l.n").alias("nb"))
    return met.where(_alike_in_size("na", "nb")).select("a", "b").distinct()


def _one_text(drawn: DataFrame) -> DataFrame:
    """drawn with the set of each doc_id's text of the smallest mark, should a doc_id have several texts."""
    several = drawn.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("mark").alias("m0"), F.max("mark").alias("m1")).where("m0 <> m1")
    if several.isEmpty():
        return drawn
    own = drawn.join(several.select("doc_id", F.col("m0").alias("mark")), ["doc_id", "mark"]).groupBy("doc_id").agg(F.first(F.struct("key1", "key2", F.col("n_shingles").alias("n"), "sketch", "mark")).alias("one"))
    every = drawn.join(own, "doc_id", "left")
    of = lambda to, c: F.when(F.col("one").isNotNull(), F.col(f"one.{to}")).otherwise(F.col(c)).alias(c)
    return scratch(every.select("doc_id", "n_shingles", of("n", "n"), of("key1", "key1"), of("key2", "key2"), of("sketch", "sketch"), of("mark", "mark")))


def find(docs: DataFrame, estimate: float = ESTIMATE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of docs."""
    with tidy() as keep:
        drawn = scratch(sketches(docs))
        drawn = keep(_one_text(drawn.withColumn("n", F.col("n_shingles"))) if not drawn.isEmpty() else drawn.withColumn("n", F.col("n_shingles")))
        labels = keep(_labels(docs, drawn, estimate))
    named = drawn.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    roots = classes.join(labels, F.col("rep") == F.col("node"), "left").select("key1", "key2", F.coalesce("root", "rep").alias("root"))
    # a class may hold a third of all rows: its root is found by a salted key
    salted = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by = drawn.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).drop("sketch")
    by = by.join(salted, ["key1", "key2", "salt"], "left")
    root = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = by.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), root).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labels(docs: DataFrame, drawn: DataFrame, estimate: float) -> DataFrame:
    """(node, root) of the classes' smallest doc_ids, for all that are linked with another."""
    named = drawn.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "mark")).alias("rep")).select("key1", "key2", F.col("rep.doc_id").alias("rep"))
    reps = scratch(
        named.join(classes.withColumnsRenamed({"key1": "k1", "key2": "k2"}), (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")) & (F.col("doc_id") == F.col("rep")))
        .select(F.col("rep").alias("node"), "n", "mark", "sketch")
        .dropDuplicates(["node"])
    )
    # inverted lists of retained values that at least two classes hold
    entries = reps.select("node", "n", F.explode("sketch").alias("v"))
    sizes = entries.groupBy("v").agg(F.count("*").alias("held")).where("held > 1")
    lists = scratch(entries.join(sizes, "v"))
    light = lists.where(F.col("held") <= LIGHT).drop("held")
    other = light.select("v", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = light.withColumnsRenamed({"node": "a", "n": "na"}).join(other, "v").where("a < b").where(_alike_in_size("na", "nb")).select("a", "b").distinct()
    pairs = scratch(estimated(pairs, reps, estimate))

    # classes that may have links through longer lists only
    need = F.greatest(F.lit(1), F.floor(F.least(F.col("n"), F.lit(K)) * estimate))
    order = F.sort_array(F.collect_list(F.struct(F.xxhash64("v", F.lit(0)).alias("lot"), "v")))
    heavy = lists.where(F.col("held") > LIGHT).groupBy("node", "n").agg(F.count("*").alias("live"), order.alias("vs")).where(F.col("live") >= need)
    # of these, live and the set's size are counted on sketches
    heavy = scratch(heavy.select("node", "n", F.col("node").alias("comp"), (F.col("live") * F.col("n") / F.least("n", F.lit(K))).alias("live"), F.slice("vs.v", 1, FEW).alias("vs")))

    wanted = scratch(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(heavy.select("node")).distinct())
    # a Bloom filter keeps the other texts out of the shuffle
    held = _held_by(Bloom(wanted.select(F.xxhash64("node").alias("key"))))
    some_docs = docs.select(F.col("doc_id").cast("long").alias("node"), F.xxhash64("text").alias("mark"), "text").where("node IS NOT NULL").where(held(F.xxhash64("node")))
    chosen = wanted.join(reps.select("node", "mark"), "node")
    texts = scratch(some_docs.join(chosen, ["node", "mark"]).select("node", "text").dropDuplicates(["node"]))

    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    some = not heavy.isEmpty()
    first = nearest
    if some:
        picks = scratch(heavy.select("node", "n", "comp", "live", F.explode("vs").alias("v")))
        first = first.unionByName(estimated(led(picks, 0), reps, estimate))
    labels = components(verified(first, texts))
    rest = crossing(pairs.join(nearest, ["a", "b"], "left_anti"), labels)
    if some:
        rest, labels = _rest_of_heavy(reps, texts.join(heavy, "node", "left_semi"), texts, rest, labels, estimate)
    return merged(labels, verified(rest, texts))


def _held_by(bloom: Bloom):
    # on Arrow arrays, since pandas would stay in the memory of every Python worker
    @F.arrow_udf("boolean")
    def held(key: pa.Array) -> pa.Array:
        return pa.array(bloom.has(key.to_numpy()))

    return held


def crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components so far."""
    return _current(pairs, labels, "a", "b").where("comp_a <> comp_b").select("a", "b")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) after more links (a, b)."""
    joined = components(_current(links, labels, "a", "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    new = joined.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    old = labels.join(new, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    return scratch(old.unionByName(fresh))


def _class_of_size(n: str) -> Column:
    return F.floor(STEPS * F.log2(n)).cast("int")


def met_across(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, s, comp, node, n, rest) of the smaller and of the larger members of the pairs that lists may join.

    A pair is met in the size class s of its smaller member (equal ones both ways), and
    only if what is left of both sets at v can make a link: 7 * rest >= 3 * (n + m). A
    larger member looks only where there are smaller ones of another component.
    """
    small = lists.where("7 * rest >= 6 * n").withColumn("s", _class_of_size("n"))
    # a value has a bounded number of size classes
    there = small.groupBy("v", "s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).groupBy("v").agg(F.collect_list(F.struct("s", "c0", "c1")).alias("there"))
    large = lists.withColumns({"low": F.expr("(3 * n + 3) div 4"), "top": F.expr("least(n, floor(7 * rest / 3) - n)")}).where("top >= low")
    large = large.join(there.hint("merge"), "v").withColumns({"low": _class_of_size("low"), "top": _class_of_size("top")})
    large = large.withColumn("t", F.explode(F.filter("there", lambda t: t["s"].between(F.col("low"), F.col("top")) & ~((t["c0"] == F.col("comp")) & (t["c1"] == F.col("comp"))))))
    return small.select("v", "s", "comp", "node", "n", "rest"), scratch(large.select("v", F.col("t.s").alias("s"), "comp", "node", "n", "rest"))


def crossing_count(small: DataFrame, large: DataFrame) -> int:
    """How many pairs of different components meet, from counts alone."""
    sides = small.groupBy("v", "s", "comp").agg(F.count("*").alias("i"), F.lit(0).cast("long").alias("p"))
    sides = sides.unionByName(large.groupBy("v", "s", "comp").agg(F.lit(0).cast("long").alias("i"), F.count("*").alias("p")))
    each = sides.groupBy("v", "s", "comp").agg(F.sum("i").alias("i"), F.sum("p").alias("p"))
    made = each.groupBy("v", "s").agg((F.sum("i").cast("double") * F.sum("p") - F.sum(F.col("i").cast("double") * F.col("p"))).alias("x"))
    return int(made.agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0])


def crossing_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b): the pairs of different components that meet; members of one component are never paired."""
    # exploded rows look small to the planner; none of these sides is broadcast
    ours, theirs = (side.select("v", "s", F.col("comp").alias(c)).distinct() for side, c in ((small, "ca"), (large, "cb")))
    some = ours.join(theirs.hint("merge"), ["v", "s"]).where("ca <> cb")
    half = some.join(small.withColumnsRenamed({"comp": "ca", "node": "a", "n": "na", "rest": "ra"}).hint("merge"), ["v", "s", "ca"])
    full = half.join(large.withColumnsRenamed({"comp": "cb", "node": "b", "n": "nb", "rest": "rb"}).hint("merge"), ["v", "s", "cb"])
    full = full.where("na <= nb AND 4 * na >= 3 * nb AND 7 * least(ra, rb) >= 3 * (na + nb)")
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest_of_heavy(reps: DataFrame, own: DataFrame, texts: DataFrame, rest: DataFrame, labels: DataFrame, estimate: float) -> tuple[DataFrame, DataFrame]:
    """The pairs still to be verified, those among classes of long lists included, and the components so far."""
    total = reps.join(own.select("node"), "node", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    own, before, turn = own.select("node", "text"), None, 0
    while True:
        turn += 1
        own, several, rarity = pruned(scratch(_current(own, labels, "node").select("node", "text", F.col("comp_node").alias("comp"))), total)
        lists = scratch(own.mapInArrow(_listed_through(several, rarity), "v long, rest long, node long, n long, comp long, live long"))
        small, large = met_across(lists)
        left = crossing_count(small, large)
        # leaders merge groups until few pairs are left, or until they merge no more
        if left <= CROSSING * lists.count() or (before is not None and 8 * left > 7 * before):
            break
        before = left
        labels = merged(labels, verified(estimated(led(scratch(picked(lists, turn)), turn), reps, estimate), texts))
        own = own.select("node", "text")
    met = estimated(crossing_pairs(small, large), reps, estimate)
    return crossing(rest, labels).unionByName(met).distinct(), labels


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the members of each component but the smallest doc_id; columns unchanged."""
    gone = find(docs).where("NOT kept").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
