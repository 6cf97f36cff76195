"""Duplicate passages by relative Lempel-Ziv parsing (operator 6).

Every text is parsed greedily against the collection itself as the reference. The
reference is indexed in blocks: seeds of 13 consecutive words, dealt over blocks by
the hash of their anchor (the smallest five-word hash in the seed, so both places
of a shared passage agree on it). An entry is a content and the place where it stands
first: the smallest document and the word there. A factor (start, length, ref_doc,
ref_start) begins at a seed that the index leads to a smaller document and is extended
word by word while the reference goes on alike from that place; where it ends, the next
seed is looked up anew. Factors have 13 words or more, and each is verbatim in ref_doc
at ref_start. They are the duplicate spans; their words are removed.

How it runs, on hashes and without ever gathering a passage's occurrences:

1. Anchors are counted over all documents; those of one document only are no
   candidates. A Bloom filter sized by their number passes the others on.
2. Runs: the seeds in a row that share one anchor position make a run of 13 to 21
   words. For each distinct run the place of its first occurrence is found; all seeds
   of a run that a smaller document holds are duplicates. Copies of a passage agree
   on every run inside it, so this settles all but the ends.
3. Factor ends: where an anchor has several distinct runs, the seeds of the first
   holder of each run are looked up one by one in the same way.
4. Contents that more than one in HEAVY of all entries hold, at most HEAVY of them, are
   broadcast with their places; the others meet by a shuffle. So no passage, however
   many documents hold it, is gathered in one task.
5. Hits are gathered for each document, parsed into factors and cut from its text.

Words are [^\\x20\\x09-\\x0D]+ of the text as it is. Cases: null, empty and short texts
have no seed; very long texts are parsed whole, one at a time; of the places of a
content the smallest document's first one is taken, so there are no ties; rows that
repeat a doc_id are one document and never duplicates of each other; rows with a null
doc_id are neither reference nor parsed; an empty table gives an empty one; extra columns,
whatever their names, pass through drop_passages() unchanged, but those named like the
measures that are asked for are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from siltstone.llm.shared import Bloom, columns_of, rest_of, scratch, small_batches, tidy
from siltstone.llm.texts import grams, mix, steps, word_hashes, words

SEED = 13
ANCHOR = 5
HEAVY = 1024
#: The bits of a place that number the word.
WORD_PART = (1 << 32) - 1


class Parsed:
    """The seeds of one step's texts: doc row, first word within its text, anchor, seed and check hash, run number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.first = words(data, offsets)
        hashed = word_hashes(data, self.start, self.end, lower=False)
        count = np.diff(self.first)
        seeds = np.maximum(count - SEED + 1, 0)
        self.row = np.repeat(np.arange(len(count)), seeds)
        self.ends = np.concatenate(([0], np.cumsum(seeds)))
        self.word = np.arange(self.ends[-1]) - self.ends[self.row]
        at = self.first[self.row] + self.word
        five = grams(hashed, ANCHOR)
        # the smallest of the nine five-word hashes within a seed, and where it is
        span = SEED - ANCHOR + 1
        if len(five) >= span:
            best = np.lib.stride_tricks.sliding_window_view(five, span).argmin(axis=1) + np.arange(len(five) - span + 1)
        else:
            best = np.zeros(0, np.int64)
        self.spot = best[at] if len(at) else np.zeros(0, np.int64)
        self.anchor = five[self.spot] if len(at) else np.zeros(0, np.uint64)
        self.seed = grams(hashed, SEED, salt=3)[at] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (self.spot[1:] != self.spot[:-1]) | (self.row[1:] != self.row[:-1])
        self.run = np.flatnonzero(new)
        self.length = np.diff(np.concatenate((self.run, [len(at)])))
        # a run's content is the hashes of its seeds in order
        if len(self.run):
            place = np.arange(len(at)) - np.repeat(self.run, self.length)
            self.content = mix(np.add.reduceat(mix(self.seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), self.run) + self.length.astype(np.uint64))
        else:
            self.content = np.zeros(0, np.uint64)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in columns.values()], names=list(columns))


def _each(batches):
    """(doc_ids, places, seeds) of each step; a place is a word's number below its text's mark, which tells texts of one doc_id apart."""
    for batch in batches:
        ids, marks = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
        for lo, hi, data, offsets in steps(batch.column(1)):
            p = Parsed(data, offsets)
            yield ids[lo:hi], (marks[lo:hi] << 32)[p.row] + p.word, p


def _anchors(batches):
    for ids, _, p in _each(batches):
        pairs = np.unique(np.stack([p.row[p.run], p.anchor[p.run].view(np.int64)]), axis=1) if len(p.run) else np.zeros((2, 0), np.int64)
        yield _batch({"key": pairs[1], "doc": ids[pairs[0]]})


def _runs_through(shared: Bloom):
    def runs(batches):
        for ids, place, p in _each(batches):
            k = p.run
            ok = shared.has(p.anchor[k])
            k, n = k[ok], p.length[ok]
            yield _batch({"anchor": p.anchor[k], "content": p.content[ok], "doc": ids[p.row[k]], "place": place[k], "n": n})

    return runs


def _seeds_through(open_runs: Bloom):
    def seeds(batches):
        for ids, place, p in _each(batches):
            ok = open_runs.has(_holder(p.content, ids[p.row[p.run]]))
            every = np.repeat(ok, p.length)
            yield _batch({"anchor": p.anchor[every], "content": p.seed[every], "doc": ids[p.row[every]], "place": place[every], "n": np.ones(int(every.sum()))})

    return seeds


def _holder(content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    doc = doc.astype(np.int64).view(np.uint64)
    return content.view(np.uint64) ^ (doc << np.uint64(19)) ^ (doc << np.uint64(41))


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first place of each distinct (anchor, content), and the rows that a smaller document holds as well, with that place."""
    held = rows.groupBy("anchor", "content").agg(F.min(F.struct("doc", "place")).alias("first"), F.max("doc").alias("most"), F.count("*").alias("m"))
    firsts = scratch(held.select("anchor", "content", F.col("first.doc").alias("least"), F.col("first.place").alias("least_place"), "most", "m"))
    again = firsts.where("least < most").select(F.col("anchor").alias("a2"), F.col("content").alias("c2"), "least", "least_place", (F.col("m") * HEAVY > rows.count()).alias("heavy"))
    heavy = again.where("heavy").select(F.col("a2").alias("a1"), F.col("c2").alias("c1"), F.struct("least", "least_place").alias("known"))
    met = rows.join(F.broadcast(heavy), (F.col("anchor") == F.col("a1")) & (F.col("content") == F.col("c1")), "left")
    # rows that have met a heavy content are dealt by keys of their own, so that none gathers
    met = met.withColumn("anchor", F.when(F.col("known").isNull(), F.col("anchor")).otherwise(F.xxhash64("doc", "place")))
    met = met.join(again.where("NOT heavy").select("a2", "c2", F.struct("least", "least_place").alias("found")), (F.col("anchor") == F.col("a2")) & (F.col("content") == F.col("c2")) & F.col("known").isNull(), "left")
    hits = met.withColumn("ref", F.coalesce("known", "found")).where("doc > ref.least").select("doc", "place", "n", "ref.least", "ref.least_place")
    word = lambda place: F.col(place).bitwiseAND(WORD_PART)
    return firsts, hits.select("doc", F.shiftright("place", 32).cast("int").alias("mark"), word("place").alias("word"), "n", F.col("least").alias("ref_doc"), word("least_place").alias("ref_word"))


def matches(docs: DataFrame) -> DataFrame:
    """(doc, mark, word, n, ref_doc, ref_word): n seeds from a word on are in ref_doc, the smallest such document, from ref_word on."""
    small_batches(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text", F.hash("text").alias("mark"))
    shape = "anchor long, content long, doc long, place long, n long"
    with tidy() as keep:
        # an anchor counts once for each document; rows repeating a doc_id only add candidates
        anchors = texts.mapInArrow(_anchors, "key long, doc long")
        shared = Bloom(anchors.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1").select("key"))
        runs = scratch(texts.mapInArrow(_runs_through(shared), shape))
        firsts, hits = _settled(runs)
        # several runs around one anchor: their ends may still share seeds
        many = firsts.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1").select("anchor")
        open_runs = firsts.join(many, "anchor", "left_semi")
        key = F.col("content").bitwiseXOR(F.shiftleft("least", 19)).bitwiseXOR(F.shiftleft("least", 41))
        unsettled = Bloom(open_runs.select(key.alias("key")))
        seeds = scratch(texts.mapInArrow(_seeds_through(unsettled), shape))
        _, ends = _settled(seeds)
        return keep(scratch(hits.unionByName(ends)))


def _covered(batches):
    for batch in batches:
        hits, texts, counts, gaps, spans = batch.column(2), [], [], [], []
        for lo, hi, data, offsets in steps(batch.column(1)):
            start, end, first = words(data, offsets)
            raw = data.tobytes()
            for k in range(lo, hi):
                a, b = int(first[k - lo]), int(first[k - lo + 1])
                factors = parse(hits[k].as_py() or [])
                gone = np.zeros(b - a + 1, np.int64)
                for f in factors:
                    gone[f["start"]] += 1
                    gone[f["start"] + f["length"]] -= 1
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                texts.append(b" ".join([raw[s:e] for s, e in zip(start[left].tolist(), end[left].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
                counts.append(b - a)
                gaps.append(b - a - len(left))
                spans.append(factors)
        arrays = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gaps, pa.int64()), pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in SPAN])))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", "text", "n_words", "n_removed", "spans"])


SPAN = ("start", "length", "ref_doc", "ref_start")


def parse(hits: list[dict]) -> list[dict]:
    """Greedy factors of a text from the index's hits (word, n, ref_doc, ref_word).

    A factor goes on while the reference holds the next seed right after the one before;
    where it ends, the next seed begins another.
    """
    factors: list[dict] = []
    found = {(h["word"] + k, h["ref_doc"], h["ref_word"] + k) for h in hits for k in range(h["n"])}
    for word, doc, spot in sorted(found):
        here = factors[-1] if factors else None
        grown = here["length"] - SEED + 1 if here else 0
        if here and (doc, word, spot) == (here["ref_doc"], here["start"] + grown, here["ref_start"] + grown):
            here["length"] += 1
        else:
            factors.append({"start": word, "length": SEED, "ref_doc": doc, "ref_start": spot})
    return factors


def drop_passages(docs: DataFrame, measures: bool = True) -> DataFrame:
    """docs with text as its kept words joined by one space, with measures also _n_words, _n_removed and _spans (in words of the input)."""
    hits = matches(docs).groupBy("doc", "mark").agg(F.collect_list(F.struct("word", "n", "ref_doc", "ref_word")).alias("hits"))
    row, field = rest_of(docs, "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.hash("text").alias("sum"), row, "text")
    whole = rows.join(hits, (F.col("id") == F.col("doc")) & (F.col("sum") == F.col("mark")), "left")
    span = ArrayType(StructType([StructField(c, LongType()) for c in SPAN]))
    shape = StructType([field, StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("spans", span)])
    done = whole.select("row", "text", "hits").mapInArrow(_covered, shape)
    own = ["_n_words", "_n_removed", "_spans"] if measures else []
    kept = columns_of("row", [c for c in docs.columns if c not in own], text=F.col("text"), n_chars=F.length("text").cast("long"))
    return done.select(*kept, *[F.col(c[1:]).alias(c) for c in own])
