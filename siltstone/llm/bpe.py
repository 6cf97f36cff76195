"""BPE encoding and decoding with an automaton of frequent words (operator 4).

The corpus' most frequent words are compiled, with their ids as output, into a
minimal acyclic transducer: words share prefixes and suffixes, each arc carries a
number, and the sum of the numbers along a word is its place in a table of id
sequences. The automaton is one flat file that every executor fetches once and all
its Python workers memory-map. Words it doesn't hold are merged exactly, by the
merge ranks of the vocabulary.

A vocabulary is a JSON file of the tokenizers library: BPE of byte-level characters
with a suffix at word ends, texts composed (NFC), lower-cased, and split by a
pattern that drops white space. Texts of common characters are split by the same
pattern here; all others, and those that hold a special token's string, by the
library's own normalizer and splitter. The result equals the library's encode()
without special tokens added, and its decode() with special tokens kept.

Cases: null and empty texts have no ids and decode to the empty string; texts of any
length are encoded whole, and long words merged by a heap; words of equal count go into
the automaton in their own order, those that occur once never, which changes no ids; repeated rows are encoded alike;
an empty table gives an empty one; extra columns pass through unchanged, but those named
ids or decoded are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

from siltstone.llm.shared import columns_of, most_frequent, rest_of, scratch_root, shipped, small_batches, tidy
from siltstone.llm.texts import LETTERS, NUMBERS, PLAIN

#: Words in the automaton, and the bytes of one: with these its size has a bound.
LEXICON = 65_536
LONGEST = 64
#: Words that a task remembers before it starts anew.
MEMORY = 600_000
#: What the vocabulary's words are made of, a fixed pattern of its file, for lower-cased plain texts.
WORD = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^\s{LETTERS}{NUMBERS}]+")
#: Bytes up to which a word is merged by plain search instead of a heap.
SHORT = 48


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Splits texts into words and merges words exactly."""

    def __init__(self, file: str):
        """file: the whole JSON text."""
        model = json.loads(file)["model"]
        self.library = Tokenizer.from_str(file)
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        shown = byte_characters()
        self.bytes = {c: b for b, c in shown.items()}
        self.inner = [ids[shown[b]] for b in range(256)]
        self.last = [ids[shown[b] + suffix] for b in range(256)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t.content: k for k, t in self.library.get_added_tokens_decoder().items()}
        self.breaks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {k: t for t, k in ids.items()} | {k: t for t, k in self.special.items()}
        self.names = [names.get(k, "") for k in range(max(names) + 1)]

    def split(self, text: str) -> list[str | int]:
        """Words of a text; the id in place of a special token."""
        if PLAIN.fullmatch(text) and not (self.breaks and self.breaks.search(text)):
            return WORD.findall(text.lower())
        out: list[str | int] = []
        for part in self.breaks.split(text) if self.breaks else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(self.bytes[c] for c in piece).decode("utf-8"))
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of a word: the pair of lowest rank is merged, leftmost first, until none is left."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[b] for b in raw[-1:]]
        merges, n = self.merges, len(ids)
        if n <= SHORT:
            get = merges.get
            pairs = [get(p) for p in zip(ids, ids[1:], strict=False)]
            while found := [p for p in pairs if p]:
                best = min(found)
                k = pairs.index(best)
                ids[k : k + 2] = [best[1]]
                del pairs[k]
                if k:
                    pairs[k - 1] = get((ids[k - 1], ids[k]))
                if k < len(pairs):
                    pairs[k] = get((ids[k], ids[k + 1]))
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(merges[p][0], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or (ids[k], ids[j]) != pair:
                continue
            ids[k] = merges[pair][1]
            alive[j], after[k] = False, after[j]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in merges:
                    heapq.heappush(heap, (merges[p][0], a, p))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode for a vocabulary without a decoder: tokens joined by one space."""
        names = self.names
        return " ".join([names[k] for k in ids if k < len(names) and names[k]])


def compile_lexicon(outputs: dict[str, list[int]]) -> bytes:
    """The minimal acyclic transducer of the words as one flat file.

    Words are added in byte order; a state whose words are all added is replaced by an
    equal one if there is one, so suffixes are shared. Each state's number of words below
    gives the arcs' outputs: the sum along a word is its rank in byte order.
    """
    words = sorted((w.encode("utf-8"), w) for w in outputs if w)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) of the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, label = path.pop()
            child = arcs[state][label]
            arcs[state][label] = register.setdefault((final[child], tuple(arcs[child].items())), child)

    last = b""
    for raw, _ in words:
        same = next((k for k, (a, b) in enumerate(zip(last, raw, strict=False)) if a != b), min(len(last), len(raw)))
        settle(same)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for label in raw[same:]:
            arcs.append({})
            final.append(False)
            arcs[state][label] = len(arcs) - 1
            path.append((state, label))
            state = len(arcs) - 1
        final[state] = True
        last = raw
    settle(0)
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for child in arcs[stack.pop()].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}
    todo = [(0, False)]
    while todo:
        state, ready = todo.pop()
        if ready:
            below[state] = final[state] + sum(below[c] for c in arcs[state].values())
        elif state not in below:
            todo.append((state, True))
            todo += [(c, False) for c in arcs[state].values()]
    rows = []
    for state in order:
        passed = int(final[state])
        for label, child in sorted(arcs[state].items()):
            rows.append((number[state] << 8 | label, number[child], passed))
            passed += below[child]
    rows.sort()
    keys = np.array([r[0] for r in rows], np.int64)
    target = np.array([r[1] for r in rows], np.int32)
    output = np.array([r[2] for r in rows], np.int32)
    ids = [outputs[w] for _, w in words]
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    flat = np.array([k for x in ids for k in x], np.uint32)
    parts = [keys, target, output, np.array([final[s] for s in order], np.uint8), ends, flat]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() + b"\0" * (-len(p.tobytes()) % 8) for p in parts)


class Lexicon:
    """A compiled automaton, read from a memory-mapped file or from bytes."""

    def __init__(self, raw: np.ndarray):
        sizes, at, parts = raw[:48].view(np.int64), 48, []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int32, np.uint32), strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        self.keys, self.target, self.output, self.final, self.ends, self.flat = parts

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    def ranks(self, words: list[str]) -> np.ndarray:
        """Each word's rank in byte order, or -1; all words walk the automaton together."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.cumsum(size) - size
        state, rank = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST) & (len(self.keys) > 0))
        alive = np.zeros(len(raw), bool)
        alive[live] = True
        depth = 0
        while len(live):
            key = state[live] << 8 | data[at[live] + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[k] == key
            alive[live[~found]] = False
            live, k = live[found], k[found]
            state[live] = self.target[k]
            rank[live] += self.output[k]
            depth += 1
            live = live[size[live] > depth]
        alive &= self.final[state].astype(bool)
        return np.where(alive, rank, -1)

    def ids(self, rank: int) -> np.ndarray:
        return self.flat[self.ends[rank] : self.ends[rank + 1]]


class Coder:
    """Encodes texts with an automaton and a vocabulary, remembering words up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str | int, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self.vocabulary.split(t) for t in texts]
        distinct = set().union(*split)
        known = self.known
        if len(known) + len(distinct) > MEMORY:
            known.clear()
        self.learn(list(distinct - known.keys()))
        return [b"".join([known[w] for w in s]) for s in split]

    def learn(self, words: list[str | int]) -> None:
        texts = [w for w in words if isinstance(w, str)]
        for w, rank in zip(texts, self.lexicon.ranks(texts).tolist(), strict=True):
            ids = self.lexicon.ids(rank) if rank >= 0 else np.array(self.vocabulary.merge(w), np.uint32)
            self.known[w] = ids.astype("<u4").tobytes()
        for w in words:
            if isinstance(w, int):
                self.known[w] = np.array([w], "<u4").tobytes()


#: Of each worker process: what was read last, so that tasks after the first find it, and words it knows.
_READ: dict[str, Vocabulary] = {}
_CODERS: dict[str, Coder] = {}


def read(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def _vocabulary(vocabulary: Broadcast) -> Vocabulary:
    path, file = vocabulary.value
    if path not in _READ:
        _READ.clear()
        _READ[path] = Vocabulary(file)
    return _READ[path]


def _coder(vocabulary: Broadcast, name: str) -> Coder:
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(_vocabulary(vocabulary), Lexicon.mapped(SparkFiles.get(name)))
    return _CODERS[name]


def word_counts(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(word, count) over all texts, for words of at most LONGEST bytes; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = _vocabulary(vocabulary).split, Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in counts.items() if isinstance(w, str) and len(w) <= LONGEST and len(w.encode("utf-8")) <= LONGEST]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "count"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(split(text.as_py() or ""))
                if len(counts) > MEMORY // 2:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compiles the most frequent words of docs and hands the file to all executors; its name there."""
    spark = docs.sparkSession
    small_batches(spark)
    with tidy():
        top = most_frequent(word_counts(docs, shipped(spark, path)).where("count > 1"), "word", "count", size).toArrow()
    merge = read(path).merge
    raw = compile_lexicon({w: merge(w) for w in top["word"].to_pylist()})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{name}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(where)
    out.write(bytearray(raw))
    out.close()
    files.deleteOnExit(where)
    spark.sparkContext.addFile(where.toString())
    return name


def encode_decode(docs: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """docs with ids array<int> and decoded string for its column text."""
    name = build_lexicon(docs, path, size)
    vocabulary = shipped(docs.sparkSession, path)
    row, field = rest_of(docs, "text", "ids", "decoded")
    shape = StructType([field, StructField("text", StringType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, coder = _vocabulary(vocabulary), _coder(vocabulary, name)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 1000):
                part = batch.slice(lo, 1000)
                coded = [np.frombuffer(x, "<u4") for x in coder.encode([t or "" for t in texts.slice(lo, 1000).to_pylist()])]
                ends = np.cumsum([0] + [len(x) for x in coded]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded).astype(np.int32)))
                decoded = pa.array([words.decode(x.tolist()) for x in coded], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, decoded], names=[*part.schema.names, "ids", "decoded"])

    coded = docs.select(row, "text").mapInArrow(run, shape)
    return coded.select(*columns_of("row", [c for c in docs.columns if c not in ("ids", "decoded")], text=F.col("text")), "ids", "decoded")
