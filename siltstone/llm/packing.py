"""Vector bin packing of documents into training sequences (operator 10).

Every document becomes ids (its text's, then the end id) and is cut freely into
pieces, which fill sequences of at most `tokens` ids. A sequence also holds at most
`segments` pieces and `loss` loss-bearing ids, so three limits bind at once. The
dot-product heuristic picks what goes into the open sequence: of the waiting pieces
that fit, the one whose demand vector (tokens, segments, loss-bearing tokens, each
as a part of its limit) has the largest dot product with what is left of the limits.
If none fits whole, the one with the largest product is cut to fit. A sequence is
closed when it is full or nothing that waits fits any more; then, to keep padding
low, its rest is cut off at the largest power of two (a sequence of such a length
needs no padding) and waits for the next one.

Loss-bearing ids are those at a document's end: as many as a column loss_tokens says, or,
without one (documents have none), all but the first `prompt` of a document's ids, as if
it began with its prompt. A document too long for one sequence is cut between the two
first, so that a sequence takes ids of both kinds and all limits can be used up.

How it runs: each partition of the input packs its own documents in one pass, so
nothing is shuffled and the work of a lost executor is done again alike. Waiting
pieces are bounded by WAITING, the rest is packed in the order of the input; at a
partition's end the last sequence is cut into powers of two in the same way.
Sequence ids are the partition's number, shifted, and a counter.

Ids come from a byte-level BPE vocabulary, a JSON file of the tokenizers library; the
result equals that library's for every text.

Cases: null and empty texts are the end id alone; a null loss_tokens is as if the column
were missing, one below 0 or above the document's ids is the nearest of these; very long
texts are encoded whole and their pieces wait like others; pieces of equal product go in
the order in which they wait; repeated rows are packed like any others; extra columns,
whatever their names, are ignored; an empty table has no sequences.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm.bpe import byte_characters
from siltstone.llm.shared import shipped, small_batches
from siltstone.llm.texts import PLAIN

TOKENS = 1024
SEGMENTS = 64
LOSS = 992
PROMPT = 0.25
END = 0
WAITING = 128
#: Bytes of ids that wait; a longer document is packed at once.
HELD = 1 << 20
#: What the vocabulary's words are made of, a fixed pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHAPE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """The ids of texts as the vocabulary's library gives them.

    Plain texts, which every Unicode version splits alike, go through a faster encoder
    that reads the same vocabulary by rank; all others, and those that hold a special
    token's string, through the library itself.
    """

    def __init__(self, file: str):
        """file: the whole JSON text."""
        self.file, read = file, json.loads(file)
        model, self.special = read["model"], [t["content"] for t in read["added_tokens"]]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in pairs]
        #: By rank equals by merge if later merges have larger ids.
        self.ranked = None
        if ids == sorted(set(ids)):
            raw = {c: b for b, c in byte_characters().items()}
            ranks = {bytes(raw[c] for c in token): k for token, k in model["vocab"].items() if token not in self.special}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's, read when a text needs it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_str(self.file)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._fast(t) if self.ranked and PLAIN.fullmatch(t) and not any(s in t for s in self.special) else self._library(t) for t in texts]

    def _fast(self, text: str) -> bytes:
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


    @classmethod
    def read(cls, path: str) -> Encoder:
        with open(path, encoding="utf-8") as file:
            return cls(file.read())


#: Of each worker process: what was read last, so that tasks after the first find it.
_READ: dict[str, Encoder] = {}


def _encoder(vocabulary: Broadcast) -> Encoder:
    path, file = vocabulary.value
    if path not in _READ:
        _READ.clear()
        _READ[path] = Encoder(file)
    return _READ[path]


class Packer:
    """Packs the pieces of one partition; take() gives the pieces placed since the last call."""

    def __init__(self, first: int, tokens: int, segments: int, loss: int):
        self.limits = np.array([tokens, segments, loss], np.int64)
        self.sequence, self.placed = first, []
        self.waiting: list[tuple] = []
        self.fresh()

    def fresh(self) -> None:
        self.left, self.open = self.limits.copy(), []

    @staticmethod
    def need(piece: tuple) -> tuple[int, int, int]:
        """Tokens, segments and loss-bearing tokens of (doc, start, ids, doc_tokens, first loss-bearing id)."""
        _, start, ids, _, bears = piece
        n = len(ids) // 4
        return n, 1, max(0, start + n - max(bears, start))

    @staticmethod
    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, whole, bears = piece
        return (doc, start, ids[: 4 * n], whole, bears), (doc, start + n, ids[4 * n :], whole, bears)

    def room(self, piece: tuple) -> int:
        """How many of the piece's ids fit what is left."""
        if self.left[1] < 1:
            return 0
        _, start, ids, _, bears = piece
        free = max(0, min(len(ids) // 4, bears - start))
        return int(min(len(ids) // 4, self.left[0], free + self.left[2]))

    def place(self, piece: tuple) -> None:
        self.open.append(piece)
        self.left = self.left - self.need(piece)

    def add(self, piece: tuple) -> None:
        doc, start, ids, whole, bears = piece
        n = len(ids) // 4
        if n > self.limits[0] and start < bears < start + n:
            self.waiting += self.cut(piece, bears - start)
        else:
            self.waiting.append(piece)
        while len(self.waiting) > WAITING or sum(len(p[2]) for p in self.waiting) > HELD:
            self.fill()

    def fill(self) -> None:
        """Fills one sequence from the waiting pieces and closes it."""
        need = np.array([self.need(p) for p in self.waiting], np.int64)
        alive = np.ones(len(need), bool)
        while alive.any() and self.left[0] > 0 and self.left[1] > 0 and self.left[2] >= 0:
            gain = (need / self.limits) @ (self.left / self.limits)
            fits = alive & (need <= self.left).all(axis=1)
            if fits.any():
                k = int(np.where(fits, gain, -1).argmax())
                self.place(self.waiting[k])
                alive[k] = False
                continue
            free = need[:, 0] - need[:, 2]
            room = np.where(alive, np.minimum(need[:, 0], np.minimum(self.left[0], free + self.left[2])), 0)
            if not room.any():
                break
            k = int(np.where(room > 0, gain, -1).argmax())
            head, tail = self.cut(self.waiting[k], int(room[k]))
            self.place(head)
            self.waiting[k], need[k] = tail, self.need(tail)
        self.waiting = [p for p, a in zip(self.waiting, alive, strict=True) if a]
        self.close()

    def close(self) -> None:
        """Writes the open sequence; what is over a power of two goes back, unless it is full."""
        used = sum(len(p[2]) // 4 for p in self.open)
        back: list[tuple] = []
        if used and used < self.limits[0]:
            over = used - (1 << (used.bit_length() - 1))
            while over:
                piece = self.open.pop()
                n = len(piece[2]) // 4
                if n > over:
                    piece, tail = self.cut(piece, n - over)
                    self.open.append(piece)
                    back.append(tail)
                    over = 0
                else:
                    back.append(piece)
                    over -= n
        offset = 0
        for piece in self.open:
            self.placed.append((*piece[:4], self.sequence, offset))
            offset += len(piece[2]) // 4
        self.sequence += bool(self.open)
        self.waiting.extend(reversed(back))
        self.fresh()

    def finish(self) -> None:
        while self.waiting:
            self.fill()

    def take(self) -> pa.RecordBatch:
        placed, self.placed = self.placed, []
        columns = list(zip(*placed, strict=True)) if placed else [[]] * 6
        doc, start, ids, whole, sequence, offset = columns
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays(
            [long(doc), long(start), long([len(x) // 4 for x in ids]), pa.array(ids, pa.binary()), long(whole), long(sequence), long(offset)],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, prompt: float = PROMPT, end: int = END) -> DataFrame:
    """The pieces of docs (doc_id, text): where each is in its document and in its sequence, with its ids; loss is by default tokens * LOSS / TOKENS."""
    small_batches(docs.sparkSession)
    most = max(1, tokens * LOSS // TOKENS) if loss is None else loss
    if min(tokens, segments, most) < 1 or not 0 <= prompt <= 1:
        raise ValueError("every limit must be at least 1, and prompt a part")
    tail = np.array([end], "<u4").tobytes()
    vocabulary = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, most)
        rows = (batch.slice(lo, 500) for batch in batches for lo in range(0, len(batch), 500))
        for part in rows:
            coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            for doc, ids, bearing in zip(part.column(0).to_pylist(), coded, part.column(2).to_pylist(), strict=True):
                ids += tail
                n = len(ids) // 4
                packer.add((doc, 0, ids, n, int(n * prompt) if bearing is None else n - max(0, min(n, bearing))))
                if len(packer.placed) > 2000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    bears = F.col("loss_tokens").cast("long") if "loss_tokens" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", bears).mapInArrow(run, SHAPE)
