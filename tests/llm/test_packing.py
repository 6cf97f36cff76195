import random
from collections import defaultdict

import numpy as np
import pytest

import public_tokenizers
from siltstone.llm import packing
from tests.llm.conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs, **limits):
    return packing.pack(docs, PATH, **limits).collect()


def plain(rows, tokens, segments, loss, prompt=packing.PROMPT):
    """The documented heuristic step by step with lists: (doc, start, length, sequence, offset) of every piece."""
    encoder = packing.Encoder.read(PATH).tokenizer
    waiting, out, sequence = [], [], 0

    def fill():
        nonlocal sequence
        left, open_ = [tokens, segments, loss], []
        while waiting and left[0] and left[1]:
            of = lambda p: (p[2], 1, max(0, p[1] + p[2] - max(p[1], p[3])))
            gain = lambda p: sum(x / m * y / m for x, y, m in zip(of(p), left, (tokens, segments, loss), strict=True))
            fit = [k for k, p in enumerate(waiting) if all(x <= y for x, y in zip(of(p), left, strict=True))]
            room = lambda p: min(p[2], left[0], max(0, min(p[2], p[3] - p[1])) + left[2])
            some = fit or [k for k, p in enumerate(waiting) if room(p)]
            if not some:
                break
            k = max(some, key=lambda j: (round(gain(waiting[j]), 12), -j))
            doc, start, n, bears = waiting[k]
            m = n if fit else room(waiting[k])
            open_.append((doc, start, m, bears))
            left = [x - y for x, y in zip(left, of(open_[-1]), strict=True)]
            if m == n:
                del waiting[k]
            else:
                waiting[k] = (doc, start + m, n - m, bears)
        used = sum(p[2] for p in open_)
        back = []
        while used < tokens and used & (used - 1):
            over = used - (1 << used.bit_length() - 1)
            doc, start, n, bears = open_.pop()
            m = min(n, over)
            if n > m:
                open_.append((doc, start, n - m, bears))
            back.append((doc, start + n - m, m, bears))
            used -= m
        at = 0
        for doc, start, n, _ in open_:
            out.append((doc, start, n, sequence, at))
            at += n
        sequence += 1
        waiting.extend(reversed(back))

    for doc, text in rows:
        n = len(encoder.encode(text or "", add_special_tokens=False).ids) + 1
        bears = int(n * prompt)
        waiting += [(doc, 0, bears, bears), (doc, bears, n - bears, bears)] if n > tokens and 0 < bears < n else [(doc, 0, n, bears)]
        while len(waiting) > packing.WAITING:
            fill()
    while waiting:
        fill()
    return out


def whole(rows, out, tokens, segments, loss):
    encoder = packing.Encoder.read(PATH)
    ids = {i: np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for i, t in rows}
    spots, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        spots[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) // 4 and r.ids == ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
    for i, parts in spots.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i]) // 4
    assert set(spots) == set(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens and len(parts) <= segments
        assert sum(max(0, r.start + r.length - max(r.start, int(r.doc_tokens * packing.PROMPT))) for r in parts) <= loss
        assert at == tokens or at & (at - 1) == 0


@pytest.mark.parametrize("limits", [{}, {"tokens": 64, "segments": 3}, {"tokens": 7, "segments": 1}])
def test_pieces_are_exact_and_within_limits(make_docs, limits):
    rng = random.Random(10)
    rows = [(k, prose(rng, rng.choice([0, 1, 5, 60, 700]))) for k in range(90)] + [(200, None), (201, ""), (202, "ünïcode 日本 🙂 <|endoftext|> don't\n\n x")]
    tokens = limits.get("tokens", packing.TOKENS)
    whole(rows, pieces(make_docs(rows), **limits), tokens, limits.get("segments", packing.SEGMENTS), max(1, tokens * packing.LOSS // packing.TOKENS))


@pytest.mark.parametrize("limits", [(1024, 64, 960), (64, 3, 60), (128, 64, 70)])
def test_equals_the_plain_heuristic(make_docs, limits):
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.choice([0, 1, 5, 60, 700, 2500]))) for k in range(100)]
    tokens, segments, loss = limits
    got = packing.pack(make_docs(rows).coalesce(1), PATH, tokens, segments, loss).collect()
    assert [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got] == plain(rows, *limits)


def test_every_limit_binds(make_docs):
    rng = random.Random(22)
    rows = [(k, prose(rng, rng.choice([60, 3000]))) for k in range(100)] + [(1000 + k, "a") for k in range(800)]
    full = defaultdict(lambda: [0, 0, 0])
    for r in pieces(make_docs(rows)):
        bears = int(r.doc_tokens * packing.PROMPT)
        for j, x in enumerate((r.length, 1, max(0, r.start + r.length - max(r.start, bears)))):
            full[r.sequence_id][j] += x
    assert [max(f[j] for f in full.values()) for j in range(3)] == [packing.TOKENS, packing.SEGMENTS, packing.LOSS]
    assert sum(f[0] == packing.TOKENS for f in full.values()) > 0.8 * len(full)


def test_very_long_texts_and_clashing_columns(make_docs):
    rng = random.Random(23)
    rows = [(1, prose(rng, 200_000)), (2, None), (2, None), (3, "x" * 300_000), (4, "short")]
    docs = make_docs(rows).selectExpr("*", "7 AS ids", "8 AS start", "9 AS sequence_id", "'a' AS `x.y`")
    out = pieces(docs)
    assert sorted(r.doc_id for r in out if r.doc_tokens == 1) == [2, 2]
    assert sum(r.length for r in out) == sum(len(x) // 4 + 1 for x in packing.Encoder.read(PATH).encode([t or "" for _, t in rows]))


def test_loss_limit(make_docs, empty_docs):
    docs = make_docs([(k, "one two three four five six seven eight") for k in range(20)]).selectExpr("*", "CAST(doc_id % 5 AS LONG) AS loss_tokens")
    left = defaultdict(int)
    for r in pieces(docs, tokens=32, segments=8, loss=4):
        first = r.doc_tokens - r.doc_id % 5
        left[r.sequence_id] += max(0, r.start + r.length - max(first, r.start))
    assert max(left.values()) <= 4
    assert pieces(empty_docs) == []


def test_same_result_twice(make_docs):
    docs = make_docs([(k, "a b c " * (k % 13)) for k in range(50)])
    assert pieces(docs) == pieces(docs)


def test_random_texts_encode_as_the_library_does():
    rng = random.Random(4)
    encoder = packing.Encoder.read(PATH)
    pools = [list(range(32, 127)) + [10, 9, 13], list(range(0xA1, 0x180)) + [32, 39, 10], list(range(0x20, 0x3000))]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(150)) for pool in pools for _ in range(60)] + ["", "  ", "'re 's  \n"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
