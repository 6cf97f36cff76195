import random

import numpy as np
import pytest

import public_tokenizers
from siltstone.llm import bpe
from tests.llm.conftest import prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return bpe.read(PATH)


def test_merges_and_decoding_equal_the_library(words):
    rng = random.Random(2)
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon({w: words.merge(w) for w in ["hello", "world", "café", "'s"]}), np.uint8))
    coder = bpe.Coder(words, lexicon)
    pools = [list(range(32, 127)) + [10, 9], list(range(0xA1, 0x180)) + [32, 39], list(range(0x20, 0x3000))]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(150)) for pool in pools for _ in range(60)]
    texts += ["", "   ", "Hello WORLD's <|endoftext|>x<|startoftext|>", "ΣΑΣ ﬁ é İ ǅ 日本 🙂🙂", "a" * 3000 + " " + "ab" * 900, "x\x00\x1c\x85y"]
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == words.library.encode(text, add_special_tokens=False).ids
        assert words.decode(ids) == words.library.decode(ids, skip_special_tokens=False)


def test_automaton_is_minimal_and_exact():
    rng = random.Random(1)
    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) + rng.choice(["ing", "ed", ""]) for _ in range(500)})
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon({w: [k] for k, w in enumerate(known)}), np.uint8))
    probe = known + ["zz", "", "ab" * 40, "ingg"]
    assert lexicon.ranks(probe).tolist() == [known.index(w) if w in known else -1 for w in probe]
    assert [int(lexicon.ids(k)[0]) for k in range(len(known))] == list(range(len(known)))
    # states are right languages: no two are equal in a minimal automaton
    arcs = {}
    for key, target in zip(lexicon.keys.tolist(), lexicon.target.tolist(), strict=True):
        arcs.setdefault(key >> 8, []).append((key & 255, target))
    states = [(int(f), tuple(arcs.get(k, []))) for k, f in enumerate(lexicon.final)]
    assert len(set(states)) == len(states)


def test_empty_lexicon():
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon({}), np.uint8))
    assert lexicon.ranks(["a", ""]).tolist() == [-1, -1]


def test_documents(make_docs, empty_docs, words):
    rng = random.Random(5)
    rows = [(k, prose(rng, 50)) for k in range(30)] + [(100, None), (101, ""), (101, ""), (102, "Don't <|endoftext|>")]
    docs = make_docs(rows).selectExpr("*", "1 AS ids", "2 AS word")
    out = bpe.encode_decode(docs, PATH, size=50).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == words.library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == words.library.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty_docs, PATH).count() == 0


def test_very_long_texts_and_clashing_columns(make_docs, words):
    rng = random.Random(6)
    rows = [(1, prose(rng, 100_000, 10**6)), (2, "z" * 50_000), (2, "z" * 50_000), (3, "a b " * 20_000)]
    docs = make_docs(rows).selectExpr("*", "1 AS decoded", "'k' AS word", "3 AS `count`", "4 AS `x.y`")
    out = bpe.encode_decode(docs, PATH, size=100).collect()
    for r, (i, text) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True):
        assert r.doc_id == i and r["x.y"] == 4 and r.word == "k" and r["count"] == 3
        assert r.ids == words.library.encode(text, add_special_tokens=False).ids
        assert r.decoded == words.library.decode(r.ids, skip_special_tokens=False)
