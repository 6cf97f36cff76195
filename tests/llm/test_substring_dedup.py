import random

from siltstone.llm import substring_dedup
from tests.llm.conftest import prose


def brute(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def check(docs, rows):
    got = substring_dedup.drop_passages(docs).collect()
    assert sorted([(r.doc_id, r._n_words, r._n_removed, r.text) for r in got], key=str) == brute(rows)
    return {r.doc_id: r for r in got}


def test_equals_brute_force(make_docs):
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (13, 20, 60, 14, 200)]
    rows = []
    for k in range(160):
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(shared).split()
            a = rng.randrange(0, max(1, len(w) - 13))
            parts += [" ".join(w[a : a + rng.randrange(10, 80)]), prose(rng, rng.randrange(0, 9))]
        rows.append((k, " ".join(parts)))
    rows += [(500 + k, rows[k][1]) for k in range(20)] + [(600, "same word " * 40), (601, "same word " * 50)]
    rng.shuffle(rows)
    out = check(make_docs(rows), rows)
    assert any(r._spans for r in out.values())


def test_edges(make_docs, empty_docs):
    text = " ".join(f"t{k}" for k in range(13))
    rows = [(2, text), (1, text + "\n"), (3, " ".join(text.split()[:12])), (4, None), (5, ""), (None, text), (6, text + " é  ü")]
    out = check(make_docs(rows), rows)
    assert out[2].text == "" and out[2]._spans[0].ref_doc == 1 and out[1]._n_removed == 0
    assert substring_dedup.drop_passages(empty_docs).count() == 0


def test_rows_repeating_a_doc_id_are_one_document(make_docs):
    text = " ".join(f"t{k}" for k in range(20))
    out = substring_dedup.drop_passages(make_docs([(1, text), (1, text), (2, text)]))
    assert sorted((r.doc_id, r._n_removed) for r in out.collect()) == [(1, 0), (1, 0), (2, 20)]


def test_factors_follow_one_reference():
    hits = [{"word": 0, "n": 3, "ref_doc": 1, "ref_word": 5}, {"word": 3, "n": 1, "ref_doc": 2, "ref_word": 8}, {"word": 4, "n": 2, "ref_doc": 2, "ref_word": 9}, {"word": 6, "n": 1, "ref_doc": 2, "ref_word": 40}]
    spans = [(0, 15, 1, 5), (3, 15, 2, 8), (6, 13, 2, 40)]
    assert substring_dedup.parse(hits) == [dict(zip(substring_dedup.SPAN, x, strict=True)) for x in spans]


def test_every_factor_is_verbatim_in_its_reference(make_docs):
    rng = random.Random(16)
    shared = [prose(rng, n) for n in (30, 80, 200)]
    rows = []
    for k in range(120):
        w = rng.choice(shared).split()
        a = rng.randrange(0, 20)
        rows.append((k, " ".join([prose(rng, rng.randrange(0, 30)), *w[a : a + rng.randrange(13, 150)], prose(rng, 5)])))
    rows += [(300, prose(rng, 10, 3) * 9), (301, prose(rng, 10, 3) * 9)]
    texts = {i: t.split() for i, t in rows}
    seen = 0
    for r in substring_dedup.drop_passages(make_docs(rows)).collect():
        for f in r._spans:
            seen += 1
            assert f.ref_doc < r.doc_id and f.length >= 13
            assert texts[r.doc_id][f.start : f.start + f.length] == texts[f.ref_doc][f.ref_start : f.ref_start + f.length]
            # greedy: a factor ends only where its reference goes on otherwise
            ahead, there = texts[r.doc_id][f.start + f.length :], texts[f.ref_doc][f.ref_start + f.length :]
            assert not ahead or not there or ahead[0] != there[0] or any(g.start == f.start + f.length - 12 for g in r._spans)
    assert seen > 100


def test_one_doc_id_with_several_texts(make_docs):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(20))
    out = substring_dedup.drop_passages(make_docs([(1, a), (2, "x y " + a), (2, b), (3, b + " end")])).collect()
    assert sorted((r.doc_id, r._n_words, r._n_removed) for r in out) == [(1, 30, 0), (2, 20, 0), (2, 32, 30), (3, 21, 20)]


def test_hot_passages_and_very_long_texts(make_docs):
    rng = random.Random(17)
    hot, long = prose(rng, 25), prose(rng, 60_000, 10**6)
    rows = [(k, prose(rng, 9, 10**6) + " " + hot) for k in range(300)] + [(900, long), (901, "y " + long)]
    check(make_docs(rows), rows)
