import math
import random
import re
from collections import Counter, defaultdict

import pytest

from siltstone.llm import quality_rules as Q
from tests.llm.conftest import prose


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    spots = defaultdict(list)
    for k in range(len(w) - 2):
        spots[tuple(w[k : k + 3])].append(k)
    covered = {j for p in spots.values() if len(p) > 1 for k in p for j in (k, k + 1, k + 2)}
    filled = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(filled) - len(set(filled)), len(covered)


def texts(rng):
    rows = [(k, prose(rng, rng.randrange(0, 120), 12)) for k in range(40)] + [(50 + k, prose(rng, 600, 9)) for k in range(4)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "a # b\na # b\n\n a # b\nx|y<é>"), (104, "one two three"), (105, "one two three one two three"), (106, "go " * 300)]
    return rows + [(107, prose(rng, 3000, 40)), (107, "again")]


def test_base_features_equal_a_plain_version(spark, make_docs):
    rows = texts(random.Random(2))
    out = Q.judge(make_docs(rows), spark.createDataFrame([(1,)], "doc_id long")).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted((i, *base(t)) for i, t in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_score_is_the_mean_log_ratio(spark, make_docs):
    rows = [(1, "good words here"), (2, "bad bad words"), (3, "good good good")]
    out = {r.doc_id: r.llr_score for r in Q.judge(make_docs(rows), spark.createDataFrame([(1,), (3,), (None,)], "doc_id long")).collect()}
    grams = lambda t: t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:], strict=False)]
    target, raw = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in (1, 3):
            target.update(grams(t))
    p = lambda c, g: math.log((c[g] + Q.ALPHA) / (sum(c.values()) + Q.ALPHA * Q.BUCKETS))
    for i, t in rows:
        assert out[i] == pytest.approx(sum(p(target, g) - p(raw, g) for g in grams(t)) / len(grams(t)), abs=1e-9)


def test_no_trusted_ids_and_empty_table(spark, make_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.llr_score for r in Q.judge(make_docs([(1, "a b c"), (2, "")]), none).collect()} == {0.0}
    assert Q.judge(empty_docs, none).count() == 0


def test_all_trusted_ids_make_the_target(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id % 7, ' v', id % 300) AS text")
    # the target of all ids is the raw corpus
    assert Q.weights(docs, docs.select("doc_id")).where("abs(weight) > 1e-12").isEmpty()
    third = docs.where("doc_id % 3 = 0").select("doc_id")
    kept = Q._of_ids(docs, third.withColumnRenamed("doc_id", "_listed"))
    assert kept.count() == third.count() and kept.where("doc_id % 3 <> 0").isEmpty()


def test_threshold_parts_the_labelled_documents(spark, make_docs):
    rng = random.Random(9)
    good = [(k, " ".join(f"g{rng.randrange(300)}" for _ in range(80))) for k in range(40)]
    bad = [(100 + k, " ".join(f"{'g' if rng.random() < 0.4 else 'b'}{rng.randrange(300)}" for _ in range(80))) for k in range(40)]
    docs = make_docs([*good, *bad, (300, "b1 b2"), (301, None)])
    ids = lambda rows: spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    out = {r.doc_id: r for r in Q.judge(docs, ids(good[:20]), ids([*bad[:20], (300, "")])).collect()}
    scores = [out[i].llr_score for i, _ in good[:20]], [out[i].llr_score for i, _ in bad[:20]]
    assert min(scores[0]) > max(scores[1])
    edge = (min(scores[0]) + max(scores[1])) / 2
    assert all(r.kept == (not r.base_failed and r.llr_score >= edge) for r in out.values())
    # without rejected documents, the least score of a trusted one
    alone = {r.doc_id: r.kept for r in Q.judge(docs, ids(good[:20])).collect()}
    assert all(alone[i] for i, _ in good[:20]) and sum(alone[i] for i, _ in bad) <= sum(out[i].llr_score >= min(scores[0]) for i, _ in bad)


@pytest.mark.parametrize("ranges", [None, 300])
def test_threshold_counts_every_labelled_document(spark, monkeypatch, ranges):
    if ranges:
        monkeypatch.setattr(Q, "RANGE", ranges)
    word = "concat(if(pmod(xxhash64(id, k), 100) < 40 + 4 * (id % 2), 'g', 'b'), pmod(xxhash64(k, id), 200))"
    docs = spark.range(13_000).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, 55), k -> {word}), ' ') AS text").cache()
    good, bad = (docs.where(f"doc_id % 2 = {y}").select("doc_id") for y in (1, 0))
    out = Q.judge(docs, good, bad).collect()
    rows = sorted((r.llr_score, r.doc_id % 2) for r in out if not r.base_failed)
    total = Counter(y for _, y in rows)
    # more of each than any sample that was ever drawn
    assert min(total.values()) > 6_000
    scores = sorted({x for x, _ in rows})
    below, gains, k = Counter(), [], 0
    for last, x in zip([None, *scores], scores, strict=False):
        while rows[k][0] < x:
            below[rows[k][1]] += 1
            k += 1
        gains.append((below[0] / total[0] + (total[1] - below[1]) / total[1], -(x if last is None else (x + last) / 2)))
    edge = -max(gains)[1]
    assert {r.doc_id for r in out if r.kept} == {r.doc_id for r in out if not r.base_failed and r.llr_score >= edge}
    scored = spark.createDataFrame(out).cache()
    assert Q.threshold_of(scored, good, bad) == edge
    assert Q.threshold_of(scored, good.where("doc_id < 0"), bad) == 0.0
    assert Q.threshold_of(scored, good, None) == min(x for x, y in rows if y)


def test_repeated_rows_very_long_texts_and_ties(spark, make_docs):
    long = prose(random.Random(1), 200_000, 5000)
    rows = [(1, long), (1, long), (2, "a b c " * 30), (2, "a b c " * 30), (3, "")]
    out = Q.judge(make_docs(rows), spark.createDataFrame([(1,)], "doc_id long"), spark.createDataFrame([(2,), (1,)], "doc_id long")).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == sorted((i, *base(t)) for i, t in rows)
    assert len({(r.doc_id, r.llr_score, r.kept) for r in out}) == 3
