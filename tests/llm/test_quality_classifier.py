import random
import zlib

import numpy as np
import pytest

from siltstone.llm import quality_classifier as C
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(rng, n):
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.6
        text = prose(rng, rng.randrange(20, 120)) + "." if good else " | ".join(prose(rng, rng.randrange(20, 120)).upper().split())
        rows.append((k, text))
        labels.append((k, int(good), 0))
    return rows, labels


def test_learns_and_held_out_labels_change_nothing(spark, make_docs):
    rows, labels = corpus(random.Random(8), 600)
    docs = make_docs(rows)
    rules = C.fit(docs, spark.createDataFrame(labels, LABELS))
    out = {r.doc_id: r for r in C.score(docs, rules).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in out.items() if r.held_out} == set(held)
    assert np.mean([out[k].predicted == labels[k][1] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    wrong = [(k, 1 - q if k in set(held) else q, t) for k, q, t in labels]
    assert C.fit(docs, spark.createDataFrame(wrong, LABELS)) == rules
    assert rules.rules and len(rules.rules) < 200


def test_column_equals_the_rules_in_numpy(spark, make_docs):
    rows, labels = corpus(random.Random(9), 300)
    docs = make_docs(rows)
    rules = C.fit(docs, spark.createDataFrame(labels, LABELS))
    stats = C.statistics(docs.text)
    got = C.score(docs, rules).select("doc_id", "score", *[c.alias(n) for n, c in stats.items()]).collect()
    for r in got:
        z = rules.bias + sum(w for tests, w in rules.rules if all((r[n] > e) == over for n, over, e in tests))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_degenerate_labels_nulls_and_empty_tables(spark, make_docs, empty_docs):
    docs = make_docs([(1, None), (2, ""), (3, "x"), (None, "y")]).selectExpr("*", "1 AS score", "2 AS `words`")
    none = spark.createDataFrame([], LABELS)
    out = C.score(docs, C.fit(docs, none)).collect()
    assert len(out) == 4 and {r.score for r in out} == {0.5} and not [r for r in out if r.doc_id is None][0].held_out
    ones = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 0), (4, None, 0)], LABELS)
    assert all(r.score > 0.5 for r in C.score(docs, C.fit(docs, ones)).collect())
    assert C.score(empty_docs, C.fit(empty_docs, none)).count() == 0


def test_lasso_meets_the_conditions_of_its_optimum():
    rng = np.random.default_rng(2)
    r = (rng.random((600, 12)) < rng.uniform(0.2, 0.8, 12)).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + r[:, 2] * r[:, 3])))).astype(float)
    w, b = C._lasso(r, y, steps=20_000)
    slope = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert abs((1 / (1 + np.exp(-(r @ w + b))) - y).mean()) < 1e-6
    for s, x in zip(slope, w, strict=True):
        assert abs(s + C.PENALTY * np.sign(x)) < 1e-5 if x else abs(s) <= C.PENALTY + 1e-6
    assert (w == 0).any() and w[0] > 0 > w[1]


def test_a_tree_splits_where_squared_error_falls_most():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    target = (x[:, 2] > 0.3) * 1.0 + (x[:, 0] > -0.5) * 0.4 + rng.normal(size=300) * 0.1
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(4)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    found = []
    C._grow(x, edges, bins, target, np.arange(300), 0, (), found)
    loss = lambda rows: ((target[rows] - target[rows].mean()) ** 2).sum()

    def best(rows):
        tries = [(loss(rows[x[rows, j] <= e]) + loss(rows[x[rows, j] > e]), j, e) for j in range(4) for e in edges[j] if C.LEAF <= (x[rows, j] <= e).sum() <= len(rows) - C.LEAF]
        return min(tries)[1:]

    for path, mean, _ in found:
        rows = np.flatnonzero(C._holds(path[:-1], x))
        assert path[-1][0] == best(rows)[0] and path[-1][2] == pytest.approx(best(rows)[1])
        assert mean == pytest.approx(target[C._holds(path, x)].mean())


def test_repeated_rows_long_texts_and_empty_tables(spark, make_docs, empty_docs):
    rows = [(k, ("fine words stand here. " if k % 2 else "### $$$ %% ") * (k + 3)) for k in range(120)] + [(1, "another text of the same id"), (500, "word " * 200_000), (501, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    docs = make_docs(rows)
    rules = C.fit(docs, labels)
    out = C.score(docs, rules).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert C.fit(docs, labels) == C.fit(docs.repartition(7), labels.repartition(3))
    assert C.keep_good(docs, rules).columns == docs.columns
    none = C.fit(empty_docs, labels.limit(0))
    assert none.rules == [] and C.score(empty_docs, none).count() == 0
