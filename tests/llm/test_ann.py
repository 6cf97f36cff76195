import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import ann

VECTORS = "vec_id long, embedding array<float>, label int"


def exact(rows, k, step):
    best = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None:
            best[i] = min(best.get(i, v), v)
    ids = np.array(sorted(best))
    x = np.array([best[i] for i in ids], np.float32).astype(float)
    out = {}
    for n, i in enumerate(ids):
        if i % step == 0:
            s = np.einsum("ij,j->i", x, x[n])
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(spark, rows, k=20, step=20):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    out = {}
    for r in sorted(ann.search(df, F.col("vec_id") % step == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_random_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=32) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(9000)]
    want, got = exact(rows, 20, 200), found(spark, rows, step=200)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q, v in got.items() for i, s in v if i in scores[q])


def test_few_candidates_ties_and_invalid_vectors_are_exact(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(20 * k, same) for k in range(30)] + [(7, [0.0, 0.0, 0.0]), (8, None), (9, [1.0, None, 2.0]), (10, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0]), (None, same), (12, [3.0, 1.0, 1.0]), (12, [2.0, 9.0, 1.0])]
    assert found(spark, rows) == exact(rows, 20, 20)
    few = rows[:3]
    assert found(spark, few) == exact(few, 20, 20)


def test_other_length_and_empty_table(spark):
    assert found(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0])]) == {0: [(2, 4.0)]}
    assert found(spark, []) == {}


def test_parallel_error_is_smaller_than_by_plain_assignment():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    book = ann.Codebook.fit(x)
    part = lambda codes: np.abs(((book.split(x) - np.stack([book.words[j][codes[:, j]] for j in range(32)], axis=1)) * book.split(x)).sum(axis=(1, 2))).mean()
    assert part(book.assign(x)) < 0.9 * part(book.assign(x, turns=0))


def test_many_blocks_parts_and_turns(spark, monkeypatch):
    """Vectors around centres: a query scans some of the parts, in several turns, each part over several blocks."""
    for name, value in (("BLOCK", 300), ("PART", 100), ("ASK", 40 * 16 * 8), ("SAMPLE", 3000)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(40, 16)) * 3
    rows = [(i, (middle[i % 40 if i % 3 else 0] + rng.normal(size=16) * 0.4).astype(np.float32).tolist()) for i in range(6000)]
    seen = []
    monkeypatch.setattr(ann, "scan", lambda *a, scan=ann.scan: seen.append(a[4]) or scan(*a))
    want, got = exact(rows, 20, 50), found(spark, rows, step=50)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9
    assert len(seen) > 1 and max(seen) < 30 and all(len(v) == 20 for v in got.values())


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.select("vec_id", "embedding").collect()]
    want, got = exact(rows, 20, 20), {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.98


def test_doubles_are_scored_as_they_are(spark):
    rows = [(k, [1.0 + k * 1e-12, 0.1]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(ann.search(df, F.col("vec_id") == 0, 3).collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in got] == [49, 48, 47]
    assert got[0].score == (1.0 + 49e-12) * 1.0 + 0.1 * 0.1


def test_one_vector_that_a_third_of_all_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 200)
    rng = np.random.default_rng(9)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).astype(np.float32).tolist()) for i in range(3000)]
    want, got = exact(rows, 20, 300), found(spark, rows, step=300)
    assert {q: [i for i, _ in v] for q, v in got.items() if q % 3 == 0} == {q: [i for i, _ in v] for q, v in want.items() if q % 3 == 0}


def test_all_of_the_nearest_whatever_the_vectors(spark, monkeypatch):
    """Few components that count, lengths that differ much, and queries that lie apart from all other rows: none of the nearest is missed."""
    monkeypatch.setattr(ann, "PART", 400)
    rng = np.random.default_rng(12)
    n, d = 9000, 32
    few = np.hstack([rng.normal(size=(n, 3)), rng.normal(size=(n, d - 3)) * 0.01])
    long = rng.normal(size=(n, d)) * np.exp(1.5 * rng.normal(size=(n, 1)))
    middle = rng.normal(size=(60, d))
    apart = np.where((np.arange(n) % 100 == 0)[:, None], rng.normal(size=(n, d)) + 4, middle[np.arange(n) % 60] + 0.05 * rng.normal(size=(n, d)))
    for x in (few, long, apart):
        rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
        want, got = exact(rows, 20, 100), found(spark, rows, step=100)
        assert {q: {i for i, _ in v} for q, v in got.items()} == {q: {i for i, _ in v} for q, v in want.items()}
