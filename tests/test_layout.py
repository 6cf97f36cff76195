"""Layout, locating, ordered decisions and models against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import metrics, models
from siltstone.operators import chunking, fusion, layout, pages, parsing, questions, reports, vector
from siltstone.sources import files, sinks


def rows(spark, values, shape):
    return spark.createDataFrame(values, shape)


def plain_clusters(rects, gap):
    root = {r[0]: r[0] for r in rects}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rects:
        for b in rects:
            if a[0] < b[0] and max(a[1], b[1]) - min(a[3], b[3]) <= gap and max(a[2], b[2]) - min(a[4], b[4]) <= gap:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("gap", [0.0, 4.0, 40.0])
def test_rect_clusters_equal_plain_ones(spark, gap):
    rng = random.Random(2)
    rects = [(k, *(a := (rng.uniform(0, 600), rng.uniform(0, 800))), a[0] + rng.uniform(0, 30), a[1] + rng.uniform(0, 30)) for k in range(70)]
    rects.append((99, 100.0, 100.0, 580.0, 101.0))
    got = {r.id: r.cluster for r in layout.rect_clusters(rows(spark, [("p", *r) for r in rects], "page string, id long, x0 double, y0 double, x1 double, y1 double"), "page", gap).collect()}
    assert got == plain_clusters(rects, gap)


def test_regions_with_captions(spark):
    paths = [("p", k, 100.0, 100.0 + 20 * k, 300.0, 101.0 + 20 * k, 1.0) for k in range(6)]
    paths += [("p", 10 + k, 120.0 + k, 130.0, 125.0 + k, 140.0, 1.0) for k in range(4)]  # within the table
    paths += [("p", 20 + k, 400.0 + 20 * k, 500.0, 415.0 + 20 * k, 560.0, 1.0) for k in range(3)]
    paths += [("p", 30, 10.0, 700.0, 90.0, 790.0, 1.0), ("p", 31, 500.0, 10.0, 500.5, 200.0, 5.0)]
    words = [("p", 1, "cell", 110.0, 110.0, 130.0, 118.0), ("p", 2, "Table", 110.0, 215.0, 130.0, 225.0), ("p", 3, "3.1", 135.0, 215.0, 150.0, 225.0), ("p", 4, "Figure", 420.0, 460.0, 450.0, 470.0), ("p", 5, "2:", 455.0, 460.0, 460.0, 470.0)]
    images = [("p", 50.0, 300.0, 60.0, 310.0), ("p", 50.0, 400.0, 100.0, 450.0)]
    box = "x0 double, y0 double, x1 double, y1 double"
    got = layout.regions(rows(spark, paths, f"page string, id long, {box}, stroke double"), rows(spark, images, f"page string, {box}"), rows(spark, words, f"page string, pos long, text string, {box}"), "page")
    found = {r.kind: (r.x0, r.y0, r.x1, r.y1, r.caption, r.label) for r in got.collect()}
    assert found == {
        "line_table": (100.0, 100.0, 300.0, 201.0, "Table 3.1", "Table 3.1"),
        "diagram": (400.0, 500.0, 455.0, 560.0, "Figure 2:", "Figure 2"),
        "image": (50.0, 400.0, 100.0, 450.0, "", "Image"),
    }


def test_span_ends_at_the_tail_or_by_length(spark):
    page = "the quick brown fox jumps over the lazy dog while nobody is looking at the garden of the old house"
    cases = [(page[10:80], (10, 80)), (page[10:40] + " and then something else", (10, 64)), ("absent text of some length", None), ("fox jumps over the lazy", (16, 39)), ("short", None)]
    for needle, want in cases:
        got = spark.range(1).select(layout.span_of(F.lit(needle), F.lit(page)).alias("s")).first().s
        assert (got and (got.start, got.end)) == want


def test_semantic_duplicates_are_decided_in_order(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 12))
    data = [(k, (base[k % 6] + rng.normal(size=12) * 0.35).tolist(), k % 5 != 0) for k in range(60)]
    got = {r.key for r in questions.said_before(rows(spark, data, "key long, vector array<double>, standing boolean"), 0.85).collect()}
    accepted, want = [], set()
    for k, v, standing in data:
        near = any(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.85 for w in accepted)
        if near:
            want.add(k)
        elif standing:
            accepted.append(v)
    assert got == want and 0 < len(want) < 60


def test_first_places_and_alike(spark):
    rng = np.random.default_rng(5)
    found = np.round(rng.normal(size=(9, 200)), 1)
    assert (vector._first(found, 7) == np.argsort(-found, axis=1, kind="stable")[:, :7]).all()
    data = [(f"k{k}", rng.normal(size=5).tolist()) for k in range(40)] + [("none", None), ("zero", [0.0] * 5)]
    df = rows(spark, data, "key string, v array<double>")
    got = {(r.a, r.b) for r in vector.alike(df, df, "key", "v", 0.4).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in data[:40]}
    assert got == {(a, b) for a in unit for b in unit if a != b and round(float(unit[a] @ unit[b]), 6) >= 0.4}


def test_generated_questions_are_numbered_and_cut(spark):
    text = "The valve opens at five bars of pressure. The pump starts after the valve opens fully. A red lamp shows that the pump is running. Nobody may enter the hall while it runs."
    docs = rows(spark, [(1, [(text, [1, 2])]), (2, [(text, [1]), (text + " More words follow in this sentence here.", [2])]), (3, [])], "doc long, chunks array<struct<text:string,pages:array<int>>>")
    got = sorted(questions.generate(docs, "doc", F.col("chunks"), 3, models.TemplateQuestions).collect(), key=lambda r: r.id)
    assert {r.doc for r in got if r.doc == 1} == {1} and all(r.reason == "valid" for r in got)
    assert [r.id for r in got if r.doc == 1] == ["1_q001", "1_q002", "1_q003"] and all(r.page_reference in ("Page 1", "Multiple pages") for r in got)
    # the same questions of another document are exact duplicates
    assert len([r for r in got if r.doc == 2]) <= 1


def test_answers_are_one_plan(spark):
    asked = rows(spark, [(1, "pump pressure valve"), (2, "red lamp")], "id long, q string")
    held = rows(spark, [(k, t) for k, t in enumerate(["the valve has a pump pressure. It holds.", "a red lamp shines. Always.", "nothing at all here. Really.", "other words stand. Here."])], "doc long, text string")
    got = {r.id: r for r in fusion.answers(asked, "id", "q", held, "doc", "text", models.embedding, models.generation, 1).collect()}
    assert "valve has a pump" in got[1].prompt and "red lamp shines" in got[2].reply and got[1].error is None


def test_models_fail_and_fall_back(spark):
    class Failing:
        def __init__(self):
            self.left = 2

        def run(self, prompts):
            self.left -= 1
            if self.left >= 0:
                raise OSError("busy")
            return ["ok"] * len(prompts)

        def read(self, images):
            raise OSError("no engine")

        def embed(self, texts):
            raise ValueError("no model")

    df = rows(spark, [("a",)], "t string").coalesce(1)
    assert df.select(models.generation(F.col("t"), Failing)["reply"]).first()[0] == "ok"
    assert df.select(models.generation(F.col("t"), Failing, attempts=2)["error"]).first()[0] == "OSError: busy"
    assert df.select(models.embedding(F.col("t"), Failing, zeros=3)).first()[0] == [0.0, 0.0, 0.0]
    assert df.select(models.recognised(F.encode("t", "UTF-8"), [Failing, models.PlainBytes])).first()[0] == "a"
    assert models.available(lambda: 1) and not models.available(lambda: Failing().read([]))
    with pytest.raises(ConnectionError):
        models.available(lambda: Failing().read([]), required=True)
    scores = df.select(metrics.embedding_score(F.lit("a b"), F.lit("a b")).alias("same"), metrics.embedding_score(F.lit(""), F.lit("x")).alias("none"), metrics.ragas().alias("r")).first()
    assert scores.same.f1 == pytest.approx(1.0) and scores.none.f1 == 0.0 and set(scores.r) == {0.0}


def test_context_of_a_model_falls_back_to_the_template(spark):
    got = rows(spark, [("One thing. Two things.",), ("",)], "t string").select(chunking.model_context(F.col("t"), lambda: models.FirstSentences(1), F.lit("T\n"))).collect()
    assert [r[0] for r in got] == ["One thing.\n\nOne thing. Two things.", "T\n"]
    assert parsing.model_headings(F.lit("")) is not None


def test_vision_answers(spark):
    said = ['{"type": "Table "}', '{"type": "photo"}', '```json\n{"type": "cover"}\n```', "a diagram of a table", "[1]", "", None]
    got = [r[0] for r in rows(spark, [(s,) for s in said], "s string").select(pages.vision_type(F.col("s"))).collect()]
    assert got == ["table", "unknown", "cover", "table", "unknown", "unknown", "unknown"]


def test_histogram_of_one_value_and_box_outliers(spark):
    one = reports.histogram(rows(spark, [(3.0,)] * 4, "v double"), "v", 5).orderBy("bin").collect()
    assert [r.n for r in one] == [4, 0, 0, 0, 0]
    box = reports.boxes(rows(spark, [("a", float(v)) for v in [*range(10), 100]], "g string, v double"), "g", "v").first()
    assert (box.low, box.median, box.high, box.outliers) == (0.0, 5.0, 9.0, 1)


def test_progress_spool_uploads_and_retries(spark, tmp_path):
    data = rows(spark, [(k, "x") for k in range(60)], "id long, v string")
    assert [sinks.write_progress(data.where(f"id < {n}"), f"{tmp_path}/p", "id") for n in (30, 30, 60)] == [30, 0, 30]
    assert spark.read.parquet(f"{tmp_path}/p").count() == 60
    assert sinks.write_spool(data, data.where("id < 5"), f"{tmp_path}/s") == 65 and files.spool_complete(spark, f"{tmp_path}/s")
    kept, broken = files.chunk_spool(spark, f"{tmp_path}/s", "chunk_type string, id long, v string")
    assert kept.count() == 65 and broken.isEmpty()
    assert sinks.save_upload(spark, "../a\\b/c.txt", b"hello", str(tmp_path)).endswith("/c.txt") and (tmp_path / "c.txt").read_bytes() == b"hello"
    tries = []

    def write():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

    assert sinks.retried(write, wait=0) and len(tries) == 3 and not sinks.retried(lambda: 1 / 0, 2, 0)
    assert files.read_model(spark, f"{tmp_path}/none").count() == 0


def test_copies_of_boxes_make_no_pairs(spark, monkeypatch):
    """Clusters of many equal boxes are found from one of each; names, boxes on other pages and broken ones stay right."""
    seen = []
    monkeypatch.setattr(layout, "near_rects", lambda rects, *a, near=layout.near_rects: seen.append(rects.count()) or near(rects, *a))
    rects = [(1000 - k, 10.0 * (k % 3), 0.0, 10.0 * (k % 3) + 5, 5.0) for k in range(300)] + [(5, 300.0, 300.0, 310.0, 310.0), (4, 300.0, 300.0, 310.0, 310.0), (2000, 90.0, 0.0, 50.0, 5.0), (2001, 90.0, 0.0, 50.0, 5.0)]
    shape = "page string, id long, x0 double, y0 double, x1 double, y1 double"
    both = [("p", *r) for r in rects] + [("q", 7, 0.0, 0.0, 5.0, 5.0), ("p", 3000, None, 0.0, 1.0, 1.0)]
    got = {r.id: r.cluster for r in layout.rect_clusters(rows(spark, both, shape), "page", 5.0).collect()}
    assert got == plain_clusters(rects, 5.0) | {7: 7, 3000: 3000} and max(seen) == 5


def test_captions_of_equal_boxes_and_words(spark):
    """A word counts for each of the equal boxes, as far as a caption goes, however many words share a place."""
    boxes = [("p", "image", 0.0, 0.0, 50.0, 50.0)] * 2
    words = [("p", k, f"w{k}", 0.0, 60.0, 9.0, 70.0) for k in range(100)]
    shape = "x0 double, y0 double, x1 double, y1 double"
    got = layout.captioned(rows(spark, boxes, f"page string, kind string, {shape}"), rows(spark, words, f"page string, pos long, text string, {shape}"), "page").collect()
    assert [r.caption for r in got] == [" ".join(f"w{k} w{k}" for k in range(15))] * 2


def test_near_rects_shuffle_no_pairs(spark):
    """Every pair once, without a shuffle of pairs to make them distinct."""
    rng = random.Random(6)
    rects = [("p", k, *(a := (rng.uniform(0, 600), rng.uniform(0, 800))), a[0] + rng.uniform(0, 90), a[1] + rng.uniform(0, 90)) for k in range(150)]
    near = layout.near_rects(rows(spark, rects, "page string, id long, x0 double, y0 double, x1 double, y1 double"), "page", 12.0)
    got = [(r.a, r.b) for r in near.collect()]
    want = {(a[1], b[1]) for a in rects for b in rects if a[1] < b[1] and max(a[2], b[2]) - min(a[4], b[4]) <= 12 and max(a[3], b[3]) - min(a[5], b[5]) <= 12}
    assert len(got) == len(set(got)) and set(got) == want
    plan = near._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in plan


def test_boxes_of_spans_and_words_of_one_place(spark):
    """Equal spans and words of one place are met once; spans over several stretches and ids of two spans keep their whole box."""
    rng = random.Random(7)
    spans = [("p", k % 40, s := rng.choice([0, 5, 60, 700]), s + rng.choice([4, 40, 300])) for k in range(60)]
    words = [("p", f := rng.randrange(0, 1000, 7), f + 5, *(float(rng.randrange(500)) for _ in range(4))) for _ in range(900)]
    got = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in layout.boxes_of(rows(spark, spans, "page string, id long, start long, end long"), rows(spark, words, "page string, from long, to long, x0 double, y0 double, x1 double, y1 double"), "page").collect()}
    want = {}
    for _, i, start, end in spans:
        met = [w[3:] for w in words if w[2] > start and w[1] < end]
        old = want.get(i)
        met += [old] if old else []
        if met:
            want[i] = (min(m[0] for m in met), min(m[1] for m in met), max(m[2] for m in met), max(m[3] for m in met))
    assert got == want


def test_plans_do_not_grow_with_the_turns(spark):
    """A chain of many turns: each row is alike to the one before it only, so every second one stands."""
    n = 24
    data = [(k, [1.0 if j in (k, k + 1) else 0.0 for j in range(n + 1)], True) for k in range(n)]
    got = questions.said_before(rows(spark, data, "key long, vector array<double>, standing boolean"), 0.5)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 40_000
    assert {r.key for r in got.collect()} == set(range(1, n, 2))
