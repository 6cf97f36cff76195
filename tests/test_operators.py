import math
import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.functions import metrics as M
from siltstone.functions import models
from siltstone.functions import text as T
from siltstone.operators import dedup, evaluation, fusion, layout, pages, parsing, questions, sparse, vector


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("The Été, where 2 cats ran!"))) == ["été", "2", "cats", "ran"]
    assert one(spark, T.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    for name in ("abc_child_1", "ünïcode"):
        assert one(spark, T.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, T.compose(F.lit("ﬁ\nx‐y"))) == "fi x-y"
    assert one(spark, T.finite(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(float("inf"))))) == [1.0, 0.0, 0.0]


def test_fusion_is_symmetric_and_breaks_ties(spark):
    a = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2)], "q int, k string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 3.0, 1), (1, "z", 2.0, 2)], "q int, k string, score double, rank int")
    out, swapped = (sorted(values(fusion.fuse(*x, "q", "k", 10).select("k", "score", "rank"))) for x in ((a, b), (b, a)))
    assert out == swapped
    assert [k for k, _, _ in sorted(out, key=lambda r: r[2])] == ["y", "x", "z"]
    assert out[1][1] == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-9)


def test_expansion_and_filter(spark):
    assert one(spark, fusion.expand(F.lit("main topic"))) == "main topic artificial intelligence machine learning deep learning"
    rows = spark.createDataFrame([("a", 5), ("b", 9)], "t string, n int")
    assert fusion.metadata_filter(rows, {"t": []}, {"n": None}).count() == 2 and values(fusion.metadata_filter(rows, {"t": ["a", "b"]}, {"n": 6})) == [("b", 9)]


def test_ranking_metrics_and_summaries(spark):
    rows = evaluation.ranking_metrics(spark.createDataFrame([(1, 1), (2, 4), (3, None)], "q int, rank int"))
    out = {r.q: r for r in rows.collect()}
    assert (out[1].mrr, out[2].mrr, out[3].mrr) == (1.0, 0.25, 0.0) and out[2].precision_at_5 == 0.2 and out[2].hit_at_3 == 0.0
    assert out[2].ndcg_at_5 == pytest.approx(1 / math.log2(5)) and out[3].found == 0.0
    assert all(out[q].mrr <= out[q].recall_at_10 and out[q].ndcg_at_1 <= out[q].ndcg_at_10 for q in (1, 2))
    stats = evaluation.metric_summary(rows, ["rank", "mrr"]).where("metric = 'rank'").first()
    assert (stats.n, stats.mean, stats["std"], stats["median"]) == (2, 2.5, 1.5, 2.5)
    lat = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 10.0)], "latency double")
    assert evaluation.latency_stats(lat).first().p95 == 9.1


def test_partition_count_changes_nothing(spark):
    docs = spark.createDataFrame([(k, f"alpha beta w{k % 7} w{k % 3}") for k in range(50)], "id long, t string")
    model = sparse.fit(docs, "t")
    runs = [sorted(values(sparse.search(docs.where("id < 5").repartition(n).select(F.col("id").alias("q"), "t"), "q", "t", sparse.postings(docs.repartition(n), "id", "t", model), "id", model, 5))) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_dense_search_equals_expression(spark):
    rows = spark.createDataFrame([(k, [float((k * 7) % 5 - 2), float(k % 3), 1.0]) for k in range(30)] + [(99, None)], "id long, embedding array<double>")
    queries = rows.where("id < 3").select(F.col("id").alias("q"), "embedding")
    fast = sorted(values(vector.top_k_cosine(queries, "q", rows, "id", k=4).select("q", "id", "rank")))
    pairs = queries.withColumnRenamed("embedding", "e").join(rows.where("embedding IS NOT NULL"), F.lit(True)).select("q", "id", F.round(vector.cosine(F.col("e"), F.col("embedding")), 6).alias("s"))
    assert fast == sorted(values(sparse.top_k(pairs, "q", "id", F.col("s"), 4).select("q", "id", "rank")))


def test_murmur_known_values_and_greedy_dedup(spark):
    import numpy as np

    assert dedup.murmur3([b"abcd"], np.array([42], np.uint32))[0, 0] == -396302900
    assert dedup.murmur3([b"", b"abcd"], np.array([1], np.uint32)).view(np.uint32)[0, 0] == 0x514E28B7
    base = "the quick brown fox jumps over the lazy dog and runs through the wide open field of golden wheat " * 3
    texts = [base, base + "x", "entirely different content about astronomy and stars " * 4, base, base + " yz", ""]
    signed = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", dedup.signature("t").alias("signature")).checkpoint()
    got = {r.id: (r.kept, r.duplicate_of) for r in dedup.keep_first(signed, "id").collect()}
    signatures = {r.id: r.signature for r in signed.collect()}
    kept = []
    for k in sorted(signatures):
        same = [j for j in kept if sum(a == b for a, b in zip(signatures[j], signatures[k], strict=True)) / 128 >= 0.8]
        assert got[k][0] == (not same), k
        if not same:
            kept.append(k)


def test_greedy_is_not_components(spark):
    sig = lambda n: [0] * (128 - n) + [1] * n
    rows = [(1, sig(0)), (2, sig(20)), (3, sig(40)), (4, sig(60)), (5, sig(0))]
    signed = spark.createDataFrame(rows, "id long, signature array<int>")
    assert sorted((r.id, r.kept) for r in dedup.keep_first(signed, "id").collect()) == [(1, True), (2, False), (3, True), (4, False), (5, False)]


@pytest.mark.parametrize("bucket", [64, 1])
def test_large_buckets_are_decided_alike(spark, monkeypatch, bucket):
    import random

    monkeypatch.setattr(dedup, "BUCKET", bucket)
    rng = random.Random(5)
    base = [rng.randrange(9) for _ in range(128)]
    rows = [(k, [x if rng.random() > 0.15 else rng.randrange(9) for x in base]) for k in range(60)]
    signed = spark.createDataFrame(rows, "id long, signature array<int>")
    got = {r.id: r.kept for r in dedup.keep_first(signed, "id").collect()}
    kept = []
    for k, s in rows:
        if not any(sum(a == b for a, b in zip(s, rows[j][1], strict=True)) / 128 >= 0.8 for j in kept):
            kept.append(k)
    assert [k for k in sorted(got) if got[k]] == kept


def test_parsers(spark):
    raw = "**Answer:** It is\nblue.\n**Evidence:** page 2\n**Confidence:** High to Low\n**Missing Info:** year"
    p = one(spark, parsing.structured_answer(F.lit(raw)))
    assert (p.answer, p.evidence, p.confidence, p.safety_notes, p.missing_info) == ("It is\nblue.", "page 2", "High", "None", "year")
    assert one(spark, parsing.structured_answer(F.lit(" plain "))).answer == "plain"
    s = lambda *x: dict(zip(parsing.SCORES, x, strict=True))
    assert parsing.judge_scores('```json\n[{"faithfulness": 12, "completeness": -1, "correctness": 5}]\n```', 2) == [s(10, 0, 5), s(0, 0, 0)]
    assert parsing.judge_scores('{"scores": [{"faithfulness": 1, "completeness": 2, "correctness": 3}]}', 1) == [s(1, 2, 3)]
    assert parsing.judge_scores('First {"faithfulness": 7, "completeness": 8, "correctness": 9} [broken', 1) == [s(7, 8, 9)]
    assert parsing.judge_scores("1. scores: 7, 8, 11", 1) == [s(7, 8, 11)] and parsing.judge_scores(None, 1) == [s(0, 0, 0)]
    assert parsing.claims('{"claims": 4, "hallucinated": 1}', 2)[0]["rate"] == 0.25 and parsing.claims("junk", 1)[0]["rate"] == 0.0
    assert one(spark, parsing.json_list(F.lit('ok ```json [{"a": 1}] ```'), "array<struct<a:int>>"))[0].a == 1


def test_text_metrics(spark):
    assert M.sentence_bleu("the cat sat on the mat".split(), "the cat sat on the mat".split()) == pytest.approx(1.0)
    assert 0 < M.sentence_bleu("the cat".split(), "the cat sat".split()) < 1 and M.sentence_bleu([], ["a"]) == 0.0
    assert M.exact_meteor("a b c".split(), "a b c".split()) == pytest.approx(1 - 0.5 / 27)
    assert one(spark, M.rouge_n(F.lit("a b b c"), F.lit("b b d"), 1)) == pytest.approx(4 / 7)
    assert one(spark, M.rouge_l(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("c")))) == pytest.approx(0.8)
    long = "the red fox jumped over the lazy dog and ran far into the dark wood until the morning came and it slept " * 2
    assert M.fuzzy_holds(long, "see: " + long.replace("fox", "f0x") + " then") and not M.fuzzy_holds(long, "blue whales sing " * 20)
    assert one(spark, M.contains_snippet(F.lit("ABC def"), F.lit("abc")))


def test_page_rules(spark):
    toc = "\n".join(f"Chapter {k} . . . . {k}" for k in range(9))
    assert one(spark, pages.toc_page(F.lit(toc))) and not one(spark, pages.toc_page(F.lit("short")))
    kind = lambda text, tables=0, images=0, f=pages.classify: one(spark, f(F.lit(text), F.lit(tables), F.lit(images))).page_type
    assert [kind("x"), kind(toc), kind("x", 0, 1), kind("x", 1, 1), kind("y" * 700, 1), kind("y " * 300), kind("y" * 180)] == ["cover", "toc", "image", "diagram", "mixed", "text", "unknown"]
    assert kind("All rights reserved. No warranty. " + "z" * 200, f=pages.classify_more) == "disclaimer"
    assert kind("\n".join("- item of the list number" for _ in range(9)), f=pages.classify_more) == "list"
    table = F.array(F.array(F.lit("a "), F.lit(None).cast("string")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, pages.serialise_table(table, F.lit(3))) == "[TABLE 3]\na | \n----\n1 | 2"
    assert one(spark, pages.route(F.lit("toc"), F.lit("t"), F.lit(None), F.lit(None), F.lit(None))) == ""
    assert one(spark, pages.vision_keyword(F.lit("A Diagram with a table"))) == "table"


def test_layout(spark):
    rects = spark.createDataFrame([(1, k, float(x), 0.0, float(x + 5), 5.0) for k, x in enumerate([0, 8, 16, 50, 57])], "page int, id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(values(layout.rect_clusters(rects, "page", 4.0).select("id", "cluster"))) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]
    chars = [(1, 1, 10.0, float(i), 18.0, c, i) for i, c in enumerate("Title")] + [(1, 1, 40.0, float(i), 10.0, c, 10 + i) for i, c in enumerate("body text here")]
    heads = pages.font_headings(spark.createDataFrame(chars, "doc int, page int, top double, x double, size double, text string, pos int"), "doc")
    assert [(r.text, r.level) for r in heads.collect()] == [("Title", 1)]
    marks = spark.createDataFrame([(1, 1, 0, 1, "A"), (1, 2, 1, 2, "A.1"), (1, 4, 2, 1, "B")], "doc int, page int, pos int, level int, title string")
    trail = pages.bookmark_trail(spark.createDataFrame([(1, p) for p in range(1, 5)], "doc int, page int"), marks, "doc")
    assert {r.page: r.trail for r in trail.collect()} == {1: ["A"], 2: ["A", "A.1"], 3: ["A", "A.1"], 4: ["B"]}


def test_questions(spark):
    schema = "n int, question string, answer string, question_type string, difficulty string, context string"
    rows = [(1, "What is this thing?", "a longer answer", "list", "easy", ""), (2, "what is this thing", "a longer answer", "list", "easy", ""), (3, "short", "a longer answer", "list", "easy", ""), (4, "What else is here then?", "one two three four five six", "list", "easy", "one nothing"), (5, "What else is there then?", "x", None, "easy", "")]
    out = {r.n: r.reason for r in questions.validate(spark.createDataFrame(rows, schema), "n").collect()}
    assert out == {1: "valid", 2: "exact duplicate", 3: "question too short", 4: "not grounded", 5: "missing question_type"}
    kinds = spark.createDataFrame([(k, "abc"[k % 3] if k > 4 else "a") for k in range(20)], "n int, kind string")
    assert sorted(r.n for r in questions.diverse(kinds, "kind", "n", 6).collect()) == [0, 1, 5, 7, 8, 10]
    assert questions.diverse(kinds, "kind", "n", 1).count() == 1
    assert one(spark, questions.unsure(F.lit("I Don't Know that"))) and not one(spark, questions.unsure(F.lit("sure")))


def test_models(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [round(sum(x * x for x in r[0]), 6) for r in df.select(models.embedding(F.col("t"))).collect()] == [1.0, 0.0, 0.0]

    class Broken:
        def run(self, prompts):
            raise ValueError("no")

    assert df.select(models.generation(F.col("t"), Broken, attempts=2).alias("g")).first().g.error == "ValueError: no"


def plain_fuzzy(snippet, content):
    """M8 and M9 of the survey, window by window."""
    import unicodedata
    from difflib import SequenceMatcher

    clean = lambda t: unicodedata.normalize("NFKC", t.lower()).translate({0x0A: " ", **dict.fromkeys(range(0x2010, 0x2014), "-")})
    snippet, content = clean(snippet), clean(content)
    n = len(" ".join(snippet.split()))
    return snippet in content or any(SequenceMatcher(None, snippet, content[k : k + n + 20]).ratio() >= 0.8 for k in range(len(content) - n))


def test_fuzzy_holds_equals_every_window():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(60)]
    seen = set()
    for _ in range(150):
        snippet = " ".join(rng.choices(words, k=rng.randint(1, 45)))
        near = "".join(x if rng.random() > rng.choice([0.02, 0.1, 0.2]) else rng.choice(["", "x", "e "]) for x in snippet)
        content = " ".join([*rng.choices(words, k=rng.randint(0, 25)), near[: rng.choice([len(near), len(near) * 3 // 4])], *rng.choices(words, k=rng.randint(0, 25))])
        want = plain_fuzzy(snippet, content)
        assert M.fuzzy_holds(snippet, content) == want, (snippet, content)
        seen.add(want)
    assert seen == {True, False}


def test_fuzzy_evidence_equals_brute_force(spark, tmp_path):
    from siltstone.plans import evaluate, search

    spread = lambda k, n: " ".join(f"word{k}x{j}" for j in range(n))
    one, two, three, four = ("".join(f" {a}{k} {b}" for k in range(8)).strip() for a, b in (("amber", "stone"), ("birch", "river"), ("cedar", "cloud"), ("delta", "flame")))
    texts = [
        # item 1: bags of the words outrank the passage itself
        *[" ".join(reversed(one.split()))] * 3, f"{one} {spread(1, 9)}",
        # item 2: begins as the passage does, and goes on otherwise
        f"{two[:70]} {spread(2, 30)}",
        # item 3: its line ends, dashes and ligatures differ
        three.replace(" ", "\n").replace("cedar3", "cedar‑3") + " ﬁ",
        # item 4: a character differs
        f"{spread(4, 5)} {four.replace('flame', 'fl4me', 1)} {spread(5, 5)}",
    ]
    items = [(1, one), (2, two), (3, three.replace("cedar3", "cedar-3") + " fi"), (4, four), (5, "nowhere")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = dict.fromkeys(dict(items))
    for r in sorted(search.sparse_topk(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        if r["rank"] <= 5 and want[r.item_id] is None and plain_fuzzy(dict(items)[r.item_id], texts[r.doc_id]):
            want[r.item_id] = r["rank"]
    assert want[1] in (3, 4, 5) and want[2] is None and want[3] and want[4] and want[5] is None
    assert dict(values(evaluate.fuzzy_evidence(spark, str(tmp_path)).select("item_id", "found_in_rank"))) == want


def test_signatures_of_words_equal_those_of_strings():
    """Shingles of four ASCII characters, hashed as single words, and all others give the least hash of every seed; no string is made for the former."""
    import numpy as np

    texts = ["the quick brown fox " * 3, "", "ab", "é", "日本語テキスト", "Ünïcode ẞ text İ ok", "\x00\x00\x00\x00a", "plain again é"]
    seeds = np.arange(dedup.PERMUTATIONS, dtype=np.uint32)
    want = [dedup.murmur3([s.encode() for s in sorted(dedup.shingles(t))], seeds).min(axis=0) for t in texts]
    assert all((a == b).all() for a, b in zip(dedup.signatures(texts), want, strict=True))


def test_pairs_far_apart_are_left_out_before_signatures_are_read(spark):
    """Chunks of one bucket whose sketches differ too much are not met; similar ones all are."""
    import random

    rng = random.Random(3)
    base = [[rng.randrange(1 << 30) for _ in range(dedup.PERMUTATIONS)] for _ in range(3)]
    signed = [(k, [v if rng.random() < 0.9 else rng.randrange(1 << 30) for v in base[k % 3]]) for k in range(45)]
    df = spark.createDataFrame(signed, "id long, signature array<int>")
    keys = df.select("id", dedup.sketch("signature").alias("s"), F.lit(1).alias("bucket"))
    met = keys.withColumnsRenamed({"id": "b", "s": "t"}).join(keys.withColumnRenamed("id", "a"), "bucket").where(dedup._may_agree(0.8))
    met = {(r.a, r.b) for r in met.collect()}
    want = {(a, b) for a, x in signed for b, y in signed if a < b and sum(p == q for p, q in zip(x, y, strict=True)) >= 0.8 * dedup.PERMUTATIONS}
    assert want and want <= met and all(a % 3 == b % 3 for a, b in met)
    assert {(r.a, r.b) for r in dedup.similar_pairs(keys.drop("s"), df, "id", 0.8, ("bucket",)).collect()} == want
