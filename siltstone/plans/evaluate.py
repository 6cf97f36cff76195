"""Queries of metric summaries, groups, failures, systems and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import metrics, models
from siltstone.operators import evaluation, parsing, vector
from siltstone.plans.tables import EVALUATION_SQL, evaluation as rows_of, questions, table, words_sql

_METRICS = ["rank", "found", "mrr", "hit_at_5", "precision_at_5", "recall_at_5", "ndcg_at_10"]


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metric_summary(rows_of(spark, d).where("error IS NULL"), _METRICS)


_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count({m}) AS n, round(avg(CAST({m} AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST({m} AS DOUBLE)), 6) AS std, round(min(CAST({m} AS DOUBLE)), 6) AS min, round(max(CAST({m} AS DOUBLE)), 6) AS max, round(median(CAST({m} AS DOUBLE)), 6) AS median FROM e WHERE error IS NULL"
    for m in _METRICS
)


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency_stats(rows_of(spark, d))


def latency_by_system(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency_stats(rows_of(spark, d), by=["system"])


_LATENCY = "count(*) AS n, round(avg(latency), 6) AS mean, round(quantile_cont(CAST(latency AS DOUBLE), 0.5), 6) AS median, round(stddev_pop(latency), 6) AS std, round(min(latency), 6) AS min, round(max(latency), 6) AS max, round(quantile_cont(CAST(latency AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(latency AS DOUBLE), 0.99), 6) AS p99"


def by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_group(rows_of(spark, d), "question_type")


def by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_group(rows_of(spark, d), "difficulty")


def by_document(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_document(rows_of(spark, d))


_GROUP = "count(*) AS questions, round(avg(found), 6) AS success_rate, round(avg(mrr), 6) AS mean_mrr, round(avg(precision_at_5), 6) AS mean_precision_at_5"


def _group_sql(c: str) -> str:
    return f"WITH {EVALUATION_SQL} SELECT coalesce({c}, 'unknown') AS {c}, {_GROUP} FROM e WHERE error IS NULL GROUP BY 1"


def grouping_sets_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.by_groups(rows_of(spark, d), ["question_type", "difficulty", "document"])


_SETS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'unknown') AS value, {_GROUP} FROM e WHERE error IS NULL GROUP BY 2" for c in ("question_type", "difficulty", "document"))


def latency_quartile_bins(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency_bins(rows_of(spark, d))


_BINS_SQL = """, p AS (SELECT quantile_cont(CAST(latency AS DOUBLE), 0.25) AS a, quantile_cont(CAST(latency AS DOUBLE), 0.5) AS b, quantile_cont(CAST(latency AS DOUBLE), 0.75) AS c FROM e),
b AS (SELECT CASE WHEN latency <= a THEN 'fast' WHEN latency <= b THEN 'medium' WHEN latency <= c THEN 'slow' ELSE 'very_slow' END AS bin, recall_at_5 FROM e, p),
n AS (SELECT unnest(['fast', 'medium', 'slow', 'very_slow']) AS bin)
SELECT n.bin, count(recall_at_5) AS n, round(coalesce(avg(recall_at_5), 0.0), 6) AS mean FROM n LEFT JOIN b ON b.bin = n.bin GROUP BY 1"""


def failure_analysis(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.failures(rows_of(spark, d), ["question_type", "difficulty"])


_FAILURE = "count(*) FILTER (WHERE found = 0) AS failures, count(*) AS questions, round(count(*) FILTER (WHERE found = 0) / count(*), 6) AS failure_rate"
_FAILURES_SQL = f"SELECT 'all' AS dimension, 'all' AS value, {_FAILURE} FROM e" + "".join(f" UNION ALL SELECT * FROM (SELECT '{c}' AS dimension, coalesce({c}, 'unknown') AS value, {_FAILURE} FROM e GROUP BY 2) WHERE failures > 0" for c in ("question_type", "difficulty"))


def failure_samples(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.failure_samples(rows_of(spark, d), "question_id").select("question_id", "question_type", "document", "error")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.selectExpr("conv_id", "turn", "text AS question", "CASE WHEN conv_id % 3 = 0 THEN 0.0D ELSE 1.0D END AS found", "1.0D / (conv_id % 5 + 1) AS mrr")


def failure_patterns(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.failure_patterns(_asked(spark, d), "question")


def query_type_heuristic(spark: SparkSession, d: str) -> DataFrame:
    kinds = _asked(spark, d).withColumn("kind", evaluation.question_kind(F.col("question")))
    return kinds.groupBy("kind").agg(F.count("*").alias("questions"), F.round(F.avg("found"), 6).alias("success_rate"), F.round(F.avg("mrr"), 6).alias("mean_mrr"))


def _contains(*words: str) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


_KIND = f"CASE WHEN {_contains('what', 'which', 'who')} THEN 'factual' WHEN {_contains('how', 'why')} THEN 'explanatory' WHEN {_contains('list', 'name', 'give')} THEN 'listing' ELSE 'other' END"


def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score_distribution(table(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


_SCORES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS score, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75 FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem) WHERE coalesce(x, 0) <> 0"
    for c in ("l_discount", "l_tax", "l_quantity")
)

#: Judged answers out of orders: a model, three scores and an error for each.
_JUDGED = {
    "answer_id": "o_orderkey",
    "model": "o_orderpriority",
    "faithfulness": "CAST(o_orderkey % 11 AS DOUBLE)",
    "completeness": "CAST(o_custkey % 11 AS DOUBLE)",
    "correctness": "CAST((o_orderkey + o_custkey) % 11 AS DOUBLE)",
    "error": "CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END",
}
_JUDGED_SQL = "j AS (SELECT *, 0.35 * faithfulness + 0.35 * completeness + 0.30 * correctness AS overall FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _JUDGED.items()) + " FROM orders))"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _JUDGED.items()])
    return rows.withColumn("overall", evaluation.overall_score(F.col("faithfulness"), F.col("completeness"), F.col("correctness")))


def overall_score(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("answer_id", "model", F.round("overall", 6).alias("overall"))


_SCORES = ["faithfulness", "completeness", "correctness", "overall"]


def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.model_summary(_judged(spark, d), "model", _SCORES)


def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.model_ranking(model_summary(spark, d), "model", "mean_overall")


_MODELS_SQL = "s AS (SELECT model, count(*) FILTER (WHERE error IS NULL) AS answers, count(*) FILTER (WHERE error IS NOT NULL) AS failures, " + ", ".join(f"round(avg({c}) FILTER (WHERE error IS NULL), 6) AS mean_{c}" for c in _SCORES) + " FROM j GROUP BY 1)"


def system_comparison(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.compare_systems(rows_of(spark, d).where("error IS NULL"), "system", "original")


_SYSTEMS_SQL = f"""WITH {EVALUATION_SQL},
s AS (SELECT system, avg(found) AS found_rate, avg(mrr) AS mrr, avg(hit_at_5) AS precision_at_5, avg(latency) AS latency_mean, quantile_cont(CAST(latency AS DOUBLE), 0.5) AS latency_p50, quantile_cont(CAST(latency AS DOUBLE), 0.95) AS latency_p95 FROM e WHERE error IS NULL GROUP BY 1),
b AS (SELECT * FROM s WHERE system = 'original'),
g AS (SELECT s.*, {", ".join(f"CASE WHEN b.{c} > 0 THEN (s.{c} - b.{c}) / b.{c} * 100 ELSE 0.0 END AS {c}_gain" for c in ("found_rate", "mrr", "precision_at_5"))}, s.latency_mean - b.latency_mean AS latency_cost, CASE WHEN b.latency_mean <> 0 THEN s.latency_mean / b.latency_mean ELSE 0.0 END AS latency_ratio FROM s, b)
SELECT system, {", ".join(f"round({c}, 6) AS {c}" for c in ("found_rate", "mrr", "precision_at_5", "latency_mean", "latency_p50", "latency_p95", "found_rate_gain", "mrr_gain", "precision_at_5_gain", "latency_cost", "latency_ratio"))}, round((found_rate_gain + mrr_gain + precision_at_5_gain) / 3, 6) AS mean_gain FROM g"""


def best_worst_docs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_and_worst(by_document(spark, d), "document", "mean_mrr")


_DOCUMENTS = "SELECT document, count(*) AS questions, round(avg(recall_at_5), 6) AS mean_recall_at_5, round(avg(mrr), 6) AS mean_mrr, round(avg(latency), 6) AS mean_latency FROM e WHERE error IS NULL GROUP BY 1"
_BEST_SQL = f"""WITH {EVALUATION_SQL}, g AS ({_DOCUMENTS}),
b AS (SELECT 'best' AS side, row_number() OVER (ORDER BY mean_mrr DESC, document) AS place, document, mean_mrr FROM g),
w AS (SELECT 'worst' AS side, row_number() OVER (ORDER BY mean_mrr, document DESC) AS place, document, mean_mrr FROM g)
SELECT side, CAST(place AS INT) AS place, document, mean_mrr FROM b WHERE place <= 5 UNION ALL SELECT side, CAST(place AS INT), document, mean_mrr FROM w WHERE place <= 5"""


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Questions left to evaluate, with the results so far: done ones keep theirs."""
    rows = rows_of(spark, d).select("question_id", "found")
    done = rows.where("question_id % 3 = 0").withColumn("state", F.lit("done"))
    left = rows.join(done.select("question_id"), "question_id", "left_anti").withColumn("state", F.lit("open"))
    return done.unionByName(left)


def baseline_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's similarity to its group's first, the group's baseline."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    base = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"), F.min("vec_id").alias("base_id"))
    met = rows.join(F.broadcast(base), "label")
    similarity = F.when(F.col("vec_id") == F.col("base_id"), 1.0).otherwise(vector.cosine(F.col("embedding"), F.col("base")))
    return met.select("vec_id", "label", F.round(similarity, 6).alias("similarity"))


_BASELINE_SQL = """WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), b AS (SELECT label, min(vec_id) AS base_id, arg_min(v, vec_id) AS w FROM n GROUP BY 1)
SELECT vec_id, n.label, CASE WHEN vec_id = base_id THEN 1.0 ELSE round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) END AS similarity FROM n JOIN b ON b.label = n.label"""


def text_scores(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE, BLEU and METEOR of each question's answer against the question."""
    rows = questions(spark, d).where("answer IS NOT NULL")
    tokens = lambda c: metrics.T.tokens(F.col(c), keep_stop_words=True)
    scores = {"rouge_1": metrics.rouge_n(F.col("answer"), F.col("question"), 1), "rouge_2": metrics.rouge_n(F.col("answer"), F.col("question"), 2), "rouge_l": metrics.rouge_l(tokens("answer"), tokens("question")), "bleu": metrics.bleu("answer", "question"), "meteor": metrics.meteor("answer", "question")}
    return rows.select("question_id", *[F.round(v, 6).alias(k) for k, v in scores.items()])


def fuzzy_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each passage of the benchmark with the first of the five documents that sparse search ranks first for it to hold it, exactly or nearly; null if none does."""
    from siltstone.plans.search import sparse_topk

    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("snippet"))
    found = sparse_topk(spark, d).where("rank <= 5").join(items, "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    # a pair may take long: few to a task, whatever bytes they have
    met = found.select("item_id", "rank", "snippet", "text").repartition(F.col("item_id"), F.col("rank"))
    held = met.where(metrics.contains_snippet(F.col("text"), F.col("snippet"))).groupBy("item_id").agg(F.min("rank").alias("found_in_rank"))
    return items.select("item_id").distinct().join(held, "item_id", "left")


def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers scored by the stand-in judge, its responses parsed."""
    rows = questions(spark, d).where("answer IS NOT NULL")
    said = rows.withColumn("said", models.verdict(F.col("question"), F.col("answer"), F.col("question")))
    return said.select("question_id", parsing.parse_judge(F.col("said"), F.lit(1))[0].alias("s")).select("question_id", "s.*")


def generation_phase(spark: SparkSession, d: str) -> DataFrame:
    """Every question answered by every model (two stand-ins), with the similarity of each answer to the baseline's."""
    rows = questions(spark, d).select("question_id", "question")
    names = F.array(F.lit("baseline"), F.lit("short"))
    each = rows.withColumn("model", F.explode(names)).withColumn("prompt", F.concat(F.lit("Context: "), "question"))
    one = models.generation(F.col("prompt"), lambda: models.FirstSentences(1))
    two = models.generation(F.col("prompt"), lambda: models.FirstSentences(2))
    each = each.withColumn("g", F.when(F.col("model") == "short", one).otherwise(two))
    told = each.select("question_id", "model", F.col("g.reply").alias("answer"), F.col("g.error").alias("error")).withColumn("e", models.embedding(F.col("answer")))
    base = told.where("model = 'baseline'").select("question_id", F.col("e").alias("b"))
    similarity = F.when(F.col("model") == "baseline", 1.0).otherwise(vector.cosine(F.col("e"), F.col("b")))
    return told.join(base, "question_id").select("question_id", "model", "answer", F.round(similarity, 6).alias("similarity_to_baseline"))


def evidence_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each passage of the benchmark with the first of five documents of sparse search that holds it exactly."""
    from siltstone.plans.search import sparse_topk

    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("snippet"))
    found = sparse_topk(spark, d).where("rank <= 5").join(items, "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    held = found.where(F.contains("text", F.col("snippet"))).groupBy("item_id").agg(F.min("rank").alias("found_in_rank"))
    return items.select("item_id").join(held, "item_id", "left")


def _evidence_sql() -> str:
    from siltstone.plans.search import _FOUND

    return f"WITH {_FOUND}, x AS (SELECT f.item_id, min(rank) AS r FROM f JOIN benchmark b ON b.item_id = f.item_id JOIN documents d ON d.doc_id = f.doc_id WHERE rank <= 5 AND contains(d.text, b.text) GROUP BY 1) SELECT b.item_id, CAST(r AS INT) AS found_in_rank FROM benchmark b LEFT JOIN x ON x.item_id = b.item_id"


def rouge(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).where("answer IS NOT NULL")
    return rows.select("question_id", *[F.round(metrics.rouge_n(F.col("answer"), F.col("question"), n), 6).alias(f"rouge_{n}") for n in (1, 2)])


def _rouge_sql() -> str:
    from siltstone.plans.tables import QUESTIONS_SQL, tokens_sql

    parts = [f"WITH {QUESTIONS_SQL}, t AS (SELECT question_id, {tokens_sql('answer', True)} AS a, {tokens_sql('question', True)} AS b FROM q0 WHERE answer IS NOT NULL)"]
    for n in (1, 2):
        gram = lambda c: f"list_transform(range(1, len({c}) - {n - 2}), lambda k: array_to_string({c}[CAST(k AS BIGINT):CAST(k + {n - 1} AS BIGINT)], ' '))"  # noqa: B023, E731
        parts.append(f"x{n} AS (SELECT question_id, g, count(*) AS c FROM (SELECT question_id, unnest({gram('a')}) AS g FROM t) GROUP BY 1, 2), y{n} AS (SELECT question_id, g, count(*) AS c FROM (SELECT question_id, unnest({gram('b')}) AS g FROM t) GROUP BY 1, 2)")
        parts.append(f"h{n} AS (SELECT x.question_id, sum(least(x.c, y.c)) AS h FROM x{n} x JOIN y{n} y ON y.question_id = x.question_id AND y.g = x.g GROUP BY 1)")
    score = lambda n: f"round(CASE WHEN greatest(0, len(a) - {n - 1}) + greatest(0, len(b) - {n - 1}) = 0 THEN 0.0 ELSE 2 * coalesce(h{n}.h, 0) / (greatest(0, len(a) - {n - 1}) + greatest(0, len(b) - {n - 1})) END, 6) AS rouge_{n}"
    return ", ".join(parts) + f" SELECT t.question_id, {score(1)}, {score(2)} FROM t LEFT JOIN h1 ON h1.question_id = t.question_id LEFT JOIN h2 ON h2.question_id = t.question_id"


def model_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every question with every model, and the stand-in's reply: the first or the first two sentences."""
    rows = questions(spark, d).select("question_id", "question").withColumn("model", F.explode(F.array(F.lit("one"), F.lit("two"))))
    reply = lambda n: models.generation(F.concat(F.lit("Context: "), "question"), lambda: models.FirstSentences(n))["reply"]
    return rows.select("question_id", "model", F.md5(F.when(F.col("model") == "one", reply(1)).otherwise(reply(2))).alias("answer_md5"))


def _grid_sql() -> str:
    from siltstone.plans.tables import QUESTIONS_SQL, strip_sql

    return f"WITH {QUESTIONS_SQL}, s AS (SELECT question_id, string_split(regexp_replace({strip_sql('question')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM q0) SELECT question_id, 'one' AS model, md5(s[1]) AS answer_md5 FROM s UNION ALL SELECT question_id, 'two', md5(array_to_string(s[1:2], ' ')) FROM s"


def embedding_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answers against questions by vectors of tokens, and the scores of a model that is switched off."""
    rows = questions(spark, d).where("answer IS NOT NULL")
    scored = rows.select("question_id", metrics.embedding_score(F.col("answer"), F.col("question")).alias("e"), metrics.ragas().alias("r"))
    return scored.select("question_id", *[F.round(f"e.{c}", 6).alias(c) for c in ("precision", "recall", "f1")], "r.*")


def answer_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits, precision and reciprocal rank of chunks: those of the first five documents of a passage's search that hold it."""
    from siltstone.plans.search import passages, sparse_topk

    held = passages(table(spark, d, "documents"), table(spark, d, "benchmark")).withColumn("held", F.lit(True))
    met = sparse_topk(spark, d).where("rank <= 5").join(held, ["item_id", "doc_id"], "left")
    hits = F.count_if(F.col("held"))
    return met.groupBy("item_id").agg(hits.alias("hits"), F.round(hits / 5, 6).alias("precision_at_5"), F.round(F.coalesce(1 / F.min(F.when(F.col("held"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


def _hits_sql() -> str:
    from siltstone.plans.search import _FOUND, _HELD

    return f"WITH {_FOUND}, {_HELD} SELECT f.item_id, count(h.doc_id) AS hits, round(count(h.doc_id) / 5, 6) AS precision_at_5, round(coalesce(1.0::DOUBLE / min(CASE WHEN h.doc_id IS NOT NULL THEN rank END), 0.0), 6) AS mrr FROM f LEFT JOIN h ON h.item_id = f.item_id AND h.doc_id = f.doc_id WHERE rank <= 5 GROUP BY 1"


QUERIES = {
    "metric_summary": (metric_summary, f"WITH {EVALUATION_SQL} {_SUMMARY_SQL}"),
    "latency_stats": (latency_stats, f"WITH {EVALUATION_SQL} SELECT {_LATENCY} FROM e"),
    "latency_by_system": (latency_by_system, f"WITH {EVALUATION_SQL} SELECT system, {_LATENCY} FROM e GROUP BY 1"),
    "by_type": (by_type, _group_sql("question_type")),
    "by_difficulty": (by_difficulty, _group_sql("difficulty")),
    "by_document": (by_document, f"WITH {EVALUATION_SQL} {_DOCUMENTS}"),
    "grouping_sets_eval": (grouping_sets_eval, f"WITH {EVALUATION_SQL} {_SETS_SQL}"),
    "latency_quartile_bins": (latency_quartile_bins, f"WITH {EVALUATION_SQL}{_BINS_SQL}"),
    "failure_analysis": (failure_analysis, f"WITH {EVALUATION_SQL} {_FAILURES_SQL}"),
    "failure_samples": (failure_samples, f"WITH {EVALUATION_SQL} SELECT question_id, question_type, document, error FROM e WHERE found = 0 ORDER BY question_id LIMIT 10"),
    "failure_patterns": (failure_patterns, f"WITH q AS (SELECT len({words_sql('text')}) AS n FROM conversations WHERE role = 'user' AND conv_id % 3 = 0) SELECT count(*) AS failures, round(avg(n), 6) AS mean_words, CAST(min(n) AS BIGINT) AS min_words, CAST(max(n) AS BIGINT) AS max_words FROM q"),
    "query_type_heuristic": (query_type_heuristic, f"SELECT {_KIND} AS kind, count(*) AS questions, round(avg(CASE WHEN conv_id % 3 = 0 THEN 0.0 ELSE 1.0 END), 6) AS success_rate, round(avg(1.0::DOUBLE / (conv_id % 5 + 1)), 6) AS mean_mrr FROM conversations WHERE role = 'user' GROUP BY 1"),
    "score_distribution": (score_distribution, _SCORES_SQL),
    "overall_score": (overall_score, f"WITH {_JUDGED_SQL} SELECT answer_id, model, round(overall, 6) AS overall FROM j"),
    "model_summary": (model_summary, f"WITH {_JUDGED_SQL}, {_MODELS_SQL} SELECT * FROM s"),
    "model_ranking": (model_ranking, f"WITH {_JUDGED_SQL}, {_MODELS_SQL} SELECT *, CAST(row_number() OVER (ORDER BY mean_overall DESC, model) AS INT) AS place FROM s"),
    "system_comparison": (system_comparison, _SYSTEMS_SQL),
    "best_worst_docs": (best_worst_docs, _BEST_SQL),
    "resume_anti_join": (resume_anti_join, f"WITH {EVALUATION_SQL} SELECT question_id, found, CASE WHEN question_id % 3 = 0 THEN 'done' ELSE 'open' END AS state FROM e"),
    "baseline_similarity": (baseline_similarity, _BASELINE_SQL),
    "evidence_ranks": (evidence_ranks, _evidence_sql()),
    "answer_hits": (answer_hits, _hits_sql()),
    "rouge": (rouge, _rouge_sql()),
    "model_grid": (model_grid, _grid_sql()),
    "embedding_scores": (embedding_scores, None),
    "text_scores": (text_scores, None),
    "fuzzy_evidence": (fuzzy_evidence, None),
    "judge_parse": (judge_parse, None),
    "generation_phase": (generation_phase, None),
}
