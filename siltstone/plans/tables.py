"""The driver's tables in the roles that queries need, each in Spark and as DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Evaluations of questions out of events: rank, groups, latency and error of each.
_EVALUATION = {
    "question_id": "event_id",
    "rank": "CASE WHEN event_id % 7 = 0 OR event_id % 50 = 1 THEN NULL ELSE (event_id * 31) % 12 + 1 END",
    "question_type": "event_type",
    "difficulty": "CASE user_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE NULL END",
    "document": "concat('doc', CAST(user_id % 20 AS VARCHAR(9)))",
    "system": "CASE event_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'hybrid' ELSE 'reranked' END",
    "latency": "value",
    "error": "CASE WHEN event_id % 50 = 1 THEN 'timeout' END",
}
_METRICS = {
    "found": "CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END",
    "mrr": "coalesce(1.0 / rank, 0.0)",
    "hit_at_5": "CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END",
    "precision_at_5": "CASE WHEN rank <= 5 THEN 0.2 ELSE 0.0 END",
    "recall_at_5": "CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END",
    "ndcg_at_10": "CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END",
}


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators.evaluation import ranking_metrics

    return ranking_metrics(table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _EVALUATION.items()]))


def _select(columns: dict[str, str], source: str, doubles: bool = False) -> str:
    return "SELECT *, " * doubles + "SELECT " * (not doubles) + ", ".join(f"{f'CAST({e} AS DOUBLE)' if doubles else e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


EVALUATION_SQL = f"v AS ({_select(_EVALUATION, 'events')}), e AS ({_select(_METRICS, 'v', doubles=True)})"

#: Questions out of conversations: a user's turn with the assistant's next turn as its answer.
_KINDS = ["single-hop", "multi-hop", "cross-page|causal", "numerical", "comparison", "definition"]
_QUESTION = {
    "question_id": "q.conv_id * 1000 + q.turn",
    "conv_id": "q.conv_id",
    "question": "q.text",
    "answer": "a.text",
    "question_type": "CASE q.conv_id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_KINDS)) + " ELSE NULL END",
    "difficulty": "CASE q.conv_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'hardest' END",
    "evidence": "CAST(q.conv_id % 3 AS INT)",
    "reasoning": "CASE WHEN q.conv_id % 5 = 0 THEN 'steps' ELSE '' END",
    "page_reference": "CASE q.conv_id % 3 WHEN 0 THEN 'Multiple' WHEN 1 THEN '3-4' ELSE '7' END",
}
_PAIRS = "conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'"
QUESTIONS_SQL = f"q0 AS ({_select(_QUESTION, _PAIRS)})"
#: With the document of the same number as context.
CONTEXT_SQL = QUESTIONS_SQL + ", q AS (SELECT q0.*, d.text AS context FROM q0 LEFT JOIN documents d ON d.doc_id = q0.conv_id)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    q, a = turns.where("role = 'user'").alias("q"), turns.where("role = 'assistant'").alias("a")
    met = q.join(a, F.expr("a.conv_id = q.conv_id AND a.turn = q.turn + 1"), "left")
    return met.selectExpr(*[f"{e} AS {c}" for c, e in _QUESTION.items()])


def questions_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    return questions(spark, sf_dir).join(docs, "conv_id", "left")


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def words_sql(x: str) -> str:
    return rf"regexp_extract_all(coalesce({x}, ''), '[^\x20\x09-\x0D]+')"


def tokens_sql(x: str, keep_stop_words: bool = False) -> str:
    found = rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return found if keep_stop_words else f"list_filter({found}, lambda w: w NOT IN ({stops}))"


def lines_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\r\n|\r|\n'), lambda s: {strip_sql('s')} <> '')"
