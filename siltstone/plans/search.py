"""Queries of sparse and dense search, fusion, filters and the evaluation of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evaluation, fusion, sparse, vector
from siltstone.plans.tables import table, tokens_sql

K = 10
_DOCS = "documents"


def scan_txt_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, _DOCS)
    return docs.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("num_lines"), F.length("text").cast("long").alias("char_count"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, _DOCS).select("doc_id", "lang", "source", "n_chars")
    return fusion.metadata_filter(docs, any_of={"lang": ["en", "fr"], "source": []}, at_least={"n_chars": 500}, at_most={"n_chars": 5000})


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return sparse.document_frequency(table(spark, d, _DOCS), "text")


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return sparse.fit(table(spark, d, _DOCS), "text").select("term", "df", F.round("idf", 6).alias("idf"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return sparse.vocabulary(sparse.document_frequency(table(spark, d, _DOCS), "text")).select("term", F.col("term_id").cast("long").alias("term_id"))


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return sparse.term_frequency(table(spark, d, _DOCS), "doc_id", "text").withColumn("tf", F.round("tf", 6))


_MODEL = f"""
t AS (SELECT doc_id, lang, text, {tokens_sql("text")} AS ts FROM documents),
u AS (SELECT doc_id, unnest(ts) AS term, len(ts) AS total FROM t),
m AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, df FROM (SELECT term, count(DISTINCT doc_id) AS df FROM u GROUP BY 1), (SELECT count(*) AS n FROM documents))"""
_FOUND = f"""{_MODEL},
dw AS (SELECT doc_id, u.term, count(*) / any_value(total) * any_value(idf) AS w FROM u JOIN m USING (term) GROUP BY 1, 2),
qt AS (SELECT item_id, {tokens_sql("text", True)} AS ts FROM benchmark),
qu AS (SELECT item_id, unnest(ts) AS term, len(ts) AS total FROM qt),
qw AS (SELECT item_id, qu.term, count(*) / any_value(total) * any_value(idf) AS w FROM qu JOIN m USING (term) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(sum(qw.w * dw.w), 9) AS score FROM qw JOIN dw USING (term) GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {K})"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return sparse.search_texts(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, _DOCS), "doc_id", "text", K)


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).withColumn("score", F.round("score", 6))


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that hold an item's text verbatim.

    Items and documents meet by an equi-join on the item's longest inner word, which a
    document with the text holds between blanks; items of fewer than three words by
    their longest word.
    """
    ws = T.words(F.col("text"))
    inner = F.when(F.size(ws) > 2, F.slice(ws, F.lit(2), F.size(ws) - 2)).otherwise(ws)
    anchor = F.element_at(F.sort_array(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    keyed = items.select("item_id", F.col("text").alias("_item"), anchor.alias("_w"))
    wanted = keyed.select("_w").distinct()
    spread = docs.select("doc_id", F.explode(F.array_distinct(ws)).alias("_w")).join(wanted, "_w", "left_semi")
    pairs = spread.join(keyed, "_w").select("item_id", "_item", "doc_id")
    return pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("_item"))).select("item_id", "doc_id").distinct()


def evidence_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return passages(table(spark, d, _DOCS), table(spark, d, "benchmark"))


_HELD = "h AS (SELECT item_id, doc_id FROM benchmark b JOIN documents x ON contains(x.text, b.text))"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    held = passages(table(spark, d, _DOCS), table(spark, d, "benchmark")).withColumn("relevant", F.lit(True))
    met = _found(spark, d).join(held, ["item_id", "doc_id"], "left")
    return evaluation.first_hit(met, "item_id", F.coalesce("relevant", F.lit(False)))


_RANKS = f"""{_FOUND}, {_HELD},
r AS (SELECT f.item_id, min(CASE WHEN h.doc_id IS NOT NULL THEN rank END) AS rank FROM f LEFT JOIN h ON h.item_id = f.item_id AND h.doc_id = f.doc_id GROUP BY 1)"""


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.ranking_metrics(_ranks(spark, d))
    return rows.select("item_id", F.col("rank").cast("long").alias("rank"), "found", F.round("mrr", 6).alias("mrr"), *[c for k in (1, 3, 5, 10) for c in (f"hit_at_{k}", F.round(f"precision_at_{k}", 6).alias(f"precision_at_{k}"), F.round(f"ndcg_at_{k}", 6).alias(f"ndcg_at_{k}"))])


def retrieval_by_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, _DOCS)
    held = passages(docs, table(spark, d, "benchmark"))
    langs = held.join(docs.select("doc_id", "lang"), "doc_id").groupBy("item_id").agg(F.min_by("lang", "doc_id").alias("lang"))
    rows = evaluation.ranking_metrics(_ranks(spark, d)).join(langs, "item_id", "left")
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return rows.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("questions"), *[mean(c) for c in ("found", "mrr", "recall_at_1", "recall_at_5", "ndcg_at_10")])


def dense_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vector.top_k_cosine(dense_queries(spark, d), "query_id", table(spark, d, "embeddings"), "vec_id", k=K)


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    corpus = fusion.metadata_filter(table(spark, d, "embeddings"), any_of={"label": [1, 3, 5]})
    return vector.top_k_cosine(dense_queries(spark, d), "query_id", corpus, "vec_id", k=K)


def _dense_sql(where: str = "true") -> str:
    return f"""
WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0 AND {where})
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= {K}"""


def dense_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Share of neighbours with the query's label, by label."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    near = dense_topk_cosine(spark, d).where("query_id <> vec_id").join(rows, "vec_id")
    own = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return near.join(own, "query_id").groupBy("query_label").agg(F.count("*").alias("neighbours"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("same_label"))


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_extendedprice", "l_quantity")
    rows = rows.groupBy("query_id", "key").agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").alias("quantity"))
    return sparse.top_k(rows, "query_id", "key", F.col("price"), 50), sparse.top_k(rows, "query_id", "key", F.col("quantity"), 50)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    dense, terms = _two_lists(spark, d)
    return fusion.fuse(dense, terms, "query_id", "key", 30, 0.6, 0.4).select("query_id", "key", F.round("score", 6).alias("score"), "rank")


RRF_SQL = """
WITH b AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS key, max(l_extendedprice) AS price, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
d AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY round(price, 9) DESC, key) AS r FROM b QUALIFY r <= 50),
s AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY round(quantity, 9) DESC, key) AS r FROM b QUALIFY r <= 50),
j AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.key, s.key) AS key, d.r AS dr, s.r AS sr, round(coalesce(CAST(0.6 AS DOUBLE) / (60 + d.r), 0.0) + coalesce(CAST(0.4 AS DOUBLE) / (60 + s.r), 0.0), 9) AS sc FROM d FULL JOIN s ON d.query_id = s.query_id AND d.key = s.key),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, least(dr, sr), key) AS rk FROM j)
SELECT query_id, key, round(sc, 6) AS score, CAST(rk AS INT) AS rank FROM k WHERE rk <= 30"""


def rerank_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by id as the shortlist of each query, reranked by cosine."""
    every = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = dense_queries(spark, d).withColumnRenamed("embedding", "q")
    near = queries.withColumn("vec_id", F.explode(F.sequence(F.col("query_id") - 15, F.col("query_id") + 15))).join(every, "vec_id")
    short = near.withColumn("rank", (F.abs(F.col("vec_id") - F.col("query_id")) * 2 + (F.col("vec_id") < F.col("query_id")).cast("int")).cast("long"))
    return fusion.rerank(short, "query_id", "vec_id", vector.cosine(F.col("q"), F.col("embedding")), K).select("query_id", "vec_id", "fused_rank", "rerank_score", "rank")


RERANK_SQL = f"""
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, abs(c.vec_id - q.vec_id) * 2 + CASE WHEN c.vec_id < q.vec_id THEN 1 ELSE 0 END AS fused_rank,
      round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) AS rerank_score
      FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id BETWEEN q.vec_id - 15 AND q.vec_id + 15)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank, vec_id) AS INT) AS rank FROM s QUALIFY rank <= {K}"""


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", fusion.expand(F.col("text")).alias("expanded"))


def _expansion_sql() -> str:
    parts = ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{' '.join(v)}' END" for k, v in fusion.SYNONYMS.items())
    return f"SELECT item_id, concat_ws(' ', text, {parts}) AS expanded FROM benchmark"


_METRIC_COLUMNS = ", ".join(
    f"CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0 END AS hit_at_{k}, CASE WHEN rank <= {k} THEN round(1.0::DOUBLE / {k}, 6) ELSE 0.0 END AS precision_at_{k}, CASE WHEN rank <= {k} THEN round(1.0::DOUBLE / log2(rank + 1), 6) ELSE 0.0 END AS ndcg_at_{k}"
    for k in (1, 3, 5, 10)
)

QUERIES = {
    "scan_txt_stats": (scan_txt_stats, "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS num_lines, CAST(length(text) AS BIGINT) AS char_count FROM documents"),
    "metadata_filter": (metadata_filter, "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 500 AND n_chars <= 5000"),
    "doc_frequency": (doc_frequency, f"WITH t AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY 1"),
    "bm25_idf": (bm25_idf, f"WITH {_MODEL} SELECT term, df, round(idf, 6) AS idf FROM m"),
    "bm25_vocabulary": (vocabulary, f"WITH t AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM documents) SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM t"),
    "term_frequency": (term_frequency, f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents), u AS (SELECT doc_id, unnest(ts) AS term, CAST(len(ts) AS BIGINT) AS total FROM t) SELECT doc_id, term, count(*) AS n, total, round(count(*) / total, 6) AS tf FROM u GROUP BY doc_id, term, total"),
    "sparse_topk": (sparse_topk, f"WITH {_FOUND} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM f"),
    "evidence_exact_match": (evidence_exact_match, f"WITH {_HELD} SELECT * FROM h"),
    "retrieval_metrics": (retrieval_metrics, f"WITH {_RANKS} SELECT item_id, rank, CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS found, round(coalesce(1.0::DOUBLE / rank, 0.0), 6) AS mrr, {_METRIC_COLUMNS} FROM r"),
    "retrieval_by_language": (retrieval_by_language, f"""WITH {_RANKS},
l AS (SELECT item_id, arg_min(lang, x.doc_id) AS lang FROM h JOIN documents x ON x.doc_id = h.doc_id GROUP BY 1)
SELECT coalesce(lang, 'none') AS lang, count(*) AS questions, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS mean_found, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS mean_mrr,
round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS mean_recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS mean_recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0 END), 6) AS mean_ndcg_at_10
FROM r LEFT JOIN l USING (item_id) GROUP BY 1"""),
    "dense_topk_cosine": (dense_topk_cosine, _dense_sql()),
    "dense_topk_filtered": (dense_topk_filtered, _dense_sql("c.label IN (1, 3, 5)")),
    "dense_relevance": (dense_relevance, f"WITH f AS ({_dense_sql().replace('WITH n', 'WITH n0', 1).replace('FROM n q JOIN n c', 'FROM n0 q JOIN n0 c')}) SELECT q.label AS query_label, count(*) AS neighbours, round(avg(CASE WHEN c.label = q.label THEN 1.0 ELSE 0.0 END), 6) AS same_label FROM f JOIN embeddings c ON c.vec_id = f.vec_id JOIN embeddings q ON q.vec_id = f.query_id WHERE f.query_id <> f.vec_id GROUP BY 1"),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "rerank_cosine": (rerank_cosine, RERANK_SQL),
    "query_expansion": (query_expansion, _expansion_sql()),
}
