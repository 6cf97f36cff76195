"""Fusion of ranked lists, staged cuts, reranking, query expansion and metadata filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.prompts import plain_prompt
from siltstone.operators.vector import top_k_cosine

#: The constant of reciprocal rank fusion.
RRF = 60


def fuse(dense: DataFrame, sparse: DataFrame, query: str, key: str, k: int, dense_weight: float = 0.5, sparse_weight: float = 0.5, digits: int = 9) -> DataFrame:
    """(query, key, dense_score, sparse_score, score, rank): weighted reciprocal ranks of two lists, ties to the better rank, then the smaller key."""
    d = dense.select(query, key, F.col("rank").alias("_dr"), F.col("score").alias("dense_score"))
    s = sparse.select(query, key, F.col("rank").alias("_sr"), F.col("score").alias("sparse_score"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (RRF + F.col(rank)), F.lit(0.0))
    both = d.join(s, [query, key], "full_outer").withColumn("score", F.round(part(dense_weight, "_dr") + part(sparse_weight, "_sr"), digits))
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.least("_dr", "_sr"), key)
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(query, key, "dense_score", "sparse_score", "score", "rank")


def rerank(shortlist: DataFrame, query: str, key: str, score: Column, k: int, digits: int = 6) -> DataFrame:
    """shortlist's k best by rerank_score, ties by the rank before."""
    scored = shortlist.withColumn("rerank_score", F.round(score, digits)).withColumnRenamed("rank", "fused_rank")
    order = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "fused_rank", key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Synonyms that expand a query, a fixed list.
SYNONYMS = {
    "ai": ["artificial intelligence", "machine learning", "deep learning"],
    "ml": ["machine learning", "ai", "artificial intelligence"],
    "llm": ["large language model", "language model", "transformer"],
}


def expand(query: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """The query followed by the synonyms of every key that its lower-cased text contains."""
    parts = [F.when(F.contains(F.lower(query), F.lit(k)), F.lit(" ".join(v))) for k, v in synonyms.items()]
    return F.concat_ws(" ", query, *parts)


def metadata_filter(rows: DataFrame, any_of: dict[str, list] | None = None, at_least: dict | None = None, at_most: dict | None = None, equal: dict | None = None) -> DataFrame:
    """rows for which all given conditions hold; None and empty lists set no condition."""
    tests = [F.col(c).isin(v) for c, v in (any_of or {}).items() if v]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    tests += [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    tests += [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def cache_key(query: Column, **params) -> Column:
    """md5 of the query and every parameter that changes its result, by name."""
    return F.md5(F.concat_ws(":", query, F.lit(repr(sorted(params.items())))))


def context(results: DataFrame, query: str, filename: str, content: str, scores: bool = False) -> DataFrame:
    """(query, context): the results of each query, best first, as blocks headed by their document."""
    head = F.format_string("[Document %d] (Score: %.4f)\n%s", F.col("rank"), F.col("score"), F.col(content)) if scores else F.format_string("[Document: %s]\n%s", F.col(filename), F.col(content))
    blocks = F.array_sort(F.collect_list(F.struct("rank", head.alias("b"))))
    return results.groupBy(query).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def answers(questions: DataFrame, query: str, question: str, corpus: DataFrame, key: str, text: str, embed: Callable[[Column], Column], generate: Callable[[Column], Column], k: int = 3) -> DataFrame:
    """(query, prompt, reply, error): the graph of embedder, retriever, prompt and generator as one plan."""
    asked = questions.select(F.col(query), F.col(question).alias("_q")).withColumn("_v", embed(F.col("_q")))
    held = corpus.select(F.col(key), F.col(text).alias("_text"), embed(F.col(text)).alias("_v"))
    found = top_k_cosine(asked.select(F.col(query), "_v"), query, held.select(key, "_v"), key, "_v", k).join(held.select(key, "_text"), key)
    said = context(found.withColumn("_file", F.col(key).cast("string")), query, "_file", "_text")
    prompts = asked.join(said, query, "left").select(query, plain_prompt(F.col("_q"), F.coalesce("context", F.lit(""))).alias("prompt"))
    return prompts.withColumn("_g", generate(F.col("prompt"))).select(query, "prompt", F.col("_g.reply").alias("reply"), F.col("_g.error").alias("error"))
