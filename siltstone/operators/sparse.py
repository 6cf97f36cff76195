"""Sparse search: term statistics, a model of inverse document frequencies, and scoring by postings.

Everything is keyed by term, so tables grow with distinct (document, term) pairs and
never with pairs of documents. Terms of queries reach the corpus' postings by an
equi-join on term; only postings of query terms are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T


def term_frequency(corpus: DataFrame, key: str, text: str, keep_stop_words: bool = False) -> DataFrame:
    """(key, term, n, total, tf): counts of a document's terms and their part of all its tokens."""
    found = corpus.select(key, T.tokens(F.col(text), keep_stop_words).alias("_t")).select(key, F.size("_t").cast("long").alias("total"), F.explode("_t").alias("term"))
    counted = found.groupBy(key, "total", "term").agg(F.count("*").alias("n"))
    return counted.select(key, "term", "n", "total", (F.col("n") / F.col("total")).alias("tf"))


def document_frequency(corpus: DataFrame, text: str) -> DataFrame:
    """(term, df): how many documents hold the term."""
    return corpus.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def fit(corpus: DataFrame, text: str) -> DataFrame:
    """The model (term, df, idf)."""
    n = corpus.agg(F.count("*").alias("n")).scalar()
    return document_frequency(corpus, text).withColumn("idf", idf(n, F.col("df")))


def vocabulary(model: DataFrame) -> DataFrame:
    """model with term_id, the term's place in code-point order.

    Terms are numbered within their first two characters, whose counts, few rows, are
    summed up in order; so no task sorts all terms.
    """
    parts = model.withColumn("_head", F.substring("term", 1, 2))
    sizes = parts.groupBy("_head").agg(F.count("*").alias("_n"))
    before = sizes.select("_head", F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_head").orderBy("term"))).join(before, "_head")
    return numbered.select(*model.columns, (F.col("_before") + F.col("_row") - 1).alias("term_id"))


def postings(corpus: DataFrame, key: str, text: str, model: DataFrame, keep_stop_words: bool = False) -> DataFrame:
    """(key, term, weight) with weight tf times idf; terms that the model lacks have none."""
    return term_frequency(corpus, key, text, keep_stop_words).join(model.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def vectors(weights: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(key, indices, values) from postings and a vocabulary."""
    met = weights.join(terms.select("term", "term_id"), "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("_v"))
    return met.select(key, F.col("_v.term_id").alias("indices"), F.col("_v.weight").alias("values"))


def top_k(found: DataFrame, query: str, key: str, score: Column, k: int, digits: int = 9) -> DataFrame:
    """(query, key, score, rank): the k best of each query by score, ties to the smaller key."""
    rounded = found.select(query, key, F.round(score, digits).alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, query: str, query_text: str, weights: DataFrame, key: str, model: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query by the product of weights; query tokens keep stop words and unknown terms in their total."""
    asked = postings(queries, query, query_text, model, keep_stop_words=True).withColumnRenamed("weight", "_q")
    met = weights.join(asked, "term").groupBy(query, key).agg(F.sum(F.col("_q") * F.col("weight")).alias("_s"))
    return top_k(met, query, key, F.col("_s"), k)


def search_texts(queries: DataFrame, query: str, query_text: str, corpus: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """As search() with the model and postings of corpus, of which only those of the queries' terms are ever made.

    Tokens meet the distinct terms of the queries where they are read, so what is
    counted and shuffled is what can score; a term's documents are counted on the same
    counts.
    """
    asked = term_frequency(queries, query, query_text, keep_stop_words=True)
    terms = asked.select("term").distinct()
    found = corpus.select(key, T.tokens(F.col(text)).alias("_t")).select(key, F.size("_t").cast("long").alias("_total"), F.explode("_t").alias("term"))
    counted = found.join(terms, "term", "left_semi").groupBy(key, "_total", "term").agg(F.count("*").alias("_n"))
    n = corpus.agg(F.count("*").alias("n")).scalar()
    model = counted.groupBy("term").agg(F.count("*").alias("_df")).select("term", idf(n, F.col("_df")).alias("_idf"))
    weighed = asked.join(model, "term").select(query, "term", (F.col("tf") * F.col("_idf")).alias("_q"), "_idf")
    met = counted.join(weighed, "term").select(query, key, (F.col("_q") * (F.col("_n") / F.col("_total") * F.col("_idf"))).alias("_part"))
    return top_k(met.groupBy(query, key).agg(F.sum("_part").alias("_s")), query, key, F.col("_s"), k)
