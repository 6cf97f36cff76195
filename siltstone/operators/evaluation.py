"""Ranking metrics of single questions, and their summaries by group, latency and system.

An evaluation is a row for each question: found rank (null if not found), group
columns, latency, and an error column that is null for a question that was answered.
Summaries leave errored rows out; failure counts have them in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def ranking_metrics(rows: DataFrame, rank: str = "rank", cuts: Sequence[int] = CUTS) -> DataFrame:
    """rows with found, mrr and, for each cut, hit, precision (1/k), recall and ndcg for one relevant document."""
    r = F.col(rank)
    out = {"found": F.when(r.isNotNull(), 1.0).otherwise(0.0), "mrr": F.coalesce(1.0 / r, F.lit(0.0))}
    for k in cuts:
        hit = F.coalesce(r <= k, F.lit(False))
        out[f"hit_at_{k}"] = F.when(hit, 1.0).otherwise(0.0)
        out[f"precision_at_{k}"] = F.when(hit, 1.0 / k).otherwise(0.0)
        out[f"recall_at_{k}"] = F.when(hit, 1.0).otherwise(0.0)
        out[f"ndcg_at_{k}"] = F.when(hit, 1.0 / F.log2(r + 1.0)).otherwise(0.0)
    return rows.withColumns(out)


def first_hit(results: DataFrame, query: str, relevant: Column) -> DataFrame:
    """(query, rank): the best rank of a relevant result, null for queries whose results hold none."""
    return results.groupBy(query).agg(F.min(F.when(relevant, F.col("rank"))).alias("rank"))


def metric_summary(rows: DataFrame, metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """(metric, n, mean, std, min, max, median): population deviation; nulls are skipped."""
    long = rows.unpivot([], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    stats = long.where("value IS NOT NULL").groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median")
    )
    return _rounded(stats, ["mean", "std", "min", "max", "median"], digits)


def _rounded(rows: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


def latency_stats(rows: DataFrame, latency: str = "latency", by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean, median, deviation, extremes and exact linear percentiles of a latency, for all rows or each group."""
    x = F.col(latency)
    points = F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), points.alias("_p"))
    stats = stats.select(*by, "n", "mean", F.col("_p")[0].alias("median"), "std", "min", "max", F.col("_p")[1].alias("p95"), F.col("_p")[2].alias("p99"))
    return _rounded(stats, ["mean", "median", "std", "min", "max", "p95", "p99"], digits)


def _group_metrics(digits: int) -> list[Column]:
    mean = lambda c, name: F.round(F.avg(c), digits).alias(name)
    return [F.count("*").alias("questions"), mean("found", "success_rate"), mean("mrr", "mean_mrr"), mean("precision_at_5", "mean_precision_at_5")]


def by_group(rows: DataFrame, group: str, digits: int = 6) -> DataFrame:
    """Questions, success rate, mean reciprocal rank and precision at 5 for each value of a column; null is unknown."""
    return rows.where("error IS NULL").groupBy(F.coalesce(group, F.lit("unknown")).alias(group)).agg(*_group_metrics(digits))


def by_groups(rows: DataFrame, groups: Sequence[str], digits: int = 6) -> DataFrame:
    """(dimension, value, ...): by_group for several columns in one pass by grouping sets."""
    named = rows.where("error IS NULL").withColumns({g: F.coalesce(g, F.lit("unknown")) for g in groups})
    sets = named.groupingSets([[F.col(g)] for g in groups], *[F.col(g) for g in groups]).agg(F.grouping_id().alias("_set"), *_group_metrics(digits))
    n = len(groups)
    mask = lambda k: F.col("_set") == (2**n - 1) - 2 ** (n - 1 - k)
    pick = lambda of: reduce(lambda c, k: c.when(mask(k), of(k)), range(1, n), F.when(mask(0), of(0)))
    return sets.select(pick(lambda k: F.lit(groups[k])).alias("dimension"), pick(lambda k: F.col(groups[k])).alias("value"), "questions", "success_rate", "mean_mrr", "mean_precision_at_5")


def by_document(rows: DataFrame, document: str = "document", digits: int = 6) -> DataFrame:
    """Questions and means of recall at 5, reciprocal rank and latency for each document."""
    mean = lambda c, name: F.round(F.avg(c), digits).alias(name)
    return rows.where("error IS NULL").groupBy(document).agg(F.count("*").alias("questions"), mean("recall_at_5", "mean_recall_at_5"), mean("mrr", "mean_mrr"), mean("latency", "mean_latency"))


#: Names of the quartile bins, in order.
BINS = ("fast", "medium", "slow", "very_slow")


def latency_bins(rows: DataFrame, latency: str = "latency", metric: str = "recall_at_5", digits: int = 6) -> DataFrame:
    """(bin, n, mean): rows by quartile of latency, an edge belonging to the lower bin; empty bins have mean 0."""
    edges = rows.agg(F.percentile(latency, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).scalar()
    x = F.col(latency)
    which = F.when(x <= edges[0], 0).when(x <= edges[1], 1).when(x <= edges[2], 2).otherwise(3)
    found = rows.groupBy(which.alias("_b")).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
    names = rows.sparkSession.range(4).select(F.col("id").cast("int").alias("_b"), F.element_at(F.array(*[F.lit(b) for b in BINS]), (F.col("id") + 1).cast("int")).alias("bin"))
    return names.join(found, "_b", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), digits).alias("mean"))


def failures(rows: DataFrame, groups: Sequence[str], digits: int = 6) -> DataFrame:
    """(dimension, value, failures, questions, failure_rate): rows not found, errors among them, in total and by group, in one pass by grouping sets."""
    named = rows.select("found", *[F.coalesce(g, F.lit("unknown")).alias(g) for g in groups])
    sets = named.groupingSets([[], *[[F.col(g)] for g in groups]], *[F.col(g) for g in groups]).agg(F.grouping_id().alias("_set"), F.count_if(F.col("found") == 0).alias("failures"), F.count("*").alias("questions"))
    n = len(groups)
    # the set of one group has the bits of all others
    alone = [(2**n - 1) - 2 ** (n - 1 - k) for k in range(n)]
    dimension = F.when(F.col("_set") == 2**n - 1, "all")
    value = F.when(F.col("_set") == 2**n - 1, "all")
    for k, g in enumerate(groups):
        dimension, value = dimension.when(F.col("_set") == alone[k], g), value.when(F.col("_set") == alone[k], F.col(g))
    every = sets.select(dimension.alias("dimension"), value.alias("value"), "failures", "questions")
    return every.withColumn("failure_rate", F.round(F.try_divide("failures", "questions"), digits)).where("failures > 0 OR dimension = 'all'")


def failure_samples(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    return rows.where("found = 0").orderBy(key).limit(n)


def failure_patterns(rows: DataFrame, question: str, digits: int = 6) -> DataFrame:
    """Failures and the mean, least and most words of their questions."""
    from siltstone.functions.text import words

    size = F.size(words(F.col(question)))
    return rows.where("found = 0").agg(F.count("*").alias("failures"), F.round(F.avg(size), digits).alias("mean_words"), F.min(size).cast("long").alias("min_words"), F.max(size).cast("long").alias("max_words"))


def question_kind(question: Column) -> Column:
    """factual, explanatory, listing or other, by the words a question contains, in that order."""
    low = F.lower(question)
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws])
    return F.when(has("what", "which", "who"), "factual").when(has("how", "why"), "explanatory").when(has("list", "name", "give"), "listing").otherwise("other")


def score_distribution(results: DataFrame, scores: Sequence[str], digits: int = 6) -> DataFrame:
    """(score, n, mean, std, min, max, q25, q50, q75) of scores that are neither null nor zero."""
    long = results.unpivot([], [F.col(s).cast("double").alias(s) for s in scores], "score", "value").where("coalesce(value, 0) <> 0")
    points = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = long.groupBy("score").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), points.alias("_p"))
    return _rounded(stats.select("score", "n", "mean", "std", "min", "max", F.col("_p")[0].alias("q25"), F.col("_p")[1].alias("q50"), F.col("_p")[2].alias("q75")), ["mean", "std", "min", "max", "q25", "q50", "q75"], digits)


def overall_score(faithfulness: Column, completeness: Column, correctness: Column) -> Column:
    return 0.35 * faithfulness + 0.35 * completeness + 0.30 * correctness


def model_summary(rows: DataFrame, model: str, metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """Means for each model over answers without an error, with the count of answers and of failures."""
    fine = F.col("error").isNull()
    means = [F.round(F.avg(F.when(fine, F.col(m))), digits).alias(f"mean_{m}") for m in metrics]
    return rows.groupBy(model).agg(F.count_if(fine).alias("answers"), F.count_if(~fine).alias("failures"), *means)


def model_ranking(summary: DataFrame, model: str, by: str) -> DataFrame:
    """summary with place, from the best mean on; the few models are one small group."""
    return summary.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), model)))


def compare_systems(rows: DataFrame, system: str, base: str, digits: int = 6) -> DataFrame:
    """Each system's rates and latencies, its gains in percent over the base system (0 where the base is 0), their mean and the latency cost."""
    points = F.percentile("latency", F.array(F.lit(0.5), F.lit(0.95)))
    stats = rows.groupBy(system).agg(F.avg("found").alias("found_rate"), F.avg("mrr").alias("mrr"), F.avg("hit_at_5").alias("precision_at_5"), F.avg("latency").alias("latency_mean"), points.alias("_p"))
    stats = stats.select(system, "found_rate", "mrr", "precision_at_5", "latency_mean", F.col("_p")[0].alias("latency_p50"), F.col("_p")[1].alias("latency_p95"))
    names = ["found_rate", "mrr", "precision_at_5"]
    first = stats.where(F.col(system) == base).agg(F.struct(*[F.first(c).alias(c) for c in [*names, "latency_mean"]])).scalar()
    gain = lambda c: F.when(first[c] > 0, (F.col(c) - first[c]) / first[c] * 100).otherwise(0.0)
    out = stats.withColumns({f"{c}_gain": gain(c) for c in names}).withColumns({"latency_cost": F.col("latency_mean") - first["latency_mean"], "latency_ratio": F.coalesce(F.try_divide(F.col("latency_mean"), first["latency_mean"]), F.lit(0.0))})
    out = out.withColumn("mean_gain", (F.col("found_rate_gain") + F.col("mrr_gain") + F.col("precision_at_5_gain")) / 3)
    return _rounded(out, [c for c in out.columns if c != system], digits)


def best_and_worst(rows: DataFrame, group: str, by: str, n: int = 5) -> DataFrame:
    """(side, place, group, by): the n best and the n worst groups; ties go by name."""
    best = rows.orderBy(F.desc(by), group).limit(n)
    worst = rows.orderBy(by, F.desc(group)).limit(n)
    place = lambda side, order: lambda d: d.withColumns({"side": F.lit(side), "place": F.row_number().over(Window.orderBy(*order))}).select("side", "place", group, by)
    return best.transform(place("best", [F.desc(by), group])).unionByName(worst.transform(place("worst", [F.col(by), F.desc(group)])))


def page_breakdown(pages: DataFrame, kind: str, digits: int = 6) -> DataFrame:
    """(kind, pages, percent)."""
    counted = pages.groupBy(kind).agg(F.count("*").alias("pages"))
    total = pages.agg(F.count("*")).scalar()
    return counted.withColumn("percent", F.round(100 * F.col("pages") / total, digits))
