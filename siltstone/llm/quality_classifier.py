"""Quality classifier by a sparse ensemble of rules (operator 8).

Statistics of the whole text are Spark columns. Shallow regression trees are boosted
on labelled documents; every path from a root to a node is a rule, a conjunction of
threshold tests. A logistic regression with lasso penalty weighs the rules and leaves
few of them; those are compiled into one Spark column, so scoring is a projection of
the scan.

Fitting takes at most SAMPLE labelled documents, those of the smallest hashes of
their ids, which the driver holds as SAMPLE rows of statistics; only rows of the
training folds: crc32(doc_id as text) mod 4 other than 2. Labels, lang, source and
doc_id are no inputs of a score.

Cases: null and empty texts have statistics of zero and a score like any other; texts of
any length are measured whole, in the task that reads them; a doc_id with both labels
counts with each, one with several rows once, by the text of the smallest hash; without
any training label, or with one label only, as in empty tables, the score is the smoothed
share of label 1 for every document; repeated rows are scored alike, and ties in score
need no order; score() replaces columns of its own names, others pass through, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import fresh, named

SAMPLE = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
TREES, DEPTH, LEAF = 40, 3, 30
PENALTY = 0.002
BLANK = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, each a double."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.array_remove(F.split(text, BLANK, -1), "")
    per = lambda n, of: F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    distinct = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "words": distinct["n"].cast("double"),
        "word_chars": per(chars, distinct["n"]),
        "distinct_words": per(distinct["d"], distinct["n"]),
        "symbols": per(count(r"[#*$%&<>\\^~={}\[\]@_/+]"), chars),
        "bars": per(count(r"\|"), chars),
        "shouts": per(count(r"[!?]"), chars),
        "capitals": per(count(r"\p{Lu}"), chars),
        "digits": per(count(r"[0-9]"), chars),
        "stops": per(count(r"[.,;:]"), chars),
        "letters": per(count(r"\p{L}"), chars),
        "lines": per(count("\n"), chars),
    }


@dataclass
class Rules:
    """Weighted conjunctions of (statistic, over, threshold): value > threshold if over, else value <= threshold."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self, of: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for tests, weight in self.rules:
            holds = F.lit(True)
            for name, over, edge in tests:
                holds = holds & (of[name] > edge if over else of[name] <= edge)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, edges: list[np.ndarray], bins: np.ndarray, target: np.ndarray, rows: np.ndarray, depth: int, path: tuple, found: list) -> None:
    """Splits a node where squared error falls most; found gets (path, mean) of every node but the root."""
    if path:
        found.append((path, target[rows].mean(), depth == DEPTH))
    if depth == DEPTH or len(rows) < 2 * LEAF:
        if path:
            found[-1] = (*found[-1][:2], True)
        return
    best = (1e-9, None, None)
    y = target[rows]
    for j, cuts in enumerate(edges):
        if not len(cuts):
            continue
        b = bins[rows, j]
        n = np.bincount(b, minlength=len(cuts) + 1).cumsum()[:-1]
        s = np.bincount(b, weights=y, minlength=len(cuts) + 1).cumsum()[:-1]
        ok = (n >= LEAF) & (len(y) - n >= LEAF)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(y) - n, 1) - y.sum() ** 2 / len(y), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        if path:
            found[-1] = (*found[-1][:2], True)
        return
    _, j, k = best
    low = bins[rows, j] <= k
    for side, over in ((rows[low], False), (rows[~low], True)):
        _grow(x, edges, bins, target, side, depth + 1, (*path, (j, over, float(edges[j][k]))), found)


def _holds(path: tuple, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, over, edge in path:
        ok &= x[:, j] > edge if over else x[:, j] <= edge
    return ok


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> Rules:
    """Boosts trees, takes their paths as rules and weighs these by a lasso logistic regression."""
    ones = int(y.sum())
    if not len(y) or ones in (0, len(y)):
        share = (ones + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    rng = np.random.default_rng(8)
    margin = np.full(len(y), np.log(ones / (len(y) - ones)))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), max(2 * LEAF, len(y) // 2))) if len(y) > 2 * LEAF else np.arange(len(y))
        found: list = []
        _grow(x, edges, bins, y - 1 / (1 + np.exp(-margin)), rows, 0, (), found)
        for path, mean, leaf in found:
            paths[tuple(sorted(path))] = None
            if leaf:
                margin[_holds(path, x)] += 1.5 * mean
    # rules that hold for the same rows are one
    columns: dict[bytes, tuple] = {}
    for path in sorted(paths, key=lambda p: (len(p), p)):
        hit = _holds(path, x)
        if LEAF // 3 <= hit.sum() <= len(y) - LEAF // 3:
            columns.setdefault(np.packbits(hit).tobytes(), (path, hit))
    if not columns:
        share = (ones + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))))
    kept = list(columns.values())
    r = np.stack([h for _, h in kept], axis=1).astype(np.float64)
    weight, bias = _lasso(r, y)
    chosen = [k for k in np.argsort(-np.abs(weight), kind="stable") if abs(weight[k]) > 1e-3]
    rules = [(tuple((names[j], over, edge) for j, over, edge in kept[k][0]), float(weight[k])) for k in chosen]
    return Rules(float(bias), rules)


def _lasso(r: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss and PENALTY times the sum of absolute weights."""
    n = len(y)
    w, b = np.zeros(r.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    top = np.ones(r.shape[1]) / np.sqrt(r.shape[1])
    for _ in range(20):
        top = r.T @ (r @ top)
        size = np.linalg.norm(top)
        top /= size
    rate = 1 / (0.25 * (size / n + 1))
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(r @ v + c))) - y
        step = v - rate * (r.T @ g) / n
        new_w, new_b = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0), c - rate * g.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    """Rules from labels.quality (0 or 1) of the training folds."""
    train = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").alias("_doc"), F.col("quality").cast("int").alias("_quality"))
    train = train.where(fold(F.col("_doc")) != HELD_OUT).distinct().orderBy(F.xxhash64("_doc"), "_doc", "_quality").limit(SAMPLE)
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(train), F.col("doc_id") == F.col("_doc"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("_mark"), "_quality", *[c.alias(n) for n, c in stats.items()])
    # a doc_id's repeated rows count once for each label, the text of the smallest hash for all; so SAMPLE bounds the rows
    rows = rows.groupBy("doc_id", "_quality").agg(F.min(F.struct("_mark", *stats)).alias("_s")).select("doc_id", "_quality", "_s.*").orderBy("doc_id", "_quality").toArrow()
    x = np.stack([rows[n].to_numpy() for n in stats], axis=1) if len(rows) else np.zeros((0, len(stats)))
    return fit_rules(list(stats), x, rows["_quality"].to_numpy().astype(np.float64))


def _scored(docs: DataFrame, rules: Rules) -> tuple[DataFrame, str]:
    """docs with the score, and the name of that column, which docs lack."""
    found, stats = statistics(F.col("text")), fresh(docs, "stats")
    own = fresh(docs, "points")
    rows = docs.select("*", F.struct(*[c.alias(n) for n, c in found.items()]).alias(stats))
    return rows.select(*map(named, docs.columns), rules.column({n: F.col(stats).getField(n) for n in found}).alias(own)), own


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs with score, held_out and predicted."""
    rows, points = _scored(docs, rules)
    own = {"score": F.col(points), "held_out": F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)), "predicted": (F.col(points) >= THRESHOLD).cast("int")}
    return rows.select(*[named(c) for c in docs.columns if c not in own], *[c.alias(name) for name, c in own.items()])


def keep_good(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of docs whose score reaches THRESHOLD, unchanged."""
    rows, points = _scored(docs, rules)
    return rows.where(F.col(points) >= THRESHOLD).select(*map(named, docs.columns))
