"""Question sets: validation, selection, sampling, statistics and quality reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.models import Generator
from siltstone.session import cut

#: Fixed lists of the quality rules.
VAGUE = ["something", "anything", "somehow", "maybe", "possibly"]
CATEGORIES = ["single-hop", "multi-hop", "cross-page", "numerical", "causal", "comparison", "temporal", "definition", "list"]
MULTI_HOP = ["multi-hop", "cross-page", "causal", "temporal", "comparison"]
UNSURE = ["i don't know", "i do not know", "cannot find", "not mentioned", "no information"]


def any_of(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def unsure(answer: Column) -> Column:
    """Whether an answer says that it doesn't know."""
    return F.coalesce(any_of(F.lower(answer), UNSURE), F.lit(False))


def grounded(answer: Column, context: Column) -> Column:
    """The part of the answer's distinct words that the context has, and whether that is enough (up to 5 words always are)."""
    own = F.array_distinct(T.words(F.lower(answer)))
    part = T.overlap(own, T.words(F.lower(context)))
    return F.struct(F.size(own).alias("words"), part.alias("overlap"), ((F.size(own) <= 5) | (part >= 0.3)).alias("grounded"))


def review_overlap(answer: Column, document: Column) -> Column:
    """The part of the answer's distinct words of more than 3 letters that the document has; below 0.5 it needs a review."""
    own = F.array_distinct(F.filter(T.words(F.lower(answer)), lambda w: F.length(w) > 3))
    return T.overlap(own, T.words(F.lower(document)))


#: Cosine from which on two questions say the same.
SAME = 0.85


def validate(rows: DataFrame, order: str, question: str = "question", answer: str = "answer", context: str = "context", vector: str | None = None, same: float = SAME) -> DataFrame:
    """rows with reason, the first rule a question breaks or valid, in the rules' order.

    Duplicates are judged in the order of a column: the first question of a normal form
    that reaches the rule stands, whatever becomes of it afterwards. With a column of
    vectors, a question whose cosine with an earlier valid one is at least same is a
    semantic duplicate; that rule stands between exact duplicates and grounding.
    """
    q, a = T.strip(F.col(question)), T.strip(F.col(answer))
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", f"missing {c}") for c in (question, answer, "question_type", "difficulty")]
    early = F.coalesce(*missing, F.when(F.length(q) < 10, "question too short"), F.when(F.length(q) > 300, "question too long"), F.when(F.length(a) < 5, "answer too short"))
    rows = rows.withColumns({"_early": early, "_hash": T.question_hash(F.col(question))})
    seen = Window.partitionBy("_hash").orderBy(F.col("_early").isNotNull(), order)
    rows = rows.withColumn("_nth", F.row_number().over(seen))
    reason = F.coalesce("_early", F.when(F.col("_nth") > 1, "exact duplicate"))
    late = F.when(~grounded(F.col(answer), F.col(context))["grounded"], "not grounded")
    if vector is None:
        return rows.withColumn("reason", F.coalesce(reason, late, F.lit("valid"))).drop("_early", "_hash", "_nth")
    rows = rows.withColumns({"_reason": reason, "_late": late})
    asked = rows.where("_reason IS NULL").select(F.col(order).alias("key"), F.col(vector).alias("vector"), F.col("_late").isNull().alias("standing"))
    copies = said_before(asked, same).select(F.col("key").alias("_key"))
    met = rows.join(copies, F.col(order) == F.col("_key"), "left")
    found = F.coalesce("_reason", F.when(F.col("_key").isNotNull(), "semantic duplicate"), "_late", F.lit("valid"))
    return met.withColumn("reason", found).drop("_early", "_hash", "_nth", "_reason", "_late", "_key")


def said_before(rows: DataFrame, same: float = SAME) -> DataFrame:
    """(key) of the rows (key, vector, standing) alike to an earlier accepted one; accepted are standing rows that are alike to no earlier accepted one.

    Pairs come from products of blocks of vectors. Then each turn accepts the rows without
    an undecided earlier neighbour and drops their neighbours, as decisions go in order.
    State is written out between turns, so that plans do not grow with them.
    """
    from siltstone.operators.vector import alike

    rows = cut(rows)
    standing = rows.where("standing")
    pairs = cut(alike(standing, rows, "key", "vector", same).where("a < b"))
    # only standing rows decide over one another
    edges = cut(pairs.join(standing.select(F.col("key").alias("b")), "b", "left_semi").select("a", "b"))
    lost = None
    while not edges.isEmpty():
        free = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = cut(edges.join(free, "a").select("b").distinct())
        lost = out if lost is None else lost.unionByName(out)
        # the free ones' edges all end in rows that are out
        gone = out.select(F.col("b").alias("x"))
        edges = cut(edges.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti"))
    accepted = standing.select(F.col("key").alias("a"))
    if lost is not None:
        accepted = accepted.join(lost.select(F.col("b").alias("a")), "a", "left_anti")
    return pairs.join(accepted, "a", "left_semi").select(F.col("b").alias("key")).distinct()


#: What a model's list of questions holds.
ASKED = "array<struct<question:string,answer:string,question_type:string,difficulty:string,page_reference:string,evidence_snippets:array<string>>>"


def generate(docs: DataFrame, document: str, chunks: Column, n: int, build: Callable[[], Generator], vector: Callable[[Column], Column] | None = None) -> DataFrame:
    """(document, id, question, answer, question_type, difficulty, page_reference, reason) of at most n questions for each document.

    chunks is an array of (text, pages). Each chunk is asked for max(1, n // chunks)
    questions, a single one for n; a reply's questions are validated against their chunk, numbered, and if
    more than n are valid, of each type the first ones stay.
    """
    from siltstone.functions import models, prompts
    from siltstone.operators import parsing

    parts = docs.select(F.col(document).alias("_doc"), F.size(chunks).alias("_of"), F.posexplode(chunks).alias("_chunk", "_c"))
    each = F.when(F.col("_of") > 1, F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_of")))).otherwise(n).cast("int")
    asked = parts.withColumn("_reply", models.generation(prompts.question_prompt(F.col("_c.text"), F.col("_c.pages"), each), build)["reply"])
    rows = asked.select("_doc", "_of", "_chunk", F.col("_c.text").alias("context"), F.posexplode(parsing.json_list(F.col("_reply"), ASKED)).alias("_spot", "_q")).select("_doc", "_of", "_chunk", "_spot", "context", "_q.*")
    rows = rows.withColumn("_order", F.format_string("%s:%08d:%08d", F.col("_doc").cast("string"), F.col("_chunk"), F.col("_spot")))
    if vector is not None:
        rows = rows.withColumn("_vector", vector(F.col("question")))
    judged = validate(rows, "_order", vector="_vector" if vector is not None else None).where("reason = 'valid'")
    place = F.row_number().over(Window.partitionBy("_doc").orderBy("_chunk", "_spot"))
    many = F.when(F.col("_of") > 1, "Multiple pages").otherwise("Page 1")
    named = judged.withColumn("_place", place).withColumns({"id": F.format_string("%s_q%03d", F.col("_doc").cast("string"), F.col("_place")), "page_reference": F.coalesce(F.nullif("page_reference", F.lit("")), many)})
    # of each type the first max(1, n // types), types in the order they appear, then the first of the rest
    kinds = named.groupBy("_doc", "question_type").agg(F.min("_place").alias("_first"))
    share = kinds.groupBy("_doc").agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.count("*"))).alias("_share"))
    nth = F.row_number().over(Window.partitionBy("_doc", "question_type").orderBy("_place"))
    ranked = named.join(kinds, ["_doc", "question_type"]).join(share, "_doc").withColumn("_rest", nth > F.col("_share"))
    order = Window.partitionBy("_doc").orderBy("_rest", F.when(~F.col("_rest"), F.col("_first")), "_place")
    return ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).select(F.col("_doc").alias(document), "id", "question", "answer", "question_type", "difficulty", "page_reference", "reason")


def number(rows: DataFrame, document: str, order: str) -> DataFrame:
    """rows with id, <document>_q001 and on, in the order of a column."""
    n = F.row_number().over(Window.partitionBy(document).orderBy(order))
    return rows.withColumn("id", F.format_string("%s_q%03d", F.col(document).cast("string"), n))


def diverse(rows: DataFrame, kind: str, order: str, n: int) -> DataFrame:
    """n rows: of each kind, in the order kinds appear, the first max(1, n // kinds); then the first of the rest."""
    kinds = rows.groupBy(kind).agg(F.min(order).alias("_first"))
    each = kinds.agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.count("*")))).scalar()
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    ranked = rows.join(kinds, kind).withColumn("_nth", nth).withColumn("_rest", F.col("_nth") > each)
    return ranked.orderBy("_rest", F.when(F.col("_rest"), F.lit(None)).otherwise(F.col("_first")), order).limit(n).select(*rows.columns)


def category_samples(rows: DataFrame, kind: str, order: str, n: int = 3) -> DataFrame:
    """(category, nth, ...): the first n rows of each category that their kind contains; a row may be in several."""
    held = F.filter(F.array(*[F.lit(c) for c in CATEGORIES]), lambda c: F.contains(F.lower(F.col(kind)), c))
    each = rows.withColumn("category", F.explode(held))
    return each.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy(order))).where(F.col("nth") <= n)


def problems(question: Column, answer: Column, kind: Column, evidence: Column) -> Column:
    """What may be wrong with a question, as an array of names."""
    q, n = F.coalesce(question, F.lit("")), F.length(F.coalesce(answer, F.lit("")))
    marks = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
    bare = F.coalesce(evidence, F.lit(0)) == 0
    rules = [
        F.when(n < 20, "very short answer").when(n > 400, "very long answer"),
        F.when(marks > 1, "several question marks"),
        F.when(any_of(F.lower(q), VAGUE), "vague language"),
        F.when(bare & any_of(F.coalesce(kind, F.lit("")), ["multi-hop", "cross-page"]), "complex without evidence"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def statistics(rows: DataFrame) -> DataFrame:
    """(name, value): questions by type and difficulty, share of multi-hop kinds, mean answer length, questions with evidence."""
    pair = lambda prefix: lambda d: d.select(F.concat(F.lit(prefix), "value").alias("name"), F.col("n").cast("double").alias("value"))
    groups = [rows.groupBy(F.coalesce(c, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).transform(pair(f"{c}:")) for c in ("question_type", "difficulty")]
    hop = F.count_if(any_of(F.coalesce("question_type", F.lit("")), ["multi-hop", "cross-page", "causal"]))
    sums = rows.agg(
        F.count("*").cast("double").alias("questions"),
        F.round(100 * hop / F.count("*"), 2).alias("multi_hop_percent"),
        F.floor(F.avg(F.length(F.coalesce("answer", F.lit(""))))).cast("double").alias("mean_answer_length"),
        F.count_if(F.coalesce("evidence", F.lit(0)) > 0).cast("double").alias("with_evidence"),
    )
    return reduce(DataFrame.unionByName, [*groups, sums.unpivot([], list(sums.columns), "name", "value")])


def quality_report(rows: DataFrame) -> DataFrame:
    """(check, value, warning): the checks of a question set with whether each is out of its bounds."""
    total = F.count("*")
    kind, level = F.coalesce("question_type", F.lit("unknown")), F.coalesce("difficulty", F.lit("unknown"))
    size = F.length(F.coalesce("answer", F.lit("")))
    percent = lambda c: F.round(100 * F.count_if(c) / total, 2)
    sums = rows.agg(
        percent(any_of(kind, MULTI_HOP)).alias("multi_hop_percent"),
        percent(F.coalesce("evidence", F.lit(0)) > 0).alias("evidence_percent"),
        percent(level == "easy").alias("easy_percent"),
        F.count_if((size < 10) | (size > 500)).cast("double").alias("answer_length_issues"),
        F.count_if(F.coalesce("reasoning", F.lit("")) != "").cast("double").alias("with_reasoning"),
        F.count_if(F.contains(F.coalesce("page_reference", F.lit("")), F.lit("Multiple")) | F.contains(F.coalesce("page_reference", F.lit("")), F.lit("-"))).cast("double").alias("cross_page"),
    )
    again = exact_duplicates(rows).agg(F.count("*").cast("double").alias("value")).select(F.lit("duplicate_questions").alias("check"), "value")
    every = sums.unpivot([], list(sums.columns), "check", "value").unionByName(again)
    bad = (
        F.when(F.col("check") == "multi_hop_percent", F.col("value") < 30)
        .when(F.col("check") == "evidence_percent", F.col("value") < 50)
        .when(F.col("check") == "easy_percent", F.col("value") > 30)
        .when(F.col("check").isin("answer_length_issues", "duplicate_questions"), F.col("value") > 0)
        .otherwise(False)
    )
    return every.withColumn("warning", bad)


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """(question, n): lower-cased questions without outer blanks that occur more than once."""
    return rows.groupBy(T.strip(F.lower("question")).alias("question")).agg(F.count("*").alias("n")).where("n > 1")


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the smallest hashes of a key and a seed, the same in every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def review_sheet(rows: DataFrame, columns: list[str], cut: int = 200, cut_columns: tuple[str, ...] = ("answer", "evidence")) -> DataFrame:
    """Text columns fit for a tab-separated sheet: tabs and line ends as spaces, long ones cut."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ")
    return rows.select(*[(F.substring(flat(c), 1, cut) if c in cut_columns else flat(c)).alias(c) for c in columns])
