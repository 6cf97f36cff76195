"""Queries of question validation, selection and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import models, prompts
from siltstone.functions import text as T
from siltstone.operators import dedup, fusion, parsing
from siltstone.operators import questions as Q
from siltstone.plans.tables import CONTEXT_SQL, QUESTIONS_SQL, questions, questions_in_context, strip_sql, table, words_sql

_HASH = rf"md5(regexp_replace({strip_sql('lower(question)')}, '[^\p{{L}}\p{{N}}\s]', '', 'g'))"


def exact_question_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).select("question_id", "question", T.question_hash(F.col("question")).alias("hash"))
    return dedup.questions_by_hash(rows, "question", "question_id").select("question_id", "hash", "duplicate")


def exact_duplicate_questions(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("role").alias("question"))
    texts = table(spark, d, "documents").select(F.col("text").alias("question"))
    return Q.exact_duplicates(turns.unionByName(texts)).select(F.md5("question").alias("question"), "n")


def word_overlap_grounding(spark: SparkSession, d: str) -> DataFrame:
    rows = questions_in_context(spark, d).where("answer IS NOT NULL AND context IS NOT NULL")
    g = Q.grounded(F.col("answer"), F.col("context"))
    part = Q.review_overlap(F.col("answer"), F.col("context"))
    rows = rows.select("question_id", g.alias("g"), F.round(part, 6).alias("review_overlap"))
    return rows.select("question_id", F.col("g.words").cast("long").alias("words"), F.round("g.overlap", 6).alias("overlap"), F.col("g.grounded").alias("grounded"), "review_overlap")


_WORDS = f"list_distinct({words_sql('lower(answer)')})"
_LONG = "list_filter(own, lambda w: length(w) > 3)"
_GROUNDING = f"""{CONTEXT_SQL}, w AS (SELECT *, {_WORDS} AS own, {words_sql('lower(context)')} AS there FROM q),
g AS (SELECT *, CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_intersect(own, there)) / len(own) END AS part FROM w)"""
_GROUNDING_SQL = f"WITH {_GROUNDING} SELECT question_id, CAST(len(own) AS BIGINT) AS words, round(part, 6) AS overlap, len(own) <= 5 OR part >= 0.3 AS grounded, round(CASE WHEN len({_LONG}) = 0 THEN 0.0 ELSE len(list_intersect({_LONG}, there)) / len({_LONG}) END, 6) AS review_overlap FROM g WHERE answer IS NOT NULL AND context IS NOT NULL"


def question_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = questions_in_context(spark, d).withColumn("context", F.coalesce("context", F.lit("")))
    return Q.validate(rows, "question_id").select("question_id", "reason")


_VALIDATION_SQL = f"""WITH {_GROUNDING},
e AS (SELECT question_id, own, part, {_HASH} AS h, CASE WHEN coalesce(question, '') = '' THEN 'missing question' WHEN coalesce(answer, '') = '' THEN 'missing answer' WHEN coalesce(question_type, '') = '' THEN 'missing question_type' WHEN coalesce(difficulty, '') = '' THEN 'missing difficulty'
  WHEN length({strip_sql('question')}) < 10 THEN 'question too short' WHEN length({strip_sql('question')}) > 300 THEN 'question too long' WHEN length({strip_sql('answer')}) < 5 THEN 'answer too short' END AS early FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY early IS NOT NULL, question_id) AS nth FROM e)
SELECT question_id, coalesce(early, CASE WHEN nth > 1 THEN 'exact duplicate' WHEN NOT (len(own) <= 5 OR part >= 0.3) THEN 'not grounded' ELSE 'valid' END) AS reason FROM n"""


def problem_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = Q.problems(F.col("question"), F.col("answer"), F.col("question_type"), F.col("evidence"))
    return questions(spark, d).select("question_id", F.array_join(flags, "; ").alias("issues")).where("issues <> ''")


_VAGUE = " OR ".join(f"contains(lower(question), '{w}')" for w in Q.VAGUE)
_FLAGS_SQL = f"""WITH {QUESTIONS_SQL}, f AS (SELECT question_id, concat_ws('; ', CASE WHEN length(coalesce(answer, '')) < 20 THEN 'very short answer' WHEN length(coalesce(answer, '')) > 400 THEN 'very long answer' END,
  CASE WHEN length(question) - length(replace(question, '?', '')) > 1 THEN 'several question marks' END, CASE WHEN {_VAGUE} THEN 'vague language' END,
  CASE WHEN evidence = 0 AND (contains(coalesce(question_type, ''), 'multi-hop') OR contains(coalesce(question_type, ''), 'cross-page')) THEN 'complex without evidence' END) AS issues FROM q0)
SELECT * FROM f WHERE issues <> ''"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))


_TYPED_SQL = f"{QUESTIONS_SQL}, t AS (SELECT question_id, coalesce(question_type, 'unknown') AS kind FROM q0)"


def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    return Q.diverse(_typed(spark, d), "question_type", "question_id", 40).select("question_id", "question_type")


_DIVERSE_SQL = f"""WITH {_TYPED_SQL}, k AS (SELECT kind, min(question_id) AS first FROM t GROUP BY 1), n AS (SELECT greatest(1, CAST(floor(40 / count(*)) AS INT)) AS each FROM k),
r AS (SELECT question_id, t.kind, first, row_number() OVER (PARTITION BY t.kind ORDER BY question_id) > each AS rest FROM t JOIN k ON k.kind = t.kind, n)
SELECT question_id, kind AS question_type FROM r ORDER BY rest, CASE WHEN rest THEN NULL ELSE first END NULLS FIRST, question_id LIMIT 40"""


def category_samples(spark: SparkSession, d: str) -> DataFrame:
    return Q.category_samples(_typed(spark, d), "question_type", "question_id").select("category", "nth", "question_id")


_CATEGORIES = "[" + ", ".join(f"'{c}'" for c in Q.CATEGORIES) + "]"
_SAMPLES_SQL = f"""WITH {_TYPED_SQL}, c AS (SELECT unnest({_CATEGORIES}) AS category)
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY question_id) AS INT) AS nth, question_id FROM t JOIN c ON contains(lower(kind), category) QUALIFY nth <= 3"""


def question_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.statistics(questions(spark, d))


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_STATS_SQL = f"""WITH {QUESTIONS_SQL}
SELECT 'question_type:' || coalesce(question_type, 'unknown') AS name, CAST(count(*) AS DOUBLE) AS value FROM q0 GROUP BY 1
UNION ALL SELECT 'difficulty:' || coalesce(difficulty, 'unknown'), CAST(count(*) AS DOUBLE) FROM q0 GROUP BY 1
UNION ALL SELECT 'questions', CAST(count(*) AS DOUBLE) FROM q0
UNION ALL SELECT 'multi_hop_percent', round(100 * count(*) FILTER (WHERE {_any("coalesce(question_type, '')", ["multi-hop", "cross-page", "causal"])}) / count(*), 2) FROM q0
UNION ALL SELECT 'mean_answer_length', floor(avg(length(coalesce(answer, '')))) FROM q0
UNION ALL SELECT 'with_evidence', CAST(count(*) FILTER (WHERE evidence > 0) AS DOUBLE) FROM q0"""


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.quality_report(questions(spark, d))


_REPORT_SQL = f"""WITH {QUESTIONS_SQL}, d AS (SELECT count(*) AS n FROM (SELECT {strip_sql('lower(question)')} AS s FROM q0 GROUP BY 1 HAVING count(*) > 1)),
r AS (SELECT 'multi_hop_percent' AS "check", round(100 * count(*) FILTER (WHERE {_any("coalesce(question_type, 'unknown')", Q.MULTI_HOP)}) / count(*), 2) AS value FROM q0
UNION ALL SELECT 'evidence_percent', round(100 * count(*) FILTER (WHERE evidence > 0) / count(*), 2) FROM q0
UNION ALL SELECT 'easy_percent', round(100 * count(*) FILTER (WHERE difficulty = 'easy') / count(*), 2) FROM q0
UNION ALL SELECT 'answer_length_issues', CAST(count(*) FILTER (WHERE length(coalesce(answer, '')) < 10 OR length(coalesce(answer, '')) > 500) AS DOUBLE) FROM q0
UNION ALL SELECT 'with_reasoning', CAST(count(*) FILTER (WHERE reasoning <> '') AS DOUBLE) FROM q0
UNION ALL SELECT 'cross_page', CAST(count(*) FILTER (WHERE contains(page_reference, 'Multiple') OR contains(page_reference, '-')) AS DOUBLE) FROM q0
UNION ALL SELECT 'duplicate_questions', CAST(n AS DOUBLE) FROM d)
SELECT "check", value, CASE "check" WHEN 'multi_hop_percent' THEN value < 30 WHEN 'evidence_percent' THEN value < 50 WHEN 'easy_percent' THEN value > 30 WHEN 'answer_length_issues' THEN value > 0 WHEN 'duplicate_questions' THEN value > 0 ELSE false END AS warning FROM r"""


def dont_know_detector(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("conv_id") % 4 == 0, F.concat("answer", F.lit(" This is Not Mentioned."))).otherwise(F.col("answer"))
    return questions(spark, d).select("question_id", Q.unsure(said).alias("unsure"))


_UNSURE_SQL = f"WITH {QUESTIONS_SQL}, s AS (SELECT question_id, CASE WHEN conv_id % 4 = 0 THEN answer || ' This is Not Mentioned.' ELSE answer END AS said FROM q0) SELECT question_id, coalesce({' OR '.join(chr(39).join(('contains(lower(said), ', w.replace(chr(39), chr(39) * 2), ')')) for w in Q.UNSURE)}, false) AS unsure FROM s"


def numbered_questions(spark: SparkSession, d: str) -> DataFrame:
    return Q.number(questions(spark, d), "conv_id", "question_id").select("question_id", "id")


_NUMBERED_SQL = f"WITH {QUESTIONS_SQL} SELECT question_id, conv_id || '_q' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY question_id) AS VARCHAR), 3, '0') AS id FROM q0"


def review_sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).withColumn("question_id", F.col("question_id").cast("string"))
    return Q.review_sheet(rows, ["question_id", "question", "answer", "question_type"])


_FLAT = "regexp_replace(coalesce({}, ''), '[\\t\\r\\n]', ' ', 'g')"
_SHEET_SQL = f"WITH {QUESTIONS_SQL} SELECT CAST(question_id AS VARCHAR) AS question_id, {_FLAT.format('question')} AS question, substring({_FLAT.format('answer')}, 1, 200) AS answer, {_FLAT.format('question_type')} AS question_type FROM q0"


def structured_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers given the five fields, and read back from them."""
    raw = F.concat(F.lit("**Answer:** "), F.col("answer"), F.lit("\n**Evidence:** "), F.substring("question", 1, 40), F.lit("\n**Confidence:** Medium to High\n**Missing Info:** none"))
    rows = questions(spark, d).where("answer IS NOT NULL").withColumn("raw", F.when(F.col("conv_id") % 2 == 0, raw).otherwise(F.col("answer")))
    return rows.select("question_id", parsing.structured_answer(F.col("raw")).alias("p")).select("question_id", "p.*")


_CR = "chr(10)"


def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = questions_in_context(spark, d).where("context IS NOT NULL")
    kind = F.when(F.col("conv_id") % 2 == 0, "reasoning").otherwise("single-hop")
    return rows.select("question_id", F.md5(prompts.answer_prompt(F.col("question"), F.col("context"), kind, 500)).alias("prompt_md5"), F.md5(prompts.plain_prompt(F.col("question"), F.col("context"))).alias("plain_md5"))


_FIELDS = "'Reply with **Answer:**, **Evidence:**, **Confidence:** (High, Medium or Low), **Safety Notes:** and **Missing Info:**, each on a line of its own.'"
_PROMPTS_SQL = f"""WITH {CONTEXT_SQL} SELECT question_id,
md5('Answer from the context only.' || {_CR} || CASE WHEN conv_id % 2 = 0 THEN 'Think step by step and compare the sources before you answer.' || {_CR} ELSE '' END || {_FIELDS} || {_CR} || 'Question: ' || question || {_CR} || 'Context:' || {_CR} || substring(context, 1, 500)) AS prompt_md5,
md5('Answer the question from the context.' || {_CR} || 'Question: ' || question || {_CR} || 'Context:' || {_CR} || context) AS plain_md5 FROM q WHERE context IS NOT NULL"""


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = questions_in_context(spark, d).where("context IS NOT NULL AND answer IS NOT NULL")
    return rows.select("question_id", F.md5(prompts.judge_pair(F.col("conv_id"), F.col("question"), F.col("context"), F.col("answer"), F.col("context"))).alias("prompt_md5"))


_JUDGE_PROMPTS_SQL = f"""WITH {CONTEXT_SQL} SELECT question_id, md5('[' || conv_id || ']' || {_CR} || 'Question: ' || substring(question, 1, 200) || {_CR} || 'Context: ' || substring(context, 1, 800) || {_CR} || 'Answer: ' || substring(answer, 1, 400) || {_CR} || 'Reference: ' || substring(context, 1, 200)) AS prompt_md5 FROM q WHERE context IS NOT NULL AND answer IS NOT NULL"""


def question_prompts(spark: SparkSession, d: str) -> DataFrame:
    pages = F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.md5(prompts.question_prompt(F.col("text"), pages, 4)).alias("prompt_md5"))


_QUESTION_PROMPTS_SQL = f"""SELECT doc_id, md5('Write 4 questions as a JSON list with question, answer, question_type, difficulty, page_reference and evidence_snippets. Difficulty: 20% easy, 50% medium, 30% hard.' || {_CR} || 'Pages: ' || array_to_string(range(1, doc_id % 4 + 2), ', ') || {_CR} || 'Text:' || {_CR} || text) AS prompt_md5 FROM documents"""


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("file"), F.concat("l_linestatus", F.lit(" "), F.col("l_partkey").cast("string")).alias("body"))
    first = rows.groupBy("l_orderkey", "rank").agg(F.min(F.struct("body", "score", "file")).alias("s")).select("l_orderkey", "rank", "s.*")
    plain = fusion.context(first, "l_orderkey", "file", "body")
    return plain.join(fusion.context(first, "l_orderkey", "file", "body", scores=True).withColumnRenamed("context", "scored"), "l_orderkey")


_BLOCK = f"string_agg({{}}, {_CR} || {_CR} ORDER BY rank)"
_CONTEXT_BLOCKS_SQL = f"""WITH r AS (SELECT l_orderkey, l_linenumber AS rank, l_discount AS score, l_returnflag AS file, l_linestatus || ' ' || l_partkey AS body FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY body, score, file) = 1)
SELECT l_orderkey, {_BLOCK.format(f"'[Document: ' || file || ']' || {_CR} || body")} AS context, {_BLOCK.format(f"printf('[Document %d] (Score: %.4f)', rank, score) || {_CR} || body")} AS scored FROM r GROUP BY 1"""


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", fusion.cache_key(F.col("text"), k=10, rerank=True).alias("cache_key"))


def random_questions(spark: SparkSession, d: str) -> DataFrame:
    return Q.random_sample(questions(spark, d), "question_id", 25, 7).select("question_id")


_RANDOM_SQL = f"WITH {QUESTIONS_SQL} SELECT question_id FROM q0 ORDER BY md5(question_id || ':7'), question_id LIMIT 25"


def rerank_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each question's source by a scorer of pairs: a stand-in for a cross encoder."""
    asked = questions(spark, d).select("question_id", "conv_id", "question")
    docs = table(spark, d, "documents").select("doc_id", "text")
    short = asked.withColumn("doc_id", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + 19))).join(docs, "doc_id").withColumn("rank", F.col("doc_id") - F.col("conv_id"))
    return fusion.rerank(short, "question_id", "doc_id", models.pair_score(F.col("question"), F.col("text")), 5).select("question_id", "doc_id", "rerank_score", "rank")


_RERANK_PAIRS_SQL = f"""WITH {QUESTIONS_SQL}, s AS (SELECT question_id, doc_id, doc_id - conv_id AS r, list_distinct({words_sql('lower(question)')}) AS x, list_distinct({words_sql('lower(text)')}) AS y FROM q0 JOIN documents ON doc_id BETWEEN conv_id AND conv_id + 19),
j AS (SELECT *, len(list_intersect(x, y)) AS n FROM s), k AS (SELECT question_id, doc_id, r, round(CASE WHEN len(x) + len(y) - n = 0 THEN 0.0 ELSE n / (len(x) + len(y) - n) END, 6) AS rerank_score FROM j)
SELECT question_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, r, doc_id) AS INT) AS rank FROM k QUALIFY rank <= 5"""


def semantic_validation(spark: SparkSession, d: str) -> DataFrame:
    """Questions validated with vectors, those of the same number among the embeddings."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector"))
    rows = questions_in_context(spark, d).withColumn("context", F.coalesce("context", F.lit(""))).join(vectors, "conv_id")
    return Q.validate(rows, "question_id", vector="vector", same=_SAME).select("question_id", "reason")


_SAME = 0.25
_SEMANTIC_SQL = f"""WITH RECURSIVE {_GROUNDING},
e AS (SELECT question_id, own, part, {_HASH} AS h, CAST(v.embedding AS DOUBLE[]) AS v, CASE WHEN coalesce(question, '') = '' THEN 'missing question' WHEN coalesce(answer, '') = '' THEN 'missing answer' WHEN coalesce(question_type, '') = '' THEN 'missing question_type' WHEN coalesce(difficulty, '') = '' THEN 'missing difficulty'
  WHEN length({strip_sql('question')}) < 10 THEN 'question too short' WHEN length({strip_sql('question')}) > 300 THEN 'question too long' WHEN length({strip_sql('answer')}) < 5 THEN 'answer too short' END AS early FROM g JOIN embeddings v ON v.vec_id = g.conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY early IS NOT NULL, question_id) AS nth FROM e),
a AS (SELECT *, row_number() OVER (ORDER BY question_id) AS i FROM n WHERE early IS NULL AND nth = 1),
s AS (SELECT b.i, list(a.i) FILTER (WHERE a.i < b.i AND round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) >= {_SAME}) AS near, any_value(len(b.own) <= 5 OR b.part >= 0.3) AS standing FROM a b, a GROUP BY 1),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, false AS again UNION ALL
  SELECT s.i, CASE WHEN s.standing AND NOT list_has_any(r.kept, coalesce(s.near, [])) THEN list_append(r.kept, s.i) ELSE r.kept END, list_has_any(r.kept, coalesce(s.near, [])) FROM r JOIN s ON s.i = r.i + 1)
SELECT n.question_id, coalesce(n.early, CASE WHEN n.nth > 1 THEN 'exact duplicate' WHEN r.again THEN 'semantic duplicate' WHEN NOT (len(n.own) <= 5 OR n.part >= 0.3) THEN 'not grounded' ELSE 'valid' END) AS reason FROM n LEFT JOIN a ON a.question_id = n.question_id LEFT JOIN r ON r.i = a.i"""


def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions on every document out of a stand-in, by chunk, validated, numbered and cut to six."""
    text = F.expr("transform(sequence(0, CAST(length(text) / 1500 AS INT)), k -> named_struct('text', substring(text, k * 1500 + 1, 1500), 'pages', array(k + 1)))")
    return Q.generate(table(spark, d, "documents"), "doc_id", text, 6, models.TemplateQuestions)


def answer_graph(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn answered from the three nearest benchmark passages, all models stand-ins."""
    rows = questions(spark, d).select("question_id", "question")
    return fusion.answers(rows, "question_id", "question", table(spark, d, "benchmark"), "item_id", "text", models.embedding, models.generation)


def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """Lists read out of replies: fenced, within prose, broken, and none."""
    item = F.concat(F.lit('[{"question": "q'), F.col("o_orderkey").cast("string"), F.lit('", "answer": "a"}, {"question": "z"}]'))
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Sure: "), item, F.lit(" done"))).when(F.col("o_orderkey") % 4 == 2, F.lit("[{broken")).otherwise(F.lit("nothing"))
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode_outer(parsing.json_list(said, "array<struct<question:string,answer:string>>")).alias("nth", "q"))
    return rows.select("o_orderkey", "nth", "q.question", "q.answer")


_JSON_SQL = """SELECT o_orderkey, 0 AS nth, 'q' || o_orderkey AS question, 'a' AS answer FROM orders WHERE o_orderkey % 4 < 2 UNION ALL SELECT o_orderkey, 1, 'z', NULL FROM orders WHERE o_orderkey % 4 < 2 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 4 >= 2"""


def heading_replies(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit('Headings: [{"heading": " H'), F.col("o_orderkey").cast("string"), F.lit(' ", "level": '), (F.col("o_orderkey") % 9).cast("string"), F.lit('}, {"heading": " "}, {"heading": "plain"}]'))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(parsing.model_headings(said)).alias("h"))
    return rows.select("o_orderkey", "h.heading", "h.level")


_HEADING_REPLIES_SQL = "SELECT o_orderkey, 'H' || o_orderkey AS heading, CAST(greatest(1, least(6, o_orderkey % 9)) AS INT) AS level FROM orders UNION ALL SELECT o_orderkey, 'plain', 2 FROM orders"


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Scores read out of four kinds of replies: a fenced list, an object that holds one, a flat object in prose, and a line of numbers."""
    f, c, k = ((F.col("o_orderkey") % n - 2).cast("string") for n in (15, 11, 13))
    one = F.concat(F.lit('{"faithfulness": '), f, F.lit(', "completeness": '), c, F.lit(', "correctness": '), k, F.lit("}"))
    line = F.concat(F.lit("3) "), F.abs(f.cast("int")).cast("string"), F.lit(", "), F.abs(c.cast("int")).cast("string"), F.lit(" and "), F.abs(k.cast("int")).cast("string"))
    kind = F.col("o_orderkey") % 4
    said = F.when(kind == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(kind == 1, F.concat(F.lit('{"results": ['), one, F.lit("]}"))).when(kind == 2, F.concat(F.lit("I say {not json} but "), one, F.lit(" so."))).otherwise(line)
    rows = table(spark, d, "orders").select("o_orderkey", parsing.parse_judge(said, F.lit(2)).alias("s"))
    return rows.select("o_orderkey", F.posexplode("s").alias("nth", "s")).select("o_orderkey", "nth", "s.*")


_CLAMPED = ", ".join(f"CAST(CASE WHEN o_orderkey % 4 = 3 THEN abs(o_orderkey % {n} - 2) ELSE greatest(0, least(10, o_orderkey % {n} - 2)) END AS DOUBLE) AS {c}" for n, c in ((15, "faithfulness"), (11, "completeness"), (13, "correctness")))
_JUDGE_SQL = f"SELECT o_orderkey, 0 AS nth, {_CLAMPED} FROM orders UNION ALL SELECT o_orderkey, 1, 0, 0, 0 FROM orders"


def claim_replies(spark: SparkSession, d: str) -> DataFrame:
    """Claims read out of lists, objects with results, single objects and prose."""
    n, bad = (F.col("o_orderkey") % 6).cast("string"), (F.col("o_orderkey") % 3).cast("string")
    one = F.concat(F.lit('{"claims": '), n, F.lit(', "hallucinated": '), bad, F.lit("}"))
    kind = F.col("o_orderkey") % 4
    said = F.when(kind == 0, F.concat(F.lit("["), one, F.lit("]"))).when(kind == 1, F.concat(F.lit('```json\n{"results": ['), one, F.lit("]}\n```"))).when(kind == 2, one).otherwise(F.lit("none"))
    rows = table(spark, d, "orders").select("o_orderkey", F.get(parsing.parse_claims(said, F.lit(1)), F.lit(0)).alias("c"))
    return rows.select("o_orderkey", "c.claims", "c.hallucinated", F.round("c.rate", 6).alias("rate"))


_CLAIMS_SQL = """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE o_orderkey % 6 END AS INT) AS claims, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE o_orderkey % 3 END AS INT) AS hallucinated, CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 6 = 0 THEN 0.0 ELSE round((o_orderkey % 3) / (o_orderkey % 6), 6) END AS rate FROM orders"""

_FIELD = "nullif(regexp_extract(raw, '(?s)\\*\\*{}:\\*\\*\\s*(.+?)(?:\\n\\*\\*|\\z)', 1), '')"
_LEVEL = "coalesce(regexp_extract(raw, '(?s)\\*\\*Confidence:\\*\\*\\s*(.+?)(?:\\n|\\z)', 1), '')"
_STRUCTURED_SQL = f"""WITH {QUESTIONS_SQL}, r AS (SELECT question_id, CASE WHEN conv_id % 2 = 0 THEN '**Answer:** ' || answer || {_CR} || '**Evidence:** ' || substring(question, 1, 40) || {_CR} || '**Confidence:** Medium to High' || {_CR} || '**Missing Info:** none' ELSE answer END AS raw FROM q0 WHERE answer IS NOT NULL)
SELECT question_id, {strip_sql(f"coalesce({_FIELD.format('Answer')}, raw)")} AS answer, {strip_sql(f"coalesce({_FIELD.format('Evidence')}, '')")} AS evidence, CASE WHEN contains({_LEVEL}, 'High') THEN 'High' WHEN contains({_LEVEL}, 'Medium') THEN 'Medium' WHEN contains({_LEVEL}, 'Low') THEN 'Low' ELSE 'Unknown' END AS confidence,
{strip_sql(f"coalesce({_FIELD.format('Safety Notes')}, 'None')")} AS safety_notes, {strip_sql(f"coalesce({_FIELD.format('Missing Info')}, 'None')")} AS missing_info FROM r"""


QUERIES = {
    "exact_question_hash": (exact_question_hash, f"WITH {QUESTIONS_SQL}, h AS (SELECT question_id, {_HASH} AS hash FROM q0) SELECT question_id, hash, question_id <> min(question_id) OVER (PARTITION BY hash) AS duplicate FROM h"),
    "exact_duplicate_questions": (exact_duplicate_questions, f"WITH u AS (SELECT role AS q FROM conversations UNION ALL SELECT text FROM documents), g AS (SELECT {strip_sql('lower(q)')} AS q, count(*) AS n FROM u GROUP BY 1) SELECT md5(q) AS question, n FROM g WHERE n > 1"),
    "word_overlap_grounding": (word_overlap_grounding, _GROUNDING_SQL),
    "question_validation": (question_validation, _VALIDATION_SQL),
    "problem_flags": (problem_flags, _FLAGS_SQL),
    "diverse_selection": (diverse_selection, _DIVERSE_SQL),
    "category_samples": (category_samples, _SAMPLES_SQL),
    "question_stats": (question_stats, _STATS_SQL),
    "quality_report": (quality_report, _REPORT_SQL),
    "dont_know_detector": (dont_know_detector, _UNSURE_SQL),
    "numbered_questions": (numbered_questions, _NUMBERED_SQL),
    "review_sheet": (review_sheet, _SHEET_SQL),
    "structured_answer": (structured_answer, _STRUCTURED_SQL),
    "answer_prompts": (answer_prompts, _PROMPTS_SQL),
    "judge_prompts": (judge_prompts, _JUDGE_PROMPTS_SQL),
    "question_prompts": (question_prompts, _QUESTION_PROMPTS_SQL),
    "context_blocks": (context_blocks, _CONTEXT_BLOCKS_SQL),
    "cache_keys": (cache_keys, "SELECT item_id, md5(text || ':[(''k'', 10), (''rerank'', True)]') AS cache_key FROM benchmark"),
    "random_questions": (random_questions, _RANDOM_SQL),
    "rerank_pairs": (rerank_pairs, _RERANK_PAIRS_SQL),
    "semantic_validation": (semantic_validation, _SEMANTIC_SQL),
    "json_replies": (json_replies, _JSON_SQL),
    "heading_replies": (heading_replies, _HEADING_REPLIES_SQL),
    "judge_replies": (judge_replies, _JUDGE_SQL),
    "claim_replies": (claim_replies, _CLAIMS_SQL),
    "generated_questions": (generated_questions, None),
    "answer_graph": (answer_graph, None),
}
