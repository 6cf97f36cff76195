"""Queries of sources, sinks, counters and reports: what is written is read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import chunking, reports, sparse
from siltstone.operators import evaluation as E
from siltstone.plans.tables import EVALUATION_SQL, QUESTIONS_SQL, questions, strip_sql, table
from siltstone.plans.tables import evaluation as rows_of
from siltstone.sources import files, sinks
from siltstone.streaming import ingest

_OWN: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A new path in the folder that the session names for checkpoints; in a temporary one in local mode without such."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="siltstone-"))
    path = f"{named.rstrip('/')}/work-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def load_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Files of four kinds: text, one in eleven broken; PDF with a reader; HTML; and one that no loader takes."""
    docs = table(spark, d, "documents")
    suffix = F.expr("element_at(array('txt', 'pdf', 'html', 'xls'), CAST(doc_id % 4 + 1 AS INT))")
    text = F.when(F.col("doc_id") % 11 == 0, F.unhex(F.lit("FFFE41"))).otherwise(F.encode("text", "UTF-8"))
    content = F.when(suffix == "html", F.encode(F.concat(F.lit("<p>"), F.col("lang"), F.lit("</p><b>x</b>")), "UTF-8")).otherwise(text)
    rows = docs.select("doc_id", suffix.alias("suffix"), content.alias("content"))
    return files.load(rows, lambda c: F.lower(F.try_validate_utf8(c.cast("string")))).select("doc_id", "suffix", F.md5("text").alias("text_md5"))


_LOAD_SQL = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' ELSE 'html' END AS suffix, md5(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN lower(text) ELSE lang || chr(10) || 'x' END) AS text_md5
FROM documents WHERE doc_id % 4 = 2 OR (doc_id % 4 < 2 AND doc_id % 11 <> 0)"""


def txt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Languages as files of the documents' hashes, walked and read."""
    path = workspace(spark)
    rows = table(spark, d, "documents").select("lang", F.md5("text").alias("value")).repartition("lang").sortWithinPartitions("value")
    rows.write.partitionBy("lang").text(path)
    read = files.load(files.walk(spark, path, ("txt",))).select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), "size", "file_hash", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return read.groupBy("lang").agg(F.count("*").alias("lines"), F.min("line").alias("first"), F.max("line").alias("last"))


def question_file(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as a JSON file with a top-level array, and read by the source."""
    rows = questions(spark, d).select(F.col("question_id").cast("string").alias("id"), "question", F.array("page_reference").alias("evidence_snippets"), "answer")
    path = workspace(spark)
    rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("questions"))).alias("value")).coalesce(1).write.text(path)
    read = files.question_set(spark, path)
    return read.select("id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"), F.get("evidence_snippets", F.lit(0)).alias("evidence"), F.col("difficulty"))


_QUESTION_FILE_SQL = f"WITH {QUESTIONS_SQL} SELECT CAST(question_id AS VARCHAR) AS id, md5(question) AS question_md5, md5(answer) AS answer_md5, page_reference AS evidence, CAST(NULL AS VARCHAR) AS difficulty FROM q0"


def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results written as JSON and as CSV, and read again."""
    rows = rows_of(spark, d).select("question_id", "rank", "question_type", "error")
    path = workspace(spark)
    sinks.write_results(rows, f"{path}/json")
    sinks.write_results(rows, f"{path}/csv", ["question_type", "question_id"], "csv")
    read = files.read_results(spark, f"{path}/json", "question_id long, rank long, question_type string, error string")
    sheet = spark.read.option("header", True).schema("question_type string, question_id long").csv(f"{path}/csv")
    return read.join(sheet.withColumnRenamed("question_type", "kind"), "question_id")


def model_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A model of terms written and read; without one, the search finds nothing."""
    docs, path = table(spark, d, "documents"), workspace(spark)
    sinks.write_model(sparse.fit(docs, "lang"), path)
    none = sparse.postings(docs, "doc_id", "lang", files.read_model(spark, f"{path}-none"))
    found = sparse.postings(docs, "doc_id", "lang", files.read_model(spark, path))
    return found.select("doc_id", "term", F.round("weight", 6).alias("weight")).unionByName(none)


_MODEL_SQL = """WITH m AS (SELECT lang AS term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM documents GROUP BY 1)
SELECT doc_id, lang AS term, round(idf, 6) AS weight FROM documents JOIN m ON m.term = lang"""


def spool_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children as JSON lines with a closing line, and what the reader finds."""
    docs, path = table(spark, d, "documents"), workspace(spark)
    up, down = docs.where("doc_id % 3 = 0").select("doc_id", "lang"), docs.where("doc_id % 3 <> 0").select("doc_id", "lang")
    sinks.write_spool(up, down, path)
    rows, broken = files.chunk_spool(spark, path, "chunk_type string, doc_id long, lang string")
    whole = files.spool_complete(spark, path)
    return rows.withColumn("complete", F.lit(whole) & F.lit(broken.isEmpty()))


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an error and without, each read from its own folder."""
    rows, path = rows_of(spark, d).select("question_id", "error"), workspace(spark)
    sinks.with_dead_letters(rows, f"{path}/good", f"{path}/bad")
    good = spark.read.parquet(f"{path}/good").withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(spark.read.schema("question_id long, error string").json(f"{path}/bad"))


def progress_parts(spark: SparkSession, d: str) -> DataFrame:
    """Progress written in two turns, the second with rows of the first again."""
    rows, path = rows_of(spark, d).select("question_id", "found"), workspace(spark)
    sinks.write_progress(rows.where("question_id % 2 = 0"), path, "question_id", 1000)
    sinks.write_progress(rows.where("question_id % 3 <> 1"), path, "question_id", 1000)
    return spark.read.parquet(path)


def half_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Hashes that one of two tables lacks, to be deleted before their files are ingested anew."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    _, half = files.new_files(docs, docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 4 <> 0"))
    return half


_HALF_SQL = """WITH h AS (SELECT doc_id, sha256(text) AS file_hash FROM documents), c AS (SELECT DISTINCT file_hash FROM h WHERE doc_id % 3 <> 0), p AS (SELECT DISTINCT file_hash FROM h WHERE doc_id % 4 <> 0)
SELECT * FROM c WHERE file_hash NOT IN (SELECT * FROM p) UNION ALL SELECT * FROM p WHERE file_hash NOT IN (SELECT * FROM c)"""


def ingestion_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("file_hash"), "doc_id")
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return reports.ingestion(docs, orders, lines, lines.where("l_linenumber <> 3"))


_COUNTS_SQL = """WITH c AS (SELECT (SELECT count(DISTINCT sha256(text)) FROM documents) AS f, (SELECT count(*) FROM orders) AS p, (SELECT count(*) FROM lineitem) AS c, (SELECT count(*) FROM lineitem WHERE l_linenumber <> 3) AS s)
SELECT 'files' AS name, CAST(f AS DOUBLE) AS value FROM c UNION ALL SELECT 'parents', p FROM c UNION ALL SELECT 'children', c FROM c UNION ALL SELECT 'stored', s FROM c UNION ALL SELECT 'children_per_file', round(c / f, 6) FROM c UNION ALL SELECT 'complete', CASE WHEN s >= c THEN 1 ELSE 0 END FROM c"""


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown report of the question types, the best first."""
    groups = E.by_group(rows_of(spark, d), "question_type", 3)
    return reports.markdown(groups, "Results by type", ["question_type", "questions", "success_rate", "mean_mrr"], [F.desc("success_rate"), F.desc("mean_mrr"), "question_type"], 3)


_REPORT_SQL = f"""WITH {EVALUATION_SQL}, g AS (SELECT coalesce(question_type, 'unknown') AS k, count(*) AS n, round(avg(found), 3) AS s, round(avg(mrr), 3) AS m FROM e WHERE error IS NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY s DESC, m DESC, k) + 4 AS line, '| ' || k || ' | ' || n || ' | ' || printf('%.3f', s) || ' | ' || printf('%.3f', m) || ' |' AS text FROM g
UNION ALL SELECT * FROM (VALUES (1, '# Results by type'), (2, ''), (3, '| question_type | questions | success_rate | mean_mrr |'), (4, '|---|---|---|---|'))"""


def recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return reports.curve(rows_of(spark, d).where("error IS NULL"), "recall_at_", (1, 3, 5, 10))


_CURVE_SQL = f"WITH {EVALUATION_SQL} " + " UNION ALL ".join(f"SELECT 'recall_at' AS series, {k}.0::DOUBLE AS x, round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS y FROM e WHERE error IS NULL" for k in (1, 3, 5, 10))


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(rows_of(spark, d), "latency")


_HISTOGRAM_SQL = f"""WITH {EVALUATION_SQL}, s AS (SELECT min(latency) AS a, max(latency) AS b, (max(latency) - min(latency)) / {reports.BINS} AS w FROM e),
c AS (SELECT CASE WHEN w > 0 THEN least({reports.BINS - 1}, floor((latency - a) / w)) ELSE 0 END AS bin, count(*) AS n FROM e, s WHERE latency IS NOT NULL GROUP BY 1)
SELECT k.bin, round(a + k.bin * w, 6) AS low, round(a + (k.bin + 1) * w, 6) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, {reports.BINS})) AS bin) k CROSS JOIN s LEFT JOIN c ON c.bin = k.bin"""


def latency_boxes(spark: SparkSession, d: str) -> DataFrame:
    return reports.boxes(rows_of(spark, d), "system", "latency")


_BOXES_SQL = f"""WITH {EVALUATION_SQL}, q AS (SELECT system, quantile_cont(CAST(latency AS DOUBLE), 0.25) AS a, quantile_cont(CAST(latency AS DOUBLE), 0.5) AS b, quantile_cont(CAST(latency AS DOUBLE), 0.75) AS c FROM e GROUP BY 1),
m AS (SELECT e.system, latency, a, b, c, latency BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS inside FROM e JOIN q ON q.system = e.system)
SELECT system, round(min(latency) FILTER (WHERE inside), 6) AS low, round(any_value(a), 6) AS q25, round(any_value(b), 6) AS median, round(any_value(c), 6) AS q75, round(max(latency) FILTER (WHERE inside), 6) AS high, count(*) FILTER (WHERE NOT inside) AS outliers FROM m GROUP BY 1"""


def score_bars(spark: SparkSession, d: str) -> DataFrame:
    return reports.bars(rows_of(spark, d), "difficulty", "mrr")


def model_list(spark: SparkSession, d: str) -> DataFrame:
    """Models that services list; every seventh answer is broken, every fifth lists none."""
    body = F.when(F.col("s_suppkey") % 7 == 0, "{broken").when(F.col("s_suppkey") % 5 == 0, '{"models": []}').otherwise(F.concat(F.lit('{"models": [{"name": "'), F.col("s_name"), F.lit('", "size": '), F.col("s_suppkey").cast("string"), F.lit('}, {"size": 3}]}')))
    return files.model_list(table(spark, d, "supplier").select(body.alias("body")))


def json_safe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), (F.col("o_orderkey") > 9).alias("late"))
    return sinks.json_safe(rows)


def projection(spark: SparkSession, d: str) -> DataFrame:
    return sinks.project(table(spark, d, "documents"), ["doc_id", "missing", "lang"])


_CONFIG = {"retrieval": {"top_k": 10, "weights": [0.6, 0.4]}, "chunking": {"parent": chunking.PARENT, "child": chunking.CHILD}}


def config_dump(spark: SparkSession, d: str) -> DataFrame:
    return sinks.config_json(spark, _CONFIG)


def min_content(spark: SparkSession, d: str) -> DataFrame:
    cut = F.substring("text", F.lit(1), (F.col("doc_id") % 100).cast("int"))
    return table(spark, d, "documents").where(chunking.enough(cut)).select("doc_id")


def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Files of documents in two batches, the second with files of the first again: parents and children of each file."""
    path = workspace(spark)
    docs = table(spark, d, "documents").select("source", F.regexp_replace("text", r"[\n\r]+", " ").alias("value")).repartition("source").sortWithinPartitions("value")
    docs.where("source < 'src4'").write.partitionBy("source").text(f"{path}/in/a")
    ingest.ingest(spark, f"{path}/in", f"{path}/out", f"{path}/state").awaitTermination()
    docs.write.partitionBy("source").text(f"{path}/in/b")
    ingest.ingest(spark, f"{path}/in", f"{path}/out", f"{path}/state").awaitTermination()
    count = lambda kind: spark.read.parquet(f"{path}/out/{kind}").groupBy("file_hash").agg(F.count("*").alias(kind))
    return count("parents").join(count("children"), "file_hash")


def _database(spark: SparkSession) -> str:
    """A new database whose tables lie in a workspace of their own."""
    name = f"siltstone_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{workspace(spark)}'")
    return name


def upserts(spark: SparkSession, d: str) -> DataFrame:
    """A table of vectors written in three turns, each with rows that the one before has, too."""
    rows, name = table(spark, d, "embeddings").select("vec_id", "label"), f"{_database(spark)}.vectors"
    sinks.upsert(rows.where("vec_id % 2 = 0").withColumn("turn", F.lit(1)), name, "vec_id")
    sinks.upsert(rows.where("vec_id % 3 = 0").withColumn("turn", F.lit(2)), name, "vec_id")
    sinks.retried(lambda: sinks.upsert(rows.where("vec_id % 5 = 0").withColumn("turn", F.lit(3)), name, "vec_id"))
    return spark.table(name)


def collections(spark: SparkSession, d: str) -> DataFrame:
    """Whether a collection is there before and after it is written, and what a prefix drops."""
    database = _database(spark)
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("dense"))
    found = [("before", str(sinks.ensure_collection(spark, f"{database}.vectors", 64)).lower())]
    for name in ("vectors", "temp_a", "test_b"):
        sinks.upsert(rows.where("vec_id < 5"), f"{database}.{name}", "vec_id")
    found.append(("after", str(sinks.ensure_collection(spark, f"{database}.vectors", 64)).lower()))
    found.append(("dropped", ",".join(sinks.drop_by_prefix(spark, dry_run=False, database=database))))
    found.append(("left", ",".join(sorted(t.name for t in spark.catalog.listTables(database)))))
    return spark.createDataFrame(found, "step string, result string")


QUERIES = {
    "load_by_suffix": (load_by_suffix, _LOAD_SQL),
    "txt_round_trip": (txt_round_trip, "SELECT lang, count(*) AS lines, min(md5(text)) AS first, max(md5(text)) AS last FROM documents GROUP BY 1"),
    "question_file": (question_file, _QUESTION_FILE_SQL),
    "results_round_trip": (results_round_trip, f"WITH {EVALUATION_SQL} SELECT question_id, CAST(rank AS BIGINT) AS rank, question_type, error, question_type AS kind FROM e"),
    "model_round_trip": (model_round_trip, _MODEL_SQL),
    "spool_round_trip": (spool_round_trip, "SELECT CASE WHEN doc_id % 3 = 0 THEN 'parent' ELSE 'child' END AS chunk_type, doc_id, lang, true AS complete FROM documents"),
    "dead_letters": (dead_letters, f"WITH {EVALUATION_SQL} SELECT question_id, error FROM e"),
    "progress_parts": (progress_parts, f"WITH {EVALUATION_SQL} SELECT question_id, found FROM e WHERE question_id % 2 = 0 OR question_id % 3 <> 1"),
    "half_ingested": (half_ingested, _HALF_SQL),
    "ingestion_counts": (ingestion_counts, _COUNTS_SQL),
    "evaluation_report": (evaluation_report, _REPORT_SQL),
    "recall_curve": (recall_curve, _CURVE_SQL),
    "latency_histogram": (latency_histogram, _HISTOGRAM_SQL),
    "latency_boxes": (latency_boxes, _BOXES_SQL),
    "score_bars": (score_bars, f"WITH {EVALUATION_SQL} SELECT 'mrr' AS series, coalesce(difficulty, 'unknown') AS x, round(avg(mrr), 6) AS y FROM e GROUP BY 2"),
    "model_list": (model_list, "SELECT s_name AS name, s_suppkey AS size FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0"),
    "json_safe": (json_safe, "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS price, o_orderkey > 9 AS late FROM orders"),
    "projection": (projection, "SELECT doc_id, lang FROM documents"),
    "config_dump": (config_dump, f"SELECT * FROM (VALUES ('chunking', '{{\"child\": {chunking.CHILD}, \"parent\": {chunking.PARENT}}}'), ('retrieval', '{{\"top_k\": 10, \"weights\": [0.6, 0.4]}}')) AS t(section, settings)"),
    "min_content": (min_content, f"SELECT doc_id FROM documents WHERE length({strip_sql('substring(text, 1, doc_id % 100)')}) >= {chunking.LEAST}"),
    "upserts": (upserts, "SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 3 WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS turn FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 OR vec_id % 5 = 0"),
    "collections": (collections, "SELECT * FROM (VALUES ('before', 'false'), ('after', 'true'), ('dropped', 'temp_a,test_b'), ('left', 'vectors')) AS t(step, result)"),
    "incremental_ingest": (incremental_ingest, None),
}
