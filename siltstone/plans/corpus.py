"""Queries of ingestion, chunking, page classification, ids and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, dedup, pages
from siltstone.plans.tables import lines_sql, strip_sql, table
from siltstone.sources import files
from siltstone.streaming import ingest


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"))).alias("chunk_index", "chunk"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("chunk_length"), F.md5("chunk").alias("chunk_md5"))


_BODY = strip_sql("coalesce(text, '')")
_CHUNKS_SQL = f"""
WITH t AS (SELECT doc_id, {_BODY} AS b FROM documents),
c AS (SELECT doc_id, CASE WHEN length(b) < 400 THEN [b] ELSE list_transform(range(0, length(b), 340), lambda k: {strip_sql('substring(b, CAST(k + 1 AS BIGINT), 400)')}) END AS cs FROM t),
f AS (SELECT doc_id, list_filter(cs, lambda x: x <> '') AS cs FROM c),
u AS (SELECT doc_id, unnest(range(0, len(cs))) AS chunk_index, unnest(cs) AS chunk FROM f)
SELECT doc_id, chunk_index, CAST(length(chunk) AS BIGINT) AS chunk_length, md5(chunk) AS chunk_md5 FROM u"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 7 == 0).cast("int").alias("tables"), (F.col("doc_id") % 5 == 0).cast("int").alias("images"))


def page_classify(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", pages.classify(F.col("text"), F.col("tables"), F.col("images")).alias("c")).select("doc_id", "c.*")


def page_classify_ext(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", pages.classify_more(F.col("text"), F.col("tables"), F.col("images")).alias("c")).select("doc_id", "c.*")


def _share_sql(pattern: str) -> str:
    return f"(CASE WHEN len(ls) = 0 THEN 0.0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '{pattern}'))) / len(ls) END)"


def _hits_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(b), '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


_PAGES_SQL = f"p AS (SELECT *, length(b) AS n, {lines_sql('b')} AS ls FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS tables, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS images, {_BODY} AS b FROM documents))"


def _typed_sql(rules: list[tuple[str, str, float]]) -> str:
    kind = " ".join(f"WHEN {w} THEN '{k}'" for w, k, _ in rules)
    sure = " ".join(f"WHEN {w} THEN {s}" for w, _, s in rules)
    return f"WITH {_PAGES_SQL} SELECT doc_id, CASE {kind} ELSE 'unknown' END AS page_type, CAST(CASE {sure} ELSE 0.4 END AS DOUBLE) AS confidence FROM p"


_HEAD = [("n < 150 AND tables = 0 AND images = 0", "cover", 0.65)]
_TOC = [(f"n < 5000 AND {_share_sql(pages.TOC_LINE)} > 0.35", "toc", 0.8), ("n < 300 AND images > 0 AND tables = 0", "image", 0.72), ("n < 300 AND images > 0", "diagram", 0.55)]
_TABLES = [("tables > 1 OR (tables = 1 AND n < 600)", "table", 0.85), ("tables = 1", "mixed", 0.7)]
_TAIL = [("n > 500 AND images = 0", "text", 0.9), ("n > 200", "text", 0.75), ("images > 0", "image", 0.55)]


def _count_sql(pattern: str) -> str:
    return f"len(list_filter(ls, lambda x: regexp_matches(x, '{pattern}')))"


_MORE = [
    *_HEAD, (f"n < 1500 AND tables = 0 AND {_hits_sql(pages.LEGAL)} >= 2", "disclaimer", 0.82), (f"tables > 0 AND {_hits_sql(pages.REVISION)} >= 3", "revision_history", 0.85), *_TOC,
    (f"{_count_sql(pages.CODE_LINE)} >= 3", "code_snippet", 0.85), (f"{_count_sql(pages.ITEM_LINE)} >= 2", "specification_item", 0.85), (f"tables > 0 AND {_hits_sql(pages.CLASS_WORDS)} >= 3", "class_reference", 0.78),
    (f"{_share_sql(pages.GLOSSARY_LINE)} > 0.30 AND n < 4000", "glossary", 0.8), *_TABLES, (f"n > 100 AND {_share_sql(pages.LIST_LINE)} > 0.45", "list", 0.82), *_TAIL,
]


def toc_ratio(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace("text", r"\.\s", " . . . 12\n")
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", F.round(pages.line_share(F.col("text"), pages.TOC_LINE), 6).alias("ratio"), pages.toc_page(F.col("text")).alias("is_toc"))


_TOC_SQL = f"""WITH t AS (SELECT doc_id, {strip_sql("CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[.]\\s', ' . . . 12' || chr(10), 'g') ELSE text END")} AS b FROM documents),
p AS (SELECT *, {lines_sql('b')} AS ls FROM t), r AS (SELECT *, {_share_sql(pages.TOC_LINE)} AS ratio FROM p)
SELECT doc_id, round(ratio, 6) AS ratio, length(b) BETWEEN 50 AND 5000 AND len(ls) >= 5 AND ratio >= 0.5 AS is_toc FROM r"""


def table_serialise(spark: SparkSession, d: str) -> DataFrame:
    row = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), "n_name"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("rs"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("rs", lambda r: r["r"]))
    return rows.where(pages.meaningful_table(cells)).select("n_regionkey", pages.serialise_table(cells, F.col("n_regionkey") + 1).alias("content"))


_TABLE_SQL = """SELECT n_regionkey, '[TABLE ' || (n_regionkey + 1) || ']' || chr(10) || 'key | name' || chr(10) || '----------' || chr(10) || string_agg(n_nationkey || ' | ' || trim(n_name), chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY 1"""


def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as chunks in order, languages as sections: each with its neighbours' sentences."""
    docs = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("parent_index"), F.lit(0).alias("child_index"), F.col("lang").alias("title"), F.array("lang").alias("hierarchy"), "text")
    return chunking.enrich(docs, "file", F.col("file")).select(F.col("parent_index").alias("doc_id"), F.md5("enriched_text").alias("enriched_md5"), F.length("enriched_text").cast("long").alias("enriched_length"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: " + strip_sql("s") + "), lambda s: s <> '')"
_CONTEXT_SQL = f"""WITH s AS (SELECT doc_id, source, lang, text, {_SENTENCES.format('text')} AS ss FROM documents),
n AS (SELECT *, lag(lang) OVER w AS pl, lag(ss) OVER w AS ps, lead(lang) OVER w AS nl, lead(ss) OVER w AS ns FROM s WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
c AS (SELECT *, concat_ws(' | ', CASE WHEN pl = lang THEN array_to_string(ps[greatest(len(ps) - 2, 1):], ' ') || '...' END, CASE WHEN nl = lang THEN '...' || array_to_string(ns[1:3], ' ') END) AS c FROM n),
e AS (SELECT doc_id, 'Document: ' || source || chr(10) || 'Section: ' || lang || chr(10) || 'Context: ' || CASE WHEN c = '' THEN 'start of section' ELSE c END || chr(10) || chr(10) || text AS e FROM c)
SELECT doc_id, md5(e) AS enriched_md5, CAST(length(e) AS BIGINT) AS enriched_length FROM e"""


def file_hash_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"))


def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.sha2("text", 256), F.lit("_child_"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", T.uuid5(name).alias("id"))


_UUID_SQL = f"""WITH h AS (SELECT doc_id, sha1(unhex('{T.UUID_NAMESPACE}') || encode(sha256(text) || '_child_' || doc_id)) AS h FROM documents)
SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || CASE WHEN substring(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substring(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substring(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM h"""


def anti_join_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Documents to ingest where children hold two of three hashes and parents three of four."""
    docs = file_hash_sha256(spark, d)
    new, _ = files.new_files(docs, docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 4 <> 0"))
    return new.select("doc_id", "file_hash")


_NEW_SQL = "WITH h AS (SELECT doc_id, sha256(text) AS file_hash FROM documents) SELECT doc_id, file_hash FROM h WHERE NOT (file_hash IN (SELECT file_hash FROM h WHERE doc_id % 3 <> 0) AND file_hash IN (SELECT file_hash FROM h WHERE doc_id % 4 <> 0))"


def semi_join_parents(spark: SparkSession, d: str) -> DataFrame:
    accepted = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(accepted, "o_orderkey", "left_semi")


def orphan_parents(spark: SparkSession, d: str) -> DataFrame:
    accepted = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(accepted, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("orphans"))


def page_chunk_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("document"), F.col("lang").alias("page"), F.when(F.col("n_chars") > 2000, "parent").otherwise("child").alias("kind"))
    return pages.page_rollup(rows, "document", "page", "kind")


def page_breakdown(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.operators.evaluation import page_breakdown as breakdown

    return breakdown(page_classify(spark, d), "page_type")


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return pages.chunk_sizes(table(spark, d, "documents"))


def anomaly_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = page_classify(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("chars")), "doc_id")
    rows = rows.withColumns({"parents": F.col("doc_id") % 2, "children": F.col("doc_id") % 5})
    return pages.anomalies(rows).select("doc_id", "page_type", "problem")


_CLASSES = _typed_sql([*_HEAD, *_TOC, *_TABLES, *_TAIL])
_ANOMALY_SQL = f"""WITH k AS ({_CLASSES}), a AS (SELECT doc_id, page_type, n_chars AS chars, doc_id % 2 AS parents, doc_id % 5 AS children FROM k JOIN documents USING (doc_id))
SELECT doc_id, page_type, 'text without chunks' AS problem FROM a WHERE children = 0 AND chars > 200
UNION ALL SELECT doc_id, page_type, 'table page without parent chunk' FROM a WHERE page_type IN ('table', 'mixed') AND parents = 0
UNION ALL SELECT doc_id, page_type, 'hardly any text for an image' FROM a WHERE page_type IN ('image', 'diagram') AND chars < 50"""


def html_headings(spark: SparkSession, d: str) -> DataFrame:
    """The sections of the pages' texts."""
    texts = table(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))
    rows = texts.select("page_id", F.posexplode(chunking.smart_sections("text")).alias("section", "s"))
    return rows.select("page_id", "section", F.col("s.title").alias("title"), F.col("s.level").alias("level"), F.length("s.content").alias("chars"))


def _html_sql(x: str) -> str:
    """What files.html_text does, in SQL."""
    text = f"regexp_replace({x}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g')"
    for n in range(1, 7):
        text = f"regexp_replace({text}, '(?i)<h{n}\\b[^>]*>', chr(10) || '{'#' * n} ', 'g')"
    text = f"regexp_replace({text}, '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|p|div|li|tr|article|nav|ul)\\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{sign}')"
    text = f"regexp_replace({text}, '[ \\t]+', ' ', 'g')"
    return strip_sql(f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')")


def _sections_sql(rows: str, key: str, first: str, numbered: bool, columns: str) -> str:
    """The sections of rows (key, text) by heading lines; for texts without page tags."""
    heading = " OR ".join(f"regexp_matches(b, '{p}')" for p in chunking.HEADINGS)
    dots = r"WHEN regexp_matches(b, '^\d+((?:\.\d+)*)\.?\s+\S') THEN length(regexp_extract(b, '^\d+((?:\.\d+)*)\.?\s+\S', 1)) - length(replace(regexp_extract(b, '^\d+((?:\.\d+)*)\.?\s+\S', 1), '.', '')) + 1"
    kind = lambda c: f"CASE WHEN starts_with(lower({c}), '[table ') THEN 'table' WHEN regexp_full_match(lower({c}), '\\[image \\d+\\]') THEN 'image' WHEN regexp_full_match(lower({c}), '\\[diagram \\d+\\]') THEN 'diagram' ELSE 'text' END"
    return f"""WITH x AS ({rows}), l AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM x),
h AS (SELECT *, {strip_sql('line')} AS b FROM l), g AS (SELECT *, b <> '' AND length(b) < 200 AND ({heading}) AS head FROM h),
v AS (SELECT *, CASE WHEN starts_with(b, '#') THEN length(b) - length(ltrim(b, '#')) WHEN {kind('b')} <> 'text' THEN 4 {dots if numbered else ''} WHEN b = upper(b) AND b <> lower(b) THEN 1 ELSE 2 END AS level FROM g),
n AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY {key} ORDER BY i) AS s FROM v),
c AS (SELECT {key}, s, coalesce(max(CASE WHEN head THEN trim(trim(b, '#: ')) END), '{first}') AS title, coalesce(max(CASE WHEN head THEN level END), 0) AS level, {strip_sql("coalesce(string_agg(CASE WHEN b <> '' THEN line || chr(10) ELSE chr(10) END, '' ORDER BY i) FILTER (WHERE NOT head), '')")} AS content FROM n GROUP BY 1, 2),
k AS (SELECT {key}, s, title, CAST(level AS INT) AS level, {kind('title')} AS kind, length(content) AS chars FROM c WHERE content <> ''),
a AS (SELECT * FROM k UNION ALL SELECT {key}, 0, 'Document', 0, 'text', length(text) FROM x WHERE {key} NOT IN (SELECT {key} FROM k)),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY s) - 1 AS INT) AS section FROM a)
SELECT {columns} FROM o"""


_HEADED = "'1 Scope of work' || chr(10) || text || chr(10) || '## Second part ##' || chr(10) || substring(text, 1, 50) || chr(10) || '[Table 4]' || chr(10) || 'ALL IN CAPITALS' || chr(10) || 'Closing words:' || chr(10) || 'end'"


def section_headed(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents with headings of every kind around their texts."""
    head = F.concat(F.lit("1 Scope of work\n"), "text", F.lit("\n## Second part ##\n"), F.substring("text", 1, 50), F.lit("\n[Table 4]\nALL IN CAPITALS\nClosing words:\nend"))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sections(head)).alias("section", "s"))
    return rows.select("doc_id", "section", F.col("s.title").alias("title"), F.col("s.level").alias("level"), F.col("s.kind").alias("kind"), F.length("s.content").alias("chars"))


def char_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct shingles of four characters, and the least and last of them, as the signatures take them."""
    found = dedup.shingle_sets("text")
    return table(spark, d, "documents").select("doc_id", found.alias("s")).select("doc_id", F.size("s").cast("long").alias("shingles"), F.array_min("s").alias("first"), F.array_max("s").alias("last"))


_SHINGLES_SQL = f"""WITH s AS (SELECT doc_id, list_distinct(CASE WHEN length(text) >= {dedup.SHINGLE} THEN list_transform(range(1, length(text) - {dedup.SHINGLE - 2}), lambda k: lower(substring(text, CAST(k AS BIGINT), {dedup.SHINGLE}))) ELSE [lower(text)] END) AS s FROM (SELECT doc_id, lower(text) AS text FROM documents))
SELECT doc_id, CAST(len(s) AS BIGINT) AS shingles, list_min(s) AS first, list_max(s) AS last FROM s"""


def model_context(spark: SparkSession, d: str) -> DataFrame:
    """Chunks under what a stand-in says of them, its first sentence; blank ones under the template."""
    from siltstone.functions.models import FirstSentences

    text = F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise("")
    got = chunking.model_context(text, lambda: FirstSentences(1), F.concat(F.lit("Source: "), "source", F.lit("\n")))
    return table(spark, d, "documents").select("doc_id", F.md5(got).alias("context_md5"))


_MODEL_CONTEXT_SQL = f"""WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 9 <> 0 THEN text ELSE '' END AS t FROM documents),
c AS (SELECT *, string_split(regexp_replace({strip_sql("substring(t, 1, 1500)")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] AS said FROM t)
SELECT doc_id, md5(CASE WHEN {strip_sql("said")} <> '' THEN {strip_sql("said")} || chr(10) || chr(10) || t ELSE 'Source: ' || source || chr(10) || t END) AS context_md5 FROM c"""


def recognised_text(spark: SparkSession, d: str) -> DataFrame:
    """Images read by a first engine, which reads nothing of some, and by a second."""
    from siltstone.functions import models

    image = F.when(F.col("doc_id") % 3 != 0, F.encode("lang", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", models.recognised(image, [models.PlainBytes, _Fallback]).alias("text"), models.described(image, "What is it?", models.PlainBytes).alias("described"))


class _Fallback:
    """A second engine that reads every image as the same word."""

    def read(self, images: list[bytes | None]) -> list[str]:
        return ["unreadable"] * len(images)


def section_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sections("text")).alias("section", "s"))
    return rows.select("doc_id", "section", F.col("s.title").alias("title"), F.col("s.level").alias("level"), F.col("s.kind").alias("kind"), F.length("s.content").alias("chars"))


def parent_child(spark: SparkSession, d: str) -> DataFrame:
    up = chunking.parents(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return chunking.children(up, "doc_id").select("doc_id", "parent_id", "child_index", "start_char", "end_char", "word_count")


def page_aware_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.page_chunks("text")).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.length("c.text").alias("chars"), F.array_join("c.pages", ",").alias("pages"))


_PAGED = "'[Page 1] ' || substring(text, 1, 900) || chr(10) || '[Page 2] ' || substring(text, 901, 900) || chr(10) || '[Page 30] end'"


def page_marked_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts of three marked pages, all of which fit one chunk."""
    paged = F.concat(F.lit("[Page 1] "), F.substring("text", 1, 900), F.lit("\n[Page 2] "), F.substring("text", 901, 900), F.lit("\n[Page 30] end"))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.page_chunks(paged)).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.length("c.text").alias("chars"), F.array_join("c.pages", ",").alias("pages"))


def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as a table's text, chunked by rows under its header."""
    line = F.concat_ws(" | ", F.col("n_nationkey").cast("string"), F.col("n_name"))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("[Table 1]\nkey | name\n----------\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    up = chunking.parents(rows.select("n_regionkey", text.alias("text")), "n_regionkey")
    return up.select("n_regionkey", "parent_index", "title", "kind", "text", "sentence_count")


_TABLE_CHUNKS_SQL = """WITH t AS (SELECT n_regionkey, 'key | name' || chr(10) || '----------' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS t, count(*) AS n FROM nation GROUP BY 1)
SELECT n_regionkey, 0 AS parent_index, '[Table 1]' AS title, 'table' AS kind, '[[Table 1]]' || chr(10) || t AS text, CAST(n + 2 AS INT) AS sentence_count FROM t WHERE length(t) >= 60"""


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Where the topics of each document begin, among its sentences."""
    return table(spark, d, "documents").select("doc_id", F.explode(chunking.topics("text")).alias("sentence"))


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(dedup.signature("text").cast("array<string>"), ",")).alias("signature_md5"))


def near_dup_greedy(spark: SparkSession, d: str) -> DataFrame:
    signed = table(spark, d, "documents").select("doc_id", dedup.signature("text").alias("signature"))
    return dedup.keep_first(signed, "doc_id")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.event_windows(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


QUERIES = {
    "chunk_fixed": (chunk_fixed, _CHUNKS_SQL),
    "page_classify": (page_classify, _CLASSES),
    "page_classify_ext": (page_classify_ext, _typed_sql(_MORE)),
    "toc_ratio": (toc_ratio, _TOC_SQL),
    "table_serialise": (table_serialise, _TABLE_SQL),
    "neighbour_context": (neighbour_context, _CONTEXT_SQL),
    "file_hash_sha256": (file_hash_sha256, "SELECT doc_id, sha256(text) AS file_hash FROM documents"),
    "uuid5_ids": (uuid5_ids, _UUID_SQL),
    "anti_join_incremental": (anti_join_incremental, _NEW_SQL),
    "semi_join_parents": (semi_join_parents, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"),
    "orphan_parents": (orphan_parents, "SELECT o_orderstatus, count(*) AS orphans FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1"),
    "page_chunk_rollup": (page_chunk_rollup, "SELECT source AS document, lang AS page, count(*) FILTER (WHERE n_chars > 2000) AS parents, count(*) FILTER (WHERE n_chars <= 2000) AS children FROM documents GROUP BY ROLLUP (source, lang)"),
    "page_breakdown": (page_breakdown, f"WITH k AS ({_CLASSES}) SELECT page_type, count(*) AS pages, round(100 * count(*) / (SELECT count(*) FROM k), 6) AS percent FROM k GROUP BY 1"),
    "chunk_sizes": (chunk_sizes, "SELECT count(*) AS n, CAST(min(length(text)) AS BIGINT) AS min, CAST(max(length(text)) AS BIGINT) AS max, CAST(floor(avg(length(text))) AS BIGINT) AS mean FROM documents"),
    "anomaly_rules": (anomaly_rules, _ANOMALY_SQL),
    "event_windows": (event_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"),
    "html_headings": (html_headings, _sections_sql(f"SELECT page_id, {_html_sql('html')} AS text FROM pages", "page_id", "Document", True, "page_id, section, title, level, chars")),
    "section_detect": (section_detect, _sections_sql("SELECT doc_id, text FROM documents", "doc_id", "Introduction", False, "doc_id, section, title, level, kind, chars")),
    "section_headed": (section_headed, _sections_sql(f"SELECT doc_id, {_HEADED} AS text FROM documents", "doc_id", "Introduction", False, "doc_id, section, title, level, kind, chars")),
    "char_shingles": (char_shingles, _SHINGLES_SQL),
    "model_context": (model_context, _MODEL_CONTEXT_SQL),
    "recognised_text": (recognised_text, "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'unreadable' END AS text, CASE WHEN doc_id % 3 <> 0 THEN 'text: ' || lang END AS described FROM documents"),
    "parent_child": (parent_child, None),
    "page_aware_chunks": (page_aware_chunks, f"SELECT doc_id, 0 AS chunk, CAST(length({strip_sql('text')}) AS INT) AS chars, '' AS pages FROM documents WHERE {strip_sql('text')} <> ''"),
    "page_marked_chunks": (page_marked_chunks, f"SELECT doc_id, 0 AS chunk, CAST(length({_PAGED}) AS INT) AS chars, '1,2,30' AS pages FROM documents"),
    "table_chunks": (table_chunks, _TABLE_CHUNKS_SQL),
    "semantic_chunks": (semantic_chunks, None),
    "minhash_signature": (minhash_signature, None),
    "near_dup_greedy": (near_dup_greedy, None),
}
