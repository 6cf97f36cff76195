"""Queries of page layout, routing and cleaning, on pages, boxes and words made out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking, layout, pages
from siltstone.plans.tables import strip_sql, table

#: The rows in both dialects: columns and their expressions over a table.
_CHARS = {"doc": "l_suppkey % 20", "page": "l_linenumber", "top": "CAST(l_partkey % 30 AS DOUBLE) * 1.5", "x": "CAST(l_orderkey % 97 AS DOUBLE)", "size": "CAST(CASE WHEN l_quantity > 45 THEN 14.02 WHEN l_quantity > 30 THEN 12.04 ELSE 10.00 END AS DOUBLE)", "text": "l_returnflag", "pos": "l_orderkey * 10 + l_linenumber"}
_RECTS = {"page": "c_nationkey", "id": "c_custkey", "x0": "CAST((c_custkey * 37) % 600 AS DOUBLE)", "y0": "CAST((c_custkey * 91) % 800 AS DOUBLE)", "x1": "CAST((c_custkey * 37) % 600 + c_custkey % 40 + 1 AS DOUBLE)", "y1": "CAST((c_custkey * 91) % 800 + c_custkey % 25 + 1 AS DOUBLE)"}
_MARKS = {"doc": "o_custkey % 15", "page_index": "o_orderkey % 200", "level": "o_orderkey % 4", "title": "concat('t', CAST(o_orderkey AS VARCHAR(20)))", "pos": "o_orderkey"}
_GAP = 12


def _of(spark: SparkSession, d: str, columns: dict[str, str], source: str, where: str = "true") -> DataFrame:
    return table(spark, d, source).where(where).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def _sql(columns: dict[str, str], source: str, where: str = "true") -> str:
    return "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {source} WHERE {where}"


def font_headings(spark: SparkSession, d: str) -> DataFrame:
    return pages.font_headings(_of(spark, d, _CHARS, "lineitem", "l_orderkey % 3 = 0"), "doc")


_FONT_SQL = f"""WITH c AS ({_sql(_CHARS, "lineitem", "l_orderkey % 3 = 0")}),
b AS (SELECT doc, round(size, 1) AS body, count(*) AS n, min(pos) AS first FROM c GROUP BY 1, 2),
m AS (SELECT doc, body FROM b QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1),
l AS (SELECT doc, page, round(top / 2) * 2 AS line, round(max(size), 1) AS size, {strip_sql("string_agg(text, '' ORDER BY x, pos, text)")} AS text FROM c GROUP BY 1, 2, 3),
g AS (SELECT l.* FROM l JOIN m ON m.doc = l.doc WHERE size >= body * 1.05 AND text <> '')
SELECT doc, page, line, text, CAST(least(6, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC)) AS INT) AS level FROM g"""


def font_body(spark: SparkSession, d: str) -> DataFrame:
    return pages.body_size(_of(spark, d, _CHARS, "lineitem"), "doc", "size", "pos")


_BODY_SQL = f"WITH c AS ({_sql(_CHARS, 'lineitem')}), b AS (SELECT doc, round(size, 1) AS body, count(*) AS n, min(pos) AS first FROM c GROUP BY 1, 2) SELECT doc, body FROM b QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, first) = 1"


def near_rects(spark: SparkSession, d: str) -> DataFrame:
    return layout.near_rects(_of(spark, d, _RECTS, "customer"), "page", _GAP)


_NEAR = f"""c AS ({_sql(_RECTS, 'customer')}),
e AS (SELECT a.page, a.id AS a, b.id AS b FROM c a JOIN c b ON a.page = b.page AND a.id < b.id AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= {_GAP} AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= {_GAP})"""


def rect_clusters(spark: SparkSession, d: str) -> DataFrame:
    return layout.rect_clusters(_of(spark, d, _RECTS, "customer"), "page", _GAP)


_CLUSTERS_SQL = f"""WITH RECURSIVE {_NEAR}, w AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id AS x, id AS y FROM c UNION SELECT r.x, w.y FROM r JOIN w ON w.x = r.y), m AS (SELECT x, min(y) AS cluster FROM r GROUP BY 1)
SELECT page, id, cluster FROM c JOIN m ON m.x = c.id"""


def layout_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of pages whose paths are the rectangles, every fifth a line, with words beside them."""
    rects = _of(spark, d, _RECTS, "customer")
    line = F.col("id") % 5 == 0
    paths = rects.withColumns({"y1": F.when(line, F.col("y0") + 1).otherwise(F.col("y1")), "x1": F.when(line, F.col("x0") + 60).otherwise(F.col("x1")), "stroke": F.lit(1.0)})
    words = rects.where("id % 3 = 0").select("page", F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "Figure 2.1").otherwise("word").alias("text"), "x0", (F.col("y0") + 30).alias("y0"), "x1", (F.col("y1") + 30).alias("y1"))
    return layout.regions(paths, rects.where("id % 11 = 0"), words, "page")


def bookmark_list(spark: SparkSession, d: str) -> DataFrame:
    return layout.bookmarks(_of(spark, d, _MARKS, "orders", "o_orderkey % 7 = 0"), "doc").withColumn("pos", F.col("pos").cast("long"))


_MARKS_SQL = f"SELECT doc, title, page_index + 1 AS page, level + 1 AS level, row_number() OVER (PARTITION BY doc ORDER BY page_index, level, pos) AS pos FROM ({_sql(_MARKS, 'orders', 'o_orderkey % 7 = 0')})"


def bookmark_trail(spark: SparkSession, d: str) -> DataFrame:
    marks = bookmark_list(spark, d)
    listed = spark.range(0, 200, 3).select(F.col("id").alias("page"))
    return pages.bookmark_trail(marks.select("doc").distinct().join(listed), marks, "doc").select("doc", "page", F.array_join("trail", " > ").alias("trail"))


_TRAIL_SQL = f"""WITH k AS ({_MARKS_SQL}), p AS (SELECT doc, unnest(range(0, 200, 3)) AS page FROM (SELECT DISTINCT doc FROM k)),
t AS (SELECT p.doc, p.page, {", ".join(f"arg_max({{'l': level, 't': title}}, k.page * 1000000 + pos) FILTER (level <= {n}) AS t{n}" for n in range(1, 7))} FROM p LEFT JOIN k ON k.doc = p.doc AND k.page <= p.page GROUP BY 1, 2)
SELECT doc, page, concat_ws(' > ', {", ".join(f"CASE WHEN t{n}.l = {n} THEN t{n}.t END" for n in range(1, 7))}) AS trail FROM t"""


def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "orders").selectExpr("o_custkey % 200 AS doc", "o_orderkey", "o_orderkey % 1000 AS start", "o_orderkey % 1000 + o_orderkey % 9 + 1 AS end")
    spans = table(spark, d, "customer").selectExpr("c_custkey % 200 AS doc", "c_custkey", "c_custkey % 900 AS from", "c_custkey % 900 + 40 AS to")
    return pages.overlapping(words, spans, "doc").select("doc", "o_orderkey", "c_custkey")


def text_location(spark: SparkSession, d: str) -> DataFrame:
    """Where a passage of each document stands in it, its beginning or its end changed in some."""
    page = F.lower(T.strip(F.regexp_replace("text", r"\s+", " ")))
    passage = F.substring("page", 31, 120)
    needle = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(passage, 1, 45), F.lit(" changed words here"))).when(F.col("doc_id") % 3 == 1, passage).otherwise(F.concat(F.lit("zz "), passage))
    rows = table(spark, d, "documents").select("doc_id", page.alias("page")).withColumn("needle", needle)
    return rows.select("doc_id", layout.span_of(F.col("needle"), F.col("page")).alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


_LOCATION_SQL = f"""WITH p AS (SELECT doc_id, lower({strip_sql("regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')")}) AS page FROM documents),
n AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN substring(page, 31, 45) || ' changed words here' WHEN 1 THEN substring(page, 31, 120) ELSE 'zz ' || substring(page, 31, 120) END AS needle FROM p),
a AS (SELECT *, coalesce({", ".join(f"CASE WHEN length(needle) >= {k} THEN nullif(instr(page, substring(needle, 1, {k})), 0) END" for k in (60, 40, 30, 20, 15))}) AS spot, CASE WHEN length(needle) >= 40 THEN right(needle, 40) ELSE needle END AS tail FROM n),
h AS (SELECT *, instr(substring(page, spot), tail) AS hit FROM a)
SELECT doc_id, spot - 1 AS start, CASE WHEN spot IS NULL THEN NULL WHEN hit > 0 THEN spot - 1 + hit - 1 + length(tail) ELSE spot - 1 + length(needle) END AS "end" FROM h"""


def text_boxes(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "customer").selectExpr("c_custkey % 200 AS page", "c_custkey AS id", "c_custkey % 900 AS start", "c_custkey % 900 + 40 AS end")
    words = table(spark, d, "orders").selectExpr("o_custkey % 200 AS page", "o_orderkey % 1000 AS from", "o_orderkey % 1000 + 5 AS to", "CAST(o_orderkey % 500 AS DOUBLE) AS x0", "CAST(o_orderkey % 700 AS DOUBLE) AS y0", "CAST(o_orderkey % 500 + 30 AS DOUBLE) AS x1", "CAST(o_orderkey % 700 + 12 AS DOUBLE) AS y1")
    return layout.boxes_of(spans, words, "page")


_BOXES_SQL = """WITH s AS (SELECT c_custkey % 200 AS page, c_custkey AS id, c_custkey % 900 AS a, c_custkey % 900 + 40 AS b FROM customer), w AS (SELECT o_custkey % 200 AS page, o_orderkey % 1000 AS f, o_orderkey AS k FROM orders)
SELECT s.page, id, CAST(min(k % 500) AS DOUBLE) AS x0, CAST(min(k % 700) AS DOUBLE) AS y0, CAST(max(k % 500 + 30) AS DOUBLE) AS x1, CAST(max(k % 700 + 12) AS DOUBLE) AS y1 FROM s JOIN w ON w.page = s.page AND f + 5 > a AND f < b GROUP BY 1, 2"""


def headings_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """Headings of pages out of bookmarks, then fonts."""
    fonts = font_headings(spark, d)
    marks = bookmark_list(spark, d).where("page % 2 = 0 AND page <= 7").select("doc", F.col("page").cast("int").alias("page"), "pos", F.col("title").alias("text"), F.col("level").cast("int").alias("level"))
    lines = fonts.select("doc", "page", F.col("line").cast("long").alias("pos"), "text", "level")
    return layout.headings(lines, [marks, lines], "doc")


_HEADINGS_SQL = f"""WITH f AS ({_FONT_SQL}), k AS ({_MARKS_SQL}),
u AS (SELECT doc, page, pos, title AS text, level, 0 AS source FROM k WHERE page % 2 = 0 AND page <= 7 UNION ALL SELECT doc, page, CAST(line AS BIGINT), text, level, 1 FROM f)
SELECT doc, CAST(page AS INT) AS page, pos, text, CAST(level AS INT) AS level, source FROM u WHERE (doc, page) IN (SELECT (doc, page) FROM f) QUALIFY source = min(source) OVER (PARTITION BY doc, page)"""



def search_text_clean(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("[TABLE 3]\n"), "text", F.lit("\n| a | b |\n---|---\n Specification of Things\nX AP R20-11\n[IMAGE 2]"))
    return table(spark, d, "documents").select("doc_id", F.md5(pages.search_text(text)).alias("text_md5"))


_CLEAN_SQL = rf"""WITH a AS (SELECT doc_id, '[TABLE 3]' || chr(10) || text || chr(10) || '| a | b |' || chr(10) || '---|---' || chr(10) || ' Specification of Things' || chr(10) || 'X AP R20-11' || chr(10) || '[IMAGE 2]' AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\[(?:TABLE|Table|IMAGE|DIAGRAM|Page)\b[^\]]*\]\s*$', ' ', 'g'), '(?m)^[-\s|+]+$', ' ', 'g'), '\|', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches({strip_sql("x")}, '{pages.RUNNING_HEADER}')), chr(10)) AS t FROM b)
SELECT doc_id, md5({strip_sql(r"regexp_replace(t, '\s+', ' ', 'g')")}) AS text_md5 FROM c"""


def header_strip(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Requirements of X\n"), "text", F.lit("\nZ CP R19-03\nlast line"))
    return table(spark, d, "documents").select("doc_id", F.md5(pages.strip_headers(text)).alias("text_md5"))


_HEADER_SQL = f"""WITH a AS (SELECT doc_id, string_split('Requirements of X' || chr(10) || text || chr(10) || 'Z CP R19-03' || chr(10) || 'last line', chr(10)) AS ls FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(ls, lambda x: NOT regexp_matches({strip_sql("x")}, '{pages.RUNNING_HEADER}')), chr(10))) AS text_md5 FROM a"""

_TYPES = ["toc", "cover", "equation", "table", "class_reference", "image", "diagram", "mixed", "text", "unknown"]
_TYPE = "element_at(array(" + ", ".join(f"'{t}'" for t in _TYPES) + f"), CAST(doc_id % {len(_TYPES)} + 1 AS INT))"
_TYPE_SQL = "[" + ", ".join(f"'{t}'" for t in _TYPES) + f"][doc_id % {len(_TYPES)} + 1]"


def page_route(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k, at: F.when(F.col("doc_id") % k != 0, F.substring("text", at, 20))
    return table(spark, d, "documents").select("doc_id", pages.route(F.expr(_TYPE), part(3, 1), part(4, 21), part(5, 41), part(7, 61)).alias("content"))


_PARTS = ", ".join(f"nullif({strip_sql(f'CASE WHEN doc_id % {k} <> 0 THEN substring(text, {at}, 20) ELSE {chr(39) * 2} END')}, '') AS {c}" for c, k, at in (("t", 3, 1), ("tab", 4, 21), ("see", 5, 41), ("rd", 7, 61)))
_BOTH = "nullif(concat_ws(chr(10) || chr(10), {}), '')"
_ROUTE_SQL = f"""WITH p AS (SELECT doc_id, {_TYPE_SQL} AS k, {_PARTS} FROM documents)
SELECT doc_id, coalesce(CASE WHEN k = 'toc' THEN NULL WHEN k IN ('cover', 'text') THEN t WHEN k = 'equation' THEN coalesce(t, see) WHEN k = 'table' THEN coalesce(tab, t, rd, see) WHEN k = 'class_reference' THEN coalesce(tab, regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'))
  WHEN k = 'image' THEN coalesce(rd, see, t) WHEN k = 'diagram' THEN coalesce({_BOTH.format('t, see')}, rd) ELSE {_BOTH.format('t, tab, see')} END, '') AS content FROM p"""


def classifier_combine(spark: SparkSession, d: str) -> DataFrame:
    vision = F.when(F.col("doc_id") % 4 == 0, "diagram").when(F.col("doc_id") % 4 == 1, "unknown")
    out = pages.combine(F.expr(_TYPE), (F.col("doc_id") % 10) / 10.0, (F.col("doc_id") % 6 == 0).cast("int"), vision)
    return table(spark, d, "documents").select("doc_id", out.alias("c")).select("doc_id", "c.*")


_COMBINE_SQL = f"""WITH p AS (SELECT doc_id, {_TYPE_SQL} AS k, CAST((doc_id % 10) / 10.0 AS DOUBLE) AS c, doc_id % 6 = 0 AS pic, CASE doc_id % 4 WHEN 0 THEN 'diagram' WHEN 1 THEN 'unknown' END AS v FROM documents),
a AS (SELECT *, (c < 0.65 OR pic OR k IN ('diagram', 'image', 'unknown')) AND v IS NOT NULL AS asked FROM p)
SELECT doc_id, CASE WHEN asked AND v <> 'unknown' THEN v WHEN k = 'unknown' THEN 'text' ELSE k END AS page_type, CASE WHEN asked THEN 1.0 ELSE c END AS confidence, asked AS used_vision FROM a"""


def vision_types(spark: SparkSession, d: str) -> DataFrame:
    """Types out of a model's answers: JSON of a known and of an unknown type, fenced JSON, and prose."""
    kind = F.expr(_TYPE)
    prose = F.concat(F.lit("This seems a "), F.upper(kind), F.lit(" on a page"))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"type": "'), kind, F.lit('", "description": "x"}'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('```json\n{"type": " '), F.upper(kind), F.lit('"}\n```'))).otherwise(prose)
    return table(spark, d, "documents").select("doc_id", pages.vision_type(said).alias("page_type"))


_VISION_SQL = f"""WITH p AS (SELECT doc_id, {_TYPE_SQL} AS k FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN CASE WHEN k IN ({", ".join(f"'{x}'" for x in pages.SEEN)}) THEN k ELSE 'unknown' END ELSE CASE {" ".join(f"WHEN contains('this seems a ' || k || ' on a page', '{x}') THEN '{x}'" for x in pages.SEEN)} ELSE 'unknown' END END AS page_type FROM p"""


def vision_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pages.vision_keyword(F.col("html"), more=True).alias("page_type"))


_SEEN_SQL = f"""SELECT page_id, CASE {" ".join(f"WHEN contains(lower(html), '{pages.SEEN_AS.get(x, x)}') THEN '{x}'" for x in pages.SEEN_MORE)} ELSE 'unknown' END AS page_type FROM pages"""


def image_markers(spark: SparkSession, d: str) -> DataFrame:
    images = F.expr("array(named_struct('width', CAST(c_custkey % 60 AS INT), 'height', CAST(c_custkey % 90 AS INT)), named_struct('width', 100, 'height', 50))")
    told, diagram = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    found = pages.image_markers(F.when(F.col("c_custkey") % 5 != 0, images), F.col("c_nationkey"), told, F.col("c_custkey") % 4 == 0, diagram)
    return table(spark, d, "customer").select("c_custkey", F.array_join(found, "").alias("blocks"))


_MARKERS_SQL = """WITH c AS (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 60 > 20 AND c_custkey % 90 > 20 AND (c_custkey % 60) * (c_custkey % 90) > 1000 THEN [[c_custkey % 60, c_custkey % 90], [100, 50]] ELSE [[100, 50]] END ELSE [] END AS im, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS told, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS dia FROM customer),
b AS (SELECT *, list_transform(range(1, len(im) + 1), lambda k: chr(10) || '[IMAGE ' || k || ']' || chr(10) || CASE WHEN told IS NOT NULL THEN told || chr(10) || '[Image ' || k || '/' || len(im) || ' on page ' || c_nationkey || ', size ' || im[k][1] || '×' || im[k][2] || ' px]' ELSE '[Embedded image ' || k || '/' || len(im) || ', page ' || c_nationkey || ', size ' || im[k][1] || '×' || im[k][2] || ' px]' END || chr(10)) AS bs FROM c)
SELECT c_custkey, array_to_string(bs, '') || CASE WHEN dia IS NOT NULL AND (len(im) = 0 OR c_custkey % 4 = 0) THEN chr(10) || '[DIAGRAM 1]' || chr(10) || dia || chr(10) ELSE '' END AS blocks FROM b"""


def visual_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", pages.meaningful_image(F.col("c_custkey") % 60, F.col("c_custkey") % 90).alias("image"), pages.has_drawings(F.col("c_custkey") % 5, F.col("c_custkey") % 14).alias("drawings"))


def tiered_text(spark: SparkSession, d: str) -> DataFrame:
    """The best of three readers: one cuts every document, the second half of them less, and some are blank."""
    first = F.when(F.col("doc_id") % 5 != 0, F.substring("text", 1, 200))
    second = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 400)).otherwise("")
    got = pages.tiered(first, second, F.concat(F.lit(" ocr "), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", F.md5(got).alias("text_md5"))


_A, _B = strip_sql("CASE WHEN doc_id % 5 <> 0 THEN substring(text, 1, 200) ELSE '' END"), strip_sql("CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 400) ELSE '' END")
_TIERED_SQL = f"WITH r AS (SELECT doc_id, lang, {_A} AS a, {_B} AS b FROM documents), c AS (SELECT *, CASE WHEN length(a) < 300 AND length(b) > length(a) THEN b ELSE a END AS x FROM r) SELECT doc_id, md5(CASE WHEN x = '' THEN 'ocr ' || lang ELSE x END) AS text_md5 FROM c"


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("head\n[Page 1 | type=text]\n"), F.substring("text", 1, 80), F.lit("\n[Page 12 | type=table]\n a | b \n[Page 3 | type=toc]\n"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(chunking.page_blocks(text)).alias("b"))
    return rows.select("doc_id", "b.page", "b.kind", F.md5("b.body").alias("body_md5"))


_BLOCKS_SQL = f"""SELECT doc_id, 1 AS page, 'text' AS kind, md5({strip_sql("substring(text, 1, 80)")}) AS body_md5 FROM documents UNION ALL SELECT doc_id, 12, 'table', md5('a | b') FROM documents UNION ALL SELECT doc_id, 3, 'toc', md5('') FROM documents"""


def base_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/set"), F.when(F.col("s_suppkey") % 2 == 0, "/").otherwise("\\"), F.col("s_name"), F.lit(".pdf"))
    return table(spark, d, "supplier").select("s_suppkey", T.base_name(path).alias("name"))


QUERIES = {
    "font_headings": (font_headings, _FONT_SQL),
    "font_body": (font_body, _BODY_SQL),
    "near_rects": (near_rects, f"WITH {_NEAR} SELECT * FROM e"),
    "rect_clusters": (rect_clusters, _CLUSTERS_SQL),
    "layout_regions": (layout_regions, None),
    "bookmark_list": (bookmark_list, _MARKS_SQL),
    "bookmark_trail": (bookmark_trail, _TRAIL_SQL),
    "interval_overlap": (interval_overlap, "SELECT o_custkey % 200 AS doc, o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey % 200 = c_custkey % 200 AND o_orderkey % 1000 + o_orderkey % 9 + 1 > c_custkey % 900 AND o_orderkey % 1000 < c_custkey % 900 + 40"),
    "text_location": (text_location, _LOCATION_SQL),
    "text_boxes": (text_boxes, _BOXES_SQL),
    "headings_by_priority": (headings_by_priority, _HEADINGS_SQL),
    "search_text_clean": (search_text_clean, _CLEAN_SQL),
    "header_strip": (header_strip, _HEADER_SQL),
    "page_route": (page_route, _ROUTE_SQL),
    "classifier_combine": (classifier_combine, _COMBINE_SQL),
    "vision_types": (vision_types, _VISION_SQL),
    "vision_keyword": (vision_words, _SEEN_SQL),
    "image_markers": (image_markers, _MARKERS_SQL),
    "visual_flags": (visual_flags, "SELECT c_custkey, c_custkey % 60 > 20 AND c_custkey % 90 > 20 AND (c_custkey % 60) * (c_custkey % 90) > 1000 AS image, c_custkey % 5 >= 3 OR c_custkey % 14 >= 10 AS drawings FROM customer"),
    "tiered_text": (tiered_text, _TIERED_SQL),
    "page_blocks": (page_blocks, _BLOCKS_SQL),
    "base_names": (base_names, "SELECT s_suppkey, s_name || '.pdf' AS name FROM supplier"),
}
