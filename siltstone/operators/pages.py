"""Page classification, content routing, tables, layout rules and inspection reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: Fixed lists and patterns of the page rules.
TOC_LINE = r"(\.\s*){2,}.*\d+\s*$"
LEGAL = ["copyright", "all rights reserved", "liability", "no warranty", "reproduction prohibited", "proprietary", "confidential", "legal notice", "disclaimer"]
REVISION = ["revision", "version", "author", "change", "date", "release", "history"]
CLASS_WORDS = ["attribute", "multiplicity", "type", "category", "stereotype", "aggregation", "class", "meta", "role"]
CODE_LINE = r"^\s*(#include|#define|typedef|void |uint\d+_t|Std_ReturnType|FUNC\(|P2VAR\(|CONST\()"
ITEM_LINE = r"\[(SWS|RS|ECUC|constr|TPS|BSW|SRS)_\w+\]"
GLOSSARY_LINE = r"^\s*[A-Z][A-Z0-9_\-]{1,15}\s{2,}.{10,}"
LIST_LINE = r"^\s*([-•*]|\d+[.)]) "
RUNNING_HEADER = r"(?i)^(?:(?:Specification|Requirements|Explanation|Adaptive Platform|Classic Platform)\s+of\s+\S|\S+\s+(?:AP|CP|FO|TR)\s+R\d{2}-\d{2}|\S+\s+Release\s+\d)"


def text_lines(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return T.lines(T.strip(F.coalesce(text, F.lit(""))))


def count_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def share_of_lines(lines: Column, pattern: str) -> Column:
    return T.share(count_lines(lines, pattern), F.size(lines))


def line_share(text: Column, pattern: str) -> Column:
    """The part of the lines that are not blank in which a pattern is found."""
    return let(text_lines(text), lambda ls: share_of_lines(ls, pattern))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a lower-cased text contains."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words])


def toc_page(text: Column) -> Column:
    """Whether a page is a table of contents: 50 to 5000 characters, at least 5 lines, half of them with dots and a number."""
    n = F.length(T.strip(F.coalesce(text, F.lit(""))))
    return n.between(50, 5000) & let(text_lines(text), lambda ls: (F.size(ls) >= 5) & (share_of_lines(ls, TOC_LINE) >= 0.5))


def _typed(rules: list[tuple[Column, str, float]]) -> Column:
    """The first rule that holds, as (page_type, confidence); unknown with 0.4 if none does."""
    pairs = [(when, F.struct(F.lit(kind).alias("page_type"), F.lit(sure).alias("confidence"))) for when, kind, sure in rules]
    case = F.when(*pairs[0])
    for when, value in pairs[1:]:
        case = case.when(when, value)
    return case.otherwise(F.struct(F.lit("unknown").alias("page_type"), F.lit(0.4).alias("confidence")))


def classify(text: Column, tables: Column, images: Column) -> Column:
    """(page_type, confidence) of a page by its text and its numbers of tables and images."""
    n = F.length(T.strip(F.coalesce(text, F.lit(""))))
    return let(text_lines(text), lambda ls: _typed([
        ((n < 150) & (tables == 0) & (images == 0), "cover", 0.65),
        ((n < 5000) & (share_of_lines(ls, TOC_LINE) > 0.35), "toc", 0.80),
        ((n < 300) & (images > 0) & (tables == 0), "image", 0.72),
        ((n < 300) & (images > 0), "diagram", 0.55),
        ((tables > 1) | ((tables == 1) & (n < 600)), "table", 0.85),
        (tables == 1, "mixed", 0.70),
        ((n > 500) & (images == 0), "text", 0.90),
        (n > 200, "text", 0.75),
        (images > 0, "image", 0.55),
    ]))


def classify_more(text: Column, tables: Column, images: Column) -> Column:
    """classify() with legal, revision, code, item, class, glossary and list pages told apart."""
    body = T.strip(F.coalesce(text, F.lit("")))
    n = F.length(body)
    return let(text_lines(text), lambda ls: _typed([
        ((n < 150) & (tables == 0) & (images == 0), "cover", 0.65),
        ((n < 1500) & (tables == 0) & (hits(body, LEGAL) >= 2), "disclaimer", 0.82),
        ((tables > 0) & (hits(body, REVISION) >= 3), "revision_history", 0.85),
        ((n < 5000) & (share_of_lines(ls, TOC_LINE) > 0.35), "toc", 0.80),
        ((n < 300) & (images > 0) & (tables == 0), "image", 0.72),
        ((n < 300) & (images > 0), "diagram", 0.55),
        (count_lines(ls, CODE_LINE) >= 3, "code_snippet", 0.85),
        (count_lines(ls, ITEM_LINE) >= 2, "specification_item", 0.85),
        ((tables > 0) & (hits(body, CLASS_WORDS) >= 3), "class_reference", 0.78),
        ((share_of_lines(ls, GLOSSARY_LINE) > 0.30) & (n < 4000), "glossary", 0.80),
        ((tables > 1) | ((tables == 1) & (n < 600)), "table", 0.85),
        (tables == 1, "mixed", 0.70),
        ((n > 100) & (share_of_lines(ls, LIST_LINE) > 0.45), "list", 0.82),
        ((n > 500) & (images == 0), "text", 0.90),
        (n > 200, "text", 0.75),
        (images > 0, "image", 0.55),
    ]))


def combine(page_type: Column, confidence: Column, images: Column, vision: Column, sure: float = 0.65) -> Column:
    """(page_type, confidence, used_vision): a vision model's type, where one was asked and knew, over the rules'."""
    asked = ((confidence < sure) | (images > 0) | page_type.isin("diagram", "image", "unknown")) & vision.isNotNull()
    ruled = F.when(page_type == "unknown", "text").otherwise(page_type)
    return F.struct(F.when(asked & (vision != "unknown"), vision).otherwise(ruled).alias("page_type"), F.when(asked, 1.0).otherwise(confidence).alias("confidence"), asked.alias("used_vision"))


#: Page types in the order in which a vision model's prose is searched for them, each with the words looked for; fixed lists.
SEEN = ["table", "image", "diagram", "equation", "cover", "toc", "mixed", "text"]
SEEN_MORE = [
    "specification_item", "class_reference", "code_snippet", "glossary", "revision_history", "disclaimer",
    "table", "image", "diagram", "equation", "cover", "toc", "list", "mixed", "text",
]
SEEN_AS = {"specification_item": "specification item", "class_reference": "class reference", "code_snippet": "code", "revision_history": "revision"}


def vision_keyword(response: Column, more: bool = False) -> Column:
    """The page type that a vision model's prose names first in the order of the types."""
    low = F.lower(F.coalesce(response, F.lit("")))
    return F.coalesce(*[F.when(low.contains(SEEN_AS.get(k, k)), F.lit(k)) for k in (SEEN_MORE if more else SEEN)], F.lit("unknown"))


def route(page_type: Column, text: Column, tables: Column, vision: Column, ocr: Column) -> Column:
    """What of a page is indexed: text, serialised tables, a description or recognised text, by its type."""
    full = lambda c: F.nullif(T.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    t, tab, see, read = full(text), full(tables), full(vision), full(ocr)
    both = lambda *cs: F.nullif(F.concat_ws("\n\n", *cs), F.lit(""))
    shown = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    out = (
        F.when(page_type.isin("toc", "revision_history", "disclaimer"), F.lit(None).cast("string"))
        .when(page_type.isin("cover", "text", "list", "glossary", "specification_item", "code_snippet"), t)
        .when(page_type == "equation", F.coalesce(t, see))
        .when(page_type == "table", F.coalesce(tab, t, read, see))
        .when(page_type == "class_reference", F.coalesce(tab, shown))
        .when(page_type == "image", F.coalesce(read, see, t))
        .when(page_type == "diagram", F.coalesce(both(t, see), read))
        .otherwise(both(t, tab, see))
    )
    return F.coalesce(out, F.lit(""))


def meaningful_table(cells: Column) -> Column:
    """Whether at least a fifth of a table's cells (array of rows) has something in it."""
    flat = F.flatten(cells)
    return F.coalesce(T.share(F.size(F.filter(flat, lambda c: T.strip(F.coalesce(c, F.lit(""))) != "")), F.size(flat)) >= 0.2, F.lit(False))


def serialise_table(cells: Column, number: Column, tag: str = "TABLE") -> Column:
    """A table as lines of cells between bars, the first underlined by dashes of its length, under a numbered tag."""
    rows = F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit("")))), " | "))
    head = F.element_at(rows, 1)
    body = F.array_join(F.concat(F.array(head, F.repeat(F.lit("-"), F.length(head))), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")
    return F.format_string(f"[{tag} %d]\n%s", number, body)


def meaningful_image(width: Column, height: Column) -> Column:
    return (width > 20) & (height > 20) & (width * height > 1000)


def has_drawings(curves: Column, long_lines: Column) -> Column:
    return (curves >= 3) | (long_lines >= 10)


def strip_headers(text: Column) -> Column:
    """The lines of a text without running headers."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~T.strip(x).rlike(RUNNING_HEADER)), "\n")


def search_text(text: Column) -> Column:
    """A chunk's text as it can be found on its page: without markers, bars and rules of dashes, blanks as one."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\[(?:TABLE|Table|IMAGE|DIAGRAM|Page)\b[^\]]*\]\s*$", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?m)^[-\s|+]+$", " "), r"\|", " ")
    return T.strip(F.regexp_replace(strip_headers(bare), r"\s+", " "))


def locate(needle: Column, haystack: Column, sizes: tuple[int, ...] = (60, 40, 30, 20, 15)) -> Column:
    """Where a text begins in another, by its longest beginning of the given sizes that is found, from 1; null if none is."""
    tries = [F.nullif(F.position(F.substring(needle, 1, k), haystack), F.lit(0)) for k in sizes]
    return F.when(F.length(needle) > 0, F.coalesce(*tries))


def overlapping(words: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """words (key, start, end, ...) met with the spans (key, from, to, ...) that they overlap."""
    return words.join(spans, key).where("end > `from` AND start < `to`")


def body_size(chars: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """(key, body): each document's most frequent rounded font size, ties to the one that appears first."""
    counted = chars.groupBy(key, F.round(size, 1).alias("body")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.max_by("body", F.struct("n", -F.col("first"))).alias("body"))


def font_headings(chars: DataFrame, key: str) -> DataFrame:
    """(key, page, line, text, level) of lines set at least 5 percent larger than the body.

    chars has key, page, top, x, size, text and pos. Lines are characters whose tops
    round to the same even number; the largest size is level 1, at most 6.
    """
    body = body_size(chars, key, "size", "pos")
    lines = chars.groupBy(key, "page", (F.round(F.col("top") / 2) * 2).alias("line")).agg(F.round(F.max("size"), 1).alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "pos", "text"))), lambda c: c["text"]), "").alias("text"))
    large = lines.join(body, key).where(F.col("size") >= F.col("body") * 1.05).where(T.strip("text") != "")
    level = F.least(F.lit(6), F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("size"))))
    return large.select(key, "page", "line", T.strip("text").alias("text"), level.alias("level"))


def bookmark_trail(pages: DataFrame, bookmarks: DataFrame, key: str, levels: int = 6) -> DataFrame:
    """pages (key, page) with trail: the latest bookmark (key, page, level, title, pos) of each level, deeper ones cleared by a higher one."""
    marks = bookmarks.select(key, "page", F.col("pos").alias("_pos"), "level", "title")
    stops = pages.select(key, "page", F.lit(None).cast("int").alias("_pos"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"))
    upto = Window.partitionBy(key).orderBy("page", F.col("_pos").isNull(), "_pos").rowsBetween(Window.unboundedPreceding, 0)
    every = marks.unionByName(stops)
    # a level's title holds unless a higher level has begun since
    for k in range(1, levels + 1):
        seen = F.last(F.when(F.col("level") <= k, F.struct(F.col("level").alias("l"), F.col("title").alias("t"))), ignorenulls=True).over(upto)
        every = every.withColumn(f"_t{k}", F.when(seen["l"] == k, seen["t"]))
    trail = F.filter(F.array(*[F.col(f"_t{k}") for k in range(1, levels + 1)]), lambda t: t.isNotNull())
    return every.where("level IS NULL").select(key, "page", trail.alias("trail"))


#: Fixed formats of the blocks for images and drawings.
IMAGE_BLOCK, DIAGRAM_BLOCK = "\n[IMAGE %d]\n%s\n", "\n[DIAGRAM 1]\n%s\n"
SHOWN, EMBEDDED = "%s\n[Image %d/%d on page %d, size %s]", "[Embedded image %d/%d, page %d, size %s]"


def image_markers(images: Column, page: Column, described: Column, drawn: Column, diagram: Column) -> Column:
    """The tagged blocks of a page's visual elements, one for each meaningful image (width, height), then one for its drawings.

    All images share the page's description, each with its size; without one they are
    named as embedded. Drawings are a block of their own where they are described: beside
    images only if the page has many of them (drawn).
    """
    kept = F.filter(F.coalesce(images, F.array().cast("array<struct<width:int,height:int>>")), lambda i: meaningful_image(i["width"], i["height"]))
    n = F.size(kept)
    told = F.coalesce(described, F.lit("")) != ""

    def block(i: Column, k: Column) -> Column:
        size = F.format_string("%d\u00d7%d px", i["width"], i["height"])
        own = F.format_string(SHOWN, described, k + 1, n, page, size)
        bare = F.format_string(EMBEDDED, k + 1, n, page, size)
        return F.format_string(IMAGE_BLOCK, k + 1, F.when(told, own).otherwise(bare))

    said = (F.coalesce(diagram, F.lit("")) != "") & ((n == 0) | drawn)
    return F.concat(F.transform(kept, block), F.when(said, F.array(F.format_string(DIAGRAM_BLOCK, diagram))).otherwise(F.array().cast("array<string>")))


def vision_type(response: Column, more: bool = False, cut: int = 4000) -> Column:
    """The page type of a vision model's answer: that of its JSON object, unknown if it is none of the types; of prose, the first type that it names."""
    said = F.substring(F.coalesce(response, F.lit("")), 1, cut)
    bare = T.strip(F.regexp_replace(said, r"```[a-z]*\n?", ""))
    kind = F.lower(T.strip(F.coalesce(F.get_json_object(bare, "$.type"), F.lit("unknown"))))
    known = F.when(kind.isin(*(SEEN_MORE if more else SEEN)), kind).otherwise("unknown")
    return F.when(F.get_json_object(bare, "$").startswith("{"), known).otherwise(vision_keyword(said, more))


def tiered(first: Column, second: Column, recognised: Column, least: int = 300) -> Column:
    """A page's text out of three readers: the first's; the second's where that has less than least characters and the second more; the recognised one where both are blank."""
    of = lambda c: T.strip(F.coalesce(c, F.lit("")))
    better = F.when((F.length(of(first)) < least) & (F.length(of(second)) > F.length(of(first))), of(second)).otherwise(of(first))
    return F.when(better == "", of(recognised)).otherwise(better)


def anomalies(pages: DataFrame) -> DataFrame:
    """pages (page_type, parents, children, chars) with problem, a row for each that a page has; pages without text have none."""
    kind = F.col("page_type")
    rules = [
        F.when((F.col("children") == 0) & (F.col("chars") > 200), "text without chunks"),
        F.when(kind.isin("table", "mixed") & (F.col("parents") == 0), "table page without parent chunk"),
        F.when(kind.isin("image", "diagram") & (F.col("chars") < 50), "hardly any text for an image"),
    ]
    return pages.where(kind != "no_text").withColumn("problem", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())))


def page_rollup(chunks: DataFrame, document: str, page: str, kind: str) -> DataFrame:
    """(document, page, parents, children): chunks of each page, of each document and in total, by rollup; totals have nulls."""
    count = lambda k: F.count_if(F.col(kind) == k)
    return chunks.rollup(document, page).agg(count("parent").alias("parents"), count("child").alias("children"))


def chunk_sizes(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(n, min, max, mean): chunks and their lengths, the mean rounded down."""
    n = F.length(text)
    return chunks.agg(F.count("*").alias("n"), F.min(n).cast("long").alias("min"), F.max(n).cast("long").alias("max"), F.floor(F.avg(n)).alias("mean"))
