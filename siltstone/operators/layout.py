"""What stands where on a page: rectangles, regions with captions, and the boxes of found texts.

Tables have a column that names the page; coordinates are points, y downwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.session import cut

#: Fixed values of the layout rules, in points and square points.
GAP, BAND, PAD = 24.0, 55.0, 10.0
THIN, LONG, STROKE = 3.0, 5.0, 2.0
TABLE_LINES, TABLE_AREA, INSIDE = 6, 600.0, 5.0
DIAGRAM_OBJECTS, DIAGRAM_AREA, IMAGE_AREA = 3, 1500.0, 400.0
CAPTION = r"(?i)^(figure|fig\.?|table|tbl\.?|diagram)\s*[\d.]"
LABEL = r"(?i)^((?:figure|fig\.?|table|tbl\.?|diagram)\s*[\d.]+)"
CAPTION_WORDS, CAPTION_CHARS = 30, 120
#: Cells of a page's grid in each direction, at most.
GRID = 32
BOX = ("x0", "y0", "x1", "y1")


def near_rects(rects: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, a, b) of a page's rectangles (key, id, x0, y0, x1, y1) with gaps of at most gap both ways.

    Rectangles meet by the cells of a grid over their page, no finer than the gap and of
    at most GRID cells each way, so only those of a neighbourhood are compared and a
    large one lies in a bounded number of cells. A pair counts in the first cell that
    both lie in, so pairs are neither shuffled nor repeated.
    """
    over = rects.groupBy(key).agg(F.min("x0").alias("_x"), F.min("y0").alias("_y"), F.greatest(F.lit(gap), F.lit(1.0), (F.max("x1") - F.min("x0")) / GRID).alias("_w"), F.greatest(F.lit(gap), F.lit(1.0), (F.max("y1") - F.min("y0")) / GRID).alias("_h"))
    cells = lambda lo, hi, least, size: F.sequence(F.floor((F.col(lo) - F.col(least) - gap) / F.col(size)), F.floor((F.col(hi) - F.col(least) + gap) / F.col(size)))
    placed = rects.select(key, "id", *BOX).join(over, key).withColumn("_xs", cells("x0", "x1", "_x", "_w")).withColumn("_ys", cells("y0", "y1", "_y", "_h"))
    placed = placed.select(key, "id", *BOX, F.col("_xs")[0].alias("_fx"), F.col("_ys")[0].alias("_fy"), F.explode("_xs").alias("_cx"), "_ys").withColumn("_cy", F.explode("_ys")).drop("_ys")
    met = placed.join(placed.withColumnsRenamed({c: f"{c}_b" for c in ("id", "_fx", "_fy", *BOX)}), [key, "_cx", "_cy"]).where("id < id_b AND _cx = greatest(_fx, _fx_b) AND _cy = greatest(_fy, _fy_b)")
    apart = lambda lo, hi: F.greatest(F.lit(0.0), F.greatest(F.col(lo), F.col(f"{lo}_b")) - F.least(F.col(hi), F.col(f"{hi}_b")))
    return met.where((apart("x0", "x1") <= gap) & (apart("y0", "y1") <= gap)).select(key, F.col("id").alias("a"), F.col("id_b").alias("b"))


def rect_clusters(rects: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, id, cluster): rectangles joined by near_rects, a cluster named by its smallest id.

    Rectangles with the same box are one from the start, named by their smallest id, so
    copies make no pairs. In each turn a cluster joins the one of the smallest name that it
    is near to, in steps of four, and the edges that are left are those between clusters, so they
    and the turns soon end; state is written out between turns.
    """
    # a box whose sides are the wrong way round by more than the gap is near to none, not even to its copy
    first = cut(rects.where((F.col("x0") - F.col("x1") <= gap) & (F.col("y0") - F.col("y1") <= gap)).groupBy(key, *BOX).agg(F.min("id").alias("_first")))
    named = _clusters(first.withColumnRenamed("_first", "id"), key, gap)
    met = rects.select(key, "id", *BOX).join(first, [key, *BOX], "left").join(named.withColumnsRenamed({"id": "_first", "cluster": "_named"}), [key, "_first"], "left")
    return met.select(key, "id", F.coalesce("_named", "id").alias("cluster"))


def _clusters(rects: DataFrame, key: str, gap: float) -> DataFrame:
    """rect_clusters() of rectangles with different boxes."""
    edges = near_rects(rects, key, gap)
    both = cut(edges.unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(rects.select(key, "id", F.col("id").alias("cluster")))
    while not both.isEmpty():
        least = both.groupBy(key, "a").agg(F.least("a", F.min("b")).alias("up"))
        for _ in range(2):
            above = least.select(key, F.col("a").alias("up"), F.col("up").alias("_top"))
            least = least.join(above, [key, "up"]).select(key, "a", F.col("_top").alias("up"))
        least = cut(least)
        labels = cut(labels.join(least.withColumnRenamed("a", "cluster"), [key, "cluster"], "left").select(key, "id", F.coalesce("up", "cluster").alias("cluster")))
        ends = both.join(least, [key, "a"]).select(key, F.col("up").alias("_a"), F.col("b").alias("a")).join(least, [key, "a"])
        both = cut(ends.where("_a <> up").select(key, F.col("_a").alias("a"), F.col("up").alias("b")).distinct())
    return labels


def _boxes(rects: DataFrame, key: str, gap: float, least: int, area: float) -> DataFrame:
    """(key, x0, y0, x1, y1) around the clusters of at least so many rectangles and so large an area."""
    met = rects.join(rect_clusters(rects, key, gap), [key, "id"]).groupBy(key, "cluster").agg(F.count("*").alias("_n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return met.where((F.col("_n") >= least) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= area)).select(key, *BOX)


def is_border(width: Column, height: Column, stroke: Column) -> Column:
    """Whether a path is a border line of a table: thin one way, longer the other, and drawn with a fine pen."""
    return (((height < THIN) & (width > LONG)) | ((width < THIN) & (height > LONG))) & (F.coalesce(F.nullif(stroke, F.lit(0.0)), F.lit(1.0)) <= STROKE)


def regions(paths: DataFrame, images: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, kind, x0, y0, x1, y1, caption, label): line tables, diagrams and images of pages.

    paths has key, id, the box and stroke; images key and the box; words key, pos, text
    and the box. A table is a cluster of border lines with a word in it; a diagram one of
    the other paths that lie in no table. A caption stands in the band below a region,
    else, if it begins like one, in the band above.
    """
    border = is_border(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("stroke"))
    boxes = _boxes(paths.where(border), key, 2 * GAP, TABLE_LINES, TABLE_AREA)
    inner = words.select(key, *[F.col(c).alias(f"w{c}") for c in BOX])
    tables = cut(boxes.distinct().join(inner.distinct(), [key]).where("wx1 > x0 AND wx0 < x1 AND wy1 > y0 AND wy0 < y1").select(key, *BOX).distinct())
    other = paths.where(~border)
    held = tables.select(key, *[F.col(c).alias(f"t{c}") for c in BOX])
    within = other.join(held, key).where(f"x0 >= tx0 - {INSIDE} AND y0 >= ty0 - {INSIDE} AND x1 <= tx1 + {INSIDE} AND y1 <= ty1 + {INSIDE}").select(key, "id").distinct()
    diagrams = _boxes(other.join(within, [key, "id"], "left_anti"), key, GAP, DIAGRAM_OBJECTS, DIAGRAM_AREA)
    shown = images.select(key, *BOX).where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= IMAGE_AREA)
    every = tables.withColumn("kind", F.lit("line_table")).unionByName(diagrams.withColumn("kind", F.lit("diagram"))).unionByName(shown.withColumn("kind", F.lit("image")))
    return captioned(every, words, key)


def captioned(boxes: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """boxes (key, kind, x0, y0, x1, y1) with caption and label by the words (key, pos, text, box) around them."""
    # of words with the same box, only the first can be among the first of a caption
    nth = F.row_number().over(Window.partitionBy(key, *BOX).orderBy("pos", "text"))
    near = words.select(key, "pos", "text", *BOX).withColumn("_nth", nth).where(F.col("_nth") <= CAPTION_WORDS).select(key, "pos", "text", *[F.col(c).alias(f"w{c}") for c in BOX])
    aside = F.expr(f"wx1 > x0 - {PAD} AND wx0 < x1 + {PAD}")
    below, above = F.expr(f"wy1 > y1 AND wy0 < y1 + {BAND}"), F.expr(f"wy1 > y0 - {BAND} AND wy0 < y0")
    first = lambda band: F.slice(F.sort_array(F.collect_list(F.when(band, F.struct("pos", "text")))), 1, CAPTION_WORDS)
    # a word counts for each of the boxes that are equal
    said = lambda band: F.array_join(F.slice(F.flatten(F.transform(first(band), lambda w: F.array_repeat(w["text"], F.first("_copies").cast("int")))), 1, CAPTION_WORDS), " ")
    by = ["kind", *BOX]
    met = boxes.groupBy(key, *by).agg(F.count("*").alias("_copies")).join(near, key).where(aside & (below | above)).groupBy(key, *by).agg(T.strip(said(below)).alias("_below"), T.strip(said(above)).alias("_above"))
    found = boxes.join(met, [key, *by], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("_below", "_above")})
    caption = F.when(F.col("_below").rlike(CAPTION), F.col("_below")).when(F.col("_below") != "", F.substring("_below", 1, CAPTION_CHARS)).when(F.col("_above").rlike(CAPTION), F.col("_above")).otherwise("")
    plain = F.when(F.col("kind") == "line_table", "Table").when(F.col("kind") == "diagram", "Diagram").otherwise("Image")
    found = found.withColumn("caption", caption)
    return found.select(key, *by, "caption", F.coalesce(F.nullif(T.strip(F.regexp_extract("caption", LABEL, 1)), F.lit("")), plain).alias("label"))


def span_of(needle: Column, haystack: Column, sizes: tuple[int, ...] = (60, 40, 30, 20, 15), tail: int = 40) -> Column:
    """(start, end) from 0 of a text in another, both with single blanks and lower-cased; null if it isn't found.

    It begins where the longest of its beginnings of the given sizes is found, and ends
    where its last tail characters are found after that, or else after its own length.
    """
    tries = [F.when(F.length(needle) >= k, F.nullif(F.position(F.substring(needle, 1, k), haystack), F.lit(0))) for k in sizes]

    def ended(at: Column) -> Column:
        last = F.when(F.length(needle) >= tail, F.substring(needle, -tail, tail)).otherwise(needle)
        hit = F.position(last, haystack, at)
        end = F.when(hit > 0, hit - 1 + F.length(last)).otherwise(at - 1 + F.length(needle))
        return F.when(at.isNotNull(), F.struct((at - 1).alias("start"), end.alias("end")))

    return F.transform(F.array(F.coalesce(*tries)), ended)[0]


#: Characters of a stretch by which spans meet words.
STRETCH = 64


def boxes_of(spans: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """spans (key, id, start, end) with the box around the words (key, from, to, box) that they overlap.

    Equal spans are looked up once, and words of one place count as one box around them;
    both meet by the stretches of STRETCH characters that they lie in.
    """
    least = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    around = [f(c).alias(c) for c, f in least.items()]
    reach = lambda lo, hi: F.explode(F.sequence(F.floor(F.least(lo, hi) / STRETCH), F.floor(F.greatest(lo, hi) / STRETCH)))
    places = words.groupBy(key, "from", "to").agg(*around).withColumn("_s", reach("from", "to"))
    asked = spans.select(key, "start", "end").distinct().withColumn("_s", reach("start", "end"))
    met = asked.join(places, [key, "_s"]).where("to > start AND `from` < end").groupBy(key, "start", "end").agg(*around)
    found = spans.select(key, "id", "start", "end").join(met, [key, "start", "end"])
    return found.groupBy(key, "id").agg(*around)


def bookmarks(rows: DataFrame, key: str) -> DataFrame:
    """(key, title, page, level, pos) of outline entries (key, title, page_index, level, pos), both counted from 1, in the order of page and level; those without a title or a page are left out."""
    kept = rows.where(F.col("page_index").isNotNull() & (T.strip(F.coalesce("title", F.lit(""))) != ""))
    order = Window.partitionBy(key).orderBy("page_index", F.coalesce("level", F.lit(0)), "pos")
    return kept.select(key, T.strip("title").alias("title"), (F.col("page_index") + 1).alias("page"), (F.coalesce("level", F.lit(0)) + 1).alias("level"), F.row_number().over(order).alias("pos"))


def headings(pages: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """(key, page, pos, text, level, source): each page's headings by the first of the sources (key, page, pos, text, level) that has any for it."""
    every = None
    for n, rows in enumerate(sources):
        named = rows.select(key, "page", "pos", "text", "level", F.lit(n).alias("source"))
        every = named if every is None else every.unionByName(named)
    first = every.groupBy(key, "page").agg(F.min("source").alias("source"))
    return every.join(first, [key, "page", "source"]).join(pages.select(key, "page").distinct(), [key, "page"], "left_semi").select(key, "page", "pos", "text", "level", "source")
