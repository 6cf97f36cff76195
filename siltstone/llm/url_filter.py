"""URL verdicts by rules and by trust propagation over hosts (operator 3), in DataFrame functions only.

A url's host is what follows its first ://, up to /, ? or #, A-Z lower-cased; its path
what follows, up to ? or #. A rule (host, path, verdict) fits its host and all its
subdomains if the url's path starts with the rule's; the longest fitting rule decides.

Pages without a rule get their host's verdict: hosts with pages that a rule allows are
trusted seeds, hosts with pages that a rule blocks are blocked seeds, each weighed by
its share of such pages. Personalised PageRank spreads trust from the trusted seeds
along the edges between hosts, and distrust from the blocked seeds along the reversed
edges. A host is blocked if its distrust is over MARGIN times its trust. Edges are the
absolute links of the pages, weighed by their number, and an edge both ways between a
host and its parent host (m.a.example.com and a.example.com) while the parent has at
least PARENT labels.

How it runs: pages are aggregated to hosts, and links to host pairs, before any
shuffle; ranks are rows (kind, host), so both directions share each of TURNS joins;
host results meet the pages by a salted key, as one host may hold a third of them.

Cases: a null url or one without :// has an empty host and path, which no rule fits;
an empty host has no edges and is allowed; a null html has no links; urls and pages of any
length are read whole; repeated rows are judged each and weigh each; rules of equal
length go by verdict, block first; equal trust and distrust allow; without rules, or
without pages that any fits, all are allowed; an empty table gives no rows; extra
columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.line_dedup import lower_ascii
from siltstone.llm.shared import scratch

DAMPING = 0.75
TURNS = 12
CUT = 4
MARGIN = 1.0
PARENT = 3
SALTS = 16
#: (host, path, verdict), a fixed list.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and all its parents: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.array(labels), lambda ls: F.transform(ls, lambda _, k: F.array_join(F.slice(ls, k + 1, F.size(ls)), ".")))[0]


def _spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, host, path, ...) with rule and ruling, both null where none fits."""
    wide = rules.select(F.col("host").alias("_suffix"), F.struct((-F.length(F.concat("host", "path"))).alias("least"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("order"), F.concat("host", "path").alias("rule"), F.col("path").alias("prefix"), "verdict").alias("r"))
    hosts = pages.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("_suffix"))
    each = hosts.join(wide, "_suffix").groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("_rules"))
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    met = salted.join(_spread(each), ["host", "_salt"], "left").drop("_salt")
    first = F.get(F.filter("_rules", lambda r: F.col("path").startswith(r["prefix"])), F.lit(0))
    met = met.withColumn("_first", first)
    return met.select(*[c for c in met.columns if c not in ("_rules", "_first")], F.col("_first.rule").alias("rule"), F.col("_first.verdict").alias("ruling"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts and edges to parent hosts; none from a host to itself."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(hrefs).alias("url"))
    full = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    links = links.select("src", host_of(full).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    ups = pages.select("host").distinct().where(F.size(F.split("host", r"\.", -1)) > PARENT)
    ups = ups.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")), F.struct(F.regexp_replace("host", r"^[^.]*\.", "").alias("src"), F.col("host").alias("dst")))).alias("e"))
    ups = ups.select("e.src", "e.dst", F.lit(1.0).alias("weight"))
    return links.unionByName(ups).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, host, rank) after TURNS turns; seeds are (kind, host, mass), edges (kind, src, dst, part) with parts of a source summing to 1."""
    ranks = seeds.select("kind", "host", F.col("mass").alias("rank"))
    for turn in range(1, TURNS + 1):
        at = ranks.select("kind", F.col("host").alias("src"), "rank")
        moved = at.join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("part")).alias("rank"))
        again = seeds.select("kind", "host", ((1 - DAMPING) * F.col("mass")).alias("rank"))
        ranks = again.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if turn % CUT == 0:
            ranks = scratch(ranks)
    return ranks


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    if rules is None:
        fixed = [F.struct(*[F.lit(x).alias(c) for x, c in zip(rule, ("host", "path", "verdict"), strict=True)]) for rule in RULES]
        rules = spark.range(1).select(F.explode(F.array(*fixed)).alias("r")).select("r.*")
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = ruled(read, rules)
    counts = scratch(known.where("ruling IS NOT NULL").groupBy(F.col("ruling").alias("kind"), "host").agg(F.count("*").cast("double").alias("n")))
    sums = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = scratch(counts.join(sums, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass")))
    linked = scratch(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")))
    both = linked.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(linked.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    edges = scratch(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("part")))
    ranks = propagate(seeds, edges)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    hosts = ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    salted = known.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    met = salted.join(_spread(hosts), ["host", "_salt"], "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    by_host = F.when(F.col("distrust") > MARGIN * F.col("trust"), "block").otherwise("allow")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruling", by_host).alias("verdict"), "trust", "distrust")
