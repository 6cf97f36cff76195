import pytest

from siltstone.llm import url_filter as U

PAGES = "page_id long, url string, html string"


def judged(spark, rows, **more):
    return {r.page_id: r for r in U.judge(spark.createDataFrame(rows, PAGES), **more).collect()}


def test_hosts_paths_and_longest_rule(spark):
    rows = [
        (1, "http://WWW.Example.COM/en/7x?q=/fr/", None), (2, "https://a.example.com/en/8", None), (3, "http://x.net/de/1#f", None), (4, "http://www.example.net/de/88", None), (5, "http://org/es/", None),
        (6, "http://notexample.com/en", None), (7, None, None), (8, "no scheme/en/7", None), (9, "http://", None), (10, "x://h?a://b/c", None), (11, "http://EXAMPLE.com.evil.org/en/7", None), (12, "a\n://ü.COM/en/7", None),
    ]
    out = judged(spark, rows)
    found = {k: (r.host, r.path, r.rule) for k, r in out.items()}
    assert found == {
        1: ("www.example.com", "/en/7x", "example.com/en/7"), 2: ("a.example.com", "/en/8", "com/en/"), 3: ("x.net", "/de/1", "net/de/"), 4: ("www.example.net", "/de/88", "example.net/de/8"), 5: ("org", "/es/", "org/es/"),
        6: ("notexample.com", "/en", None), 7: ("", "", None), 8: ("", "", None), 9: ("", "", None), 10: ("h", "", None), 11: ("example.com.evil.org", "/en/7", None), 12: ("ü.com", "/en/7", "com/en/"),
    }
    assert [out[k].verdict for k in (1, 2, 3, 4, 5, 7)] == ["allow", "block", "block", "block", "block", "allow"]


def test_ranks_equal_a_plain_power_iteration(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [
        (1, "http://good.example.com/en/7", link("friend.example.org", "friend.example.org", "other.example.org")), (2, "http://bad.example.net/de/1", link("good.example.com")),
        (3, "http://friend.example.org/fr/1", link("bad.example.net") + '<a href="/local">y</a>'), (4, "http://other.example.org/fr/2", link("friend.example.org")), (5, "http://m.other.example.org/fr", None), (6, "http://lone.example.com/fr", ""),
    ]
    edges = {("good.example.com", "friend.example.org"): 2, ("good.example.com", "other.example.org"): 1, ("bad.example.net", "good.example.com"): 1, ("friend.example.org", "bad.example.net"): 1, ("other.example.org", "friend.example.org"): 1}
    for a, b in (("m.other.example.org", "other.example.org"), ("good.example.com", "example.com"), ("bad.example.net", "example.net"), ("friend.example.org", "example.org"), ("other.example.org", "example.org"), ("lone.example.com", "example.com")):
        if len(a.split(".")) > U.PARENT:
            edges[a, b] = edges[b, a] = 1

    def ranks(seed, pairs):
        out = {}
        for (a, _), w in pairs.items():
            out[a] = out.get(a, 0) + w
        rank = dict(seed)
        for _ in range(U.TURNS):
            new = {h: (1 - U.DAMPING) * m for h, m in seed.items()}
            for (a, b), w in pairs.items():
                new[b] = new.get(b, 0) + U.DAMPING * rank.get(a, 0) * w / out[a]
            rank = new
        return rank

    trust = ranks({"good.example.com": 1.0}, edges)
    distrust = ranks({"bad.example.net": 1.0}, {(b, a): w for (a, b), w in edges.items()})
    for r in judged(spark, rows).values():
        assert r.trust == pytest.approx(trust.get(r.host, 0), abs=1e-12) and r.distrust == pytest.approx(distrust.get(r.host, 0), abs=1e-12)
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > U.MARGIN * r.trust else "allow")


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "http://a.com/en/", None)] * 3
    assert spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS rule", "3 AS trust").transform(U.judge).count() == 3
    assert U.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_ties_long_urls_repeated_rows_and_empty_tables(spark):
    shape = "page_id long, url string, html string"
    rules = spark.createDataFrame([("com", "/aa/", "allow"), ("x.com", "/a", "block"), ("com", "/aaa", "block")], "host string, path string, verdict string")
    long = "https://deep.x.com/" + "a" * 200_000
    rows = [(1, "http://x.com/aa/1", None), (2, long, "x" * 100_000), (3, "http://y.com/aa/", ""), (3, "http://y.com/aa/", ""), (4, None, None), (5, "no scheme", None)]
    out = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, shape), rules).collect()}
    # x.com/a and com/aa/ are seven characters each: block goes first
    assert (out[1].rule, out[1].verdict) == ("x.com/a", "block")
    assert out[2].path == "/" + "a" * 200_000 and out[2].verdict == "block"
    assert out[3].verdict == "allow" and out[4].host == "" and out[5].path == "" and out[4].rule is None
    assert U.judge(spark.createDataFrame(rows, shape), rules).count() == len(rows)
    assert U.judge(spark.createDataFrame([], shape)).count() == 0
    alone = U.judge(spark.createDataFrame(rows, shape), rules.limit(0)).collect()
    assert {r.verdict for r in alone} == {"allow"} and {r.rule for r in alone} == {None}


def test_rules_are_those_of_the_contract(spark):
    assert U.RULES == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    rows = [(1, "http://a.com/en/1", None), (2, "http://example.com/en/71", None), (3, "http://x.net/de/1", None), (4, "http://www.example.net/de/88", None), (5, "http://org/es/", None), (6, "http://example.net/de/7", None)]
    out = judged(spark, rows)
    assert {k: (r.rule, r.verdict) for k, r in out.items()} == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"), 6: ("net/de/", "allow"),
    }
