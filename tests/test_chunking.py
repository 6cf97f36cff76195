import random

from pyspark.sql import functions as F

from siltstone.operators import chunking as C


def test_sections_levels_pages_and_hierarchy():
    text = "before\n\n[Page 2 | type=text]\n# Top\nalpha\n1. Introduction\nbeta\n2.1 Details Here\ngamma\n[Table 1]\na | b\n----\n1 | 2\nSUMMARY NOTES\nend"
    out = C.split_sections(text)
    assert [(s.title, s.level, s.page_number, s.kind) for s in out] == [("Introduction", 0, None, "text"), ("Top", 1, 2, "text"), ("1. Introduction", 2, 2, "text"), ("2.1 Details Here", 2, 2, "text"), ("[Table 1]", 4, 2, "table"), ("SUMMARY NOTES", 1, 2, "text")]
    assert out[4].hierarchy == ["Introduction", "Top", "2.1 Details Here", "[Table 1]"]
    assert C.split_sections("  \n")[0].title == "Document"
    assert C.split_sections("3.1.2 Deep Title\nx", "Document", numbered=True)[0].level == 3


def test_packing_covers_and_overlaps():
    rng = random.Random(1)
    sentences = [f"Sentence number {k} has {'x' * rng.randrange(1, 60)} in it." for k in range(80)]
    out = C.pack_sentences(sentences, 300, 80, topics=False)
    joined = " ".join(sentences)
    assert all(p.text in joined and len(p.text) <= 300 + 90 for p in out)
    assert all(any(s in p.text for p in out) for s in sentences)
    assert any(a.text.split(". ")[-1] in b.text for a, b in zip(out, out[1:], strict=False))


def test_topic_change_splits_without_overlap():
    cats = [f"The cat purrs and the kitten sleeps near whiskers number {k}." for k in range(12)]
    stars = [f"Galaxies contain stars whose nuclear fusion emits photons {k}." for k in range(12)]
    assert len(C.topic_starts(cats)) == 1
    assert C.topic_starts(cats[:8]) == {0}
    assert C.topic_starts(cats + stars) >= {0}


def test_long_sentence_and_table_rows():
    assert C.split_long("aa bb cc dd", 5) == ["aa bb", "cc dd"] and C.split_long("a" * 9 + " b", 5) == ["a" * 9, "b"]
    rows = ["h1 | h2", "-------"] + [f"row {k} | value" for k in range(20)]
    out = C.table_rows("\n".join(rows), "Table 1", 100)
    assert len(out) > 1 and all(p.text.startswith("[Table 1]\nh1 | h2\n-------\nrow") for p in out)
    assert [r for p in out for r in p.text.split("\n")[3:]] == rows[2:]
    assert len(C.table_rows("h\nr", "", 100)) == 1 and C.table_rows(" \n", "t", 9) == []


def test_pages_are_kept_whole_and_carry_the_end():
    text = "".join(f"[Page {k} | type=text]\n" + "word word. " * 30 for k in range(1, 8))
    out = C.page_aware(text, size=800)
    assert [p for _, ps in out for p in ps][0] == 1 and len(out) > 2 and {p for _, ps in out for p in ps} == set(range(1, 8))


def test_parents_children_and_context(spark):
    body = "\n".join(["# One", " ".join(f"Alpha sentence {k} is here." for k in range(200)), "# Two", " ".join(f"Beta sentence {k} is there." for k in range(60))])
    docs = spark.createDataFrame([(1, body), (2, None), (3, "short")], "doc_id long, text string")
    up = C.parents(docs, "doc_id")
    down = C.children(up, "doc_id")
    assert up.select("parent_id").distinct().count() == up.count() and down.join(up, "parent_id", "left_anti").count() == 0
    rich = C.enrich(down, "doc_id", F.lit("f.txt")).orderBy("parent_index", "child_index").collect()
    assert rich[0].enriched_text.startswith("Document: f.txt\nSection: Introduction > One\nContext: ...")
    assert all(r.text in r.enriched_text for r in rich)


def test_page_blocks_and_windows(spark):
    df = spark.createDataFrame([("x\n[Page 1 | type=text]\nhello\n[Page 2 | type=toc]\nworld",)], "t string")
    assert [tuple(b) for b in df.select(C.page_blocks(F.col("t"))).first()[0]] == [(1, "text", "hello"), (2, "toc", "world")]
    one = spark.createDataFrame([("a" * 1000,), (" short ",), ("",)], "t string").select(C.fixed_windows(F.col("t"))).collect()
    assert [len(x) for x in one[0][0]] == [400, 320 + 80, 320] and one[1][0] == ["short"] and one[2][0] == []


def test_digits_that_are_no_page_number():
    """A text without marks may begin with digits, and marks may hold more of them than a page number has."""
    assert C.page_aware("4754543480058766 is a number. End.") == [("4754543480058766 is a number. End.", [])]
    assert C.page_aware("[Page 2] a\n[Page 4754543480058766] b") == [("[Page 2] a\n[Page 4754543480058766] b", [2])]
    assert [s.page_number for s in C.split_sections("[Page 4754543480058766 | type=text]\n# A\nb")] == [None]
