import random

import pytest

from siltstone.llm import line_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=2):
    held = {}
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UP)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < least or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 3])
def test_equals_brute_force(make_docs, least):
    rng = random.Random(7)
    pool = [f"Line number {k} of the pool É" for k in range(12)] + ["short", "", "  padded line here  ", "PADDED line HERE"]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {k} {j} words words" for j in range(rng.randrange(0, 9)))) for k in range(80)]
    rows += [(None, "Line number 1 of the pool É\nx"), (200, None), (201, ""), (202, "tail line of text\n"), (203, "tail line of text\n\n")]
    got = line_dedup.drop_repeated(make_docs(rows), min_docs=least).collect()
    assert sorted([(r.doc_id, r._n_lines, r._n_dropped, r.text) for r in got], key=str) == brute(rows, least)
    assert all(r.n_chars == len(r.text) for r in got)


def test_repeated_rows_empty_table_and_clashing_columns(spark, empty_docs):
    docs = spark.createDataFrame([(1, "the very same line", 5), (1, "the very same line", 5), (2, "the very same line", 6)], "doc_id long, text string, _n_line long").selectExpr("*", "7 AS `_x.y`")
    out = line_dedup.drop_repeated(docs)
    assert sorted((r.doc_id, r._n_dropped) for r in out.collect()) == [(1, 0), (1, 0), (2, 1)]
    assert line_dedup.drop_repeated(empty_docs).count() == 0
