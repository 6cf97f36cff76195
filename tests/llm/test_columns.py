"""Extra columns, whatever their names, change nothing and, where rows pass through, come out unchanged."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, bpe, line_dedup, near_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, url_filter
from tests.llm.conftest import prose

NAMES = (
    "_id _doc _gone _hits _stats _lines _sum _mark _row _quality _trusted _word _bits _s _salt _suffix _rules _first _n_words _spans row id doc mark sum gone lines hits stats one "
    "node root n v a b comp live rest key1 key2 salt block rank vec bucket weight word count n_words ids start kind path score host url2 ruling x.y"
).split()
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(31)
    passage = prose(rng, 30)
    rows = [(k, f"{prose(rng, 60)}\n{passage if k % 3 else ''}\nthe very same line here {k % 5}\ntoken = \"4d44c79e8bf7c55759c4958dd60ed83d2ef8cd{k:02d}\"") for k in range(24)]
    return rows + [(100 + k, rows[k][1]) for k in range(3)] + [(200, None), (201, "")]


def with_extra(df):
    """The table with a column of each name that it lacks: the name's place as text, with the row's first column."""
    first = df.columns[0]
    return df.select("*", *[F.concat_ws(":", F.lit(k), F.col(first).cast("string")).alias(n) for k, n in enumerate(NAMES) if n not in df.columns])


@pytest.fixture(scope="module")
def plain(make_docs):
    return make_docs(texts())


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(24)], "doc_id long, quality int")


PASSING = {
    "line_dedup": lambda d, labels: line_dedup.drop_repeated(d, counts=False),
    "near_dedup": lambda d, labels: near_dedup.keep_one(d),
    "substring_dedup": lambda d, labels: substring_dedup.drop_passages(d, measures=False),
    "quality_classifier": lambda d, labels: quality_classifier.keep_good(d, quality_classifier.Rules(3.0)),
    "secret_scan": lambda d, labels: secret_scan.redact(d.drop("path"), DETECTOR),
}
DETECTOR = secret_scan.train(secret_scan.labelled_findings(600))


@pytest.mark.parametrize("name", PASSING)
def test_rows_pass_through(plain, labels, name):
    docs = with_extra(plain)
    docs = docs.drop("path") if name == "secret_scan" else docs
    out = PASSING[name](docs, labels)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    before = {tuple(r[c] for c in own) for r in docs.collect()}
    rows = out.collect()
    assert rows and {tuple(r[c] for c in own) for r in rows} <= before
    want = {(r.doc_id, r.text) for r in PASSING[name](plain, labels).collect()}
    assert {(r.doc_id, r.text) for r in rows} == want


def _measured(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)


MEASURING = {
    "near_dedup": lambda d, labels: _measured(near_dedup.find(d), "doc_id", "n_shingles", "component_id", "kept"),
    "quality_rules": lambda d, labels: _measured(quality_rules.judge(d, labels.where("quality = 1").select("doc_id")), "doc_id", "n_words", "kept", "llr_score"),
    "bpe": lambda d, labels: _measured(bpe.encode_decode(d, WORDS, 100), "doc_id", "ids", "decoded"),
    "substring_dedup": lambda d, labels: _measured(substring_dedup.drop_passages(d), "doc_id", "_n_words", "_n_removed", "_spans"),
    "line_dedup": lambda d, labels: _measured(line_dedup.drop_repeated(d), "doc_id", "_n_lines", "_n_dropped", "text"),
    "quality_classifier": lambda d, labels: _measured(quality_classifier.score(d, quality_classifier.fit(d, labels)), "doc_id", "held_out", "score", "predicted"),
    "secret_scan": lambda d, labels: _measured(secret_scan.scan(d.drop("path"), DETECTOR), "doc_id", "start", "length", "kind", "score"),
    "packing": lambda d, labels: _measured(packing.pack(d, BYTES), "doc_id", "start", "length", "sequence_id", "offset"),
}


@pytest.mark.parametrize("name", MEASURING)
def test_results_do_not_depend_on_other_columns(plain, labels, name):
    assert MEASURING[name](with_extra(plain), with_extra(labels)) == MEASURING[name](plain, labels)


def test_pages_and_vectors(spark):
    rng = random.Random(3)
    pages = spark.createDataFrame([(k, f"https://h{k % 4}.example.com/en/{k}", "<a href='https://b.org/'>x</a>") for k in range(20)] + [(90, None, None)], "page_id long, url string, html string")
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert _measured(url_filter.judge(with_extra(pages)), *columns) == _measured(url_filter.judge(pages), *columns)
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(60)], "vec_id long, embedding array<double>")
    columns = ("query_id", "rank", "vec_id", "score")
    assert _measured(ann.search(with_extra(vectors), F.col("vec_id") % 20 == 0, 5), *columns) == _measured(ann.search(vectors, F.col("vec_id") % 20 == 0, 5), *columns)


STAGES = pytest.importorskip("corpus_pipeline").STAGES


@pytest.mark.parametrize(("name", "stage"), STAGES)
def test_stages(spark, plain, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = with_extra(plain).drop("path")
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name != STAGES[-1][0]:
        assert out.columns == docs.columns
        got = {(r.doc_id, r._id, r._gone, r["x.y"], r.text) for r in rows}
        assert {g[:4] for g in got} <= {(r.doc_id, r._id, r._gone, r["x.y"]) for r in docs.collect()}
        assert {(g[0], g[4]) for g in got} == {(r.doc_id, r.text) for r in stage(spark, plain, str(tmp_path)).collect()}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
