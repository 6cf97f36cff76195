import numpy as np
import pytest

from siltstone.llm import line_dedup, near_dedup, packing, quality_classifier, secret_scan

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_each_stage_decides_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, after = docs.columns, [docs]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, after[-1], DATA)
        assert out.columns == columns, name
        after.append(spark.createDataFrame(out.toPandas(), docs.schema))
    first, good, lined, single, masked = after
    rules = quality_classifier.fit(first, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in quality_classifier.score(first, rules).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == want and 0 < len(want) < first.count()
    assert {(r.doc_id, r.text) for r in lined.collect()} == {(r.doc_id, r.text) for r in line_dedup.drop_repeated(good).collect()}
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in near_dedup.find(lined).where("kept").collect()}
    assert masked.count() == single.count()
    assert secret_scan.scan(masked, secret_scan.train(words=secret_scan.corpus_words(single))).where("is_secret").count() == 0
    pieces = pipeline.STAGES[-1][1](spark, masked, DATA).collect()
    encoder = packing.Encoder.read(pipeline.VOCABULARY)
    texts = [r.text or "" for r in masked.collect()]
    assert sum(r.length for r in pieces) == sum(len(x) // 4 + 1 for x in encoder.encode(texts))


def test_run_equals_its_stages(spark):
    rows = pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    used = {}
    for r in rows.collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= packing.TOKENS and np.mean([n == packing.TOKENS for n in used.values()]) > 0.8
