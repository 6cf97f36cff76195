import io
import json
import shutil
import zipfile

from pyspark.sql import functions as F

from siltstone.sources import files, sinks
from siltstone.streaming import ingest


def docx(paragraphs, rows):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{"".join(map(p, paragraphs))}{table}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.TXT").write_text("line one\nline two", encoding="utf-8")
    (tmp_path / "a.docx").write_bytes(docx(["first", " ", "second"], [["h", "k"], ["1", "2"]]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.bin").write_bytes(b"x")
    found = files.walk(spark, str(tmp_path))
    assert {r.filename for r in found.collect()} == {"a.docx", "b.TXT", "c.docx"}
    texts = {r.filename: r.text for r in files.load(found).collect()}
    assert texts == {"a.docx": "first\nsecond\n[Table 1]\nh | k\n1 | 2", "b.TXT": "line one\nline two"}
    assert [r.doc_id for r in files.numbered(found).orderBy("path").collect()] == ["doc001", "doc002", "doc003"]
    html = "<html><script>x()</script><h2 class='a'>Head &amp; more</h2><p>Para<br>two</p><!-- no --></html>"
    assert spark.range(1).select(files.html_text(F.lit(html))).first()[0] == "## Head & more\nPara\ntwo"


def test_question_set_and_spool(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"dataset_info": {"n": 1}, "questions": [{"id": "doc001_q001", "question": "Q?", "source_document": "a.pdf"}]}, indent=1))
    row = files.question_set(spark, str(tmp_path / "q.json")).first()
    assert row.id == "doc001_q001" and row.answer is None
    lines = ['{"chunk_type": "child", "id": "1"}', "", "not json", '{"chunk_type": "parent", "id": "2"}', '{"__complete": true, "total_children": 1, "total_parents": 1}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    rows, broken = files.chunk_spool(spark, str(tmp_path / "s.jsonl"), "chunk_type string, id string")
    assert sorted(r.id for r in rows.collect()) == ["1", "2"] and [r.line for r in broken.collect()] == ["not json"]
    assert files.spool_complete(spark, str(tmp_path / "s.jsonl"))


def test_new_files(spark):
    f = spark.createDataFrame([(k,) for k in "abcd"], "file_hash string")
    new, half = files.new_files(f, f.where("file_hash IN ('a', 'b')"), f.where("file_hash IN ('a', 'c')"))
    assert {r[0] for r in new.collect()} == set("bcd") and {r[0] for r in half.collect()} == {"b", "c"}


def test_tables(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS temp_points")
    assert not sinks.ensure_collection(spark, "temp_points", 2)
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, dense array<double>")
    sinks.upsert(rows, "temp_points", "id")
    for _ in range(2):
        sinks.upsert(spark.createDataFrame([(2, [9.0, 9.0]), (3, [0.0, 1.0])], rows.schema), "temp_points", "id")
    assert {r.id: r.dense[0] for r in spark.table("temp_points").collect()} == {1: 1.0, 2: 9.0, 3: 0.0}
    assert sinks.ensure_collection(spark, "temp_points", 2)
    try:
        sinks.ensure_collection(spark, "temp_points", 3)
        raise AssertionError("dimension not checked")
    except Exception as e:
        assert "components" in str(e)
    assert "temp_points" in sinks.drop_by_prefix(spark) and spark.catalog.tableExists("temp_points")
    sinks.drop_by_prefix(spark, dry_run=False)
    assert not spark.catalog.tableExists("temp_points")
    bad = rows.withColumn("error", F.when(F.col("id") == 2, "lost"))
    assert sinks.with_dead_letters(bad, str(tmp_path / "good"), str(tmp_path / "bad")) == (1, 1)
    assert sinks.project(rows, ["id", "none"]).columns == ["id"]
    sinks.write_results(rows.select("id"), str(tmp_path / "r"), ["id"], "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def test_incremental_ingest(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    text = " ".join(f"Sentence {k} of the file is here." for k in range(100))
    (inbox / "a.txt").write_text(text)

    def run():
        q = ingest.ingest(spark, str(inbox), target, str(tmp_path / "cp"))
        q.awaitTermination(120)

    run()
    n = spark.read.parquet(f"{target}/children").count()
    (inbox / "copy.txt").write_text(text)
    (inbox / "b.txt").write_text(text.upper())
    run()
    rows = spark.read.parquet(f"{target}/children")
    assert n > 0 and rows.select("file_hash").distinct().count() == 2 and rows.count() >= 2 * n - 2


def test_event_windows_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path))
    q = ingest.event_windows(stream).writeStream.format("memory").queryName("windows_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows_out").collect())) == sorted(map(tuple, ingest.event_windows(events).collect()))


def test_functions_of_texts_get_bounded_batches(spark):
    """A worker's memory goes by a batch of bounded rows and bytes, not by the rows of a task."""
    from siltstone.functions.vectorised import BATCH
    from siltstone.operators import dedup

    before = {name: spark.conf.get(name) for name in BATCH}
    try:
        for name in BATCH:
            spark.conf.set(name, "10000000")
        dedup.shingle_sets("text")
        assert {name: int(spark.conf.get(name)) for name in BATCH} == BATCH
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        dedup.shingle_sets("text")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
