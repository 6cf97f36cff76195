"""The queries that SQL can express equal DuckDB; all of them give their contract's columns for every row."""

import duckdb
import pytest

from siltstone.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_ann": "query_id rank vec_id score",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op8_quality_classifier": "doc_id held_out score predicted",
    "op9_secret_scan": "doc_id start length kind score is_secret",
    "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    rows = queries.queries()[name](spark, DATA)
    assert rows.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    one = {"doc_id": "documents", "page_id": "pages"}.get(rows.columns[0])
    if one and name not in ("op9_secret_scan", "op10_packing"):
        assert rows.count() == spark.read.parquet(f"{DATA}/{one}.parquet").count()
    else:
        # no document of the smallest tables holds a secret
        assert (rows.count() > 0) == (name != "op9_secret_scan")
