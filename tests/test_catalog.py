"""Every query with SQL equals DuckDB on the small tables."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from siltstone.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    of = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([tuple(of(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_loads_without_the_removable_folders(tmp_path, pipeline):
    top = Path(__file__).parents[1]
    shutil.copytree(top / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and (top / "corpus_pipeline.py").exists())]:
        shutil.copy(top / name, tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
