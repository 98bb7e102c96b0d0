"""Every query with an oracle gives the oracle's rows."""

import os

import duckdb
import pytest

from meterglass.plans import catalog

DATA = os.environ.get("METERGLASS_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert got
    if name in catalog.ORACLE_SQL:
        out = tables.execute(catalog.ORACLE_SQL[name])
        at = [[c[0] for c in out.description].index(c) for c in columns]
        assert got == sorted(str(tuple(r[i] for i in at)) for r in out.fetchall())


def test_entry_works_without_the_corpus_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "meterglass", tmp_path / "meterglass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.stdout.split() == [str(len(catalog.QUERIES)), "False"], said.stderr
