import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from slatecast import catalog

ROOT = Path(__file__).resolve().parents[2]
TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in Path(TABLES).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got, want = catalog.QUERIES[name](spark, TABLES).toPandas(), con.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(table):
        plain = table[columns].astype(object)
        return sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))

    same = rows(got) == rows(want)
    assert same


def test_the_rest_works_without_the_optional_part(tmp_path):
    """With the training-data operators and the pipeline gone, the driver's contract holds and names the other queries."""
    for p in ROOT.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "slatecast", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "slatecast").mkdir()
    for p in (ROOT / "slatecast").iterdir():
        if p.name != "llm":
            (tmp_path / "slatecast" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and entry.oracle_sql().keys() <= entry.queries().keys()
