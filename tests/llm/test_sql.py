import os
from pathlib import Path

import pytest

from slatecast.llm import queries

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_merkle", "op13_minhash"])
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in Path(TABLES).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    made = queries.QUERIES[name](spark, TABLES)
    found = con.sql(queries.ORACLES[name])
    columns = sorted(made.columns)
    assert sorted(found.columns) == columns
    want = sorted(repr(dict(sorted(zip(found.columns, row, strict=True)))) for row in found.fetchall())
    assert sorted(repr(dict(sorted(row.asDict().items()))) for row in made.collect()) == want
