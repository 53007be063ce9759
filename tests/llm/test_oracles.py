"""The registered corpus queries against their DuckDB statements."""

import os

import duckdb
import pytest

from routeloom.llm.oracles import ORACLES
from routeloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found, result = QUERIES[name](spark, SMALL), db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in found.collect()))) == sorted(map(str, result.fetchall()))
