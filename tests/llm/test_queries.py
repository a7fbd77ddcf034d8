"""The registered corpus queries on the smallest tables: those with SQL against it, the others to their end."""

import os

import duckdb
import pytest

from recollect.llm import queries
from tests.test_queries import SF, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    per_row = {"op2": "documents", "op4": "documents", "op5": "documents", "op7": "documents", "op10": "documents", "op13": "documents"}.get(name.split("_")[0])
    assert len(got) == duck.sql(f"select count(*) from {per_row}").fetchone()[0] if per_row else True
    assert os.path.isdir(SF)
