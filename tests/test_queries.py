"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from recollect.plans import candidates, capacity, files, graphs, lifecycle, packs, prompts, registry, relations, reports, retrieval, rules, runs, states  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if not isinstance(v, list) and pd.isna(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    """What SQL does not express runs to its end all the same; brute force is beside its operator's tests."""
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) and len(got.columns)
