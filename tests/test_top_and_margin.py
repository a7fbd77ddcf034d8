"""e5_top_and_margin against its SQL where vectors are zero, null or alone."""

import duckdb
import pytest

from recollect.plans import registry, retrieval  # noqa: F401  registers the queries

ROWS = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [0.25, 0.875]), (20, [0.0, 0.0]), (40, None), (60, [0.25, 0.125]), (7, None)]


@pytest.mark.parametrize("rows", [ROWS, ROWS[3:5], ROWS[3:6], [ROWS[4], ROWS[6]], ROWS[:1], ROWS[4:5], ROWS[3:4]])
def test_every_query_has_a_row(spark, tmp_path, rows):
    table = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(table)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{table}/*.parquet'")
    want = {r[0]: repr(r[1:]) for r in con.execute(registry.ORACLE_SQL["e5_top_and_margin"]).fetchall()}
    got = {r["query_id"]: repr((r["top"], r["margin"])) for r in registry.QUERIES["e5_top_and_margin"](spark, str(tmp_path)).collect()}
    assert got == want
