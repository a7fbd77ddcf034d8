"""Excerpts of texts in which letters beyond ASCII touch names and white space is not the usual, against the SQL."""

import duckdb

from recollect.plans import packs, registry  # noqa: F401

TEXT = "ÜTCPx is a ÉAB B\n\nnext of ÜHTTPs and plan of it " + "w" * 300 + "\n\nshort only \u0085\n\n" + "x" * 500 + "\n\x0b\nTail unleſs"


def test_excerpt_is_that_of_the_sql(spark, tmp_path):
    rows = [(1, 1, "assistant", TEXT), (1, 2, "user", "we recommend propos next"), (1, 3, "assistant", "a" * 1300), (1, 4, "user", "tail")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["g26_conversation_excerpt"]).fetchall()
    got = registry.QUERIES["g26_conversation_excerpt"](spark, str(tmp_path)).select("prompt_id", "position", "message", "text", "tokens").collect()
    assert sorted(map(tuple, got)) == sorted(want)
