"""Halves go to the even neighbour, as in SQL's cast of a double to a whole number."""

import datetime as dt

import pandas as pd

from recollect.plans import registry, runs  # noqa: F401


def test_purge_run_rounds_halves_to_even(spark, tmp_path):
    day = dt.datetime(1995, 1, 1)
    orders = pd.DataFrame([(k, 1, "O", price, day, "1") for k, price in ((1, 2992.5), (2, 2993.5), (3, 10.4), (4, 10.6))], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    spark.createDataFrame(orders).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(99, 1.0)], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(99, "click")], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["k20_purge_run"](spark, str(tmp_path)).toPandas().set_index("id")["bytes"]
    assert got.to_dict() == {1: 2992, 2: 2994, 3: 10, 4: 11}


def test_batches_round_halves_to_even(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, k), 3, "click", 1250.0125 if k == 1 else 1250.0) for k in (1, 4)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    # 50,000.5 is 50,000 bytes, so both fit into 100,000
    got = registry.QUERIES["j4_batches"](spark, str(tmp_path)).toPandas()
    assert sorted(zip(got["event_id"], got["batch"], strict=True)) == [(1, 0), (4, 0)]
