"""Float records: round trip, pushed ordinals, commits and what they refuse; reports."""

import os

import numpy as np
import pytest

from recollect.sources import reports, vectors


def rows(n, width=3):
    return [(i, None if i % 11 == 5 else [float(i), i / 7, -1.5][:width]) for i in range(n)]


def test_round_trip_and_pushed_ordinals(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors.write_vectors(spark.createDataFrame(rows(500), "ordinal int, vector array<double>").repartition(5), path, 3)
    got = {r["ordinal"]: r["vector"] for r in vectors.read_vectors(spark, path, 3, 64).collect()}
    assert got == {i: None if v is None else [float(np.float32(x)) for x in v] for i, v in rows(500)}
    some = vectors.read_vectors(spark, path, 3, 64).where("ordinal >= 130 AND ordinal < 140")
    assert sorted(r["ordinal"] for r in some.collect()) == list(range(130, 140)) and some.rdd.getNumPartitions() < 3
    assert vectors.read_vectors(spark, path, 3).where("ordinal = 77").count() == 1
    assert vectors.read_vectors(spark, path, 3).where("ordinal > 900").count() == 0


def test_a_write_that_fails_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors.write_vectors(spark.createDataFrame(rows(20), "ordinal int, vector array<double>"), path, 3)
    for bad in ([(0, [1.0]), (1, [1.0, 2.0, 3.0])], [(0, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], [(0, [1.0, 2.0, 3.0])] * 2):
        with pytest.raises(Exception, match="wide|gap|turn"):
            vectors.write_vectors(spark.createDataFrame(bad, "ordinal int, vector array<double>"), path, 3)
    assert vectors.read_vectors(spark, path, 3).count() == 20
    vectors.write_vectors(spark.createDataFrame(rows(7), "ordinal int, vector array<double>"), path, 3)
    assert vectors.read_vectors(spark, path, 3).count() == 7
    vectors.write_vectors(spark.createDataFrame([], "ordinal int, vector array<double>"), path, 3)
    assert vectors.read_vectors(spark, path, 3).count() == 0


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([("b", 1, 5, "two\nlines | bar"), ("b", 2, 9, None), ("b", 3, 9, "x"), (None, 4, 1, "y"), ("a", 5, 1, "z")], "kind string, id int, at int, text string")
    lines = [r["line"] for r in reports.inbox(items, "Inbox", 2).orderBy("n").collect()]
    assert lines == ["# Inbox", "## a (1)", "- 5: z", "## b (3)", "- 2: ", "- 3: x", "## other (1)", "- 4: y"]
    path = str(tmp_path / "report")
    for _ in range(2):
        reports.write(reports.inbox(items, "Inbox", 2), path)
    (file,) = [f for f in os.listdir(path) if f.startswith("part-")]
    with open(f"{path}/{file}", encoding="utf-8") as f:
        assert f.read().splitlines() == lines
    assert [r["line"] for r in reports.inbox(items.limit(0), "Inbox").collect()] == ["# Inbox"]
