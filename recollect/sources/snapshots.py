"""Versioned Parquet snapshots behind a numbered pointer: stage, check, then flip, on condition that nobody else did."""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after which a number that was claimed and never pointed to counts as given up.
LEASE = 900.0


class Conflict(Exception):
    """Somebody else has published since the token was read, or is publishing now."""


def publish(rows: DataFrame, root: str, revision: str, expected: int | None = None) -> int:
    """Write rows as a revision, count what was written, and point to it last; returns the count.

    With expected, the token that was read with what the rows were made of, the pointer moves only if the token is still
    the newest; otherwise Conflict is raised and nothing is pointed to. Without it the newest token is taken as it is."""
    spark = rows.sparkSession
    if expected is not None and token(spark, root) != expected:
        raise Conflict(f"{root} has moved on from {expected}")
    rows.write.mode("errorifexists").parquet(f"{root}/rev={revision}")
    n = spark.read.parquet(f"{root}/rev={revision}").count()
    number = _claim(spark, root, expected)
    spark.createDataFrame([(revision, n, number)], "revision string, rows long, at long").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return n


def token(spark: SparkSession, root: str) -> int:
    """The number of the newest pointer, 0 before the first."""
    return _pointers(spark, root).agg(F.max("at")).first()[0] or 0


def exclusive(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. Of several that try, one succeeds: by the local file system's own
    means where it is one, else by a create that does not overwrite."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        try:
            os.close(os.open(where.path, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False).close()
    except Exception as e:  # a Java exception, told apart by its class
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _age(spark: SparkSession, path: str) -> float:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return time.time() - at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime() / 1000


def _claim(spark: SparkSession, root: str, expected: int | None) -> int:
    """A number for the next pointer that nobody else has: the one after the newest, or after what was given up. A claim
    made meanwhile is somebody else's."""
    while True:
        newest = token(spark, root)
        if expected is not None and newest != expected:
            raise Conflict(f"{root} has moved on from {expected} to {newest}")
        number = newest + 1
        while not exclusive(spark, f"{root}/claims/{number}"):
            if _age(spark, f"{root}/claims/{number}") < LEASE:
                if expected is not None:
                    raise Conflict(f"{root}: another writer is about to publish {number}")
                time.sleep(0.2)
                break
            number += 1
        else:
            return number


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointers ever written; none before the first. A pointer is one file that a commit puts in place whole, and
    nothing is deleted, so a reader finds the old or the new one and a crash leaves the old."""
    from pyspark.errors import AnalysisException

    schema = "revision string, rows long, at long"
    try:
        return spark.read.schema(schema).parquet(f"{root}/pointer")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def pinned(spark: SparkSession, root: str) -> DataFrame:
    """The revision that the newest pointer names, checked against its count."""
    at = _pointers(spark, root).orderBy(F.desc("at")).first()
    rows = spark.read.parquet(f"{root}/rev={at['revision']}")
    if rows.count() != at["rows"]:
        raise ValueError(f"revision {at['revision']} is incomplete")
    return rows


def replace_if_changed(rows: DataFrame, root: str, expected: int) -> bool:
    """Publish rows in place of the pinned revision if they differ from it as a set; whether they did. expected is the
    token that was read with what rows were made of: if the pointer has moved since, Conflict, changed or not."""
    spark = rows.sparkSession
    if token(spark, root) != expected:
        raise Conflict(f"{root} has moved on from {expected}")
    if expected:
        held = pinned(spark, root)
        marked = rows.distinct().withColumn("side_", F.lit(1)).unionByName(held.distinct().withColumn("side_", F.lit(2)))
        if marked.groupBy(*rows.columns).agg(F.sum("side_").alias("sides_")).where("sides_ < 3").isEmpty():
            return False
    publish(rows, root, uuid.uuid4().hex, expected)
    return True


def retired(revisions: DataFrame, pointer: DataFrame, keep: int) -> DataFrame:
    """revisions(revision, built_at) that the newest pointer does not name, beyond the newest `keep`, oldest first."""
    from pyspark.sql import Window

    loose = revisions.join(pointer.select(F.max_by("revision", "at").alias("revision")), "revision", "left_anti")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("built_at"), "revision")
    return loose.withColumn("n", F.row_number().over(w)).where(F.col("n") > keep).drop("n")
