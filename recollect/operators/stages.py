"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where it is unset and the session runs on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="recollect-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/recollect-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table of the shared folder: numbers given by place stay what they are, and a lost executor costs a
    reread."""
    spark = rows.sparkSession
    path = new_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows of a task that sorts or gathers them by key.
TASK_ROWS = 1 << 18


def tasks_for(rows: DataFrame, most_rows: int | None = None) -> int:
    """Tasks for joins of rows by key, as many as keep each at about most_rows, so that one's memory does not grow with
    the table; the session's number at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (most_rows or TASK_ROWS)))
