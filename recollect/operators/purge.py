"""Purge runs: a capped walk over what is due, carried out in steps that can be taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshots import exclusive


def capped_walk(due: DataFrame, order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """The rows of due that a walk in the order takes, with `ordinal` from 0: each that still fits under most_size in all, at
    most most_rows; the walk skips what does not fit and goes on. The order's columns are not null and tell rows apart; a
    null size is 0.

    A round asks for the first rows after the last one seen that fit into what is left, as many as may still be taken, and
    walks over those. Every round but the last takes one at least, so there are most_rows rounds at most and usually
    two or three, each a sort that keeps a bounded number of rows; only those come to the driver."""
    spark, taken, left, seen = due.sparkSession, [], most_size, None
    rows = due.withColumn("size_", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    while len(taken) < most_rows:
        after = rows.where(F.col("size_") <= left)
        if seen is not None:
            after = after.where(F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType) for c, v in zip(order, seen, strict=True)]))
        found = after.orderBy(*order).limit(most_rows - len(taken)).collect()
        for row in found:
            if row["size_"] <= left:
                left -= row["size_"]
                taken.append(row)
        if not found:
            break
        seen = [found[-1][c] for c in order]
    schema = T.StructType([*due.schema.fields, T.StructField("ordinal", T.LongType())])
    return spark.createDataFrame([(*[r[c] for c in due.columns], k) for k, r in enumerate(taken)], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def mark(spark: SparkSession, root: str, step: int) -> None:
    """The checkpoint: a step is done once its mark is there."""
    exclusive(spark, f"{root}/done/{step}")


def run(selected: Callable[[], DataFrame], root: str, spark: SparkSession, recheck: Callable[[DataFrame], DataFrame], step: int = 16, most_steps: int | None = None) -> DataFrame:
    """Carry out the plan that lies at root, or that `selected` makes if there is none, and return what recheck says of all
    rows whose step is done: at most most_steps steps of `step` rows in this call.

    The plan is written once, so that a run that is taken up again goes on with the rows it chose. A step's rows are
    written to a place of the step's own and then marked done: a crash before the mark has the step done again in the
    same place, and never twice. recheck(rows of the plan) decides by what is true now."""
    if not _exists(spark, f"{root}/plan/_SUCCESS"):
        selected().write.mode("overwrite").parquet(f"{root}/plan")
    plan = spark.read.parquet(f"{root}/plan")
    steps = -(-plan.count() // step)
    first = next((k for k in range(steps) if not _exists(spark, f"{root}/done/{k}")), steps)
    last = steps if most_steps is None else min(steps, first + most_steps)
    for k in range(first, last):
        recheck(plan.where((F.col("ordinal") >= k * step) & (F.col("ordinal") < (k + 1) * step))).write.mode("overwrite").parquet(f"{root}/outcomes/step={k}")
        mark(spark, root, k)
    if not last:
        return recheck(plan.limit(0))
    return spark.read.option("basePath", f"{root}/outcomes").parquet(*[f"{root}/outcomes/step={k}" for k in range(last)]).drop("step")
