"""Scores, schedules and selections over the life of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import RetryPolicy, WorkingSetPolicy


def retry_seconds(work_id: Column, attempt: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """The delay of an attempt with a jitter of 0.9 to 1.0 fixed by the work and attempt, rounded."""
    base = F.element_at(F.array(*map(F.lit, policy.delays)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(policy.delays))).cast("int"))
    byte = F.conv(F.substring(F.sha2(F.concat_ws(":", work_id.cast("string"), attempt.cast("string")), 256), 1, 2), 16, 10).cast("int")
    return F.round(base * (0.9 + byte / 2550)).cast("long")


def backoff_minutes(failures: Column) -> Column:
    return F.least(F.lit(360), F.lit(5) * F.pow(F.lit(2), F.least(failures - 1, F.lit(7)))).cast("long")


def soft_score(tier: Column, high_value: Column, evidence: Column, relations: Column, tags: Column) -> Column:
    """100 a tier, 20 for high value, then evidence, relations and tags with a cap of five each."""
    return (tier * 100 + high_value.cast("int") * 20 + F.least(evidence, F.lit(5)) * 3 + F.least(relations, F.lit(5)) * 2 + F.least(tags, F.lit(5))).cast("long")


def capacity_state(active: Column, target: int, hard: int) -> Column:
    return F.when(active >= hard, "hard_limited").when(active > target, "pressured").otherwise("available")


def working_set(features: DataFrame, observed_at: Column, policy: WorkingSetPolicy = WorkingSetPolicy()) -> DataFrame:
    """features(id, space, last_activity, protected, soft_score) with mandatory and ranked.

    A space at or under its target keeps all. Above it, protected and recently active rows are mandatory, and the rest
    fill up to the low water by activity, soft score and id; more than that only if the mandatory ones are more."""
    space = Window.partitionBy("space")
    rows = features.withColumn("mandatory", F.col("protected") | (F.coalesce(F.col("last_activity"), F.lit("1970-01-01").cast("timestamp")) >= observed_at - F.expr(f"interval {policy.cold_days} days")))
    rows = rows.withColumn("n", F.count("*").over(space)).withColumn("m", F.sum(F.col("mandatory").cast("int")).over(space))
    order = space.orderBy(F.desc("mandatory"), F.desc_nulls_last("last_activity"), F.desc("soft_score"), "id")
    ranked = (F.col("n") <= policy.target) | (F.row_number().over(order) <= F.greatest(F.lit(policy.low_water), F.col("m")))
    return rows.withColumn("ranked", ranked).drop("n", "m")


def exclusion_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, space, outcome, before): what two sets of exclusions(id, space) say of each id: excluded now, restored, or kept
    out."""
    sides = before.select("id", "space", F.lit(1).alias("side")).unionByName(after.select("id", "space", F.lit(2).alias("side")))
    sides = sides.groupBy("id").agg(F.max("space").alias("space"), F.sum("side").alias("side"))
    outcome = F.when(F.col("side") == 1, "restored").when(F.col("side") == 2, "excluded").otherwise("kept out")
    return sides.select("id", "space", outcome.alias("outcome"), (F.col("side") != 2).alias("before"))


def receipt_rollup(receipts: DataFrame, items: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, summary): receipts newer than the cut, and the older ones summed by day and kind.

    receipts(receipt_id, kind, created_at, tokens), items(receipt_id, outcome)."""
    cut = as_of - F.expr(f"interval {24 * days} hours")
    old = receipts.where(F.col("created_at") <= cut)
    counts = items.groupBy("receipt_id").agg(F.count_if(F.col("outcome") == "selected").alias("selected"), F.count_if(F.col("outcome") == "omitted").alias("omitted"))
    summary = (
        old.join(counts, "receipt_id", "left")
        .groupBy(F.to_date("created_at").alias("summary_date"), "kind")
        .agg(F.count("*").alias("receipts"), F.round(F.sum("tokens"), 2).alias("tokens"), F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"), F.coalesce(F.sum("omitted"), F.lit(0)).alias("omitted"))
    )
    return receipts.where(F.col("created_at") > cut), summary
