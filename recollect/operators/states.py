"""State that moves by decisions and attempts: guarded changes of memories, what needs a compact form, model health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The state that an action leads to.
TARGETS = {"archive": "archived", "restore": "active", "review": "review_due"}


def apply_decisions(current: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, outcome, revision, state) after the first decision on each id.

    current(id, revision, state), decisions(id, revision, action, at); the first by time, then by action and revision.
    unknown: no such memory (revision and state null). stale: it has moved on since the decision was made. unchanged: it is in
    that state already, so a replay does nothing. applied: a new revision in the new state.
    """
    first = decisions.groupBy("id").agg(F.min(F.struct("at", "action", "revision")).alias("d"))
    target = F.lit(None).cast("string")
    for action, state in TARGETS.items():
        target = F.when(F.col("d.action") == action, state).otherwise(target)
    rows = first.select("id", F.col("d.revision").alias("asked"), target.alias("target")).join(current, "id", "left")
    outcome = (
        F.when(F.col("state").isNull(), "unknown")
        .when(F.col("state") == F.col("target"), "unchanged")
        .when(F.col("target").isNull() | ~F.col("asked").eqNullSafe(F.col("revision")), "stale")
        .otherwise("applied")
    )
    rows = rows.withColumn("outcome", outcome)
    applied = F.col("outcome") == "applied"
    return rows.select("id", "outcome", F.when(applied, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(applied, F.col("target")).otherwise(F.col("state")).alias("state"))


def to_compact(memories: DataFrame, compacts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Ids of active memories(id, revision, state) with neither a compact form of their revision in compacts(id, revision,
    valid) nor a summary in summaries(id)."""
    good = compacts.where("valid").select("id", "revision")
    return memories.where("state = 'active'").join(good, ["id", "revision"], "left_anti").join(summaries, "id", "left_anti").select("id")


# The failures that make a model unavailable at once.
IMMEDIATE = ("authentication", "invalid_model", "invalid_configuration")


def model_health(attempts: DataFrame, immediate: tuple[str, ...] = IMMEDIATE, degraded_after: int = 3, degraded_span: float = 120.0, down_span: float = 1800.0, schema_limit: int = 5) -> DataFrame:
    """(model, at, ok, category, state, piece, since): the health of a model after each of its attempts(model, at, ok,
    category).

    unavailable: a failure of an immediate category, schema_limit failures schema_invalid in a row, or failures that span
    down_span seconds. degraded: degraded_after failures that span degraded_span. A success while healthy forgets the
    failures; otherwise the second success since a failure recovers. Attempts at one time go failures first, then by
    category; since is the first failure that is remembered. Two successes in a row leave every model healthy with nothing
    to remember, so its attempts are cut there and the pieces go to different tasks; a task reads them in order and keeps
    a few numbers. A piece ends with the recovery, so it holds one incident at most.
    """
    w = Window.partitionBy("model").orderBy("at", "ok", "category")
    ends = F.coalesce(F.lag("ok", 1).over(w) & F.lag("ok", 2).over(w), F.lit(False)).cast("long")
    rows = attempts.select("model", F.col("at").cast("timestamp").alias("at"), "ok", "category", ends.alias("ends"))
    rows = rows.withColumn("piece", F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("ends")
    rows = rows.withColumn("micros", F.unix_micros("at")).repartition("model", "piece").sortWithinPartitions("model", "piece", "at", "ok", "category")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, failures, broken, since, probed = None, "healthy", 0, 0, None, False
        for batch in batches:
            states, first = [], []
            for model, piece, ok, category, now in zip(batch["model"], batch["piece"], batch["ok"], batch["category"], batch["micros"], strict=True):
                if (model, piece) != key:
                    key, state, failures, broken, since, probed = (model, piece), "healthy", 0, 0, None, False
                if not ok:
                    failures, probed = failures + 1, False
                    broken = broken + 1 if category == "schema_invalid" else 0
                    since = now if since is None else since
                    if category in immediate or broken >= schema_limit or now - since >= down_span * 1e6:
                        state = "unavailable"
                    elif failures >= degraded_after and now - since >= degraded_span * 1e6:
                        state = "degraded"
                elif state == "healthy" or probed:
                    state, failures, broken, since, probed = "healthy", 0, 0, None, False
                else:
                    probed = True
                states.append(state)
                first.append(since)
            yield batch[["model", "at", "ok", "category"]].assign(state=states, piece=batch["piece"], since=pd.array(first, dtype="Int64"))

    kept = rows.select("model", "at", "ok", "category").schema
    out = rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", state string, piece long, since long")
    return out.withColumn("since", F.timestamp_micros("since"))


def model_incidents(health: DataFrame) -> DataFrame:
    """(model, started_at, last_failure_at, ended_at, state, reason, transitions) of health as model_health gives it: from
    the first failure that led out of health to the recovery.

    state is the last that was reached, or recovered; reason the last failure's category; transitions how often the state
    changed after the first; ended_at null while it lasts."""
    w = Window.partitionBy("model", "piece").orderBy("at", "ok", "category")
    rows = health.withColumn("before", F.lag("state", 1, "healthy").over(w))
    ill, failed = F.col("state") != "healthy", ~F.col("ok")
    # the recovery is the only row of a piece that is healthy after one that is not
    back = (F.col("state") == "healthy") & (F.col("before") != "healthy")
    at = F.struct("at", "ok", "category")
    found = rows.groupBy("model", "piece").agg(
        F.min(F.when(ill, F.col("since"))).alias("started_at"),
        F.max(F.when(ill & failed, F.col("at"))).alias("last_failure_at"),
        F.max(F.when(back, F.col("at"))).alias("ended_at"),
        F.max_by("state", F.when(ill, at)).alias("last"),
        F.max_by("category", F.when(ill & failed, at)).alias("reason"),
        F.count_if(ill & (F.col("before") != "healthy") & (F.col("before") != F.col("state"))).alias("transitions"),
    )
    return found.where("started_at is not null").select("model", "started_at", "last_failure_at", "ended_at", F.when(F.col("ended_at").isNotNull(), "recovered").otherwise(F.col("last")).alias("state"), "reason", "transitions")
