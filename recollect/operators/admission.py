"""Which extracted statements are admitted, where they go, how they are merged, and what is archived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import ArchivePolicy, RecoveryPolicy


def admission(decision: Column, task_observation: Column) -> Column:
    """struct(outcome, reason) of a retention decision."""
    held = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"))
    return (
        F.when(decision.isin("no_memory", "session_only"), held("rejected", decision))
        .when(decision == "uncertain", held("isolated", decision))
        .when(task_observation, held("rejected", F.lit("task_observation")))
        .otherwise(held("admitted", decision))
    )


def paged(rows: DataFrame, keys: list[str], order: list[str], size: int = 64) -> DataFrame:
    """rows with `page`, counted from 0, of `size` rows each within the keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("page", F.floor(place / size).cast("long"))


def retired_only(evidence: Column, prefixes: Column) -> Column:
    """Whether there is evidence and every line of it holds a prefix, first at its start or after white space, `/` or `]`."""

    def at_boundary(line: Column, prefix: Column) -> Column:
        at = F.position(prefix, line)
        return (at == 1) | ((at > 1) & F.substr(line, at - 1, F.lit(1)).rlike(r"[\s/\]]"))

    under = lambda line: F.exists(prefixes, lambda prefix: at_boundary(line, prefix))
    return (F.size(evidence) > 0) & (F.size(prefixes) > 0) & F.forall(evidence, under)


def tier(x: DataFrame) -> tuple[Column, Column]:
    """(tier, reason) of extracted items x, by the first rule that holds.

    x(retired, explicit_user, requested, lasting, catch_all boolean; support, durability, scope, verdict, documented_at,
    unmerged_branch, branch string; sessions long); unmerged_branch is the first open branch of a relevant repository."""
    c = {name: F.col(name) for name in x.columns}
    own_task = c["explicit_user"] & (c["support"] == "user_task_instruction")
    task, open_branch = own_task & ~c["requested"], c["unmerged_branch"].isNotNull()
    user_said = c["explicit_user"] & ~c["support"].isin("user_task_instruction", "pasted_task_instruction", "not_user_stated")
    repeated = c["sessions"] >= 2
    some_branch = F.coalesce(c["unmerged_branch"], F.lit("unknown_branch"))
    verdict = c["verdict"]
    rules = [
        (c["retired"], "drop", F.lit("retired_subject")),
        ((c["durability"] == "episodic") & ~own_task & ~c["lasting"] & ~c["requested"], "drop", F.lit("episodic")),
        (c["catch_all"] & (c["scope"] != "global"), "drop", F.lit("catch_all_project")),
        (verdict.isin("contradicted", "stale"), "review", verdict),
        ((verdict == "documented") | (F.coalesce(c["documented_at"], F.lit("")) != ""), "drop", F.lit("already_in_autoloaded_docs")),
        (task & repeated, "inject", F.lit("recurring")),
        (task, "pool", F.lit("user_task_instruction")),
        (verdict == "branch_scoped", "branch", F.when(F.coalesce(c["branch"], F.lit("")) != "", c["branch"]).otherwise(some_branch)),
        (open_branch & (verdict != "confirmed"), "branch", some_branch),
        (verdict == "confirmed", "inject", F.lit("confirmed")),
        (c["requested"], "inject", F.lit("user_requested")),
        (user_said, "inject", F.lit("explicit_user")),
        (repeated, "inject", F.lit("recurring")),
        (F.lit(True), "pool", F.concat(F.lit("single_session_"), verdict)),
    ]
    first = F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(to).alias("tier"), why.alias("reason"))) for holds, to, why in rules])
    return first["tier"], first["reason"]


def merged(members: DataFrame, limit: int = 10) -> DataFrame:
    """One row for every group of members(group, id, session, explicit_user, first_seen, hints, paths, detail): nothing of
    a member is lost but hints and paths beyond the limit; the longest detail stands for all."""
    some = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, limit)
    return members.groupBy("group").agg(
        F.array_sort(F.collect_set("id")).alias("members"),
        F.array_sort(F.collect_set("session")).alias("sessions"),
        F.bool_or("explicit_user").alias("explicit_user"),
        F.min("first_seen").alias("first_seen"),
        some("hints").alias("hints"),
        some("paths").alias("paths"),
        F.max_by("detail", F.struct(F.length("detail"), -F.col("id"))).alias("detail"),
    )


def archive_preview(inventory: DataFrame, observed_at: Column, previous: list[str], policy: ArchivePolicy = ArchivePolicy()) -> DataFrame:
    """The rows of inventory(id, space, protected, retention_rank, priority, last_activity) that a run would archive,
    with the pass (`space` or `aggregate`) that takes them.

    First the spaces under pressure give what they hold over their target, then, if all together are over, the rest
    follows; a run takes at most a batch. Both passes are the first rows of an order, at most a batch of each space."""
    order = ["retention_rank", "priority", "last_activity", "id"]
    counts = inventory.groupBy("space").agg(F.count("*").alias("n"))
    hot = F.col("space").isin([s for s in previous if s != "aggregate"])
    pressed = counts.where((F.col("space") != "global") & ((F.col("n") > policy.space_high) | (hot & (F.col("n") > policy.space_target))))
    eligible = inventory.where(~F.col("protected") & (F.col("last_activity") < observed_at - F.expr(f"interval {policy.cold_days} days")))
    # the rank is bounded by the batch before the exchange, then by what the space holds over its target
    nth = F.row_number().over(Window.partitionBy("space").orderBy(*order))
    local = eligible.withColumn("nth", nth).where(F.col("nth") <= policy.batch).join(pressed, "space").where(F.col("nth") <= F.col("n") - policy.space_target)
    first = local.orderBy(*order).limit(policy.batch).select(*inventory.columns, F.lit("space").alias("pass"))
    total = inventory.agg(F.count("*").alias("total"))
    sizes = first.agg(F.count("*").alias("taken")).join(F.broadcast(total))
    over = (F.col("total") > policy.total_high) | (F.lit("aggregate" in previous) & (F.col("total") > policy.total_target))
    room = sizes.select(F.when(over, F.least(F.lit(policy.batch) - F.col("taken"), F.col("total") - policy.total_target - F.col("taken"))).otherwise(0).alias("room"))
    rest = eligible.join(F.broadcast(first.select("id")), "id", "left_anti").orderBy(*order).limit(policy.batch)
    place = F.row_number().over(Window.orderBy(*order))  # over one batch at most
    second = rest.withColumn("nth", place).join(F.broadcast(room)).where(F.col("nth") <= F.col("room")).select(*inventory.columns, F.lit("aggregate").alias("pass"))
    return first.unionByName(second)


def due_work(work: DataFrame, health: DataFrame, now: Column, policy: RecoveryPolicy = RecoveryPolicy()) -> DataFrame:
    """work(id, state, retry_at, lease_until, error, attempts, recoveries, updated_at) that can run now, with why.

    Work blocked by a lost connection or login comes back after a pause, if the model has answered since, and only a few
    times; health(last_success_at) has one row if the model is healthy and none if it is not."""
    c = F.col
    lost = ((c("error") == "authentication") & (c("attempts") >= 1)) | (c("error").isin("timeout", "unavailable", "rate_limited") & ((c("attempts") >= policy.attempts) | (c("recoveries") > 0)))
    paused = c("updated_at") <= now - F.expr(f"interval {policy.pause_hours} hours")
    answered = F.coalesce(c("last_success_at") > c("updated_at"), F.lit(False))
    why = (
        F.when(c("state") == "pending", "pending")
        .when((c("state") == "retrying") & (c("retry_at") <= now), "retry")
        .when((c("state") == "processing") & (c("lease_until") < now), "lease_expired")
        .when((c("state") == "blocked") & lost & (c("recoveries") < policy.recoveries) & paused & answered, "recovered")
    )
    # a single row, present or not: an aggregate gives exactly one
    one = health.agg(F.max("last_success_at").alias("last_success_at"))
    return work.join(F.broadcast(one)).withColumn("why", why).where(c("why").isNotNull()).drop("last_success_at")


def recent_work(events: DataFrame, notes: DataFrame, now: Column, idle_minutes: int, days: int, latest: int) -> DataFrame:
    """(session, project, last_at) of sessions with a prompt that have been idle for a while and whose work has moved on since
    their note, fewer than `latest` notes of their project being newer; events(session, project, at, kind),
    notes(session, project, through_at)."""
    window = events.where(F.col("at") >= now - F.expr(f"interval {days} days"))
    seen = window.groupBy("session").agg(F.max("at").alias("last_at"), F.count_if(F.col("kind") == "prompt").alias("prompts"), F.min_by("project", F.when(F.col("project").isNotNull(), F.col("at"))).alias("project"))
    idle = seen.where((F.col("prompts") > 0) & (F.col("last_at") <= now - F.expr(f"interval {idle_minutes} minutes")))
    moved = idle.join(notes.select("session", "through_at"), "session", "left").where(F.col("through_at").isNull() | (F.col("through_at") < F.col("last_at")))
    # only a project's `latest` newest notes can keep a session out: the oldest of them, if there are so many, is the bar
    newest = Window.partitionBy("project").orderBy(F.desc("through_at"), "session")
    bar = notes.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") == latest).select("project", F.col("through_at").alias("bar"))
    return moved.join(bar, "project", "left").where(F.col("bar").isNull() | (F.col("bar") <= F.col("last_at"))).select("session", "project", "last_at")
