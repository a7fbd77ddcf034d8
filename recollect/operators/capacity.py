"""Capacity of spaces: what a working set is ranked by, how full each space is, and what is owed about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories that are never left out of a working set.
RISKS = ("safety", "security", "compliance")


def working_set_features(catalog: DataFrame, selections: DataFrame, candidates: DataFrame, edges: DataFrame, reviews: DataFrame, verifications: DataFrame, conflicts: DataFrame, categories: tuple[str, ...] = RISKS) -> DataFrame:
    """(id, space, last_activity, protected, why, degree, evidence, high_value) of the active memories of
    catalog(id, space, revised_at, category).

    last_activity: the later of the revision and the newest of selections(id, at). evidence and high_value come from
    candidates(id, pinned, high_value, evidence), an array a row; degree counts both ends of edges(a, b). protected, and the first
    reason why: pinned; an open review(id) or verification(id); an open conflict(id, others), whose others is a list in
    JSON; a category of risk. Lists that are no JSON name nobody, repeated evidence counts once, an edge to itself counts
    both its ends. Every source is summed by id before it is joined, so a hot memory is one row of each join."""
    last = selections.groupBy("id").agg(F.max("at").alias("selected_at"))
    held = candidates.groupBy("id").agg(F.bool_or(F.coalesce("pinned", F.lit(False))).alias("pinned"), F.bool_or(F.coalesce("high_value", F.lit(False))).alias("high_value"))
    cited = candidates.select("id", F.explode("evidence").alias("e")).distinct().groupBy("id").agg(F.count("*").alias("evidence"))
    degree = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    kind = catalog.schema["id"].dataType.simpleString()
    named = conflicts.select("id").unionByName(conflicts.select(F.explode(F.from_json("others", f"array<{kind}>")).alias("id"))).where("id IS NOT NULL").distinct()
    flag = lambda rows, name: rows.select("id").distinct().withColumn(name, F.lit(True))
    rows = catalog
    for more in (last, held, cited, degree, flag(reviews, "review"), flag(verifications, "verification"), flag(named, "conflict")):
        rows = rows.join(more, "id", "left")
    why = F.when(F.col("pinned"), "pinned").when(F.col("review"), "open_review").when(F.col("verification"), "open_verification").when(F.col("conflict"), "open_conflict").when(F.col("category").isin(*categories), "risk_category")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("id", "space", F.greatest("revised_at", "selected_at").alias("last_activity"), why.isNotNull().alias("protected"), why.alias("why"), zero("degree"), zero("evidence"), F.coalesce("high_value", F.lit(False)).alias("high_value"))


def space_state(ranked: Column, target: Column, hard: Column) -> Column:
    return F.when(ranked >= hard, "hard_limited").when(ranked > target, "over_target").otherwise("within_target")


def capacity_status(catalog: DataFrame, exclusions: DataFrame, limits: DataFrame, obligations: DataFrame) -> DataFrame:
    """(space, durable, ranked, excluded, state, obligation, next_review_at) of every space that holds active memories or is
    owed a review.

    catalog(id, revision, space), exclusions(id, revision, space) of the current revision only, limits(kind, target, hard) for
    the kinds `global` and `project`, obligations(space, state, next_review_at), of which satisfied ones show no state. A
    space's kind is what stands before its first colon; null spaces are left out."""
    out = exclusions.select("id", "revision", "space").distinct().withColumn("out", F.lit(1))
    counts = catalog.where("space IS NOT NULL").join(out, ["id", "revision", "space"], "left").groupBy("space").agg(F.count("*").alias("durable"), F.coalesce(F.sum("out"), F.lit(0)).alias("excluded"))
    owed = obligations.select("space", F.when(F.col("state") != "satisfied", F.col("state")).alias("obligation"), "next_review_at")
    every = counts.join(owed, "space", "full").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("durable", "excluded")})
    every = every.withColumn("kind", F.split("space", ":")[0]).join(limits, "kind")
    ranked = F.col("durable") - F.col("excluded")
    return every.select("space", "durable", ranked.alias("ranked"), "excluded", space_state(ranked, F.col("target"), F.col("hard")).alias("state"), "obligation", "next_review_at")


def owed_reviews(status: DataFrame, mandatory: DataFrame, limits: DataFrame, before: DataFrame, now: Column, retry: str = "1 day") -> DataFrame:
    """(space, state, first_exceeded_at, next_review_at, satisfied_at): what is owed after a rebalance, in place of before, as
    a merge: pending while what must stay, mandatory(space, n), is more than the low water of limits(kind, low_water), else
    satisfied. first_exceeded_at stays what it was while the debt lasts; what before has of other spaces stays."""
    rows = status.select("space", F.split("space", ":")[0].alias("kind")).join(mandatory, "space", "left").join(limits.select("kind", "low_water"), "kind")
    new = rows.select("space", F.when(F.coalesce("n", F.lit(0)) > F.col("low_water"), "pending").otherwise("satisfied").alias("state"))
    old = before.select("space", F.col("state").alias("old_state"), F.col("first_exceeded_at").alias("since"), F.col("next_review_at").alias("old_review"), F.col("satisfied_at").alias("old_satisfied"))
    both = new.join(old, "space", "full")
    pending = F.col("state") == "pending"
    first = F.when(F.col("state").isNull(), F.col("since")).when(pending, F.when(F.col("old_state") == "pending", F.col("since")).otherwise(now)).otherwise(F.col("since"))
    return both.select(
        "space", F.coalesce("state", "old_state").alias("state"), first.alias("first_exceeded_at"),
        F.when(F.col("state").isNull(), F.col("old_review")).otherwise(now + F.expr(f"interval {retry}")).alias("next_review_at"),
        F.when(F.col("state").isNull(), F.col("old_satisfied")).when(F.col("state") == "satisfied", now).alias("satisfied_at"),
    )
