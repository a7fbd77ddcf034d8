"""Mixing sources to target weights by capped water-filling. DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPolicy:
    weights: tuple[int, ...] = (5, 2, 1)  # given to the sources in code point order, null last, again and again
    share: float = 1.5  # of all sizes, what the mix takes in all
    max_epochs: float = 2.0  # a source's target is at most this many times its size
    seed: str = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column, policy: MixPolicy) -> Column:
    """The seeded place of a row: by its id and its text, so that rows with a null or repeated id part as well."""
    return F.md5(F.concat(F.lit(policy.seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def _source(source: Column) -> Column:
    """A source as one non-null string: 'v' and the name, or 'z' for null, which so comes last."""
    return F.coalesce(F.concat(F.lit("v"), source), F.lit("z"))


def source_targets(sizes: DataFrame, policy: MixPolicy = MixPolicy()) -> DataFrame:
    """(src, source_size, target) for sizes(src, size).

    Water-filling in closed form: with the sources in ascending order of cap / weight, those before the first whose
    cap the level reaches no more are clamped, and the level is what is left over the weights that are left. The
    windows run over one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = (
        sizes.groupBy("src")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(every.orderBy("src")) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, policy.weights)), (F.col("rank") % len(policy.weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * policy.max_epochs)
    )
    upward = every.orderBy(F.col("cap") / F.col("weight"), "src")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    total = F.least(F.sum("source_size").over(every) * policy.share, F.sum("cap").over(every))
    level = ranked.select(
        "*",
        ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    free = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("cap_order", "level"))).over(every)
    return (
        level.withColumn("cap_order", F.row_number().over(upward))
        .withColumn("water", free["level"])
        .select("src", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("water")), F.col("cap")).alias("target"))
    )


def _plan(rows: DataFrame, policy: MixPolicy) -> DataFrame:
    """(src, source_size, target, whole, last_key): every document of src is taken `whole` times, and once more where
    its key is at most last_key.

    The fraction is cut in the seeded order of md5 keys. A first pass sums sizes by the key's first three digits, at
    most 4,096 rows a source, to find the one slice where the cut falls; only that slice's rows are put in order.
    """
    targets = materialize(source_targets(rows, policy), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    slices = rows.groupBy("src", F.substring("key", 1, 3).alias("slice")).agg(F.sum("size").alias("slice_size"))
    upward = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        slices.withColumn("up_to", F.sum("slice_size").over(upward))
        .join(targets.select("src", "need"), "src")
        .where((F.col("up_to") >= F.col("need")) & (F.col("need") > 0))
        .groupBy("src", "need")
        .agg(F.min(F.struct("slice", (F.col("up_to") - F.col("slice_size")).alias("before"))).alias("at"))
        .select("src", "need", F.col("at.slice").alias("slice"), F.col("at.before").alias("before"))
    )
    cut = materialize(cut, "mix-cut")
    inside = (
        rows.withColumn("slice", F.substring("key", 1, 3))
        .join(cut, ["src", "slice"])
        .groupBy("src", "slice", "need", "before", "key")
        .agg(F.sum("size").alias("size"))
    )
    order = Window.partitionBy("src", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        inside.withColumn("middle", F.col("before") + F.sum("size").over(order) - F.col("size") / 2)
        .groupBy("src")
        .agg(F.max(F.when(F.col("middle") <= F.col("need"), F.col("key"))).alias("last_in_slice"), F.min("slice").alias("slice"))
    )
    # no key of the slice is taken: the cut is just before the slice, and a bare prefix sorts before all of its keys
    plan = targets.join(last, "src", "left").withColumn("last_key", F.coalesce("last_in_slice", "slice"))
    return materialize(plan.select("src", "source_size", "target", "whole", "last_key"), "mix-plan")


def mix(docs: DataFrame, policy: MixPolicy = MixPolicy(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(plan, report): the plan by source, and one row per document with doc_id, size, source_size, target, taken.

    Rows with one doc_id and text are taken alike; null and empty texts have size 0 and are taken as often as others of their
    source; a null source is a source of its own, last in order. Equal seeds give equal mixes whatever the
    partitioning. An empty table gives empty results. The report names no other column of docs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _source(F.col(source_col)).alias("src"), word_count(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col), policy).alias("key"))
    rows = materialize(rows, "mix-sizes")
    plan = _plan(rows, policy)
    report = rows.join(plan, "src").select("doc_id", "size", "source_size", "target", (F.col("size") * repetitions()).alias("taken"))
    return plan, report


def repetitions() -> Column:
    """How often a document with columns key, whole and last_key is taken."""
    return F.col("whole") + F.when(F.col("key") <= F.col("last_key"), 1).otherwise(0)


def mixed_documents(docs: DataFrame, policy: MixPolicy = MixPolicy(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row repeated as often as the mix takes it, with the columns of docs."""
    plan, _ = mix(docs, policy, id_col, text_col, source_col)
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _source(docs[source_col]).alias("src"), _key(docs[id_col], docs[text_col], policy).alias("key"))
    times = held.join(plan, "src").select("row", repetitions().cast("int").alias("times")).where("times > 0")
    return times.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")
