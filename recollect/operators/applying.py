"""What becomes of extracted statements when they are applied: observed, revised, written, due for review, or passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import chains
from .stages import written


def apply_outcomes(items: DataFrame, known: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, state, memory, reason) of each of items(batch, ordinal, id, tier, key, fits), once decided.

    known(key, memory, active): statements written before, a key once. decisions(id, decision, target_memory, target_item, human,
    loaded, merged): what a comparison said of an item that is none of those: new, duplicate, refines or conflicts with a memory,
    or with an earlier item of its batch, whose memory it then shares; loaded marks a target that every session reads
    anyway. Items without a decision are new. An item that is not to be injected only makes a known statement due for review.
    What a person wrote is never revised. A refinement without a merged statement, or whose text does not fit (fits), and
    every later revision of a memory in one batch are written on their own; a written item's memory is `new:` and its id.
    Ids are distinct; nulls in flags are false.

    Items that point to earlier ones form chains; they are followed by doubling pointers, so that long chains take few
    rounds."""
    rows = items.join(known.select("key", F.col("memory").alias("known"), "active"), "key", "left").join(decisions, "id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.select(
        "batch", "ordinal", "id", "known", no("active").alias("active"), no("fits").alias("fits"), (F.coalesce("tier", F.lit("")) == "inject").alias("inject"), F.coalesce("decision", F.lit("new")).alias("decision"),
        "target_memory", "target_item", no("human").alias("human"), no("loaded").alias("loaded"), (F.trim(F.coalesce("merged", F.lit(""))) != "").alias("merged"),
    )
    rows = written(rows.withColumn("open", F.col("inject") & F.col("known").isNull()), "applied-items")
    # an earlier open item of the batch that is not loaded has a memory to share
    shared = rows.where("open AND NOT (loaded AND decision <> 'new')").select(F.col("id").alias("target_item"), F.col("batch").alias("b_"), F.col("ordinal").alias("o_"))
    rows = rows.join(shared, "target_item", "left").withColumn("target_item", F.when((F.col("b_") == F.col("batch")) & (F.col("o_") < F.col("ordinal")), F.col("target_item"))).drop("b_", "o_")
    loaded = F.col("open") & F.col("loaded") & (F.col("decision") != "new")
    aimed = F.col("open") & ~loaded & (F.col("decision") != "new") & (F.col("target_memory").isNotNull() | F.col("target_item").isNotNull())
    own = F.col("open") & ~loaded & (~aimed | ((F.col("decision") == "refines") & ~F.col("merged") & ~F.col("human")))
    rows = written(rows.withColumns({"is_loaded": loaded, "own": own}), "applied-aims")
    links = rows.where("open AND NOT is_loaded").select("id", F.when(~F.col("own") & F.col("target_memory").isNull(), F.col("target_item")).alias("next"))
    heads = chains(links).select("id", "head")
    made = F.concat(F.lit("new:"), F.col("id").cast("string"))
    ends = rows.where("open AND NOT is_loaded").select(F.col("id").alias("head"), F.when(F.col("own"), made).otherwise(F.col("target_memory").cast("string")).alias("shared"))
    rows = rows.join(heads.join(ends, "head").select("id", "shared"), "id", "left")
    conflict = F.col("decision") == "conflicts"
    state = (
        F.when(~F.col("inject"), F.when(F.col("active"), "review_due").otherwise("skipped"))
        .when(F.col("known").isNotNull(), F.when(F.col("active"), "observed").otherwise("skipped"))
        .when(F.col("is_loaded") | (~F.col("own") & F.col("human")), F.when(conflict, "conflict_human").otherwise("duplicate_human"))
        .when(F.col("own"), "written")
        .when(F.col("decision") == "duplicate", "observed")
        .otherwise("revised")
    )
    memory = F.when(F.col("open"), F.col("shared")).when(F.col("active") | F.col("inject"), F.col("known").cast("string"))
    rows = rows.select("batch", "ordinal", "id", "inject", "active", "known", "fits", "open", "is_loaded", "decision", "merged", state.alias("state"), memory.alias("memory"))
    # the first revision of a memory in a batch that fits goes through
    turn = F.row_number().over(Window.partitionBy("batch", "memory", (F.col("state") == "revised") & F.col("fits")).orderBy("ordinal"))
    rows = rows.withColumn("turn", turn)
    apart = (F.col("state") == "revised") & (~F.col("fits") | (F.col("turn") > 1))
    reason = (
        F.when(~F.col("inject"), F.when(F.col("active"), "verifier").otherwise("no_dreaming_memory_to_review"))
        .when(F.col("known").isNotNull(), F.when(F.col("active"), "same_statement").otherwise("rolled_back_or_archived"))
        .when(apart & ~F.col("fits"), "too_long_merged")
        .when(apart, "revised_in_batch")
        .when((F.col("state") == "written") & (F.col("decision") == "refines") & ~F.col("merged"), "no_merged_statement")
        .otherwise(F.col("decision"))
    )
    return rows.select("id", F.when(apart, "written").otherwise(F.col("state")).alias("state"), F.when(apart, made).otherwise(F.col("memory")).alias("memory"), reason.alias("reason"))
