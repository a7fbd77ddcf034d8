"""What is kept of candidates: scorer verdicts, fallbacks, reasons, groups under a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scorer_selection(items: DataFrame, threshold: float = 0.5, weak_least: float = 0.6, weak_items: int = 2, most: int = 6) -> DataFrame:
    """items(query_id, id, position, band, score) that a scorer's verdicts keep, with their new position: those at the
    threshold, weak ones only at weak_least and the best weak_items of them, by score and then their old order. A null
    score is 0."""
    score = F.coalesce("score", F.lit(0.0))
    rows = items.withColumn("score", score).where(F.when(F.col("band") == "weak", F.col("score") >= max(threshold, weak_least)).otherwise(F.col("score") >= threshold))
    order = [F.desc("score"), F.col("position")]
    weak = F.row_number().over(Window.partitionBy("query_id", "band").orderBy(*order))
    rows = rows.withColumn("weak", weak).where((F.col("band") != "weak") | (F.col("weak") <= weak_items))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("position", place).where(F.col("position") <= most).drop("weak")


def confident(direct: Column, band: Column, lift: Column, applicable: Column, least: float = 0.05) -> Column:
    """What stands without a scorer's verdict: direct references, and high ones with a clear lift or that apply."""
    return direct | ((band == "high") & F.coalesce((lift >= least) | applicable, F.lit(False)))


def omission(band: Column, known: Column, present: Column, restricted: Column) -> Column:
    """Why a scored item was left out: its noted reason where it was weak or merely did not fit."""
    return F.when(band == "weak", F.coalesce(known, F.lit("weak_relevance"))).when(present, "already_present").when(restricted, "post_soft_ineligible").otherwise(F.coalesce(known, F.lit("item_limit")))


def candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """(query_id, id, sources): the union of what each source names, and which ones name it."""
    every = None
    for name, rows in sources.items():
        part = rows.select("query_id", "id", F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def fitting_groups(groups: DataFrame, limit: int) -> DataFrame:
    """groups(owner, id, size) taken largest first, ties to the smaller id, each that still fits under the limit; the
    walk goes on past one that does not."""
    lists = groups.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "id"))).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(s: Column, r: Column) -> Column:
        fits = s["used"] - r["less"] <= limit
        return F.struct((s["used"] - F.when(fits, r["less"]).otherwise(0)).alias("used"), F.when(fits, F.concat(s["ids"], F.array(r["id"]))).otherwise(s["ids"]).alias("ids"))

    return lists.select("owner", F.aggregate("rows", start, step).alias("s")).select("owner", F.col("s.used").alias("used"), F.explode("s.ids").alias("id"))


def page_after(rows: DataFrame, binding: list[Column], keys: list[str], last: dict | None, size: int) -> DataFrame:
    """The next rows in descending order of the first key and ascending order of the second, after the last one seen,
    with the digest that binds a cursor to what was asked."""
    first, second = keys
    if last:
        rows = rows.where((F.col(first) < last[first]) | ((F.col(first) == last[first]) & (F.col(second) > last[second])))
    bound = F.sha2(F.to_json(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(binding)])), 256)
    return rows.orderBy(F.desc(first), second).limit(size).withColumn("binding", bound)
