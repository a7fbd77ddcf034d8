"""Relational operators that are more than one built-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """left with the value of right's latest row of the same key at or before left's instant, else null.

    One pass over both sides in time order: the last value seen is carried on, so no pairs are formed."""
    marked = left.select("*", F.lit(1).alias("_side"), F.col(left_at).alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    facts = right.select(F.col(key), F.lit(0).alias("_side"), F.col(right_at).alias("_at"), F.col(value).alias("_value"))
    carried = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marked.unionByName(facts, allowMissingColumns=True)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(carried)).where("_side = 1").drop("_side", "_at", "_value")


def first_per(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; the limit runs before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of the same key, and the rest of new added."""
    return old.join(new, key, "left_anti").unionByName(new)


def broken_references(edges: DataFrame, nodes: DataFrame, edge_col: str, node_col: str) -> DataFrame:
    return edges.join(nodes, F.col(edge_col) == F.col(node_col), "left_anti")


def islands(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """rows with `run`, the place in a chain of intervals in which each starts where the one before ends."""
    w = Window.partitionBy(key).orderBy(start)
    fresh = F.when(F.lag(end).over(w) == F.col(start), 0).otherwise(1)
    chains = rows.withColumn("_chain", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return chains.withColumn("run", F.row_number().over(Window.partitionBy(key, "_chain").orderBy(start))).drop("_chain")


def evenly_spaced(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """At most limit rows of each key at about equal distances in order, first and last among them."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (limit - 1) + 0.5).cast("int")))
    return placed.where((F.col("_n") <= limit) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def prefix_within(rows: DataFrame, keys: list[str], order: list[Column | str], size: str, limit: float) -> DataFrame:
    """Each key's rows in order as long as their sizes add up to limit at most; the first row always."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("position", F.row_number().over(w)).withColumn("total", total).where((F.col("total") <= limit) | (F.col("position") == 1))


def balanced_split(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """(key, split_at, rest): after how many rows in order the two parts of a key are nearest in size."""
    w = Window.partitionBy(key)
    run = F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.select(key, F.row_number().over(w.orderBy(order)).alias("i"), F.count("*").over(w).alias("n"), F.round(F.abs(F.sum(size).over(w) - 2 * run), 4).alias("rest"))
    return placed.where("i < n").groupBy(key).agg(F.min(F.struct("rest", "i")).alias("best")).select(key, F.col("best.i").alias("split_at"), F.col("best.rest").alias("rest"))


def ordinals(rows: DataFrame, key: str) -> DataFrame:
    """rows with `ordinal`, their place from 0 by a key, whatever its values; only a count for each task is summed in one
    run."""
    return ranked(rows, [], [key], name="ordinals").withColumnRenamed("place", "ordinal")


def tree_digest(rows: DataFrame, key: str, content: Column, fan: int = 1024, levels: int = 3) -> DataFrame:
    """One row with `digest`: SHA-256 over the rows in key order, a tree of groups of at most `fan` neighbouring keys, so
    that no group grows with the table; at least `levels` levels, and as many as the largest key needs. Keys are distinct
    whole numbers from 0; no rows give no digest."""
    largest = rows.agg(F.max(key)).first()[0] or 0
    while fan**levels <= largest:
        levels += 1
    level = rows.select(F.col(key).cast("long").alias("k"), F.sha2(content, 256).alias("d"))
    for _ in range(levels):
        level = level.groupBy(F.floor(F.col("k") / fan).alias("k")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    return level.select(F.col("d").alias("digest"))


def area_under_curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row with `auc`: the share of pairs of a row with label 1 and one with label 0 in which the first has the larger
    score, ties half; null if there are none. Counts go by distinct score, and what lies below each is a running sum that no
    task does alone."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by_score = known.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    placed = ranked(by_score, [], ["score"], ["neg"], name="auc")
    return placed.withColumn("w", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).agg(F.round(F.try_divide(F.sum("w"), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def round_robin(rows: DataFrame, key: str, category: str, order: str) -> DataFrame:
    """rows with `position` from 1 within the key: one of each category in turn, categories by name, their rows by the
    order. Neither a key's nor a category's rows are gathered."""
    turns = ranked(rows, [key, category], [order], name="turns").withColumnRenamed("place", "turn_")
    return ranked(turns, [key], ["turn_", category], name="robin").withColumn("position", F.col("place") + 1).drop("turn_", "place")


def preferred_match(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, preference): each left row's match by the first of keys that has one, the smallest right_id among
    several. Of rows that share a key's value only the smallest is joined, so no row meets all of its kind."""
    every = None
    for n, (l, r) in enumerate(keys, 1):
        least = right.where(F.col(r).isNotNull()).groupBy(F.col(r).alias("match_")).agg(F.min(right_id).alias(right_id))
        part = left.select(left_id, F.col(l).alias("match_")).join(least, "match_").select(left_id, right_id, F.lit(n).alias("preference"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(left_id).agg(F.min(F.struct("preference", right_id)).alias("best")).select(left_id, f"best.{right_id}", "best.preference")


def merge_sums(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Summary rows with a batch of more added to them: measures add up where keys meet."""
    both = old.select(*keys, *sums).unionByName(new.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """rows with the longest root that is the path or ends before one of its slashes, or null. Every path gives its own
    prefixes, so that roots are met by equality."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    distinct = rows.select(path).distinct()
    hits = distinct.select(path, F.explode(prefixes).alias(root)).join(roots.select(root).distinct(), root)
    best = hits.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return rows.join(best, path, "left")


def first_samples(rows: DataFrame, keys: list[str], id_col: str, n: int) -> DataFrame:
    """(keys, count, samples): how many rows, and the first n ids; no group is gathered beyond those."""
    w = Window.partitionBy(*keys).orderBy(id_col)
    some = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("samples"))
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).join(some, keys)


def ranking_quality(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: recall at each k and the mean reciprocal rank over expected(query_id, id), against ranked(query_id, id,
    rank). What was not found counts 0."""
    at = expected.join(ranked, ["query_id", "id"], "left")
    recall = [F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("int")), 6).alias(f"recall_{k}") for k in ks]
    return at.agg(*recall, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
