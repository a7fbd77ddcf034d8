"""Markdown reports: lines as rows, and a sink that puts a report in place whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inbox(items: DataFrame, title: str, limit: int = 20) -> DataFrame:
    """(n, line): a report over items(kind, id, at, text): a title, each kind's count, and its newest `limit` items, ties by
    id. Line breaks and bars in texts are made plain, null texts are empty; kinds go by name, null last as `other`.
    Only a count and `limit` items a kind are gathered, whatever there is."""
    rows = items.select(F.coalesce("kind", F.lit("other")).alias("kind"), "id", "at", "text")
    counts = rows.groupBy("kind").agg(F.count("*").alias("count"))
    heads = counts.select("kind", F.lit(0).alias("place"), F.concat(F.lit("## "), "kind", F.lit(" ("), F.col("count").cast("string"), F.lit(")")).alias("line"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("at"), "id"))
    newest = rows.withColumn("place", place).where(F.col("place") <= limit)
    listed = newest.select("kind", "place", F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(": "), _plain(F.col("text"))).alias("line"))
    body = heads.unionByName(listed)
    top = items.sparkSession.createDataFrame([("", -1, f"# {title}")], "kind string, place int, line string")
    ordered = top.unionByName(body.select("kind", F.col("place").cast("int").alias("place"), "line"))
    # the lines of a report: one for each kind and limit of each
    return ordered.select((F.row_number().over(Window.orderBy(F.col("kind") != "", "kind", "place")) - 1).cast("long").alias("n"), "line")


def _plain(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\|", "/")), F.lit(""))


def write(lines: DataFrame, path: str) -> None:
    """The lines as one text file in a folder of its own, in order; what was there is replaced once the new one is whole."""
    lines.repartition(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)
