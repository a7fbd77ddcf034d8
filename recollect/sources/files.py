"""Readers of files: diagnostics as JSON lines, memories and documents as Markdown, an inbox as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import headings

_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n(.*))?$"


def diagnostics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON of this schema are left out, fields that a version lacks are null."""
    rows = spark.read.text(path).select(F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return rows.where("r is not null and r._broken is null").select("r.*").drop("_broken")


def _markdown(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value")


def memories(spark: SparkSession, path: str, fields: tuple[str, ...], id_field: str = "id") -> DataFrame:
    """(path, <fields>, body, fault) of every Markdown file below a folder.

    The front matter has each field once, as `name: value`, and no other; the file is named by the id. The first fault:
    no_front_matter, unknown_field, repeated_field, missing_field, wrong_name; null if there is none. Empty files give no row.
    """
    front = F.regexp_extract("value", _FRONT, 1)
    names = F.regexp_extract_all("front", F.lit(r"(?m)^([A-Za-z_][A-Za-z0-9_]*):"), F.lit(1))
    known = F.array(*map(F.lit, fields))

    def value(name: str) -> Column:
        return F.nullif(F.regexp_extract("front", rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))

    rows = _markdown(spark, path).withColumn("front", front).withColumn("names", names)
    fault = (
        F.when(F.col("front") == "", "no_front_matter")
        .when(F.size(F.array_except("names", known)) > 0, "unknown_field")
        .when(F.size("names") > F.size(F.array_distinct("names")), "repeated_field")
        .when(F.greatest(F.lit(0), *[value(f).isNull().cast("int") for f in fields]) == 1, "missing_field")
        .when(F.col("file") != F.concat(value(id_field), F.lit(".md")), "wrong_name")
    )
    body = F.when(F.col("front") == "", F.col("value")).otherwise(F.regexp_extract("value", _FRONT, 2))
    return rows.select("path", *[value(f).alias(f) for f in fields], body.alias("body"), fault.alias("fault"))


def catalog(read: DataFrame, id_field: str = "id") -> DataFrame:
    """Memories as read, with the fault duplicate_id on every row whose id another sound row has too."""
    n = read.where("fault is null").groupBy(id_field).agg(F.count("*").alias("_n"))
    rows = read.join(n, id_field, "left")
    return rows.withColumn("fault", F.coalesce("fault", F.when(F.col("_n") > 1, "duplicate_id"))).select(*read.columns)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, headings, content_hash) of every Markdown file below a folder."""
    return _markdown(spark, path).select("path", F.col("value").alias("body"), headings(F.col("value")).alias("headings"), F.sha2("value", 256).alias("content_hash"))


def inbox(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    """Events of JSON files as they arrive, a bounded number of files to a batch (Spark takes a bound of files or of bytes, not both)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
