"""Files made of the test tables and read back: vectors by ordinal, Markdown, JSON lines, snapshots, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered, stages
from ..sources import files, reports, snapshots, vectors
from .registry import Tables, query


@query(
    "a4_vectors_by_ordinal",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings)
    SELECT ordinal, len(embedding)::BIGINT AS width, embedding[1]::DOUBLE AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM r WHERE ordinal >= 100 AND ordinal < 333""",
)
def vectors_by_ordinal(t: Tables) -> DataFrame:
    """Embeddings as records, and a range of them read back."""
    rows = ordered.ranked(t.embeddings, [], ["vec_id"])
    width = len(rows.select("embedding").first()[0])
    spark = rows.sparkSession
    path = stages.new_folder(spark, "vectors").removeprefix("file://")
    vectors.write_vectors(rows.select(F.col("place").alias("ordinal"), F.col("embedding").alias("vector")), path, width)
    found = vectors.read_vectors(spark, path, width, 64).where("ordinal >= 100 AND ordinal < 333")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("ordinal", F.size("vector").cast("long").alias("width"), F.col("vector")[0].cast("double").alias("first"), F.round(total, 6).alias("total"))


@query(
    "a18_review_inbox",
    r"""WITH i AS (SELECT event_type AS kind, event_id AS id, ts AS "at", props AS text FROM events WHERE value > 50),
    b AS (SELECT kind, 0 AS place, '## ' || kind || ' (' || count(*) || ')' AS line FROM i GROUP BY kind
          UNION ALL SELECT kind, place, '- ' || id || ': ' || trim(replace(regexp_replace(text, '\s+', ' ', 'g'), '|', '/')) FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY "at" DESC, id) AS place FROM i) WHERE place <= 20
          UNION ALL SELECT '', -1, '# Review inbox')
    SELECT row_number() OVER (ORDER BY kind <> '', kind, place) - 1 AS n, line FROM b""",
)
def review_inbox(t: Tables) -> DataFrame:
    """Written and read back."""
    items = t.events.where("value > 50").selectExpr("event_type AS kind", "event_id AS id", "ts AS at", "props AS text")
    lines = reports.inbox(items, "Review inbox")
    spark = lines.sparkSession
    path = stages.new_folder(spark, "report")
    reports.write(lines, path)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("n", "line"))
    return whole.select(F.col("n").cast("long").alias("n"), "line")


@query("c16_pinned_revision", "SELECT p_partkey, p_name, 'r2' AS revision FROM part WHERE p_size > 20")
def pinned_revision(t: Tables) -> DataFrame:
    """Two revisions are published; readers see the one that the newest pointer names, and its count holds (A2, A11)."""
    spark = t.part.sparkSession
    root = stages.new_folder(spark, "catalog")
    for revision, least in (("r1", 10), ("r2", 20)):
        snapshots.publish(t.part.where(F.col("p_size") > least).select("p_partkey", "p_name"), root, revision)
    pointer = spark.read.parquet(f"{root}/pointer").agg(F.max_by("revision", "at").alias("revision"))
    return snapshots.pinned(spark, root).join(F.broadcast(pointer))


@query(
    "a12_retired_revisions",
    "SELECT revision, built_at FROM (SELECT *, row_number() OVER (ORDER BY built_at DESC, revision) AS n FROM (SELECT 'r' || c_custkey AS revision, c_custkey % 97 AS built_at FROM customer WHERE c_custkey <> (SELECT max(c_custkey) FROM customer))) WHERE n > 25",
)
def retired_revisions(t: Tables) -> DataFrame:
    revisions = t.customer.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("revision"), (F.col("c_custkey") % 97).alias("built_at"))
    pointer = t.customer.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("revision"), F.col("c_custkey").alias("at"))
    return snapshots.retired(revisions, pointer, 25)


@query("a10_diagnostics", "SELECT event_id, event_type, value FROM events WHERE event_id % 7 <> 0")
def diagnostics(t: Tables) -> DataFrame:
    """Events as JSON lines, every seventh of them cut off in the middle."""
    line = F.to_json(F.struct("event_id", "event_type", "value", "ts"))
    spark = t.events.sparkSession
    path = stages.new_folder(spark, "diagnostics")
    t.events.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return files.diagnostics(spark, path, "event_id long, event_type string, value double")


@query("a9_inbox", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'")
def inbox(t: Tables) -> DataFrame:
    """Events as JSON files, taken from the inbox two files at a time until it is empty."""
    spark = t.events.sparkSession
    path, out, state = (stages.new_folder(spark, n) for n in ("inbox", "taken", "inbox-state"))
    t.events.where("event_type <> 'view'").select("event_id", "user_id", "event_type").repartition(6).write.json(path)
    stream = files.inbox(spark, path, "event_id long, user_id long, event_type string", 2)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
