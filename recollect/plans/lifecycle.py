"""Intake, schedules, retention and selection; events are capture events with the user as session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import BatchPolicy, WorkingSetPolicy
from ..functions.text import excerpt
from ..operators import intake, lifecycle, relational
from .registry import Tables, query


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("user_id").alias("session"), F.to_date("ts").cast("string").alias("turn"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("value").alias("bytes"))


@query("j1_accept_first", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) = 1")
def accept_first(t: Tables) -> DataFrame:
    return intake.accept_first(t.events, ["user_id", "event_type", "props"], ["ts", "event_id"]).select("event_id")


@query(
    "j3_batch_readiness",
    """SELECT user_id AS session, ts::DATE::VARCHAR AS turn, count(*) AS n, round(sum(value), 4) AS bytes, max(ts) AS last_at, bool_or(event_type = 'purchase') AS stopped, bool_or(event_type = 'signup') AS ended,
       count(*) >= 5 OR sum(value) >= 300 OR bool_or(event_type = 'purchase') OR bool_or(event_type = 'signup') OR max(ts) <= TIMESTAMP '2024-01-15' AS ready FROM events GROUP BY ALL""",
)
def readiness(t: Tables) -> DataFrame:
    return intake.batch_readiness(_events(t), F.lit("2024-01-15 00:30:00").cast("timestamp"), 30, BatchPolicy(5, 300.0, "purchase", "signup"))


@query(
    "j5_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id AS session, min(ts) AS started_at, max(ts) + INTERVAL 2 HOUR AS closed_at, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions(t: Tables) -> DataFrame:
    return intake.sessions(_events(t))


@query(
    "j8_turn_pairs",
    """WITH k AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
       SELECT conv_id AS session, min(turn) AS prompt_turn, max(turn) FILTER (role = 'assistant') AS reply_turn FROM k WHERE k > 0 GROUP BY conv_id, k""",
)
def turn_pairs(t: Tables) -> DataFrame:
    return intake.turn_pairs(t.conversations.withColumnRenamed("conv_id", "session"))


@query(
    "j13_attempt_health",
    """SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS started_at, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures,
       count(*) FILTER (event_type = 'error') >= 3 OR (count(*) >= 20 AND count(*) FILTER (event_type = 'error') >= 0.02 * count(*)) AS degraded FROM events GROUP BY 1""",
)
def health(t: Tables) -> DataFrame:
    return intake.attempt_health(t.events.select(F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed")))


@query("j17_overflow_minutes", "SELECT date_trunc('minute', ts) AS minute, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL")
def overflow(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("minute", "ts").alias("minute"), F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "j19_balanced_split",
    """WITH r AS (SELECT user_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, round(abs(sum(value) OVER (PARTITION BY user_id) - 2 * sum(value) OVER w), 4) AS rest
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
       SELECT user_id, arg_min(i, (rest, i))::INT AS split_at, min(rest) AS rest FROM r WHERE i < n GROUP BY user_id""",
)
def split(t: Tables) -> DataFrame:
    return relational.balanced_split(t.events, "user_id", "event_id", "value")


@query(
    "i8_retry_delays",
    """SELECT event_id, (event_id % 7 + 1)::INT AS attempt, round([30, 60, 120, 240, 480, 900][least(event_id % 7 + 1, 6)] * (0.9 + ('0x' || substr(sha256(event_id || ':' || (event_id % 7 + 1)), 1, 2))::INT / 2550))::BIGINT AS delay FROM events""",
)
def retry(t: Tables) -> DataFrame:
    attempt = (F.col("event_id") % 7 + 1).cast("int")
    return t.events.select("event_id", attempt.alias("attempt"), lifecycle.retry_seconds(F.col("event_id"), attempt).alias("delay"))


@query("i9_backoff", "SELECT p_size::BIGINT AS failures, least(360, 5 * 2 ** least(p_size - 1, 7))::BIGINT AS minutes FROM part GROUP BY p_size")
def backoff(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_size").cast("long").alias("failures")).distinct().withColumn("minutes", lifecycle.backoff_minutes(F.col("failures")))


@query("i10_soft_score", "SELECT p_partkey, (p_size % 3 * 100 + (p_brand = 'Brand#2')::INT * 20 + least(p_size, 5) * 3 + least(length(p_type), 5) * 2 + least(length(p_name), 5))::BIGINT AS score FROM part")
def soft_score(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", lifecycle.soft_score(F.col("p_size") % 3, F.col("p_brand") == "Brand#2", F.col("p_size"), F.length("p_type"), F.length("p_name")).alias("score"))


@query("i2_excerpts", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 57) || ' ... ' || right(text, 58) END AS excerpt FROM documents")
def excerpts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", excerpt(F.col("text"), 120).alias("excerpt"))


@query(
    "a8_segments",
    """WITH s AS (SELECT doc_id, text, unnest(range(greatest(1, ceil(length(text) / 1024.0))::BIGINT)) AS segment FROM documents)
       SELECT doc_id, segment::INT AS segment, sha256(substr(text, segment * 1024 + 1, 1024)) AS segment_sha256 FROM s""",
)
def segments(t: Tables) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1024)).cast("int")
    rows = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("segment"))
    return rows.select("doc_id", "segment", F.sha2(F.substring("text", F.col("segment") * 1024 + 1, F.lit(1024)), 256).alias("segment_sha256"))


@query("a7_reassembled", "SELECT doc_id, greatest(1, ceil(length(text) / 1024.0))::BIGINT AS segments, sha256(text) AS whole_sha256, true AS intact FROM documents")
def reassembled(t: Tables) -> DataFrame:
    """Cut into segments, gathered in order and checked against the whole digest."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1024)).cast("int")
    cut = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("segment")).select("doc_id", F.sha2("text", 256).alias("want"), "segment", F.substring("text", F.col("segment") * 1024 + 1, F.lit(1024)).alias("part"))
    whole = cut.groupBy("doc_id", "want").agg(F.array_sort(F.collect_list(F.struct("segment", "part"))).alias("p"))
    digest = F.sha2(F.array_join(F.transform("p", lambda x: x["part"]), ""), 256)
    return whole.select("doc_id", F.size("p").cast("long").alias("segments"), digest.alias("whole_sha256"), (digest == F.col("want")).alias("intact"))


@query(
    "d3_receipt_rollup",
    """WITH i AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS s, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)
       SELECT o_orderdate::DATE::VARCHAR AS summary_date, o_orderpriority AS kind, count(*) AS receipts, round(sum(o_totalprice), 2) AS tokens, coalesce(sum(s), 0)::BIGINT AS selected, coalesce(sum(o), 0)::BIGINT AS omitted
       FROM orders LEFT JOIN i ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1998-07-01' - INTERVAL 720 HOUR GROUP BY ALL""",
)
def rollup(t: Tables) -> DataFrame:
    receipts = t.orders.select(F.col("o_orderkey").alias("receipt_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("tokens"))
    items = t.lineitem.select(F.col("l_orderkey").alias("receipt_id"), F.when(F.col("l_linestatus") == "F", "selected").otherwise("omitted").alias("outcome"))
    return lifecycle.receipt_rollup(receipts, items, F.lit("1998-07-01").cast("timestamp"), 30)[1].withColumn("summary_date", F.col("summary_date").cast("string"))


@query(
    "k13_working_set",
    """WITH f AS (SELECT c_custkey AS id, c_nationkey AS space, max(o_orderdate) AS last_activity, c_acctbal < -900 AS protected, c_custkey % 17 AS soft_score FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
       m AS (SELECT *, protected OR coalesce(last_activity, TIMESTAMP '1970-01-01') >= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY AS mandatory FROM f),
       n AS (SELECT *, count(*) OVER (PARTITION BY space) AS n, sum(mandatory::INT) OVER (PARTITION BY space) AS k,
             row_number() OVER (PARTITION BY space ORDER BY mandatory DESC, last_activity DESC NULLS LAST, soft_score DESC, id) AS r FROM m)
       SELECT id, space, mandatory, n <= 40 OR r <= greatest(30, k) AS ranked FROM n""",
)
def working_set(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_activity"))
    features = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("space"), (F.col("c_acctbal") < -900).alias("protected"), (F.col("c_custkey") % 17).alias("soft_score")).join(last, "id", "left")
    return lifecycle.working_set(features, F.lit("2000-06-01").cast("timestamp"), WorkingSetPolicy(40, 30, 90)).select("id", "space", "mandatory", "ranked")


@query("i6_calendar", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS purge_at, date_trunc('week', o_orderdate)::TIMESTAMP AS week FROM orders")
def calendar(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 3 months")).alias("purge_at"), F.date_trunc("week", "o_orderdate").alias("week"))


@query("i5_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
