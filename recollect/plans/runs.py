"""Work along an order over the test tables: batches of sessions, purge runs, chains of revisions, members by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import WorkingSetPolicy
from ..operators import admission, candidates, intake, lifecycle, prompts, purge, stages
from ..sources import snapshots
from .registry import Tables, query

_CAPTURED = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS session, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id // 70 END AS turn,
    CASE WHEN event_type = 'signup' AND event_id % 41 = 0 THEN 'SessionEnd' WHEN event_type = 'view' THEN 'SessionStart' ELSE 'UserPromptSubmit' END AS kind,
    ts AS "at", CAST(value * 40 AS BIGINT) AS bytes, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id % 2 END AS project FROM events"""


@query(
    "j4_batches",
    f"""WITH RECURSIVE e AS ({_CAPTURED}),
    u AS (SELECT *, min(CASE WHEN kind = 'SessionEnd' THEN "at" END) OVER (PARTITION BY session ORDER BY "at" RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS until FROM e),
    g AS (SELECT *, CASE WHEN until IS NULL THEN turn END AS own, row_number() OVER w - 1 AS place, sum(bytes) OVER w AS ends FROM u
          WINDOW w AS (PARTITION BY session, until, CASE WHEN until IS NULL THEN turn END ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING)),
    h(session, until, own, head, base, past, ends) AS (
      SELECT DISTINCT session, until, own, 0::BIGINT, 0::HUGEINT, 0::BIGINT, 0::HUGEINT FROM g
      UNION ALL
      SELECT g.session, g.until, g.own, h.past, h.ends, max(g.place) + 1, max(g.ends) FROM h JOIN g ON g.session = h.session AND g.until IS NOT DISTINCT FROM h.until AND g.own IS NOT DISTINCT FROM h.own
      WHERE g.place BETWEEN h.past AND h.past + 63 AND (g.place = h.past OR g.ends - h.ends <= 100000) GROUP BY g.session, g.until, g.own, h.past, h.ends),
    b AS (SELECT g.*, h.head FROM g JOIN h ON g.session = h.session AND g.until IS NOT DISTINCT FROM h.until AND g.own IS NOT DISTINCT FROM h.own AND g.place >= h.head AND g.place < h.past),
    k AS (SELECT session, until, own, head, min(("at", event_id)) AS first, bool_and(kind IN ('SessionStart', 'SessionEnd')) AS lifecycle_only, CASE WHEN min(project) = max(project) THEN min(project) END AS one FROM b GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first) - 1 AS batch FROM k)
    SELECT event_id, CAST(b.session AS VARCHAR) AS session, batch, place - b.head AS ordinal, lifecycle_only, one AS project
    FROM b JOIN n ON n.session = b.session AND n.until IS NOT DISTINCT FROM b.until AND n.own IS NOT DISTINCT FROM b.own AND n.head = b.head""",
)
def session_batches(t: Tables) -> DataFrame:
    """One session holds a third of all events."""
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 41 == 0), "SessionEnd").when(F.col("event_type") == "view", "SessionStart").otherwise("UserPromptSubmit")
    events = t.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("session"), F.when(F.col("event_id") % 11 != 0, F.floor(F.col("event_id") / 70)).alias("turn"),
        kind.alias("kind"), F.col("ts").alias("at"), F.rint(F.col("value") * 40).cast("long").alias("bytes"), F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 2).alias("project"),
    )
    return intake.batches(events, most_bytes=100_000)


_DUE = """SELECT o_orderkey AS id, o_orderdate + INTERVAL 3 MONTH AS due_at, CAST(o_totalprice AS BIGINT) AS bytes FROM orders
    WHERE o_custkey % 6 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'error')
    AND o_orderdate + INTERVAL 3 MONTH <= TIMESTAMP '2000-01-01'"""


@query(
    "k20_purge_run",
    f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY due_at, id) AS place FROM ({_DUE})),
    h(k, place, room) AS (
      SELECT 0, 0::BIGINT, 6000000::BIGINT
      UNION ALL
      SELECT n.k + 1, n.place, n.room - d.bytes FROM (SELECT h.k, h.room, min(d.place) AS place FROM h JOIN d ON d.place > h.place AND d.bytes <= h.room WHERE h.k < 48 GROUP BY ALL) n JOIN d USING (place))
    SELECT id, h.k - 1 AS ordinal, bytes, CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE 'purged' END AS outcome FROM h JOIN d USING (place) JOIN orders ON o_orderkey = id""",
)
def purge_run(t: Tables) -> DataFrame:
    """Orders stand for archived memories; what has moved on since the plan was made stays."""
    nobody = t.events.where("event_type = 'error'").selectExpr("event_id AS id", "array(event_id) AS others")
    reviews = t.lineitem.where("l_quantity = 50").selectExpr("l_orderkey AS id")
    archived = t.orders.selectExpr("o_orderkey AS id", "false AS retain_forever", "cast(null AS timestamp) AS purge_after", "o_custkey % 6 = 0 AS pinned", "cast(o_orderdate AS timestamp) AS archived_at")
    eligible = candidates.purge_eligibility(archived, reviews, reviews.limit(0), nobody).where("reason IS NULL AND purge_at <= timestamp'2000-01-01'")
    due = eligible.join(t.orders.selectExpr("o_orderkey AS id", "cast(rint(o_totalprice) AS long) AS bytes"), "id").select("id", "purge_at", "bytes")
    now = t.orders.selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE 'purged' END AS outcome")
    root = stages.new_folder(due.sparkSession, "purge")
    return purge.run(lambda: purge.capped_walk(due, ["purge_at", "id"], "bytes", 48, 6_000_000), root, due.sparkSession, lambda rows: rows.join(now, "id").select("id", "ordinal", "bytes", "outcome"))


def _excluded(day: str) -> str:
    return f"""WITH f AS (SELECT c_custkey AS id, c_nationkey AS space, max(o_orderdate) AS last_activity, c_acctbal < -900 AS protected, c_custkey % 17 AS soft_score FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate <= TIMESTAMP '{day}' GROUP BY ALL),
       m AS (SELECT *, protected OR coalesce(last_activity, TIMESTAMP '1970-01-01') >= TIMESTAMP '{day}' - INTERVAL 90 DAY AS mandatory FROM f),
       n AS (SELECT *, count(*) OVER (PARTITION BY space) AS n, sum(mandatory::INT) OVER (PARTITION BY space) AS k,
             row_number() OVER (PARTITION BY space ORDER BY mandatory DESC, last_activity DESC NULLS LAST, soft_score DESC, id) AS r FROM m)
       SELECT id, space FROM n WHERE NOT (n <= 40 OR r <= greatest(30, k))"""


@query(
    "k15_rebalance",
    f"""SELECT coalesce(a.id, b.id) AS id, coalesce(a.space, b.space) AS space, CASE WHEN a.id IS NULL THEN 'excluded' WHEN b.id IS NULL THEN 'restored' ELSE 'kept out' END AS outcome, a.id IS NOT NULL AS before
        FROM ({_excluded('1999-06-01')}) a FULL JOIN ({_excluded('2000-06-01')}) b ON a.id = b.id""",
)
def rebalance(t: Tables) -> DataFrame:
    """The working set of one day in place of that of another, on condition that nobody published meanwhile."""

    def excluded(day: str) -> DataFrame:
        last = t.orders.where(F.col("o_orderdate") <= F.lit(day).cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_activity"))
        features = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("space"), (F.col("c_acctbal") < -900).alias("protected"), (F.col("c_custkey") % 17).alias("soft_score")).join(last, "id", "left")
        return lifecycle.working_set(features, F.lit(day).cast("timestamp"), WorkingSetPolicy(40, 30, 90)).where("NOT ranked").select("id", "space")

    before = excluded("1999-06-01")
    spark = before.sparkSession
    root = stages.new_folder(spark, "exclusions")
    snapshots.replace_if_changed(before, root, 0)
    held, now = snapshots.pinned(spark, root), snapshots.token(spark, root)
    snapshots.replace_if_changed(excluded("2000-06-01"), root, now)
    return lifecycle.exclusion_changes(held, snapshots.pinned(spark, root))


_ATTEMPTS = """SELECT user_id % 30 AS service, event_id // 2 AS request, ts AS "at", CASE event_type WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'empty' END WHEN 'view' THEN 'empty' WHEN 'signup' THEN 'cancelled' ELSE 'completed' END AS outcome,
    CASE WHEN event_id % 37 = 0 THEN 5 END AS late FROM events WHERE user_id % 30 <> 4"""


@query(
    "j13_service_health",
    f"""WITH a AS ({_ATTEMPTS}), v AS (SELECT user_id % 30 AS service, date_trunc('hour', ts) AS "at", 'busy' AS outcome, count(*) AS n FROM events WHERE value > 99 GROUP BY ALL),
    o AS (SELECT service, request, max("at") AS "at", max((outcome IN ('deadline_exceeded', 'failed', 'unavailable', 'busy') OR coalesce(late > 0, false))::INT) AS failed, max((outcome = 'completed')::INT) AS done FROM a WHERE "at" <= TIMESTAMP '2024-01-20' GROUP BY ALL),
    l AS (SELECT service, max("at") AS lf FROM (SELECT service, "at" FROM o WHERE failed = 1 UNION ALL SELECT service, "at" FROM v WHERE "at" <= TIMESTAMP '2024-01-20') GROUP BY service),
    s AS (SELECT DISTINCT service FROM o UNION SELECT DISTINCT service FROM v WHERE "at" <= TIMESTAMP '2024-01-20'),
    r AS (SELECT service, lf, (SELECT count(*) FROM o WHERE o.service = s.service AND failed = 1 AND "at" >= TIMESTAMP '2024-01-18') + (SELECT coalesce(sum(n), 0) FROM v WHERE v.service = s.service AND "at" >= TIMESTAMP '2024-01-18' AND "at" <= TIMESTAMP '2024-01-20') AS f,
          (SELECT count(*) FROM o WHERE o.service = s.service AND "at" >= TIMESTAMP '2024-01-18') AS recent, (SELECT count(*) FROM o WHERE o.service = s.service AND failed = 0 AND done = 1 AND (lf IS NULL OR "at" > lf)) AS ok
          FROM s LEFT JOIN l USING (service))
    SELECT service, CASE WHEN lf IS NULL THEN 'healthy' WHEN TIMESTAMP '2024-01-20' >= lf + INTERVAL 12 HOUR AND ok >= 5 THEN 'recovered' WHEN f >= 6 OR (recent >= 20 AND f >= 0.15 * recent) THEN 'degraded' WHEN TIMESTAMP '2024-01-20' < lf + INTERVAL 12 HOUR THEN 'recovering' ELSE 'awaiting_verification' END AS state,
           lf AS last_failure_at, f::BIGINT AS recent_failures, ok AS successes_since, lf + INTERVAL 12 HOUR AS quiet_until FROM r""",
)
def service_health(t: Tables) -> DataFrame:
    """Days stand for minutes, as the events are so far apart."""
    outcome = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 4 == 0, "failed").otherwise("empty")).when(F.col("event_type") == "view", "empty").when(F.col("event_type") == "signup", "cancelled").otherwise("completed")
    attempts = t.events.where("user_id % 30 <> 4").select((F.col("user_id") % 30).alias("service"), F.floor(F.col("event_id") / 2).alias("request"), F.col("ts").alias("at"), outcome.alias("outcome"), F.when(F.col("event_id") % 37 == 0, 5).alias("late"))
    counted = t.events.where("value > 99").groupBy((F.col("user_id") % 30).alias("service"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"), F.lit("busy").alias("outcome")).agg(F.count("*").alias("n"))
    return intake.service_health(attempts, counted, F.lit("2024-01-20").cast("timestamp_ntz"), "2 days", "12 hours", least=6, share=0.15)


@query(
    "j7_rendered_chunks",
    r"""WITH RECURSIVE t AS (SELECT conv_id AS session, upper(coalesce(role, 'unknown')) AS role, row_number() OVER w - 1 AS place, chr(10) || '' AS nl,
        sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, upper(coalesce(role, 'unknown')), coalesce(text, '') ROWS UNBOUNDED PRECEDING) AS number, coalesce(text, '') AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, upper(coalesce(role, 'unknown')), coalesce(text, ''))),
    l AS (SELECT session, place, CASE WHEN role = 'USER' THEN chr(10) ELSE '' END || '### T' || CASE WHEN number < 10 THEN '0' ELSE '' END || coalesce(number, 0) || ' ' || role || chr(10) || text AS line FROM t),
    g AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY session ORDER BY place ROWS UNBOUNDED PRECEDING) AS ends FROM l),
    h(session, chunk, head, past, ends) AS (
      SELECT DISTINCT session, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::HUGEINT FROM g
      UNION ALL SELECT g.session, h.chunk + 1, h.past, max(g.place) + 1, max(g.ends) FROM h JOIN g USING (session) WHERE g.place >= h.past AND (g.place = h.past OR g.ends - h.ends <= 1501) GROUP BY g.session, h.chunk, h.past)
    SELECT session, chunk, count(*) AS lines, string_agg(substr(line, 1, 1500) || chr(10), '' ORDER BY place) AS text FROM h JOIN g USING (session) WHERE g.place >= h.head AND g.place < h.past GROUP BY session, chunk""",
)
def rendered_chunks(t: Tables) -> DataFrame:
    return intake.rendered_chunks(t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), "role", "text"), 1500)


@query("g22_unseen", "SELECT l_orderkey AS epoch, l_partkey AS id, l_linenumber AS revision, l_quantity AS score FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem g WHERE g.l_returnflag = 'R' AND g.l_orderkey = l.l_orderkey AND g.l_partkey = l.l_partkey AND g.l_linenumber = l.l_linenumber)")
def unseen(t: Tables) -> DataFrame:
    """What was returned counts as given."""
    rows = t.lineitem.selectExpr("l_orderkey AS epoch", "l_partkey AS id", "l_linenumber AS revision", "l_quantity AS score", "l_returnflag AS flag")
    return prompts.unseen(rows.drop("flag"), rows.where("flag = 'R'").select("epoch", "id", "revision").distinct())


@query(
    "b22_retired_only",
    """SELECT page_id FROM pages, (SELECT ['/fr/', 'old/', '/de/8'] AS prefixes) WHERE list_bool_and(list_transform(['see ' || regexp_extract(url, '/[a-z]{2}/[0-9]*'), 'old/' || page_id], lambda e:
        list_bool_or(list_transform(prefixes, lambda p: position(p IN e) = 1 OR (position(p IN e) > 1 AND substr(e, position(p IN e) - 1, 1) IN (' ', '/', ']'))))))""",
)
def retired_only(t: Tables) -> DataFrame:
    """A page's evidence is its language's path and its number's."""
    evidence = F.array(F.concat(F.lit("see "), F.regexp_extract("url", "/[a-z]{2}/[0-9]*", 0)), F.concat(F.lit("old/"), F.col("page_id").cast("string")))
    return t.pages.where(admission.retired_only(evidence, F.array(*map(F.lit, ("/fr/", "old/", "/de/8"))))).select("page_id")


_NOTES = "SELECT user_id AS session, user_id % 12 AS project, min(ts) + INTERVAL 12 DAY AS through_at FROM events WHERE user_id % 3 = 0 GROUP BY user_id"


@query(
    "j18_recent_work",
    f"""WITH n AS ({_NOTES}), e AS (SELECT user_id AS session, user_id % 12 AS project, ts AS "at", CASE WHEN event_type = 'click' THEN 'prompt' ELSE 'other' END AS kind FROM events WHERE ts >= TIMESTAMP '2024-02-05' - INTERVAL 20 DAY),
    s AS (SELECT session, project, max("at") AS last_at FROM e GROUP BY ALL HAVING count(*) FILTER (kind = 'prompt') > 0 AND max("at") <= TIMESTAMP '2024-02-05' - INTERVAL 30 MINUTE)
    SELECT session, project, last_at FROM s LEFT JOIN n USING (session, project) WHERE (through_at IS NULL OR through_at < last_at) AND (SELECT count(*) FROM n m WHERE m.project = s.project AND m.through_at > s.last_at) < 2""",
)
def recent_work(t: Tables) -> DataFrame:
    events = t.events.selectExpr("user_id AS session", "user_id % 12 AS project", "ts AS at", "CASE WHEN event_type = 'click' THEN 'prompt' ELSE 'other' END AS kind")
    notes = t.events.where("user_id % 3 = 0").groupBy(F.col("user_id").alias("session"), (F.col("user_id") % 12).alias("project")).agg((F.min("ts") + F.expr("interval 12 days")).alias("through_at"))
    return admission.recent_work(events, notes, F.lit("2024-02-05").cast("timestamp_ntz"), 30, 20, 2)
