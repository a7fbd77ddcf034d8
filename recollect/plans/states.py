"""Guarded changes, compact forms and model health over the test tables: parts stand for memories, events for attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coalescing, states
from .registry import Tables, query

_CURRENT = "SELECT p_partkey AS id, p_size % 3 AS revision, CASE p_size % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'review_due' ELSE 'active' END AS state FROM part WHERE p_partkey % 9 <> 0"
_DECISIONS = "SELECT l_partkey AS id, l_suppkey % 3 AS revision, CASE l_linenumber % 4 WHEN 0 THEN 'archive' WHEN 1 THEN 'restore' WHEN 2 THEN 'review' ELSE 'other' END AS action, l_shipdate AS at FROM lineitem"


def _rows(t: Tables, sql: str, table: str) -> DataFrame:
    """The rows of a SELECT over one table that both engines read alike."""
    columns, where = sql.removeprefix("SELECT ").split(f" FROM {table}")
    return getattr(t, table).where(where.removeprefix(" WHERE ") or "true").selectExpr(*columns.split(", "))


@query(
    "k12_guarded_changes",
    f"""SELECT id, CASE WHEN state IS NULL THEN 'unknown' WHEN state = target THEN 'unchanged' WHEN target IS NULL OR asked <> revision THEN 'stale' ELSE 'applied' END AS outcome,
        CASE WHEN outcome = 'applied' THEN revision + 1 ELSE revision END AS revision, CASE WHEN outcome = 'applied' THEN target ELSE state END AS state
        FROM (SELECT id, revision AS asked, CASE action WHEN 'archive' THEN 'archived' WHEN 'restore' THEN 'active' WHEN 'review' THEN 'review_due' END AS target FROM ({_DECISIONS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at", action, asked) = 1)
        LEFT JOIN ({_CURRENT}) USING (id)""",
)
def guarded_changes(t: Tables) -> DataFrame:
    return states.apply_decisions(_rows(t, _CURRENT, "part"), _rows(t, _DECISIONS, "lineitem"))


@query(
    "k22_to_compact",
    f"SELECT id FROM ({_CURRENT}) c WHERE state = 'active' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = id AND l_linenumber % 3 = revision AND l_returnflag = 'R' AND l_quantity < 20) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = id)",
)
def to_compact(t: Tables) -> DataFrame:
    compacts = t.lineitem.selectExpr("l_partkey AS id", "l_linenumber % 3 AS revision", "l_returnflag = 'R' AND l_quantity < 20 AS valid")
    return states.to_compact(_rows(t, _CURRENT, "part"), compacts, t.supplier.selectExpr("s_suppkey AS id"))


_FAILED = "CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'schema_invalid' WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'authentication' END"
#: The history of a model, one attempt after the other; seconds stand for days, as a user of the tables comes by that seldom.
_HEALTH = f"""
n AS (
  SELECT user_id AS model, ts AS "at", {_FAILED} IS NULL AS ok, {_FAILED} AS category,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, {_FAILED} IS NULL, {_FAILED}) AS i FROM events),
h(model, i, "at", ok, category, state, failures, broken, since, probed, incident) AS (
  SELECT DISTINCT model, 0::BIGINT, NULL::TIMESTAMP, true, NULL::VARCHAR, 'healthy', 0, 0, NULL::TIMESTAMP, false, 0 FROM n
  UNION ALL
  SELECT n.model, n.i, n."at", n.ok, n.category,
         CASE WHEN NOT n.ok AND (n.category IN ('authentication', 'invalid_model', 'invalid_configuration') OR (n.category = 'schema_invalid' AND broken >= 4) OR n."at" - coalesce(since, n."at") >= INTERVAL 20 DAY) THEN 'unavailable'
              WHEN NOT n.ok AND failures >= 2 AND n."at" - coalesce(since, n."at") >= INTERVAL 2 DAY THEN 'degraded'
              WHEN n.ok AND (state = 'healthy' OR probed) THEN 'healthy' ELSE state END,
         CASE WHEN NOT n.ok THEN failures + 1 WHEN state = 'healthy' OR probed THEN 0 ELSE failures END,
         CASE WHEN NOT n.ok THEN CASE WHEN n.category = 'schema_invalid' THEN broken + 1 ELSE 0 END WHEN state = 'healthy' OR probed THEN 0 ELSE broken END,
         CASE WHEN NOT n.ok THEN coalesce(since, n."at") WHEN state = 'healthy' OR probed THEN NULL ELSE since END,
         n.ok AND NOT (state = 'healthy' OR probed),
         CASE WHEN n.ok AND state <> 'healthy' AND probed THEN incident + 1 ELSE incident END
  FROM h JOIN n ON n.model = h.model AND n.i = h.i + 1)"""


def _health(t: Tables) -> DataFrame:
    attempts = t.events.selectExpr("user_id AS model", "ts AS at", f"{_FAILED} IS NULL AS ok", f"{_FAILED} AS category")
    return states.model_health(attempts, degraded_span=2 * 86_400.0, down_span=20 * 86_400.0)


@query("j14_model_health", f"WITH RECURSIVE {_HEALTH} SELECT model, \"at\", ok, category, state FROM h WHERE i > 0")
def model_health(t: Tables) -> DataFrame:
    return _health(t).select("model", "at", "ok", "category", "state").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "j14_model_incidents",
    f"""WITH RECURSIVE {_HEALTH},
    b AS (SELECT *, lag(state, 1, 'healthy') OVER (PARTITION BY model ORDER BY i) AS before FROM h WHERE i > 0),
    -- an incident's rows are those out of health and the recovery that follows
    k AS (SELECT *, count(*) FILTER (state <> 'healthy' AND before = 'healthy') OVER (PARTITION BY model ORDER BY i) AS no FROM b WHERE state <> 'healthy' OR before <> 'healthy')
    SELECT model, min(since) FILTER (state <> 'healthy') AS started_at, max("at") FILTER (NOT ok) AS last_failure_at, max("at") FILTER (state = 'healthy') AS ended_at,
           CASE WHEN count(*) FILTER (state = 'healthy') > 0 THEN 'recovered' ELSE arg_max(state, i) END AS state,
           arg_max(category, i) FILTER (NOT ok) AS reason, count(*) FILTER (state <> 'healthy' AND before <> 'healthy' AND before <> state) AS transitions
    FROM k GROUP BY model, no""",
)
def model_incidents(t: Tables) -> DataFrame:
    found = states.model_incidents(_health(t))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_failure_at", "ended_at")})


_CHANGES = "SELECT user_id % 40 AS catalog, ts AS \"at\", CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'built' ELSE 'change' END AS kind FROM events"


@query(
    "j12_coalesced_builds",
    f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY "at", kind) AS i FROM ({_CHANGES})),
    h(catalog, i, gen, pub, bld, started, dirty, forced, failed, out_at, reason, seen) AS (
      SELECT DISTINCT catalog, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::VARCHAR, NULL::TIMESTAMP FROM n
      UNION ALL
      SELECT catalog, CASE WHEN fire THEN i ELSE i + 1 END, CASE WHEN NOT fire AND kind = 'change' THEN gen + 1 ELSE gen END,
             CASE WHEN NOT fire AND kind = 'built' AND bld IS NOT NULL THEN greatest(pub, bld) ELSE pub END,
             CASE WHEN fire THEN gen WHEN kind IN ('built', 'failed') THEN NULL ELSE bld END, CASE WHEN fire THEN due ELSE started END,
             CASE WHEN fire THEN dirty WHEN kind = 'change' THEN "at" WHEN kind = 'built' AND bld >= gen THEN NULL ELSE dirty END,
             CASE WHEN fire THEN forced WHEN kind = 'change' THEN coalesce(forced, "at" + INTERVAL 12 HOUR) WHEN kind = 'built' AND bld >= gen THEN NULL ELSE forced END,
             CASE WHEN fire THEN failed WHEN kind = 'failed' AND bld IS NOT NULL THEN "at" WHEN kind = 'built' AND bld IS NOT NULL THEN NULL ELSE failed END,
             CASE WHEN fire THEN due END, CASE WHEN fire THEN CASE WHEN forced <= due THEN 'force_due' ELSE 'quiet_period' END END, CASE WHEN fire THEN due ELSE "at" END
      FROM (SELECT d.*, n."at", n.kind, coalesce(d.due < n."at", d.due <= TIMESTAMP '2024-02-01', false) AS fire
            FROM (SELECT *, CASE WHEN gen > pub THEN greatest(least(dirty + INTERVAL 4 HOUR, forced), coalesce(failed + INTERVAL 30 HOUR, dirty), coalesce(CASE WHEN bld IS NOT NULL THEN started + INTERVAL 30 HOUR END, dirty), seen) END AS due FROM h) d
            LEFT JOIN n ON n.catalog = d.catalog AND n.i = d.i + 1 AND n."at" <= TIMESTAMP '2024-02-01')
      WHERE fire OR kind IS NOT NULL)
    SELECT catalog, out_at AS "at", gen AS generation, reason FROM h WHERE out_at IS NOT NULL""",
)
def coalesced_builds(t: Tables) -> DataFrame:
    """Users by forties are catalogs; hours stand for seconds, as their events are so far apart."""
    hour = 3_600_000_000
    events = t.events.selectExpr("user_id % 40 AS catalog", "ts AS at", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'built' ELSE 'change' END AS kind")
    until = 1_706_745_600_000_000  # 2024-02-01
    found = coalescing.builds(events, until, coalescing.CoalescePolicy(4 * hour, 12 * hour, 30 * hour))
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))
