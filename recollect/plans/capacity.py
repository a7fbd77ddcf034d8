"""Capacity over the test tables: parts are memories and their brands projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capacity
from .registry import Tables, query


@query(
    "k14_working_set_features",
    """WITH c AS (SELECT p_partkey AS id, p_brand AS space, TIMESTAMP '1999-01-01' + to_days(p_size) AS revised_at, CASE WHEN p_size = 7 THEN 'security' ELSE p_type END AS category FROM part),
    s AS (SELECT l_partkey AS id, max(l_shipdate) AS at_ FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    k AS (SELECT l_partkey AS id, bool_or(l_linenumber = 7 AND l_quantity > 45) AS pinned, bool_or(l_discount > 0.09) AS high_value FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    e AS (SELECT id, count(DISTINCT e) AS evidence FROM (SELECT l_partkey AS id, unnest([l_suppkey, l_orderkey % 10]) AS e FROM lineitem WHERE l_linestatus = 'F') GROUP BY id),
    d AS (SELECT id, count(*) AS degree FROM (SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 48 UNION ALL SELECT l_suppkey FROM lineitem WHERE l_quantity > 48) GROUP BY id),
    x AS (SELECT event_id AS id FROM events WHERE event_type = 'error' AND event_id % 5 = 0 UNION SELECT unnest([event_id + 1, event_id + 3]) FROM events WHERE event_type = 'error' AND event_id % 5 = 0 AND event_id % 2 = 0),
    f AS (SELECT c.*, at_, coalesce(degree, 0) AS degree, coalesce(evidence, 0) AS evidence, coalesce(high_value, false) AS high_value,
          CASE WHEN pinned THEN 'pinned' WHEN c.id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'open_review' WHEN c.id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) THEN 'open_verification'
               WHEN c.id IN (SELECT id FROM x) THEN 'open_conflict' WHEN category IN ('safety', 'security', 'compliance') THEN 'risk_category' END AS why
          FROM c LEFT JOIN s USING (id) LEFT JOIN k USING (id) LEFT JOIN e USING (id) LEFT JOIN d USING (id))
    SELECT id, space, greatest(revised_at, at_) AS last_activity, why IS NOT NULL AS protected, why, degree, evidence, high_value FROM f""",
)
def features(t: Tables) -> DataFrame:
    catalog = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("space"), (F.lit("1999-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))).alias("revised_at"), F.when(F.col("p_size") == 7, "security").otherwise(F.col("p_type")).alias("category"))
    selections = t.lineitem.where("l_returnflag = 'R'").selectExpr("l_partkey AS id", "l_shipdate AS at")
    held = t.lineitem.where("l_linestatus = 'F'").selectExpr("l_partkey AS id", "l_linenumber = 7 AND l_quantity > 45 AS pinned", "l_discount > 0.09 AS high_value", "array(l_suppkey, l_orderkey % 10) AS evidence")
    edges = t.lineitem.where("l_quantity > 48").selectExpr("l_partkey AS a", "l_suppkey AS b")
    conflicts = t.events.where("event_type = 'error' AND event_id % 5 = 0").selectExpr("event_id AS id", "CASE WHEN event_id % 2 = 0 THEN to_json(array(event_id + 1, event_id + 3)) ELSE 'not a list' END AS others")
    return capacity.working_set_features(catalog, selections, held, edges, t.supplier.where("s_acctbal < 0").selectExpr("s_suppkey AS id"), t.customer.where("c_acctbal > 9000").selectExpr("c_custkey AS id"), conflicts)


_STATUS = """c AS (SELECT p_partkey AS id, p_size AS revision, CASE WHEN p_partkey % 9 = 0 THEN 'global' ELSE 'project:' || p_brand END AS space FROM part),
    x AS (SELECT DISTINCT l_partkey AS id, l_linenumber * 7 AS revision FROM lineitem), n AS (SELECT space, count(*) AS durable, count(x.id) AS excluded FROM c LEFT JOIN x ON x.id = c.id AND x.revision = c.revision GROUP BY space),
    o AS (SELECT 'project:Brand#' || n_nationkey AS space, CASE n_nationkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'linked' ELSE 'satisfied' END AS state, TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS next_review_at FROM nation WHERE n_nationkey % 2 = 1),
    m AS (SELECT 'global' AS kind, 150 AS target, 200 AS hard, 90 AS low_water UNION ALL SELECT 'project', 68, 74, 10),
    s AS (SELECT space, coalesce(durable, 0) AS durable, coalesce(durable, 0) - coalesce(excluded, 0) AS ranked, coalesce(excluded, 0) AS excluded, nullif(state, 'satisfied') AS obligation, next_review_at, m.* FROM n FULL JOIN o USING (space) JOIN m ON m.kind = split_part(space, ':', 1))"""


def _status(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    space = F.when(F.col("p_partkey") % 9 == 0, "global").otherwise(F.concat(F.lit("project:"), "p_brand"))
    catalog = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("revision"), space.alias("space"))
    excluded = t.lineitem.selectExpr("l_partkey AS id", "l_linenumber * 7 AS revision").distinct().join(catalog.select("id", "space"), "id")
    limits = t.region.sparkSession.createDataFrame([("global", 150, 200, 90), ("project", 68, 74, 10)], "kind string, target int, hard int, low_water int")
    state = F.when(F.col("n_nationkey") % 3 == 0, "pending").when(F.col("n_nationkey") % 3 == 1, "linked").otherwise("satisfied")
    owed = t.nation.where("n_nationkey % 2 = 1").select(F.concat(F.lit("project:Brand#"), F.col("n_nationkey").cast("string")).alias("space"), state.alias("state"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("n_nationkey"))).alias("next_review_at"))
    return capacity.capacity_status(catalog, excluded, limits.drop("low_water"), owed), limits, owed


@query("k16_capacity_status", f"WITH {_STATUS} SELECT space, durable, ranked, excluded, CASE WHEN ranked >= hard THEN 'hard_limited' WHEN ranked > target THEN 'over_target' ELSE 'within_target' END AS state, obligation, next_review_at FROM s")
def status(t: Tables) -> DataFrame:
    return _status(t)[0]


@query(
    "k16_owed_reviews",
    f"""WITH {_STATUS}, y AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'global' ELSE 'project:' || p_brand END AS space, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1),
    w AS (SELECT space, CASE WHEN coalesce(n, 0) > low_water THEN 'pending' ELSE 'satisfied' END AS state FROM s LEFT JOIN y USING (space)),
    b AS (SELECT space, state AS old, next_review_at - INTERVAL 9 DAY AS since FROM o)
    SELECT space, state, CASE WHEN state = 'pending' AND old IS DISTINCT FROM 'pending' THEN TIMESTAMP '2024-03-01' ELSE since END AS first_exceeded_at, TIMESTAMP '2024-03-02' AS next_review_at, CASE WHEN state = 'satisfied' THEN TIMESTAMP '2024-03-01' END AS satisfied_at FROM w LEFT JOIN b USING (space)""",
)
def owed(t: Tables) -> DataFrame:
    found, limits, before = _status(t)
    space = F.when(F.col("p_partkey") % 9 == 0, "global").otherwise(F.concat(F.lit("project:"), "p_brand"))
    mandatory = t.part.where("p_size > 40").groupBy(space.alias("space")).agg(F.count("*").alias("n"))
    before = before.withColumns({"first_exceeded_at": F.col("next_review_at") - F.expr("interval 9 days"), "satisfied_at": F.lit(None).cast("timestamp_ntz")})
    return capacity.owed_reviews(found, mandatory, limits, before, F.lit("2024-03-01").cast("timestamp_ntz"))
