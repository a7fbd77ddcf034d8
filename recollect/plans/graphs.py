"""Graphs over the test tables: parts are memories, line items tie them, parts of one batch are revisions of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import applying, graphs
from .registry import Tables, query

_NEXT = "CASE WHEN p_partkey % 1000 <> 999 AND p_partkey + 1 < (SELECT count(*) FROM part) THEN p_partkey + 1 END"


@query(
    "k28_revision_heads",
    f"""WITH RECURSIVE r AS (SELECT p_partkey AS id, {_NEXT} AS next FROM part),
    h(id, head, steps) AS (SELECT id, id, 0::BIGINT FROM r WHERE next IS NULL UNION ALL SELECT r.id, head, steps + 1 FROM h JOIN r ON r.next = h.id)
    SELECT id, head, steps, steps = 0 AS current FROM h""",
)
def revision_heads(t: Tables) -> DataFrame:
    """Chains of a thousand revisions."""
    last = t.part.agg(F.max("p_partkey")).first()[0]
    following = F.when((F.col("p_partkey") % 1000 != 999) & (F.col("p_partkey") < last), F.col("p_partkey") + 1)
    return graphs.current_heads(t.part.select(F.col("p_partkey").alias("id"), following.alias("next")))


_EDGES = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey END AS source, (l_suppkey * 13 + l_orderkey) % 1500 AS target, l_returnflag || l_linenumber AS type FROM lineitem"


@query(
    "k28_related_pages",
    f"""WITH RECURSIVE e AS ({_EDGES}),
    s AS (SELECT source AS asked, target AS id, type, 'outgoing' AS direction FROM e UNION ALL SELECT target, source, type, 'incoming' FROM e WHERE source <> target),
    v AS (SELECT asked, s.id, type, direction, 10 + d.p_size AS tokens FROM s JOIN part a ON a.p_partkey = asked JOIN part d ON d.p_partkey = s.id WHERE asked % 20 = 0 AND (d.p_size % 9 <> 0 OR d.p_brand = a.p_brand)),
    g AS (SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER w AS ends FROM v WINDOW w AS (PARTITION BY asked ORDER BY type, id, direction ROWS UNBOUNDED PRECEDING)),
    h(asked, page, head, past, ends) AS (
      SELECT DISTINCT asked, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::HUGEINT FROM g
      UNION ALL SELECT g.asked, h.page + 1, h.past, max(g.place) + 1, max(g.ends) FROM h JOIN g USING (asked) WHERE g.place BETWEEN h.past AND h.past + 15 AND (g.place = h.past OR g.ends - h.ends <= 500) GROUP BY g.asked, h.page, h.past)
    SELECT asked, page, place - head AS ordinal, direction, type, id, tokens FROM h JOIN g USING (asked) WHERE g.place >= h.head AND g.place < h.past""",
)
def related_pages(t: Tables) -> DataFrame:
    """Every twentieth part asks; a third of all edges begin at one of them."""
    edges = t.lineitem.selectExpr("CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey END AS source", "(l_suppkey * 13 + l_orderkey) % 1500 AS target", "concat(l_returnflag, l_linenumber) AS type")
    docs = t.part.selectExpr("p_partkey AS id", "p_size % 9 = 0 AS private", "p_brand AS project", "cast(10 + p_size AS bigint) AS tokens")
    asked = t.part.where("p_partkey % 20 = 0").selectExpr("p_partkey AS id", "p_brand AS project")
    return graphs.related(asked, edges, docs, limit=16, tokens=500)


_EVIDENCE = """SELECT p_partkey AS project, 'path' AS kind, CAST(p_partkey // 2 AS VARCHAR) AS value FROM part WHERE p_partkey % 7 <> 3
    UNION ALL SELECT p_partkey, 'origin', CAST((p_partkey + 1) // 2 AS VARCHAR) FROM part WHERE p_partkey % 10 <> 9
    UNION ALL SELECT p_partkey, 'name', p_brand FROM part WHERE p_size = 50 UNION ALL SELECT p_partkey, 'name', NULL FROM part WHERE p_size = 1"""
_RESOLVED = f"""e AS (SELECT DISTINCT * FROM ({_EVIDENCE}) WHERE value IS NOT NULL),
    k AS (SELECT DISTINCT a.project AS a, b.project AS b FROM e a JOIN e b USING (kind, value)),
    r(project, seen) AS (SELECT a, b FROM k UNION SELECT r.project, k.b FROM r JOIN k ON k.a = r.seen),
    n AS (SELECT project, min(seen) AS resolved, count(*) AS members FROM r GROUP BY project)"""


def _evidence(t: Tables) -> DataFrame:
    text = lambda c: F.floor(c).cast("long").cast("string").alias("value")
    key = F.col("p_partkey")
    rows = t.part.where(key % 7 != 3).select(key.alias("project"), F.lit("path").alias("kind"), text(key / 2))
    rows = rows.unionByName(t.part.where(key % 10 != 9).select(key.alias("project"), F.lit("origin").alias("kind"), text((key + 1) / 2)))
    rows = rows.unionByName(t.part.where("p_size = 50").select(key.alias("project"), F.lit("name").alias("kind"), F.col("p_brand").alias("value")))
    return rows.unionByName(t.part.where("p_size = 1").select(key.alias("project"), F.lit("name").alias("kind"), F.lit(None).cast("string").alias("value")))


@query("k29_projects", f"WITH RECURSIVE {_RESOLVED} SELECT * FROM n")
def projects(t: Tables) -> DataFrame:
    return graphs.resolve_projects(_evidence(t))[0]


@query(
    "k29_collisions",
    f"""WITH RECURSIVE {_RESOLVED}, o AS (SELECT project, count(*) AS pieces FROM e GROUP BY project)
    SELECT kind, value, count(*) AS projects, min(resolved) AS resolved, bool_or(pieces = 1) AS ambiguous FROM e JOIN n USING (project) JOIN o USING (project) GROUP BY kind, value HAVING count(*) > 1""",
)
def collisions(t: Tables) -> DataFrame:
    return graphs.resolve_projects(_evidence(t))[1]


_LEFT_OUT = """SELECT l_orderkey // 10 AS session, row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ordinal, l_partkey AS id,
    ' st' || l_partkey % 90 AS statement, [l_suppkey % 150, l_partkey % 150] AS evidence, l_linenumber % 3 AS signals FROM lineitem"""


@query(
    "k30_restored",
    f"""WITH RECURSIVE c AS ({_LEFT_OUT}),
    h(session, ordinal, id, statements, covered, restored) AS (
      SELECT DISTINCT session, 0::BIGINT, 0::BIGINT, ['st' || session % 90], [session % 150], false FROM c
      UNION ALL
      SELECT session, ordinal, id, CASE WHEN ok THEN list_append(statements, st) ELSE statements END, CASE WHEN ok THEN list_concat(covered, evidence) ELSE covered END, ok FROM (
        SELECT c.session, c.ordinal, c.id, trim(statement) AS st, evidence, statements, covered,
               (signals >= 2 OR evidence[1] % 4 = 0 OR evidence[2] % 4 = 0) AND NOT list_contains(statements, trim(statement)) AND NOT list_has_any(covered, evidence) AS ok FROM h JOIN c ON c.session = h.session AND c.ordinal = h.ordinal + 1))
    SELECT session, ordinal, id FROM h WHERE restored""",
)
def restored(t: Tables) -> DataFrame:
    """Orders by tens are sessions; a line item's parts and suppliers are its evidence."""
    session = F.floor(F.col("l_orderkey") / 10).cast("long")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = graphs.ranked(t.lineitem.select(session.alias("session"), *order), ["session"], order)
    candidates = rows.select(
        "session", (F.col("place") + 1).alias("ordinal"), F.col("l_partkey").alias("id"), F.concat(F.lit(" st"), F.col("l_partkey") % 90).alias("statement"),
        F.array(F.col("l_suppkey") % 150, F.col("l_partkey") % 150).alias("evidence"), (F.col("l_linenumber") % 3).alias("signals"),
    )
    sessions = candidates.select("session").distinct()
    explicit = candidates.select("session", F.explode("evidence").alias("evidence")).where("evidence % 4 = 0")
    return graphs.restore_unrepresented(candidates, sessions.select("session", F.concat(F.lit("st"), F.col("session") % 90).alias("statement")), sessions.select("session", (F.col("session") % 150).alias("evidence")), explicit)


_APPLIED = """n AS (SELECT *, l_orderkey // 10 AS batch, row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ordinal FROM lineitem),
    i AS (SELECT batch, ordinal, batch * 1000 + ordinal AS id, l_linenumber <> 6 AS inject, 'k' || l_partkey % 900 AS key, l_quantity < 45 AS fits, CASE WHEN l_suppkey % 5 = 0 THEN 'new' ELSE ['new', 'duplicate', 'refines', 'conflicts'][l_partkey % 4 + 1] END AS decision,
          CASE WHEN l_suppkey % 5 > 0 AND l_suppkey % 3 = 0 THEN 'm' || l_suppkey END AS target_memory, CASE WHEN l_suppkey % 5 > 0 AND l_suppkey % 3 > 0 THEN batch * 1000 + l_suppkey % (ordinal + 1) END AS target_item,
          l_suppkey % 21 = 0 AS human, l_suppkey % 5 > 0 AND l_partkey % 11 = 0 AS loaded, l_partkey % 8 < 5 AS merged FROM n),
    k AS (SELECT 'k' || p_partkey AS key, 'm' || p_partkey AS known, p_size % 3 > 0 AS active FROM part WHERE p_partkey < 400),
    o AS (SELECT i.*, known, coalesce(active, false) AS active, inject AND known IS NULL AS open, loaded AND decision <> 'new' AS is_loaded FROM i LEFT JOIN k USING (key)),
    p AS (SELECT o.* EXCLUDE (target_item), t.id AS target_item FROM o LEFT JOIN o t ON t.id = o.target_item AND t.ordinal < o.ordinal AND t.open AND NOT t.is_loaded),
    w AS (SELECT *, open AND NOT is_loaded AND (decision = 'new' OR (target_memory IS NULL AND target_item IS NULL) OR (decision = 'refines' AND NOT merged AND NOT human)) AS own FROM p),
    r(id, shared) AS (SELECT id, CASE WHEN own THEN 'new:' || id ELSE target_memory END FROM w WHERE open AND NOT is_loaded AND (own OR target_memory IS NOT NULL)
      UNION ALL SELECT w.id, r.shared FROM r JOIN w ON w.target_item = r.id WHERE w.open AND NOT w.is_loaded AND NOT w.own AND w.target_memory IS NULL),
    s AS (SELECT w.*, shared, CASE WHEN NOT inject THEN CASE WHEN active THEN 'review_due' ELSE 'skipped' END WHEN known IS NOT NULL THEN CASE WHEN active THEN 'observed' ELSE 'skipped' END
          WHEN is_loaded OR (NOT own AND human) THEN CASE WHEN decision = 'conflicts' THEN 'conflict_human' ELSE 'duplicate_human' END WHEN own THEN 'written' WHEN decision = 'duplicate' THEN 'observed' ELSE 'revised' END AS st,
          CASE WHEN open THEN shared WHEN active OR inject THEN known END AS memory FROM w LEFT JOIN r USING (id)),
    x AS (SELECT *, st = 'revised' AND (NOT fits OR row_number() OVER (PARTITION BY batch, memory, st = 'revised' AND fits ORDER BY ordinal) > 1) AS apart FROM s)"""


@query(
    "k24_apply_outcomes",
    f"""WITH RECURSIVE {_APPLIED} SELECT id, CASE WHEN apart THEN 'written' ELSE st END AS state, CASE WHEN apart THEN 'new:' || id ELSE memory END AS memory,
    CASE WHEN NOT inject THEN CASE WHEN active THEN 'verifier' ELSE 'no_dreaming_memory_to_review' END WHEN known IS NOT NULL THEN CASE WHEN active THEN 'same_statement' ELSE 'rolled_back_or_archived' END
         WHEN apart AND NOT fits THEN 'too_long_merged' WHEN apart THEN 'revised_in_batch' WHEN st = 'written' AND decision = 'refines' AND NOT merged THEN 'no_merged_statement' ELSE decision END AS reason FROM x""",
)
def apply_outcomes(t: Tables) -> DataFrame:
    """Line items by tens of orders are batches of statements; what the comparison said is read off their keys."""
    batch = F.floor(F.col("l_orderkey") / 10).cast("long")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = graphs.ranked(t.lineitem.select(batch.alias("batch"), *order, "l_quantity"), ["batch"], order).withColumn("ordinal", F.col("place") + 1)
    rows = rows.withColumn("id", F.col("batch") * 1000 + F.col("ordinal"))
    told, pick = F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 3
    items = rows.select("batch", "ordinal", "id", F.when(F.col("l_linenumber") != 6, "inject").otherwise("review").alias("tier"), F.concat(F.lit("k"), F.col("l_partkey") % 900).alias("key"), (F.col("l_quantity") < 45).alias("fits"))
    known = t.part.where("p_partkey < 400").select(F.concat(F.lit("k"), "p_partkey").alias("key"), F.concat(F.lit("m"), "p_partkey").alias("memory"), (F.col("p_size") % 3 > 0).alias("active"))
    decisions = rows.where(told).select(
        "id", F.element_at(F.array(*map(F.lit, ("new", "duplicate", "refines", "conflicts"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("decision"), F.when(pick == 0, F.concat(F.lit("m"), "l_suppkey")).alias("target_memory"),
        F.when(pick > 0, F.col("batch") * 1000 + F.col("l_suppkey") % (F.col("ordinal") + 1)).alias("target_item"), (F.col("l_suppkey") % 21 == 0).alias("human"), (F.col("l_partkey") % 11 == 0).alias("loaded"), F.when(F.col("l_partkey") % 8 < 5, "merged").alias("merged"),
    )
    return applying.apply_outcomes(items, known, decisions)
