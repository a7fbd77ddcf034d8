"""Candidate rules over the test tables: orders stand for candidates, lineitem for their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates
from .registry import Tables, query


def _spark(sql: str) -> str:
    """Expressions that DuckDB reads, in Spark's words."""
    return sql.replace("list_value(", "array(").replace("::INT", "").replace("::BIGINT", "")


_SHAPES = """SELECT l_orderkey, l_linenumber,
    CASE l_linenumber % 4 WHEN 0 THEN 'explicit_user_statement' WHEN 1 THEN 'human_memory_reference' WHEN 2 THEN 'code_or_configuration' ELSE 'command_outcome' END AS evidence_class,
    l_partkey % 11 = 0 AS echo, l_partkey % 13 = 0 AS truncated, CASE WHEN l_partkey % 17 = 0 THEN 'changed' ELSE 'intact' END AS integrity,
    CASE l_suppkey % 4 WHEN 0 THEN repeat('g', 64) WHEN 1 THEN NULL ELSE repeat('ab', 32) END AS content_hash,
    concat('m', l_suppkey % 5) AS human_id, 'r1' AS human_revision, repeat('0f', 32) AS human_hash, concat('m', l_orderkey % 5, ':r1') AS source,
    repeat('c', 64) AS file_hash, CASE WHEN l_partkey % 3 = 0 THEN 'src/a' ELSE '/src/a' END AS file_path,
    CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN repeat('1', 40) ELSE repeat('1', 41) END AS repo_revision, CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 2 = 0 THEN NULL ELSE '/repo' END AS repo_root,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'make' END AS command, '/work' AS cwd, CASE WHEN l_partkey % 7 <> 0 THEN 0 END AS exit_code, repeat('d', 64) AS result_hash FROM lineitem"""

_SHAPE_RULE = """CASE evidence_class WHEN 'explicit_user_statement' THEN regexp_matches(content_hash, '^[0-9a-f]{64}$')
    WHEN 'human_memory_reference' THEN source = human_id || ':' || human_revision
    WHEN 'code_or_configuration' THEN file_path LIKE '/%' AND (repo_revision IS NULL AND repo_root IS NULL OR coalesce(length(repo_revision) IN (40, 64), false) AND repo_root IS NOT NULL)
    ELSE command <> '' AND exit_code IS NOT NULL AND regexp_matches(content_hash, '^[0-9a-f]{64}$') END"""


@query("b17_evidence_shape", f"SELECT l_orderkey, l_linenumber, evidence_class, coalesce(NOT echo AND NOT truncated AND integrity = 'intact' AND {_SHAPE_RULE}, false) AS eligible FROM ({_SHAPES})")
def evidence_shape(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr(*_columns(_SHAPES))
    return rows.select("l_orderkey", "l_linenumber", "evidence_class", candidates.eligible_shape().alias("eligible"))


def _columns(select: str) -> list[str]:
    """The columns of a SELECT, cut at commas outside brackets."""
    body, depth, out = _spark(select)[len("SELECT ") :].rsplit(" FROM ", 1)[0], 0, [""]
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


_SOURCES = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN list_value('core@0a1b2c3', ' web@abcdef0 seen', 'core@0a1b2c3') WHEN 1 THEN list_value('no commit', 'a b@123456') END AS evidence,
    CASE WHEN p_partkey % 3 = 0 THEN list_value('tools', concat('lib', p_size), 'tools') END AS paths,
    list_value(concat('base', p_size % 4, ':src/a:12'), 'bare') AS baseline, list_value('owner@main', concat('base', p_size % 2, '@dev'), '@none') AS branches, p_size FROM part"""


@query(
    "b23_repositories",
    f"SELECT p_partkey, array_to_string(list_sort(CASE WHEN p_partkey % 5 = 0 THEN ['core', 'web'] WHEN p_partkey % 3 = 0 THEN list_distinct(paths) ELSE list_distinct(['base' || p_size % 4 || ':src/a', 'owner', 'base' || p_size % 2]) END), ',') AS repositories FROM ({_SOURCES})",
)
def repositories(t: Tables) -> DataFrame:
    rows = t.part.selectExpr(*_columns(_SOURCES))
    found = candidates.relevant_repositories(*map(F.col, ("evidence", "paths", "baseline", "branches")))
    return rows.select("p_partkey", F.array_join(F.array_sort(found), ",").alias("repositories"))


_GATE = """SELECT o_orderkey, o_orderkey % 31 = 0 AS verification_needed, o_orderkey % 29 = 0 AS conflict,
    CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'contradicted' WHEN 2 THEN 'uncertain' ELSE 'supported' END AS assessed,
    o_custkey % 3 AS n_certain, CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END AS n_open, CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS n_cited,
    o_custkey % 4 = 0 AS only_statements, o_orderkey % 4 = 0 AS stable_tag, o_custkey % 7 = 0 AS is_global, o_custkey % 2 + 1 AS n_evidence,
    CASE WHEN o_orderkey % 5 = 0 THEN 'inferred' ELSE 'asserted' END AS certainty,
    CASE o_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'task_local' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'transient' WHEN 4 THEN 'no_retention' ELSE 'long_term' END AS disposition,
    o_orderkey % 3 = 0 AS private, o_custkey % 14 = 0 AS authorized, o_orderkey % 4 AS n_projects, o_orderkey % 5 AS n_sources, 3 AS n_contents,
    CASE o_orderkey % 9 WHEN 4 THEN 'session_only' WHEN 5 THEN 'project_phase' WHEN 6 THEN NULL ELSE 'long_term' END AS durability,
    o_custkey % 23 = 0 AS space_full, o_custkey % 19 = 0 AS total_full FROM orders"""


@query(
    "k3_promotion",
    f"""SELECT o_orderkey, CASE WHEN reason IS NULL THEN 'promoted' WHEN reason = 'material_conflict' THEN 'conflict' WHEN reason = 'semantic_contradiction' OR reason LIKE 'non_durable%' THEN 'rejected' ELSE 'wait' END AS decision, reason FROM (
        SELECT o_orderkey, CASE WHEN verification_needed THEN 'verification_required' WHEN conflict THEN 'material_conflict' WHEN assessed = 'contradicted' THEN 'semantic_contradiction'
        WHEN n_certain = 0 AND n_open = 0 THEN 'insufficient_evidence'
        WHEN assessed IS DISTINCT FROM 'supported' AND (is_global OR n_evidence > 1 OR certainty <> 'asserted' OR n_open > 0 OR only_statements AND NOT stable_tag) THEN 'semantic_assessment_required'
        WHEN n_certain = 0 AND n_cited = 0 THEN 'insufficient_evidence'
        WHEN assessed IS NOT NULL AND disposition IN ('task_local', 'transient', 'no_retention') THEN 'non_durable_' || disposition
        WHEN assessed IS NOT NULL AND disposition = 'uncertain' THEN 'durability_uncertain' WHEN assessed IS NOT NULL AND disposition IS NULL THEN 'durability_assessment_required'
        WHEN is_global AND NOT authorized AND private THEN 'private_global_requires_human_authorization' WHEN is_global AND NOT authorized AND (n_projects < 2 OR n_sources < 2) THEN 'global_corroboration_missing'
        WHEN durability IN ('session_only', 'project_phase') THEN 'durability_' || durability || '_hold' WHEN space_full THEN 'memory_space_capacity_hard_limit' WHEN total_full THEN 'aggregate_active_capacity_limit' END AS reason FROM ({_GATE}))""",
)
def promotion(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*_columns(_GATE)).select("o_orderkey", candidates.promotion_gate().alias("g")).select("o_orderkey", "g.decision", "g.reason")


_KINDS = "list_value('long_term', 'project_phase', 'uncertain', 'session_only', 'no_memory')"


def _kind_of(number: str) -> str:
    return f"CASE {number} % 5 WHEN 0 THEN 'long_term' WHEN 1 THEN 'project_phase' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'session_only' ELSE 'no_memory' END"


@query(
    "k1_intake",
    f"""WITH new AS (SELECT o_orderkey AS candidate, o_custkey AS fingerprint, {_kind_of('o_orderkey')} AS durability FROM orders),
        evidence AS (SELECT l_orderkey AS candidate, l_suppkey AS source, l_returnflag = 'R' AS echo FROM lineitem), existing AS (SELECT c_custkey AS fingerprint, {_kind_of('c_nationkey')} AS durability FROM customer WHERE c_custkey % 5 = 0),
        tombstones AS (SELECT * FROM (SELECT c_custkey AS fingerprint, unnest(range(10)) AS source FROM customer WHERE c_custkey % 3 = 0) WHERE source % 5 <> fingerprint % 5),
        r AS (SELECT n.*, (SELECT max(list_position({_KINDS}, e.durability)) FROM existing e WHERE e.fingerprint = n.fingerprint) AS old,
              EXISTS (SELECT 1 FROM tombstones b WHERE b.fingerprint = n.fingerprint) AND NOT EXISTS (SELECT 1 FROM evidence v WHERE v.candidate = n.candidate AND NOT v.echo AND NOT EXISTS (SELECT 1 FROM tombstones b WHERE b.fingerprint = n.fingerprint AND b.source = v.source)) AS silent FROM new n),
        s AS (SELECT *, old IS NULL AND silent AS suppressed FROM r)
        SELECT candidate, CASE WHEN suppressed THEN 'suppressed' WHEN old IS NOT NULL OR candidate <> min(candidate) FILTER (NOT suppressed) OVER (PARTITION BY fingerprint) THEN 'merged' ELSE 'created' END AS outcome,
               CASE WHEN suppressed THEN durability ELSE {_KINDS}[greatest(old, max(list_position({_KINDS}, durability)) FILTER (NOT suppressed) OVER (PARTITION BY fingerprint))] END AS durability FROM s""",
)
def intake(t: Tables) -> DataFrame:
    new = t.orders.selectExpr("o_orderkey AS candidate", "o_custkey AS fingerprint", f"{_kind_of('o_orderkey')} AS durability")
    evidence = t.lineitem.selectExpr("l_orderkey AS candidate", "l_suppkey AS source", "l_returnflag = 'R' AS echo")
    existing = t.customer.where("c_custkey % 5 = 0").selectExpr("c_custkey AS fingerprint", f"{_kind_of('c_nationkey')} AS durability")
    tombstones = t.customer.where("c_custkey % 3 = 0").selectExpr("c_custkey AS fingerprint", "explode(sequence(0L, 9L)) AS source").where("source % 5 <> fingerprint % 5")
    return candidates.intake(new, evidence, existing, tombstones)


@query(
    "k2_material_evidence",
    """WITH n AS (SELECT l_partkey AS candidate, l_suppkey AS source, l_quantity AS content, l_shipdate AS seen FROM lineitem WHERE l_returnflag = 'N' AND l_discount < 0.08), k AS (SELECT l_partkey AS candidate, l_suppkey AS source, l_quantity AS content FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber < 4)
       SELECT candidate, count(*) AS n, max(seen) AS last_at FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.candidate = n.candidate AND k.source = n.source) AND NOT EXISTS (SELECT 1 FROM k WHERE k.candidate = n.candidate AND k.content = n.content) GROUP BY candidate""",
)
def material(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr("l_partkey AS candidate", "l_suppkey AS source", "l_quantity AS content", "l_shipdate AS at", "l_discount < 0.08 AS eligible", "l_returnflag AS flag", "l_linenumber AS line")
    return candidates.material_evidence(rows.where("flag = 'N'"), rows.where("flag = 'A' AND line < 4"))


@query(
    "k9_to_reevaluate",
    """SELECT candidate FROM (SELECT o_custkey AS candidate, arg_max({'d': CASE WHEN o_orderkey % 2 = 0 THEN 'wait' ELSE 'rejected' END, 'r': o_orderpriority}, {'t': o_orderdate, 'd': CASE WHEN o_orderkey % 2 = 0 THEN 'wait' ELSE 'rejected' END, 'r': o_orderpriority}) AS x FROM orders GROUP BY 1)
       WHERE x.d = 'wait' AND x.r = '1-URGENT' AND candidate IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND candidate NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""",
)
def reevaluate(t: Tables) -> DataFrame:
    decisions = t.orders.selectExpr("o_custkey AS candidate", "o_orderdate AS at", "CASE WHEN o_orderkey % 2 = 0 THEN 'wait' ELSE 'rejected' END AS decision", "o_orderpriority AS reason")
    evidence = t.customer.where("c_acctbal > 0").selectExpr("c_custkey AS candidate")
    return candidates.to_reevaluate(decisions, evidence, t.lineitem.where("l_quantity = 50").selectExpr("l_partkey AS candidate"), "1-URGENT")


_BURSTS = """SELECT o_orderkey, CASE WHEN o_orderkey % 150 < 25 AND o_custkey % 4 = 0 THEN 'new' ELSE concat('p', o_custkey % 3) END AS project, concat('s', o_custkey % 40) AS session,
    CASE WHEN o_orderkey % 150 < 25 AND o_custkey % 4 = 0 THEN true WHEN o_custkey % 3 = 0 THEN o_orderkey % 150 < 30 WHEN o_custkey % 3 = 1 THEN o_orderkey % 10 <> 0 ELSE o_orderkey % 10 = 0 END AS high,
    CASE WHEN o_orderkey % 6 = 0 THEN list_value(o_orderpriority) ELSE list_value('constraint', o_orderpriority, 'constraint') END AS tags, o_orderkey % 150 AS days FROM orders"""


@query(
    "k7_anomalies",
    f"""WITH c AS (SELECT *, TIMESTAMP '2024-06-01' - INTERVAL 1 HOUR - to_days(days::INT) AS created FROM ({_BURSTS})),
        p AS (SELECT project, count(*) FILTER (days < 30) AS n, count(*) FILTER (days < 30 AND high) AS n_high, count(*) FILTER (days >= 30 AND days < 120) AS nb, count(*) FILTER (days >= 30 AND days < 120 AND high) AS hb, count(*) FILTER (days >= 30) AS past FROM c GROUP BY ALL),
        g AS (SELECT project, tag, count(*) AS k FROM (SELECT project, unnest(list_distinct(tags)) AS tag FROM c WHERE high AND days < 30) GROUP BY ALL)
        SELECT 'session_burst:' || session AS key, 'session_burst' AS kind, count(*) AS n, count(*) FILTER (high) AS n_high FROM c WHERE created >= TIMESTAMP '2024-05-02' AND created < TIMESTAMP '2024-06-01' GROUP BY session HAVING count(*) >= 12 AND count(*) FILTER (high) >= 10
        UNION ALL SELECT 'project_rolling_change:' || project, 'project_rolling_change', n, n_high FROM p WHERE n >= 50 AND nb >= 100 AND n_high / n >= 0.6 AND n_high / n - hb / nb >= 0.25
        UNION ALL SELECT 'cold_start:' || project, 'cold_start', n, n_high FROM p WHERE past < 100 AND n >= 50 AND n_high / n >= 0.8
        UNION ALL SELECT 'tag_dominance:' || project || ':' || tag, 'tag_dominance', k, n_high FROM g JOIN p USING (project) WHERE n_high >= 20 AND k >= 0.8 * n_high""",
)
def anomalies(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr(*_columns(_BURSTS)).withColumn("created", F.expr("TIMESTAMP '2024-06-01' - INTERVAL 1 HOUR - make_dt_interval(cast(days AS int))"))
    return candidates.anomalies(rows, "2024-05-02", "2024-06-01")


_BATCHES = "SELECT l_orderkey AS session, l_linenumber AS ordinal, l_partkey % 4 = 0 AS split, l_suppkey % 3 = 0 AS selected, l_quantity > 40 AS has_end, CASE WHEN l_discount < 0.09 THEN 'completed' ELSE 'pending' END AS state FROM lineitem"


@query(
    "j20_consolidation_ready",
    f"""WITH b AS (SELECT * FROM ({_BATCHES}) WHERE NOT split), c AS (SELECT session, max(ordinal) AS through FROM b WHERE selected OR has_end GROUP BY session),
        a AS (SELECT c.session, c.through, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 5 ELSE -1 END AS done FROM c LEFT JOIN orders ON o_orderkey = c.session)
        SELECT session, max(through) AS through FROM a JOIN b USING (session) WHERE through > coalesce(done, -1) AND ordinal > coalesce(done, -1) AND ordinal <= through AND session NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY session HAVING bool_and(state = 'completed')""",
)
def consolidation(t: Tables) -> DataFrame:
    cursors = t.orders.where("o_custkey % 3 = 0").selectExpr("o_orderkey AS session", "o_custkey % 5 AS through")
    running = t.orders.where("o_orderstatus = 'P'").selectExpr("o_orderkey AS session")
    return candidates.consolidation_ready(t.lineitem.selectExpr(*_columns(_BATCHES)), cursors, running)


_ARCHIVED = "SELECT o_orderkey AS id, o_custkey % 11 = 0 AS retain_forever, CASE WHEN o_custkey % 4 = 0 THEN o_orderdate + INTERVAL 10 DAY END AS purge_after, o_custkey % 6 = 0 AS pinned, CASE WHEN o_custkey % 17 <> 0 THEN o_orderdate + INTERVAL 5 HOUR END AS archived_at FROM orders"


@query(
    "k19_purge_eligibility",
    f"""SELECT id, CASE WHEN reason IS NULL THEN coalesce(purge_after, archived_at + INTERVAL 3 MONTH) END AS purge_at, reason FROM (
        SELECT *, CASE WHEN retain_forever THEN 'retain_forever' WHEN purge_after IS NULL AND pinned THEN 'pinned' WHEN purge_after IS NULL AND archived_at IS NULL THEN 'undated'
        WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) THEN 'open_review' WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 1) THEN 'open_verification'
        WHEN id IN (SELECT unnest([event_id, event_id + 3, event_id + 7]) FROM events WHERE event_type = 'error') THEN 'open_conflict' END AS reason FROM ({_ARCHIVED}))""",
)
def purge(t: Tables) -> DataFrame:
    reviews, verifications = (t.lineitem.where(f"l_quantity = {n}").selectExpr("l_orderkey AS id") for n in (50, 1))
    conflicts = t.events.where("event_type = 'error'").selectExpr("event_id AS id", "array(event_id + 3, event_id + 7) AS others")
    return candidates.purge_eligibility(t.orders.selectExpr(*_columns(_ARCHIVED)), reviews, verifications, conflicts)


@query(
    "k31_retention_clamp",
    f"""WITH o AS (SELECT o_orderkey AS id, {_kind_of('o_orderkey')} AS decision, o_custkey AS a, o_custkey + 1 AS b FROM orders), i AS (SELECT c_custkey + 1 AS e, list_position({_KINDS}, {_kind_of('c_nationkey')}) AS place FROM customer WHERE c_custkey % 3 = 0),
        s AS (SELECT id, decision, list_position({_KINDS}, decision) AS own, (SELECT max(place) FROM i WHERE e = a OR e = b) AS strictest FROM o)
        SELECT id, CASE WHEN strictest > own THEN {_KINDS}[strictest] ELSE decision END AS decision, coalesce(strictest > own, false) AS clamped FROM s WHERE NOT coalesce(strictest > own AND strictest > 2, false)""",
)
def clamp(t: Tables) -> DataFrame:
    outputs = t.orders.selectExpr("o_orderkey AS id", f"{_kind_of('o_orderkey')} AS decision", "array(o_custkey, o_custkey + 1, o_custkey) AS evidence")
    inputs = t.customer.where("c_custkey % 3 = 0").selectExpr(f"{_kind_of('c_nationkey')} AS decision", "array(c_custkey + 1) AS evidence")
    return candidates.clamp_retention(outputs, inputs)


@query(
    "k32_identity_faults",
    """WITH e AS (SELECT DISTINCT l_orderkey AS request, l_linenumber AS id FROM lineitem), r AS (SELECT l_orderkey AS request, l_linenumber + CASE WHEN l_partkey % 9 = 0 THEN 7 ELSE 0 END AS id, l_suppkey AS evidence FROM lineitem WHERE l_partkey % 10 <> 0),
        k AS (SELECT l_orderkey AS request, l_suppkey AS evidence FROM lineitem WHERE l_quantity > 5), q AS (SELECT request FROM e UNION SELECT request FROM r)
        SELECT request, (SELECT count(*) FROM e WHERE e.request = q.request AND NOT EXISTS (SELECT 1 FROM r WHERE r.request = e.request AND r.id = e.id)) AS missing,
               (SELECT count(DISTINCT id) FROM r WHERE r.request = q.request AND NOT EXISTS (SELECT 1 FROM e WHERE r.request = e.request AND r.id = e.id)) AS extra,
               (SELECT count(*) FROM (SELECT request AS z, id FROM r GROUP BY ALL HAVING count(*) > 1) WHERE z = q.request) AS repeated,
               (SELECT count(DISTINCT evidence) FROM r WHERE r.request = q.request AND NOT EXISTS (SELECT 1 FROM k WHERE k.request = r.request AND k.evidence = r.evidence)) AS uncited FROM q""",
)
def faults(t: Tables) -> DataFrame:
    expected = t.lineitem.selectExpr("l_orderkey AS request", "l_linenumber AS id")
    returned = t.lineitem.where("l_partkey % 10 <> 0").selectExpr("l_orderkey AS request", "l_linenumber + CASE WHEN l_partkey % 9 = 0 THEN 7 ELSE 0 END AS id", "array(l_suppkey) AS evidence")
    return candidates.identity_faults(expected, returned, t.lineitem.where("l_quantity > 5").selectExpr("l_orderkey AS request", "l_suppkey AS evidence"))


@query(
    "g25_prompt_history",
    r"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM conversations WHERE role = 'user' AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
        h AS (SELECT conv_id, turn, list_filter([x, lag(x, 1) OVER w, lag(x, 2) OVER w], lambda v: v IS NOT NULL) AS r FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn, x)),
        e AS (SELECT conv_id, turn, len(r) AS n, unnest(range(len(r))) AS back, unnest(r) AS x FROM h),
        l AS (SELECT *, string_split(x, ' ') AS w, CASE WHEN n = 1 THEN 40 WHEN n = 2 THEN [26, 14][back + 1] ELSE [22, 11, 7][back + 1] END AS room FROM e)
        SELECT conv_id, turn, back, CASE WHEN len(w) <= room THEN x ELSE array_to_string(w[1:ceil((room - 1) / 2)::INT] || ['…'] || w[len(w) - floor((room - 1) / 2)::INT + 1:], ' ') END AS text FROM l""",
)
def history(t: Tables) -> DataFrame:
    rows = t.conversations.where("role = 'user'").selectExpr("conv_id AS session", "turn AS ordinal", "text")
    return candidates.prompt_history(rows, budget=40).select(F.col("session").alias("conv_id"), F.col("ordinal").alias("turn"), F.col("back").cast("long").alias("back"), "text")


_WINDOWS = ("2024-01-10", "2024-01-12", "2024-01-14", "2024-01-16")


@query(
    "k7_continued_anomalies",
    f"""WITH d AS (SELECT user_id AS key, list_position({list(_WINDOWS[:3])}, w) AS k FROM (SELECT user_id, CASE WHEN ts < TIMESTAMP '{_WINDOWS[1]}' THEN '{_WINDOWS[0]}' WHEN ts < TIMESTAMP '{_WINDOWS[2]}' THEN '{_WINDOWS[1]}' ELSE '{_WINDOWS[2]}' END AS w
        FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{_WINDOWS[0]}' AND ts < TIMESTAMP '{_WINDOWS[3]}') GROUP BY ALL HAVING count(*) >= 2),
    u AS (SELECT key, max(k) AS last, bool_or(k = 1) AS a, bool_or(k = 2) AS b, bool_or(k = 3) AS c FROM d GROUP BY key),
    n AS (SELECT *, CASE WHEN c THEN 1 + CASE WHEN b THEN 1 + a::INT ELSE 0 END WHEN b THEN 1 + a::INT ELSE 1 END AS n FROM u)
    SELECT 'burst:' || key AS key, 'burst' AS kind, CASE WHEN NOT c THEN 'resolved' WHEN n >= 2 THEN 'persistent' ELSE 'provisional' END AS state, 'rolling' AS evaluation, {list(_WINDOWS[:3])}[last] AS start, {list(_WINDOWS[1:])}[last] AS "end", n::BIGINT AS count FROM n""",
)
def continued_anomalies(t: Tables) -> DataFrame:
    """Users with two errors or more in each of three windows that follow each other."""
    state = t.events.sparkSession.createDataFrame([], "key string, kind string, state string, evaluation string, start string, end string, count long")
    for start, end in zip(_WINDOWS, _WINDOWS[1:], strict=False):
        seen = t.events.where((F.col("event_type") == "error") & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))).groupBy("user_id").count().where("count >= 2")
        found = seen.select(F.concat(F.lit("burst:"), F.col("user_id").cast("string")).alias("key"), F.lit("burst").alias("kind"))
        state = candidates.continued(state, found, "rolling", start, end)
    return state
