"""Decision rules over the test tables: documents stand for memories, conversations for prompts, pages for origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categories, rules
from ..operators import intake
from .registry import Tables, query

_RE2 = {k: v.replace("'", "''") for k, v in vars(rules).items() if isinstance(v, str) and k.isupper()}
_HARMLESS = " AND ".join(f"NOT regexp_matches(near, '{p}')" for p in rules.HARMLESS)


@query(
    "b14_sensitivity",
    f"""WITH x AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 6 WHEN 1 THEN ' Authorization: Bearer abc.def' WHEN 2 THEN ' auth token Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9' WHEN 3 THEN ' credential test_0123456789012345678901' WHEN 4 THEN ' password = hunter2hunter2' ELSE '' END AS t FROM documents),
        n AS (SELECT *, CASE WHEN regexp_matches(t, '{_RE2['CONTEXTUAL']}') THEN regexp_extract(t, '{_RE2['CONTEXTUAL']}', 1) END AS near FROM x)
        SELECT doc_id, CASE WHEN regexp_matches(t, '{_RE2['AUTHORIZATION']}') OR regexp_matches(t, '{_RE2['PRIVATE_KEY']}') OR regexp_matches(t, '{_RE2['CREDENTIAL_FIELD']}') THEN 'secret' WHEN near IS NOT NULL AND {_HARMLESS} THEN 'uncertain' ELSE 'normal' END AS state,
               CASE WHEN regexp_matches(t, '{_RE2['AUTHORIZATION']}') THEN 'authorization_header' WHEN regexp_matches(t, '{_RE2['PRIVATE_KEY']}') THEN 'private_key' WHEN regexp_matches(t, '{_RE2['CREDENTIAL_FIELD']}') THEN 'credential_field' WHEN near IS NOT NULL AND {_HARMLESS} THEN 'contextual_credential' END AS category FROM n""",
)
def sensitivity(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 6
    planted = F.when(kind == 1, " Authorization: Bearer abc.def").when(kind == 2, " auth token Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9").when(kind == 3, " credential test_0123456789012345678901").when(kind == 4, " password = hunter2hunter2").otherwise("")
    rows = t.documents.select("doc_id", rules.sensitivity(F.concat(F.coalesce("text", F.lit("")), planted)).alias("s"))
    return rows.select("doc_id", "s.state", "s.category")


_PROMPT = """CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN 'x <user_message> ' || coalesce(text, '') || ' </user_message> y <user_message>two</user_message>' WHEN 2 THEN ' p: ' || coalesce(text, '')
       WHEN 3 THEN 'a <private>hid' || chr(10) || 'den</private> b <PV>c</PV> d </pv> e' WHEN 4 THEN 'open <pv> ' || coalesce(text, '') ELSE ['ok.', 'Continue', 'What about this?', ' <task-notification>done', '   ', 'fix it now please'][conv_id % 6 + 1] END"""


def _prompts(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.expr(_PROMPT.replace("[conv_id % 6 + 1]", "[cast(conv_id % 6 as int)]").replace("['ok.'", "array('ok.'").replace("please']", "please')")).alias("prompt"))


@query("b16_user_words", rf"SELECT conv_id, turn, CASE WHEN regexp_matches(prompt, '(?s)<user_message>.*?</user_message>') THEN array_to_string(list_transform(regexp_extract_all(prompt, '(?s)<user_message>(.*?)</user_message>', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10) || chr(10)) ELSE prompt END AS words FROM (SELECT *, {_PROMPT} AS prompt FROM conversations)")
def user_words(t: Tables) -> DataFrame:
    return _prompts(t).select("conv_id", "turn", rules.user_words(F.col("prompt")).alias("words"))


@query(
    "b15_public_text",
    rf"""SELECT conv_id, turn, coalesce(regexp_matches(CASE WHEN regexp_matches(prompt, '(?s)<user_message>.*?</user_message>') THEN array_to_string(list_transform(regexp_extract_all(prompt, '(?s)<user_message>(.*?)</user_message>', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10) || chr(10)) ELSE prompt END, '{_RE2["PRIVATE_PREFIX"]}'), false) AS whole,
        CASE WHEN whole THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(prompt, '(?is)<(?:private|pv)>.*?</(?:private|pv)>', '', 'g'), '(?is)<(?:private|pv)>.*$', '', 'g'), '(?i)</(?:private|pv)>', '', 'g') END AS text FROM (SELECT conv_id, turn, {_PROMPT} AS prompt FROM conversations)""",
)
def public_text(t: Tables) -> DataFrame:
    return _prompts(t).select("conv_id", "turn", rules.public_text(F.col("prompt")).alias("p")).select("conv_id", "turn", "p.whole", "p.text")


@query(
    "b12_skip_reason",
    rf"""SELECT conv_id, turn, CASE WHEN plain = '' THEN 'empty_prompt' WHEN length(plain) <= 12 AND regexp_matches(plain, '{_RE2["CONTINUATION"]}') THEN 'continuation_only' WHEN regexp_matches(prompt, '{_RE2["NOTIFICATION"]}') THEN 'agent_notification' END AS reason
        FROM (SELECT *, lower(regexp_replace(coalesce(prompt, ''), '^\s+|\s+$', '', 'g')) AS plain FROM (SELECT conv_id, turn, {_PROMPT} AS prompt FROM conversations))""",
)
def skip_reason(t: Tables) -> DataFrame:
    return _prompts(t).select("conv_id", "turn", rules.skip_reason(F.col("prompt")).alias("reason"))


@query("b13_context_dependent", rf"SELECT conv_id, turn, coalesce(length(lower(regexp_replace(prompt, '^\s+|\s+$', '', 'g'))) <= 160 AND regexp_matches(lower(regexp_replace(prompt, '^\s+|\s+$', '', 'g')), '{_RE2['DEICTIC']}'), false) AS dependent FROM (SELECT conv_id, turn, {_PROMPT} AS prompt FROM conversations)")
def context_dependent(t: Tables) -> DataFrame:
    return _prompts(t).select("conv_id", "turn", rules.context_dependent(F.col("prompt")).alias("dependent"))


_MEMORY = """SELECT p_partkey AS id, ['safety_data_integrity', 'preference_constraint', 'failure_recovery_hazard', 'durable_reference', 'architecture_contract'][(p_partkey % 5 + 1)::INT] AS category,
    CASE WHEN p_size % 2 = 0 THEN 'human_authored' ELSE 'agent_derived' END AS authority, CASE p_size % 4 WHEN 0 THEN ['constraint'] WHEN 1 THEN ['decision', 'other'] ELSE ['other'] END AS tags,
    CASE WHEN p_size % 3 = 0 THEN 'v2' END AS policy, CASE WHEN p_size % 7 = 0 THEN 'review_due' ELSE 'current' END AS validity, p_brand = 'Brand#1' AS own, p_name, p_type, p_size FROM part"""


def _memories(t: Tables) -> DataFrame:
    c = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.get(F.array(*map(F.lit, ("safety_data_integrity", "preference_constraint", "failure_recovery_hazard", "durable_reference", "architecture_contract"))), (F.col("p_partkey") % 5).cast("int")).alias("category"),
        F.when(c % 2 == 0, "human_authored").otherwise("agent_derived").alias("authority"),
        F.when(c % 4 == 0, F.array(F.lit("constraint"))).when(c % 4 == 1, F.array(F.lit("decision"), F.lit("other"))).otherwise(F.array(F.lit("other"))).alias("tags"),
        F.when(c % 3 == 0, "v2").alias("policy"),
        F.when(c % 7 == 0, "review_due").otherwise("current").alias("validity"),
        (F.col("p_brand") == "Brand#1").alias("own"),
        "p_name",
        "p_type",
        "p_size",
    )


@query("b3_authority_gate", f"SELECT id FROM ({_MEMORY}) WHERE (authority = 'human_authored' OR policy IS NOT DISTINCT FROM 'v2') AND NOT (authority = 'agent_derived' AND validity = 'review_due')")
def authority_gate(t: Tables) -> DataFrame:
    return _memories(t).where(rules.authority_gate(F.col("authority"), F.col("policy"), F.col("validity"), True, "v2")).select("id")


_TIER = "CASE WHEN category = 'safety_data_integrity' OR (authority = 'human_authored' AND category IN ('preference_constraint', 'architecture_contract')) OR list_has_any(tags, ['safety', 'architecture', 'decision']) THEN 'critical' WHEN category IN ('failure_recovery_hazard', 'workflow_environment_toolchain') OR list_contains(tags, 'constraint') THEN 'strong' ELSE 'normal' END"


@query("b6_base_tier", f"SELECT id, {_TIER} AS tier FROM ({_MEMORY})")
def base_tier(t: Tables) -> DataFrame:
    return _memories(t).select("id", rules.base_tier(F.col("category"), F.col("authority"), F.col("tags")).alias("tier"))


@query("b5_effective_tier", f"SELECT id, CASE WHEN own AND b = 'normal' THEN 'strong' WHEN own THEN 'critical' ELSE b END AS tier FROM (SELECT *, {_TIER} AS b FROM ({_MEMORY}))")
def effective_tier(t: Tables) -> DataFrame:
    return _memories(t).select("id", rules.effective_tier(rules.base_tier(F.col("category"), F.col("authority"), F.col("tags")), F.col("own")).alias("tier"))


@query("b8_searchable_text", f"SELECT id, array_to_string(list_filter([x for x in [trim(p_name), trim(p_type), '', trim(category)]], lambda x, i: x <> '' AND list_position([trim(p_name), trim(p_type), '', trim(category)], x) = i), chr(10)) AS text FROM ({_MEMORY})")
def searchable_text(t: Tables) -> DataFrame:
    return _memories(t).select("id", rules.searchable_text(F.col("p_name"), F.col("p_type"), F.lit("  "), F.col("category"), F.col("p_name")).alias("text"))


_FORMS = f"""SELECT *, p_size % 5 <> 0 AND greatest(1, ceil(strlen(p_name) / 4.0)) <= 3 AS compact_ok, p_size % 3 <> 0 AND p_size % 5 <> 1 AS label_ok, {_TIER} AS tier FROM ({_MEMORY})"""


@query("b9_representation_valid", f"SELECT id, compact_ok, label_ok FROM ({_FORMS})")
def representation_valid(t: Tables) -> DataFrame:
    return _forms(t).select("id", "compact_ok", "label_ok")


def _forms(t: Tables) -> DataFrame:
    size = F.col("p_size")
    rows = _memories(t).withColumn("compact_ok", rules.representation_valid(F.col("p_name"), size % 5 != 0, F.lit(1), F.lit(1), 3))
    label = rules.representation_valid(F.lit("label"), size % 3 != 0, F.when(size % 5 == 1, 0).otherwise(1), F.lit(1), 48)
    return rows.withColumn("label_ok", label).withColumn("tier", rules.base_tier(F.col("category"), F.col("authority"), F.col("tags")))


@query("b10_representation", f"SELECT id, CASE WHEN compact_ok THEN 'compact' WHEN tier <> 'normal' AND label_ok THEN 'identity' END AS kind, CASE WHEN compact_ok THEN p_name WHEN tier <> 'normal' AND label_ok THEN p_type END AS text FROM ({_FORMS})")
def representation(t: Tables) -> DataFrame:
    chosen = rules.representation(F.col("p_name"), F.col("compact_ok"), F.col("p_type"), F.col("label_ok"), F.col("tier"), F.lit(True))
    return _forms(t).select("id", chosen.alias("r")).select("id", "r.kind", "r.text")


@query("b11_summaries", f"SELECT id, CASE WHEN authority = 'human_authored' AND NOT compact_ok THEN coalesce(s_name, p_name) ELSE p_name END AS compact FROM ({_FORMS}) LEFT JOIN supplier ON s_suppkey = id")
def summaries(t: Tables) -> DataFrame:
    rows = _forms(t).join(t.supplier, F.col("s_suppkey") == F.col("id"), "left")
    return rows.select("id", F.when((F.col("authority") == "human_authored") & ~F.col("compact_ok"), F.coalesce("s_name", "p_name")).otherwise(F.col("p_name")).alias("compact"))


@query("i15_exact_compact", "SELECT p_partkey, greatest(1, ceil(strlen(trim(p_name)) / 4.0)) <= 3 AND contains(lower(p_name), CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 'steel' END) AS exact FROM part")
def exact_compact(t: Tables) -> DataFrame:
    word = F.when(F.col("p_size") % 2 == 0, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise("  STEEL")
    return t.part.select("p_partkey", rules.exact_compact(F.col("p_name"), F.array(word, F.lit(" ")), 3).alias("exact"))


_ASSESSED = "SELECT event_id, ['high', 'normal', 'low', NULL][(event_id % 4 + 1)::INT] AS priority, event_id % 5 <> 0 AS current, ['durable', 'unknown', 'task'][(event_id % 3 + 1)::INT] AS horizon, ['rule', 'run_result', 'uncertain', 'fact'][(user_id % 4 + 1)::INT] AS kind FROM events"


@query("i16_retention_priority", f"SELECT event_id, CASE WHEN priority IS NULL OR NOT current OR horizon = 'unknown' OR kind = 'uncertain' OR (priority = 'high' AND (horizon <> 'durable' OR kind IN ('task_requirement', 'artifact_detail', 'run_result'))) THEN 'normal' ELSE priority END AS priority FROM ({_ASSESSED})")
def retention_priority(t: Tables) -> DataFrame:
    pick = lambda values, by: F.get(F.array(*[F.lit(v).cast("string") for v in values]), by.cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    return t.events.select("event_id", rules.retention_priority(pick(("high", "normal", "low", None), e % 4), e % 5 != 0, pick(("durable", "unknown", "task"), e % 3), pick(("rule", "run_result", "uncertain", "fact"), u % 4)).alias("priority"))


@query(
    "b26_category_and_scope",
    """SELECT event_id, CASE WHEN claim IN ('preference', 'decision_requirement') THEN 'preference_constraint' WHEN claim IN ('workflow_process', 'machine_state') THEN 'workflow_environment_toolchain' ELSE 'durable_reference' END AS category,
       CASE WHEN CASE WHEN requested IS NOT NULL THEN requested = 'global' ELSE user_id % 2 = 0 AND value > 50 AND event_type = 'click' END THEN 'global' ELSE 'project' END AS scope
       FROM (SELECT *, ['preference', 'machine_state', 'fact'][(event_id % 3 + 1)::INT] AS claim, CASE event_id % 7 WHEN 0 THEN 'global' WHEN 1 THEN 'project' END AS requested FROM events WHERE value IS NOT NULL)""",
)
def category_and_scope(t: Tables) -> DataFrame:
    e = F.col("event_id")
    claim = F.when(e % 3 == 0, "preference").when(e % 3 == 1, "machine_state").otherwise("fact")
    requested = F.when(e % 7 == 0, "global").when(e % 7 == 1, "project")
    scope = rules.item_scope(requested, F.when(F.col("user_id") % 2 == 0, "global").otherwise("project"), F.col("value") > 50, F.when(F.col("event_type") == "click", "user_stated_rule").otherwise("none"))
    return t.events.where("value is not null").select("event_id", rules.claim_category(claim).alias("category"), scope.alias("scope"))


@query(
    "b29_origin_key",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^http://([^/]+)', 1) AS host, regexp_extract(url, '^http://[^/]+(/[^?#]*)', 1) AS path, url FROM pages WHERE regexp_matches(url, '^http://[^/:@]+/[^?#]+'))
       SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://' WHEN 1 THEN 'ssh://' WHEN 2 THEN 'https://' ELSE 'https://' END || lower(host) || CASE WHEN page_id % 4 = 3 THEN ':8443' ELSE '' END || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS origin FROM u""",
)
def origin_key(t: Tables) -> DataFrame:
    host, path = F.regexp_extract("url", r"^http://([^/]+)", 1), F.regexp_extract("url", r"^http://[^/]+/([^?#]*)", 1)
    kind = F.col("page_id") % 4
    origin = F.when(kind == 0, F.concat(F.lit("http://u:p@"), F.upper(host), F.lit(":80/"), path, F.lit(".git?x=1"))).when(kind == 1, F.concat(F.lit("git@"), host, F.lit(":"), path, F.lit(".git")))
    origin = origin.when(kind == 2, F.concat(F.lit("https://"), host, F.lit(":443/"), path, F.lit("#top"))).otherwise(F.concat(F.lit("https://"), host, F.lit(":8443/"), path))
    bare = F.col("url").rlike(r"^http://[^/:@]+/[^?#]+")
    return t.pages.where(bare).select("page_id", rules.origin_key(origin).alias("origin"))


@query("i20_file_paths", rf"SELECT page_id, list_distinct(regexp_extract_all('edit src/a' || page_id % 3 || '/b.ts, src/a' || page_id % 3 || '/b.ts and ./docs/x.md but not a.py ' || url, '{rules.FILE_PATH}')).list_sort() AS paths FROM pages")
def file_paths(t: Tables) -> DataFrame:
    n = (F.col("page_id") % 3).cast("string")
    text = F.concat(F.lit("edit src/a"), n, F.lit("/b.ts, src/a"), n, F.lit("/b.ts and ./docs/x.md but not a.py "), "url")
    return t.pages.select("page_id", F.array_sort(rules.file_paths(text)).alias("paths"))


@query("g33_identifiers", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['run_all(', 'run_all', 'pkg.mod_' || doc_id, 'camelCaseName'] WHEN 1 THEN ['SomeThing'] ELSE [] END AS names FROM documents")
def identifiers(t: Tables) -> DataFrame:
    kind, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("use camelCaseName or `(run_all()` of pkg.mod_"), n, F.lit(" and `abc`"))).when(kind == 1, "a SomeThing, SomeThing or `return`").otherwise("plain words only")
    return t.documents.select("doc_id", rules.identifiers(text).alias("names"))


@query("g16_direct_references", "SELECT conv_id, turn, n AS memory FROM (SELECT conv_id, turn, unnest(list_distinct([conv_id + 1, turn + 2])) AS n FROM conversations) WHERE n IN (SELECT doc_id FROM documents)")
def direct_references(t: Tables) -> DataFrame:
    text = F.concat(F.lit("see M:"), (F.col("conv_id") + 1).cast("string"), F.lit(" (M:"), (F.col("turn") + 2).cast("string"), F.lit("), not XM:3 or M:07"))
    asked = t.conversations.select("conv_id", "turn", F.explode(rules.references(text)).alias("memory"))
    return asked.join(t.documents.select(F.col("doc_id").alias("memory")), "memory", "left_semi").select("conv_id", "turn", "memory")


@query("i21_cursor", "SELECT o_orderkey, rtrim(translate(base64((o_orderpriority || chr(31) || o_orderkey)::BLOB), '+/', '-_'), '=') AS cursor, o_orderkey AS back FROM orders")
def cursor(t: Tables) -> DataFrame:
    made = t.orders.select("o_orderkey", rules.cursor(F.col("o_orderpriority"), F.col("o_orderkey")).alias("cursor"))
    return made.withColumn("back", rules.cursor_parts(F.col("cursor"))[1].cast("long"))


@query("f12_halved_batch", "SELECT event_id, greatest(1, floor(16 / power(2, event_id % 7)))::INT AS size FROM events")
def halved(t: Tables) -> DataFrame:
    return t.events.select("event_id", rules.halved_batch(F.col("event_id") % 7).alias("size"))


@query("i14_token_estimate", "SELECT doc_id, greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::BIGINT AS tokens FROM documents")
def tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("i17_subject_hash", """SELECT s_suppkey, sha256('{"scope":"' || CASE WHEN s_nationkey % 2 = 0 THEN 'global' ELSE 'project' END || '","body":"' || s_name || '"}') AS subject FROM supplier""")
def subject_hash(t: Tables) -> DataFrame:
    subject = F.to_json(F.struct(F.when(F.col("s_nationkey") % 2 == 0, "global").otherwise("project").alias("scope"), F.col("s_name").alias("body")))
    return t.supplier.select("s_suppkey", F.sha2(subject, 256).alias("subject"))


@query(
    "i7_due_occurrences",
    """WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS cadence, DATE '2026-07-01' + (s_suppkey % 40)::INT AS a FROM supplier),
       d AS (SELECT s_suppkey, cadence, unnest(generate_series(a, a + INTERVAL 90 DAY, INTERVAL 1 DAY))::DATE AS d FROM c)
       SELECT s_suppkey, cadence, (d + INTERVAL 19 HOUR)::VARCHAR AS due_at FROM d WHERE CASE WHEN d < DATE '2026-09-11' THEN isodow(d) = 1 AND (cadence = 'weekly' OR day(d) <= 7) WHEN cadence = 'monthly' THEN isodow(d) = 1 ELSE date_diff('day', DATE '2026-09-11', d) % 3 = 0 END""",
)
def due_occurrences(t: Tables) -> DataFrame:
    """At 19:00 of the session's time zone (UTC here)."""
    first = F.date_add(F.lit("2026-07-01").cast("date"), (F.col("s_suppkey") % 40).cast("int"))
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "weekly").otherwise("monthly").alias("cadence"), first.alias("a"))
    days = rows.select("s_suppkey", "cadence", F.explode(rules.due_dates(F.col("cadence"), F.col("a"), F.date_add("a", 90))).alias("d"))
    return days.select("s_suppkey", "cadence", F.date_format(F.col("d").cast("timestamp") + F.expr("interval 19 hours"), "yyyy-MM-dd HH:mm:ss").alias("due_at"))


@query(
    "j15_index_wait",
    """WITH s AS (SELECT event_id, ['building', 'failed', 'complete'][(event_id % 3 + 1)::INT] AS state, ts, user_id % 2 = 0 AS backlog FROM events),
       r AS (SELECT *, CASE WHEN state = 'building' THEN 'building' WHEN state = 'failed' THEN 'failure_cooldown' WHEN backlog THEN 'backlog_coalescing' ELSE 'ready' END AS reason FROM s)
       SELECT event_id, reason, CASE WHEN reason <> 'ready' THEN ts + INTERVAL 120 SECOND END AS until FROM r""",
)
def index_wait(t: Tables) -> DataFrame:
    e = F.col("event_id")
    state = F.when(e % 3 == 0, "building").when(e % 3 == 1, "failed").otherwise("complete")
    done = F.when(e % 3 != 0, F.col("ts"))
    return t.events.select("event_id", rules.index_wait(state, F.when(e % 3 == 0, F.col("ts")), done, F.col("user_id") % 2 == 0, 120).alias("w")).select("event_id", "w.reason", "w.until")


@query(
    "g9_fused_score",
    "SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 / (60 + user_id) END + 1 / (60 + event_id % 50 + 1) + CASE WHEN event_type = 'click' THEN 1 / 61 ELSE 0 END + CASE WHEN event_type = 'error' THEN 0.5 / 61 ELSE 0 END, 9) AS fused FROM events",
)
def fused(t: Tables) -> DataFrame:
    ranks = [F.when(F.col("user_id") % 3 != 0, F.col("user_id")), F.col("event_id") % 50 + 1, F.lit(None).cast("int")]
    kind = F.col("event_type")
    return t.events.select("event_id", F.round(rules.fused_score(F.col("event_id") % 9 == 0, ranks, kind == "click", kind == "error"), 9).alias("fused"))


@query(
    "g11_explicit_admission",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 50 = 0 THEN 'memory_identity' END, CASE WHEN user_id % 3 = 0 THEN 'lexical_match' END,
       CASE WHEN (event_id % 4 = 0 AND sim >= 0.82 AND margin >= 0.02) OR (sim >= 0.58 AND user_id % 3 = 0) THEN 'semantic_match' END], lambda x: x IS NOT NULL), '+') AS reasons
       FROM (SELECT *, (event_id % 100) / 100.0::DOUBLE AS sim, (event_id % 7) / 100.0::DOUBLE AS margin FROM events) WHERE event_id % 50 = 0 OR user_id % 3 = 0 OR (event_id % 4 = 0 AND sim >= 0.82 AND margin >= 0.02)""",
)
def explicit_admission(t: Tables) -> DataFrame:
    e = F.col("event_id")
    reasons = rules.explicit_admission(e % 50 == 0, F.col("user_id") % 3 == 0, e % 4 == 0, e % 100 / 100, e % 7 / 100)
    return t.events.select("event_id", reasons.alias("r")).where(F.size("r") > 0).select("event_id", F.array_join("r", "+").alias("reasons"))


@query(
    "d23_recall_stages",
    """SELECT CASE WHEN l_orderkey IS NULL THEN 'not_examined' WHEN l_linestatus = 'F' THEN 'injected' ELSE CASE l_returnflag WHEN 'A' THEN 'already_present' WHEN 'N' THEN 'local_weak' ELSE 'limit' END END AS stage, count(*) AS n
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY 1""",
)
def recall_stages(t: Tables) -> DataFrame:
    item = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "selected").otherwise("omitted").alias("outcome"), "l_returnflag")
    omission = F.when(F.col("l_returnflag") == "A", "already_present").when(F.col("l_returnflag") == "N", "weak_relevance").otherwise("item_limit")
    return t.orders.join(item, "o_orderkey", "left").groupBy(rules.recall_stage(F.col("outcome"), omission).alias("stage")).agg(F.count("*").alias("n"))


@query(
    "g32_quote_location",
    r"""WITH k AS (SELECT conv_id, role, regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g') AS body FROM conversations), q AS (SELECT conv_id, substr(arg_min(body, length(body)), 1, 50) AS needle FROM k WHERE body <> '' GROUP BY conv_id HAVING count(DISTINCT length(body)) = count(*))
       SELECT q.conv_id, CASE WHEN bool_or(role = 'user' AND contains(body, needle)) THEN 'user' WHEN bool_or(contains(body, needle)) THEN 'other' ELSE 'missing' END AS source FROM q JOIN k USING (conv_id) GROUP BY q.conv_id""",
)
def quote_location(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "role", rules.quote_key(F.coalesce("text", F.lit(""))).alias("body"))
    asked = turns.where("body <> ''").groupBy("conv_id").agg(F.min_by("body", F.length("body")).alias("b"), F.count_distinct(F.length("body")).alias("d"), F.count("*").alias("n")).where("d = n")
    held = asked.select("conv_id", F.substring("b", 1, 50).alias("needle")).join(turns, "conv_id")
    hit = F.contains("body", "needle")
    by = held.groupBy("conv_id").agg(F.bool_or((F.col("role") == "user") & hit).alias("u"), F.bool_or(hit).alias("o"))
    return by.select("conv_id", F.when(F.col("u"), "user").when(F.col("o"), "other").otherwise("missing").alias("source"))


_NAMED = """CASE p_partkey % 9 WHEN 0 THEN ' Security Policy' WHEN 1 THEN 'API contract' WHEN 2 THEN 'bug repair build' WHEN 3 THEN 'misc' WHEN 4 THEN '安全规则' WHEN 5 THEN 'architecture_contract' WHEN 6 THEN 'durable_reference' WHEN 7 THEN NULL ELSE p_type END"""
_SPOKEN = ", ".join(f"CASE WHEN coalesce(regexp_matches(lower(trim(n)), '{words}'), false) OR tag IN ({', '.join(map(repr, (*categories.TAGS[c], '')))}) THEN '{c}' END" for c, words in categories.SIGNALS.items())


@query(
    "b25_legacy_category",
    f"""SELECT p_partkey, CASE WHEN n IN ({", ".join(map(repr, (*categories.SIGNALS, categories.REST)))}) THEN n WHEN len(f) > 0 THEN array_to_string(f, ',') ELSE '{categories.REST}' END AS categories
        FROM (SELECT p_partkey, n, list_filter([{_SPOKEN}], lambda x: x IS NOT NULL) AS f FROM (SELECT p_partkey, {_NAMED} AS n, CASE p_size % 4 WHEN 0 THEN 'negation' WHEN 1 THEN 'effective_repair' WHEN 2 THEN 'other' END AS tag FROM part))""",
)
def legacy_category(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey", f"{_NAMED} AS n", "CASE p_size % 4 WHEN 0 THEN array('negation', 'other') WHEN 1 THEN array('effective_repair') WHEN 2 THEN array('other') END AS tags")
    return rows.select("p_partkey", F.array_join(categories.categories(F.col("n"), F.col("tags")), ",").alias("categories"))


_KEY = b"a key of the tests"


def _hmac_sql(message: str) -> str:
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || CAST({message} AS BLOB))))"


_SCREENED = f"""x AS (SELECT doc_id, n_chars, coalesce(text, '') || CASE doc_id % 6 WHEN 1 THEN ' Authorization: Bearer abc' || doc_id % 40 WHEN 2 THEN ' auth token Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx' || doc_id % 9 WHEN 3 THEN ' credential test_0123456789012345678901' WHEN 4 THEN ' password = hunter2hunter2' ELSE '' END AS t FROM documents),
    n AS (SELECT *, CASE WHEN regexp_matches(t, '{_RE2['CONTEXTUAL']}') THEN regexp_extract(t, '{_RE2['CONTEXTUAL']}', 1) END AS near FROM x),
    v AS (SELECT doc_id, n_chars, CASE WHEN regexp_matches(t, '{_RE2['AUTHORIZATION']}') THEN 'authorization_header' WHEN regexp_matches(t, '{_RE2['PRIVATE_KEY']}') THEN 'private_key' WHEN regexp_matches(t, '{_RE2['CREDENTIAL_FIELD']}') THEN 'credential_field' WHEN near IS NOT NULL AND {_HARMLESS} THEN 'contextual_credential' END AS category,
          CASE WHEN regexp_matches(t, '{_RE2['AUTHORIZATION']}') THEN regexp_extract(t, '{_RE2['AUTHORIZATION']}') WHEN regexp_matches(t, '{_RE2['PRIVATE_KEY']}') THEN regexp_extract(t, '{_RE2['PRIVATE_KEY']}') WHEN regexp_matches(t, '{_RE2['CREDENTIAL_FIELD']}') THEN regexp_extract(t, '{_RE2['CREDENTIAL_FIELD']}') ELSE near END AS matched FROM n)"""


def _screened(t: Tables) -> tuple[DataFrame, DataFrame]:
    kind, n = F.col("doc_id") % 6, lambda k: (F.col("doc_id") % k).cast("string")
    planted = F.when(kind == 1, F.concat(F.lit(" Authorization: Bearer abc"), n(40))).when(kind == 2, F.concat(F.lit(" auth token Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx"), n(9))).when(kind == 3, " credential test_0123456789012345678901").when(kind == 4, " password = hunter2hunter2").otherwise("")
    events = t.documents.select(F.col("doc_id").alias("event_id"), (F.col("doc_id") % 50).alias("source"), F.col("n_chars").alias("at"), F.concat(F.coalesce("text", F.lit("")), planted).alias("text"))
    return intake.credential_findings(events, _KEY)


@query(
    "j2_credential_findings",
    f"""WITH {_SCREENED}, f AS (SELECT {_hmac_sql("category || chr(0) || matched")} AS fingerprint, category, doc_id % 50 AS source, min(n_chars) AS at_ FROM v WHERE category IS NOT NULL GROUP BY ALL)
    SELECT fingerprint, CASE WHEN category = 'contextual_credential' THEN 'quarantined' ELSE 'blocked_secret' END AS state, category, min(at_) AS first_seen_at, max(at_) AS last_seen_at, count(*) AS occurrences FROM f GROUP BY fingerprint, category""",
)
def credential_findings(t: Tables) -> DataFrame:
    return _screened(t)[1]


@query("j2_kept_events", f"WITH {_SCREENED} SELECT doc_id AS event_id, doc_id % 50 AS source, n_chars AS \"at\" FROM v WHERE category IS NULL")
def kept_events(t: Tables) -> DataFrame:
    return _screened(t)[0].select("event_id", "source", "at")
