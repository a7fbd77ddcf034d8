"""Packs over the test tables: documents are memories and their sources projects; conversations are themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import SessionPolicy
from ..operators import packs
from .registry import Tables, query

_MEMORIES = """SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN source END AS project, CASE n_chars % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'strong' ELSE 'normal' END AS tier,
    lang AS category, CASE doc_id % 10 WHEN 0 THEN 'always' WHEN 1 THEN 'never' ELSE 'auto' END AS startup, n_chars AS order_key, doc_id % 3 <> 0 AS compact_valid, n_chars % 150 + 10 AS compact_tokens,
    doc_id % 2 = 0 AS identity_valid, n_chars % 60 + 5 AS identity_tokens, CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-06-01' END AS valid_from, CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-03-01' END AS valid_until FROM documents"""


@query(
    "g24_session_pack",
    f"""WITH RECURSIVE m AS ({_MEMORIES}), r AS (SELECT DISTINCT source AS request_id, source AS project FROM documents),
    e AS (SELECT request_id, m.*, greatest(0, list_position(['critical', 'strong', 'normal'], tier) - 1 - (m.project IS NOT NULL)::INT) AS rk, (startup <> 'always')::INT AS phase FROM r JOIN m ON m.project IS NULL OR m.project = r.project
          WHERE startup <> 'never' AND coalesce(valid_from <= TIMESTAMP '2024-05-01', true) AND coalesce(valid_until >= TIMESTAMP '2024-05-01', true)),
    n AS (SELECT *, row_number() OVER (PARTITION BY request_id, phase, rk, category ORDER BY order_key, id) AS round FROM e),
    c AS (SELECT *, 24 + CASE WHEN kind = 'compact' THEN compact_tokens ELSE identity_tokens END AS tokens, row_number() OVER (PARTITION BY request_id ORDER BY phase, rk, round, category, id) AS place FROM (
          SELECT *, CASE WHEN compact_valid AND compact_tokens <= 96 THEN 'compact' WHEN rk < 2 AND identity_valid AND identity_tokens <= 48 THEN 'identity' END AS kind FROM n) WHERE kind IS NOT NULL),
    h(request_id, k, place, used, al, named) AS (
      SELECT request_id, 0, 0::BIGINT, 120::BIGINT, 0::BIGINT, 0 FROM r
      UNION ALL
      SELECT request_id, k + 1, c.place, used + c.tokens, al + CASE WHEN phase = 0 THEN c.tokens ELSE 0 END, named + (kind = 'identity')::INT FROM (
        SELECT h.*, min(c.place) AS next FROM h JOIN c USING (request_id) WHERE k < 12 AND c.place > h.place AND used + c.tokens <= 1200 AND (phase = 1 OR al + c.tokens <= 600) AND (kind <> 'identity' OR named < 4) GROUP BY ALL) x
      JOIN c USING (request_id) WHERE c.place = x.next)
    SELECT request_id, k::BIGINT - 1 AS position, id, ['critical', 'strong', 'normal'][rk + 1] AS tier, kind, tokens FROM h JOIN c USING (request_id, place)""",
)
def session_pack(t: Tables) -> DataFrame:
    """Every source starts a session on one day."""
    columns = _MEMORIES.replace("\n", " ").removeprefix("SELECT ").removesuffix(" FROM documents").split(", ")
    docs = t.documents.selectExpr(*[c.replace("TIMESTAMP '", "TIMESTAMP_NTZ '") for c in columns])
    requests = t.documents.select(F.col("source").alias("request_id"), F.col("source").alias("project"), F.lit("2024-05-01").cast("timestamp_ntz").alias("at")).distinct()
    return packs.pack_sessions(requests, docs, SessionPolicy())


#: A prompt, the messages before it in its conversation, and what their texts hold.
_EXCERPT = r"""
t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id * 1000 + turn AS prompt_id, conv_id, i, text AS prompt, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: len(w) > 1 AND NOT list_contains(['the', 'this', 'that', 'please'], w))) AS terms FROM t WHERE role = 'user'),
m AS (SELECT prompt_id, terms, prompt, p.i - t.i AS back, t.role, t.text FROM p JOIN t ON t.conv_id = p.conv_id AND t.i < p.i AND p.i - t.i <= 6),
w AS (SELECT prompt_id FROM m GROUP BY prompt_id HAVING sum(greatest(1, ceil(strlen(text) / 4)) + 10) <= 300),
o AS (SELECT *, min(back) FILTER (role = 'assistant') OVER (PARTITION BY prompt_id) AS assistant, min(back) FILTER (role = 'user') OVER (PARTITION BY prompt_id) AS users,
      list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM m),
q AS (SELECT *, unnest(parts) AS part, unnest(range(len(parts))) AS ordinal, greatest(0, coalesce(list_position(list_transform(parts, lambda x: len(regexp_replace(x, '[*\s]', '', 'g')) > 8), true), 0) - 1) AS first FROM o),
s AS (SELECT prompt_id, back AS message, ordinal, role, part AS text, greatest(1, ceil(strlen(part) / 4))::BIGINT AS tokens,
      CASE WHEN back = assistant AND regexp_matches(prompt, '(?i)recommend|propos|plan') AND regexp_matches(part, '(?i)recommend|propos|plan') THEN 0 WHEN back = assistant AND ordinal = first THEN 1 WHEN back = users AND ordinal = first THEN 2 ELSE 3 END AS priority,
      round((12.0::DOUBLE / (1 + (back - 1) * 0.65::DOUBLE) + least(3, len(list_filter(terms, lambda w: contains(lower(part), w)))) * 3 + least(2, len(regexp_extract_all(part, '`[^`\n]+`|\b[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b'))) * 1.5::DOUBLE
        + CASE WHEN regexp_matches(part, '(?i)must not|do not|only|unless') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(part, '(?i)recommend|propos|plan') THEN 4 ELSE 0 END + CASE WHEN ordinal = 0 THEN 3 ELSE 0 END) / sqrt(greatest(24, ceil(strlen(part) / 4))), 6) AS score FROM q),
u AS (SELECT *, tokens + 10 AS cost FROM s WHERE prompt_id NOT IN (SELECT prompt_id FROM w) AND tokens + 10 <= 300 QUALIFY row_number() OVER (PARTITION BY prompt_id, role, text ORDER BY priority, score DESC, message, ordinal) = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY priority, score DESC, message, ordinal) AS place FROM u)"""


@query(
    "g26_conversation_excerpt",
    rf"""WITH RECURSIVE {_EXCERPT},
    h(prompt_id, place, used) AS (
      SELECT DISTINCT prompt_id, 0::BIGINT, 0::BIGINT FROM c
      UNION ALL
      SELECT prompt_id, c.place, used + c.cost FROM (SELECT h.*, min(c.place) AS next FROM h JOIN c USING (prompt_id) WHERE c.place > h.place AND used + c.cost <= 300 GROUP BY ALL) x JOIN c USING (prompt_id) WHERE c.place = x.next),
    a AS (SELECT prompt_id, message, ordinal, text, cost AS tokens FROM h JOIN c USING (prompt_id, place) UNION ALL SELECT prompt_id, back, 0, text, greatest(1, ceil(strlen(text) / 4))::BIGINT + 10 FROM m WHERE prompt_id IN (SELECT prompt_id FROM w))
    SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY message DESC, ordinal) - 1 AS position, message, text, tokens FROM a""",
)
def excerpt(t: Tables) -> DataFrame:
    """Every prompt of a user with what stands before it in its conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = t.conversations.select("conv_id", "turn", "role", "text", place.alias("i"))
    asked = turns.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "conv_id", F.col("i").alias("at"), F.col("text").alias("prompt"))
    before = asked.select("prompt_id", "conv_id", "at").join(turns, "conv_id").where("i < at AND at - i <= 6").select("prompt_id", (F.col("at") - F.col("i")).alias("back"), "role", "text")
    return packs.conversation_excerpt(asked, before, 300)
