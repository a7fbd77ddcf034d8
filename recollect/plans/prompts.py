"""Prompt scoring, packs, admission, archive and work queries. Benchmark items are prompts, documents memories; what the
tables lack (decisions, verdicts, flags) is derived from the keys by arithmetic, the same in the SQL."""

from __future__ import annotations

from operator import mod

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import ArchivePolicy, EpochPolicy, PackPolicy, PromptPolicy
from ..functions.text import search_terms, token_estimate
from ..operators import admission, prompts, retrieval
from .registry import Tables, query
from .retrieval import _BM25, _TERMS, _items, _memories

ABSENT = 0.693147180559945  # ln 2, the weight of a term that no document has

_EVIDENCE = f"""WITH src AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark), {_TERMS},
u AS (SELECT DISTINCT id, term FROM sighting), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT term, ln(1 + n / count(*)::DOUBLE) AS weight, count(*) <= greatest(1, floor(n * 0.01)) AND length(term) >= 3 AS rare FROM u, n WHERE id LIKE 'd%' GROUP BY term, n),
q AS (SELECT id AS qid, term, coalesce(weight, {ABSENT}) AS weight, coalesce(rare, false) AS rare FROM u LEFT JOIN w USING (term) WHERE id LIKE 'q%'),
total AS (SELECT qid, sum(weight) AS total FROM q GROUP BY qid),
e AS (SELECT qid, u.id, count(*) AS matched, round(sum(weight) / any_value(total), 6) AS coverage, bool_or(rare) AS rare FROM q JOIN u USING (term) JOIN total USING (qid) WHERE u.id LIKE 'd%' GROUP BY qid, u.id)
"""


def _evidence(t: Tables) -> DataFrame:
    terms = lambda rows, key: rows.select(key, F.explode(F.array_distinct(search_terms(F.col("text")))).alias("term"))
    held = terms(_memories(t), "id")
    weights = prompts.term_weights(held, t.documents.count())
    return prompts.term_evidence(terms(_items(t), "query_id"), held, weights, ABSENT)


@query("g20_applicability", f"{_EVIDENCE} SELECT substr(qid, 2)::BIGINT AS query_id, substr(id, 2)::BIGINT AS id, matched, coverage, rare FROM e WHERE (matched >= 2 AND coverage >= 0.25) OR (rare AND coverage >= 0.15)")
def applicability(t: Tables) -> DataFrame:
    found = _evidence(t)
    return found.where(prompts.applies(F.col("matched"), F.col("coverage"), F.col("rare"))).select("query_id", "id", "matched", "coverage", "rare")


@query("g15_strong_exact", f"{_EVIDENCE} SELECT substr(qid, 2)::BIGINT AS query_id, count(*) AS n FROM e WHERE rare OR (matched >= 2 AND coverage >= 0.5) GROUP BY 1")
def exact(t: Tables) -> DataFrame:
    return _evidence(t).where(prompts.strong_exact(F.col("matched"), F.col("coverage"), F.col("rare"))).groupBy("query_id").agg(F.count("*").alias("n"))


@query(
    "g10_lexical_admission",
    r"""WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark), k AS (SELECT item_id, term, count(*) OVER (PARTITION BY item_id) AS terms FROM q WHERE length(term) > 1),
       d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents)
       SELECT item_id AS query_id, doc_id AS id, count(*) AS matched, round(count(*) / any_value(terms), 6) AS coverage FROM k JOIN d USING (term) GROUP BY ALL
       HAVING CASE WHEN any_value(terms) <= 2 THEN count(*) / any_value(terms) >= 0.5 ELSE count(*) >= 2 AND count(*) / any_value(terms) >= 0.3 END""",
)
def lexical_admission(t: Tables) -> DataFrame:
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 1))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("w")).select("query_id", F.size("w").alias("terms"), F.explode("w").alias("term"))
    held = t.documents.select(F.col("doc_id").alias("id"), F.explode(words(F.col("text"))).alias("term"))
    met = asked.join(held, "term").groupBy("query_id", "id", "terms").agg(F.count("*").alias("matched"))
    return met.where(prompts.lexical_admission(F.col("terms"), F.col("matched"))).select("query_id", "id", "matched", F.round(F.col("matched") / F.col("terms"), 6).alias("coverage"))


def _features(query_id, id_, rest=mod):
    """Of columns or of arrays, whose rest is np.fmod: that of a negative number is negative, as in SQL."""
    is_ = lambda n: rest(id_, n) == query_id
    return {"direct": is_(97), "exact": is_(31), "applicable": rest(id_, 5) == 0, "signal": is_(41), "matched": rest(id_, 4), "coverage": rest(id_, 10) / 10, "lexical_rank": rest(id_, 20) + 1}


@query(
    "g19_scored_bands",
    """WITH sim AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
       m AS (SELECT query_id, CASE WHEN count(*) >= 8 THEN list_sort(list(similarity))[count(*) // 2 + 1] ELSE 0.83 END AS m, max_by(id, (similarity, -id)) AS best FROM sim GROUP BY query_id),
       f AS (SELECT query_id, id, round(similarity - m, 7) AS lift, id = best AS leads, id % 97 = query_id AS direct, id % 31 = query_id AS exact, id % 5 = 0 AS applicable, id % 41 = query_id AS signal, id % 4 AS matched, (id % 10) / 10.0 AS coverage, id % 20 + 1 AS rank FROM sim JOIN m USING (query_id)),
       g AS (SELECT *, lift >= 0.02 AS strong, matched >= 2 AND coverage >= 0.3 AS worded FROM f),
       s AS (SELECT query_id, id, lift, (CASE WHEN direct THEN 5 ELSE 0 END + CASE WHEN exact THEN 4 ELSE 0 END
             + CASE WHEN leads AND lift >= 0.03 THEN 4 WHEN strong AND (exact OR applicable OR worded) THEN 2 WHEN lift >= 0.01 AND (exact OR applicable OR worded) THEN 1 ELSE 0 END
             + CASE WHEN matched >= 2 AND rank <= 3 AND coverage >= 0.6 THEN 2 WHEN worded AND rank <= 10 THEN 1 ELSE 0 END + signal::INT + applicable::INT)::INT AS score,
             direct OR exact OR (leads AND lift >= 0.03) OR (strong AND (applicable OR worded)) AS anchored FROM g),
       ed AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 3 = 0), near AS (SELECT DISTINCT query_id, CASE WHEN id = a THEN b ELSE a END AS id FROM s JOIN ed ON id = a OR id = b WHERE score >= 4)
       SELECT query_id, id, lift, score + (n.id IS NOT NULL AND score >= 2)::INT AS score, CASE WHEN score >= 4 THEN 'high' ELSE 'probable' END AS band, anchored
       FROM s LEFT JOIN near n USING (query_id, id) WHERE score >= 2""",
)
def bands(t: Tables) -> DataFrame:
    """Every twentieth vector as a prompt against all rows, with one hop; the band is of the score before the hop."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    # what is weak (a score below 2) gains nothing by the hop
    worth = lambda query_id, id_, lift, leads: prompts.may_reach(2, _features(query_id, id_, np.fmod), lift, leads)
    near = retrieval.cosine_lift(rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), rows, worth=worth)
    features = near.withColumns(_features(F.col("query_id"), F.col("id")))
    edges = t.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return prompts.one_hop(prompts.scored(features).where("score >= 2"), edges).select("query_id", "id", "lift", "score", "band", "anchored")


@query(
    "f7_packs",
    f"""{_BM25.replace("WITH src", "WITH RECURSIVE src")},
r AS (SELECT query_id, rank, id, CASE WHEN rank % 3 = 0 THEN 'probable' ELSE 'high' END AS band, greatest(1, ceil(strlen(text) / 4.0))::BIGINT // 4 + 1 AS tokens,
      (greatest(1, ceil(strlen(text) / 4.0))::BIGINT // 4 + 1) * 2 AS full_tokens, rank % 2 = 1 AS exact FROM lex JOIN documents ON doc_id = id WHERE rank <= 16),
w AS (SELECT query_id, 0 AS pos, 0::BIGINT AS used, 0 AS probable, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM r)
      UNION ALL SELECT w.query_id, pos + 1, used + CASE WHEN fits THEN tokens ELSE 0 END, probable + (fits AND band = 'probable')::INT, CASE WHEN fits THEN list_append(kept, id) ELSE kept END
      FROM w JOIN LATERAL (SELECT *, used + tokens <= 1024 AND len(kept) < 6 AND (band = 'high' OR probable < 2) AS fits FROM r WHERE r.query_id = w.query_id AND r.rank = w.pos + 1) x ON true),
fin AS (SELECT query_id, arg_max(kept, pos) AS kept, arg_max(used, pos) AS used FROM w GROUP BY query_id),
g AS (SELECT query_id, 0 AS pos, used, kept, []::VARCHAR[] AS kinds FROM fin
      UNION ALL SELECT g.query_id, pos + 1, used + CASE WHEN up THEN full_tokens - tokens ELSE 0 END, kept, list_append(kinds, CASE WHEN up THEN 'standard' ELSE 'compact' END)
      FROM g JOIN LATERAL (SELECT *, band = 'high' AND exact AND full_tokens <= 192 AND used + full_tokens - tokens <= 600 AS up FROM r WHERE r.query_id = g.query_id AND r.id = kept[pos + 1]) x ON true WHERE pos < len(kept)),
h AS (SELECT query_id, arg_max(used, pos) AS used, arg_max(kinds, pos) AS kinds, arg_max(kept, pos) AS kept FROM g GROUP BY query_id),
o AS (SELECT query_id, used, unnest(kept) AS id, unnest(kinds) AS kind FROM h)
SELECT o.query_id, rank AS position, o.id, kind, CASE WHEN kind = 'standard' THEN full_tokens ELSE tokens END AS tokens, used FROM o JOIN r USING (query_id, id)""",
)
def packs(t: Tables) -> DataFrame:
    found = retrieval.bm25(_items(t), _memories(t), most=16)
    size = t.documents.select(F.col("doc_id").alias("id"), (F.floor(token_estimate(F.col("text")) / 4) + 1).cast("long").alias("tokens"))
    band = F.when(F.col("rank") % 3 == 0, "probable").otherwise("high")
    ranked = found.join(size, "id").select("query_id", F.col("rank").alias("position"), "id", band.alias("band"), "tokens", (F.col("tokens") * 2).alias("full_tokens"), (F.col("rank") % 2 == 1).alias("exact"))
    return prompts.pack(ranked, PackPolicy())


@query(
    "g23_epoch_budget",
    """WITH RECURSIVE p AS (SELECT conv_id AS epoch, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::BIGINT AS tokens FROM conversations),
       w AS (SELECT epoch, 1::BIGINT AS pos, tokens, 0::BIGINT AS spent, CASE WHEN tokens > 120 THEN 'blocked' ELSE 'open' END AS state FROM p WHERE pos = 1
       UNION ALL SELECT p.epoch, p.pos, p.tokens, x.now, CASE WHEN x.now + p.tokens > 120 THEN 'blocked' WHEN x.now >= 60 THEN 'soft' ELSE 'open' END
       FROM w JOIN p ON p.epoch = w.epoch AND p.pos = w.pos + 1, LATERAL (SELECT w.spent + CASE WHEN w.state = 'blocked' THEN 0 ELSE w.tokens END AS now) x)
       SELECT epoch, pos AS ordinal, tokens, spent, state FROM w""",
)
def epoch_budget(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = t.conversations.select(F.col("conv_id").alias("epoch"), place.alias("ordinal"), token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return prompts.epoch_budget(rows, EpochPolicy(soft=60, hard=120))


_DECIDED = "list_extract(['no_memory', 'session_only', 'uncertain', 'project_memory', 'global_memory'], (event_id % 5 + 1)::INT)"


@query(
    "b19_admission_pages",
    f"""WITH d AS (SELECT event_id, user_id, {_DECIDED} AS decision, event_type = 'click' AS seen FROM events),
       a AS (SELECT *, CASE WHEN decision IN ('no_memory', 'session_only') THEN 'rejected' WHEN decision = 'uncertain' THEN 'isolated' WHEN seen THEN 'rejected' ELSE 'admitted' END AS outcome,
             CASE WHEN decision IN ('no_memory', 'session_only', 'uncertain') OR NOT seen THEN decision ELSE 'task_observation' END AS reason FROM d)
       SELECT event_id, user_id, outcome, reason, (row_number() OVER (PARTITION BY user_id, outcome ORDER BY event_id) - 1) // 64 AS page FROM a""",
)
def admissions(t: Tables) -> DataFrame:
    decision = F.element_at(F.array(*map(F.lit, ("no_memory", "session_only", "uncertain", "project_memory", "global_memory"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = t.events.withColumn("a", admission.admission(decision, F.col("event_type") == "click")).select("event_id", "user_id", "a.outcome", "a.reason")
    return admission.paged(rows, ["user_id", "outcome"], ["event_id"])


@query(
    "b21_tiers",
    """WITH x AS (SELECT event_id AS e, event_id % 29 = 0 AS retired, event_id % 2 = 0 AS explicit_user, event_id % 11 = 0 AS requested, event_id % 13 = 0 AS lasting, event_id % 17 = 0 AS catch_all,
         list_extract(['user_task_instruction', 'pasted_task_instruction', 'not_user_stated', 'user_rule'], (event_id // 2 % 4 + 1)::INT) AS support, CASE WHEN event_id % 7 = 0 THEN 'episodic' ELSE 'durable' END AS durability,
         CASE WHEN event_id % 3 = 0 THEN 'global' ELSE 'project' END AS scope, list_extract(['confirmed', 'contradicted', 'stale', 'documented', 'branch_scoped', 'unverifiable', 'plausible'], (user_id % 7 + 1)::INT) AS verdict,
         CASE WHEN event_id % 19 = 0 THEN 'notes.md' END AS documented_at, CASE WHEN event_id % 5 = 0 THEN 'topic' END AS unmerged, CASE WHEN event_id % 4 = 0 THEN 'main2' ELSE '' END AS branch, user_id % 3 AS sessions FROM events),
       r AS (SELECT *, explicit_user AND support = 'user_task_instruction' AS own FROM x)
       SELECT e AS event_id, CASE WHEN retired THEN 'drop retired_subject' WHEN durability = 'episodic' AND NOT own AND NOT lasting AND NOT requested THEN 'drop episodic' WHEN catch_all AND scope <> 'global' THEN 'drop catch_all_project'
         WHEN verdict IN ('contradicted', 'stale') THEN 'review ' || verdict WHEN verdict = 'documented' OR documented_at IS NOT NULL THEN 'drop already_in_autoloaded_docs'
         WHEN own AND NOT requested THEN CASE WHEN sessions >= 2 THEN 'inject recurring' ELSE 'pool user_task_instruction' END
         WHEN verdict = 'branch_scoped' THEN 'branch ' || coalesce(nullif(branch, ''), unmerged, 'unknown_branch') WHEN unmerged IS NOT NULL AND verdict <> 'confirmed' THEN 'branch ' || unmerged
         WHEN verdict = 'confirmed' THEN 'inject confirmed' WHEN requested THEN 'inject user_requested' WHEN explicit_user AND support = 'user_rule' THEN 'inject explicit_user'
         WHEN sessions >= 2 THEN 'inject recurring' ELSE 'pool single_session_' || verdict END AS placed FROM r""",
)
def tiers(t: Tables) -> DataFrame:
    e, pick = F.col("event_id"), lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    x = t.events.select(
        "event_id",
        (e % 29 == 0).alias("retired"),
        (e % 2 == 0).alias("explicit_user"),
        (e % 11 == 0).alias("requested"),
        (e % 13 == 0).alias("lasting"),
        (e % 17 == 0).alias("catch_all"),
        pick(("user_task_instruction", "pasted_task_instruction", "not_user_stated", "user_rule"), F.floor(e / 2) % 4).alias("support"),
        F.when(e % 7 == 0, "episodic").otherwise("durable").alias("durability"),
        F.when(e % 3 == 0, "global").otherwise("project").alias("scope"),
        pick(("confirmed", "contradicted", "stale", "documented", "branch_scoped", "unverifiable", "plausible"), F.col("user_id") % 7).alias("verdict"),
        F.when(e % 19 == 0, "notes.md").alias("documented_at"),
        F.when(e % 5 == 0, "topic").alias("unmerged_branch"),
        F.when(e % 4 == 0, "main2").otherwise("").alias("branch"),
        (F.col("user_id") % 3).alias("sessions"),
    )
    to, why = admission.tier(x)
    return x.select("event_id", F.concat_ws(" ", to, why).alias("placed"))


@query(
    "k23_extraction_merge",
    """SELECT event_type || (value::BIGINT % 50) AS "group", len(list(event_id)) AS members, list_sort(list(DISTINCT user_id)) AS sessions, bool_or(event_id % 10 = 0) AS explicit_user, min(ts) AS first_seen,
       list_sort(list(DISTINCT 'h' || event_id % 23))[1:10] AS hints, max_by(props, (length(props), -event_id)) AS detail FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def extraction_merge(t: Tables) -> DataFrame:
    rows = t.events.where("value is not null").select(
        F.concat("event_type", (F.bround("value").cast("long") % 50).cast("string")).alias("group"),
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session"),
        (F.col("event_id") % 10 == 0).alias("explicit_user"),
        F.col("ts").alias("first_seen"),
        F.array(F.concat(F.lit("h"), (F.col("event_id") % 23).cast("string"))).alias("hints"),
        F.array().cast("array<string>").alias("paths"),
        F.col("props").alias("detail"),
    )
    return admission.merged(rows).select("group", F.size("members").cast("long").alias("members"), "sessions", "explicit_user", "first_seen", "hints", "detail")


@query(
    "k17_archive_preview",
    """WITH i AS (SELECT event_id AS id, event_type AS space, event_id % 7 = 0 AS protected, event_id % 3 AS retention_rank, user_id AS priority, ts AS last_activity FROM events),
       n AS (SELECT space, count(*) AS n FROM i GROUP BY space), tot AS (SELECT count(*) AS total FROM i),
       el AS (SELECT * FROM i WHERE NOT protected AND last_activity < TIMESTAMP '2030-01-01' - INTERVAL 14 DAY),
       lo AS (SELECT el.* FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY retention_rank, priority, last_activity, id) AS nth FROM el) el JOIN n USING (space)
              WHERE space <> 'global' AND (n > 198 OR (space = 'click' AND n > 190)) AND nth <= n - 190),
       a AS (SELECT id, space FROM lo ORDER BY retention_rank, priority, last_activity, id LIMIT 50), t AS (SELECT count(*) AS taken FROM a),
       b AS (SELECT id, space, row_number() OVER (ORDER BY retention_rank, priority, last_activity, id) AS nth FROM el WHERE id NOT IN (SELECT id FROM a))
       SELECT id, space, 'space' AS pass FROM a UNION ALL SELECT id, space, 'aggregate' FROM b, t, tot WHERE total > 980 AND nth <= least(50 - taken, total - 960 - taken)""",
)
def archive(t: Tables) -> DataFrame:
    i = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("space"), (F.col("event_id") % 7 == 0).alias("protected"), (F.col("event_id") % 3).alias("retention_rank"), F.col("user_id").alias("priority"), F.col("ts").alias("last_activity"))
    policy = ArchivePolicy(space_high=198, space_target=190, total_high=980, total_target=960)
    return admission.archive_preview(i, F.lit("2030-01-01").cast("timestamp"), ["click"], policy).select("id", "space", "pass")


@query(
    "j11_due_work",
    """WITH h AS (SELECT max(ts) AS ok FROM events WHERE event_type = 'view'), w AS (SELECT event_id AS id, list_extract(['pending', 'retrying', 'processing', 'blocked', 'done'], (event_id % 5 + 1)::INT) AS state, ts AS pos,
         list_extract(['authentication', 'timeout', 'schema'], (user_id % 3 + 1)::INT) AS error, event_id // 5 % 9 AS attempts, event_id // 3 % 4 AS recoveries FROM events), n AS (SELECT max(ts) AS now FROM events)
       SELECT * FROM (SELECT id, CASE WHEN state = 'pending' THEN 'pending' WHEN state = 'retrying' AND pos + INTERVAL 1 DAY <= now THEN 'retry' WHEN state = 'processing' AND pos + INTERVAL 2 DAY < now THEN 'lease_expired'
         WHEN state = 'blocked' AND ((error = 'authentication' AND attempts >= 1) OR (error = 'timeout' AND (attempts >= 7 OR recoveries > 0))) AND recoveries < 2 AND pos <= now - INTERVAL 6 HOUR AND ok > pos THEN 'recovered' END AS why FROM w, h, n) WHERE why IS NOT NULL""",
)
def due(t: Tables) -> DataFrame:
    e, pick = F.col("event_id"), lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    work = t.events.select(
        e.alias("id"),
        pick(("pending", "retrying", "processing", "blocked", "done"), e % 5).alias("state"),
        (F.col("ts") + F.expr("interval 1 day")).alias("retry_at"),
        (F.col("ts") + F.expr("interval 2 days")).alias("lease_until"),
        pick(("authentication", "timeout", "schema"), F.col("user_id") % 3).alias("error"),
        (F.floor(e / 5) % 9).alias("attempts"),
        (F.floor(e / 3) % 4).alias("recoveries"),
        F.col("ts").alias("updated_at"),
    )
    health = t.events.where("event_type = 'view'").select(F.col("ts").alias("last_success_at"))
    now = F.lit(t.events.agg(F.max("ts")).head()[0])
    return admission.due_work(work, health, now).select("id", "why")


@query("f7_epoch_packs")
def epoch_packs(t: Tables) -> DataFrame:
    """Benchmark items as the prompts of eight epochs against all documents, from the words they share and the vectors of the
    same number to what each prompt is given; in an epoch every pack depends on those before it."""
    memories = t.documents.select(F.col("doc_id").alias("id"), "text", "source", "n_chars")
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.join(t.benchmark.select(F.col("item_id").alias("id")), "id").select(F.col("id").alias("query_id"), "vector")
    near = retrieval.cosine_lift(asked, vectors.join(memories.select("id"), "id"))
    lexical = retrieval.bm25(_items(t), _memories(t), most=128).select("query_id", "id", F.col("rank").alias("lexical_rank"))
    evidence = _evidence(t)
    met = evidence.join(lexical, ["query_id", "id"], "left").where("lexical_rank IS NOT NULL OR matched >= 2")
    exact, applicable = (f(F.col("matched"), F.col("coverage"), F.col("rare")) for f in (prompts.strong_exact, prompts.applies))
    features = met.join(near, ["query_id", "id"], "left").withColumns({"exact": exact, "applicable": applicable, "direct": F.lit(False), "signal": F.lit(False), "leads": F.coalesce("leads", F.lit(False))})
    # what is weak (a score below 2) gains nothing by the hop
    scored = prompts.one_hop(prompts.scored(features).where("score >= 2"), memories.where("id % 3 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    size = lambda n: token_estimate(F.substring(F.coalesce("text", F.lit("")), 1, n))
    tier = F.when(F.col("n_chars") % 5 == 0, "critical").when(F.col("n_chars") % 5 == 1, "strong").otherwise("normal")
    forms = memories.select("id", tier.alias("tier"), (F.col("n_chars") % 3 == 0).alias("human"), (F.col("source") == "src0").alias("own"), (F.col("n_chars") % 4 > 0).alias("compact_valid"), size(260).alias("compact_tokens"), (F.col("n_chars") % 2 == 0).alias("identity_valid"), size(90).alias("identity_tokens"), F.lit(True).alias("standard_valid"), size(640).alias("standard_tokens"))
    rows = scored.join(forms, "id").withColumns({"epoch": F.col("query_id") % 8, "prompt": F.col("query_id"), "revision": F.lit(1)})
    return prompts.epoch_packs(rows, PromptPolicy(epoch_soft=1200, epoch_hard=2400))

