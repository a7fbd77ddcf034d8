"""Selections, reports and candidate rules over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import relational, retrieval, selection
from . import retrieval as texts
from .registry import Tables, query


@query("b4_exclusions", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber % 3 = p_size % 3 AND l_returnflag = 'A')")
def exclusions(t: Tables) -> DataFrame:
    gone = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") % 3).alias("revision"))
    return t.part.select("p_partkey", (F.col("p_size") % 3).alias("revision")).join(gone, ["p_partkey", "revision"], "left_anti").select("p_partkey")


@query("b18_confirmed", "SELECT l_orderkey, count(*) AS tags, bool_and(trim(CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'reason' END) <> '' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS confirmed FROM lineitem GROUP BY l_orderkey")
def confirmed(t: Tables) -> DataFrame:
    """Every tag of an order has a reason whose cited evidence is of an allowed class."""
    tags = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") == 7, " ").otherwise("reason").alias("reason"), F.col("l_suppkey").alias("s_suppkey"))
    held = tags.join(t.supplier.where("s_acctbal > 0").select("s_suppkey", F.lit(True).alias("allowed")), "s_suppkey", "left")
    good = (rules.strip(F.col("reason")) != "") & F.coalesce("allowed", F.lit(False))
    return held.groupBy("l_orderkey").agg(F.count("*").alias("tags"), F.bool_and(good).alias("confirmed"))


@query(
    "b24_quality_codes",
    """SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 3 = 0 THEN 'compact_unvalidated' END, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'compact_exact_repairable' END, CASE WHEN page_id % 5 = 0 THEN 'operational_provenance' END], lambda x: x IS NOT NULL), ',') AS codes FROM pages""",
)
def quality_codes(t: Tables) -> DataFrame:
    n = F.col("page_id")
    source = F.concat(F.lit("session/"), F.when(n % 5 == 0, "latency-probe").otherwise("probes"), F.lit("/1"))
    codes = F.array(F.when(n % 3 == 0, "compact_unvalidated"), F.when((n % 3 == 0) & rules.exact_compact(F.lit("short body"), F.array(F.when(n % 2 == 0, "Short ").otherwise("long"))), "compact_exact_repairable"), F.when(source.rlike(rules.PROBE_SOURCE), "operational_provenance"))
    return t.pages.select("page_id", F.array_join(F.array_compact(codes), ",").alias("codes"))


@query(
    "b28_longest_prefix",
    r"""WITH r AS (SELECT DISTINCT regexp_extract(url, '^http://[^/]+', 0) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^http://[^/]+/[^/?#]+', 0) FROM pages WHERE page_id % 2 = 0)
        SELECT page_id, (SELECT max_by(root, length(root)) FROM r WHERE root <> '' AND (url = root OR starts_with(url, root || '/'))) AS root FROM pages""",
)
def longest_prefix(t: Tables) -> DataFrame:
    one, two = F.regexp_extract("url", r"^http://[^/]+", 0), F.regexp_extract("url", r"^http://[^/]+/[^/?#]+", 0)
    roots = t.pages.select(one.alias("root")).unionByName(t.pages.where("page_id % 2 = 0").select(two.alias("root"))).where("root <> ''")
    return relational.longest_prefix(t.pages.select("page_id", "url"), "url", roots, "root").select("page_id", "root")


@query("c6_in_and_not_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderpriority NOT IN ('5-LOW', '1-URGENT')")
def in_and_not_in(t: Tables) -> DataFrame:
    low = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where(~F.col("o_orderpriority").isin("5-LOW", "1-URGENT")).join(low, "o_custkey", "left_semi").select("o_orderkey")


@query("c8_both_ends", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size % 3 = l_linenumber % 3 JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey % 2 = l_linenumber % 2")
def both_ends(t: Tables) -> DataFrame:
    left = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3).alias("lr"))
    right = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 2).alias("rr"))
    edges = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 3).alias("lr"), (F.col("l_linenumber") % 2).alias("rr"))
    return edges.join(left, ["l_partkey", "lr"]).join(right, ["l_suppkey", "rr"]).select("l_orderkey", "l_linenumber")


@query("d4_merged_sums", "SELECT event_type, user_id, count(*) AS n, count(value) AS known FROM events GROUP BY ALL")
def merged_sums(t: Tables) -> DataFrame:
    part = lambda k: t.events.where(f"event_id % 3 = {k}").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count("value").alias("known"))
    once = relational.merge_sums(part(0), part(1), ["event_type", "user_id"], ["n", "known"])
    return relational.merge_sums(once, part(2), ["event_type", "user_id"], ["n", "known"])


@query("d6_distinct_in_join", "SELECT c_custkey, count(DISTINCT o_orderpriority) AS kinds, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS any_done FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def distinct_in_join(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("any_done"))


@query(
    "d11_weighted_rollup",
    """WITH s AS (SELECT c_mktsegment AS category, o_orderpriority AS source, c_custkey AS finding, 1 AS weight FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'
       UNION ALL SELECT c_mktsegment, 'legacy_unknown', c_custkey, c_nationkey + 1 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')),
       f AS (SELECT category, source, finding, sum(weight) AS n FROM s GROUP BY ALL) SELECT category, source, count(*) AS findings, sum(n)::BIGINT AS occurrences FROM f GROUP BY ALL""",
)
def weighted_rollup(t: Tables) -> DataFrame:
    seen = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("source"), F.lit(1).cast("long").alias("weight"))
    known = t.customer.join(seen, "c_custkey").select("c_mktsegment", "source", "c_custkey", "weight")
    legacy = t.customer.join(seen, "c_custkey", "left_anti").select("c_mktsegment", F.lit("legacy_unknown").alias("source"), "c_custkey", (F.col("c_nationkey") + 1).cast("long").alias("weight"))
    per = known.unionByName(legacy).groupBy(F.col("c_mktsegment").alias("category"), "source", "c_custkey").agg(F.sum("weight").alias("n"))
    return per.groupBy("category", "source").agg(F.count("*").alias("findings"), F.sum("n").alias("occurrences"))


@query("d12_logical_requests", "SELECT coalesce(CASE WHEN user_id % 3 = 0 THEN event_type || ':' || user_id END, 'request:' || event_id) AS request, max(ts) AS at, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS succeeded FROM events GROUP BY 1")
def logical_requests(t: Tables) -> DataFrame:
    kind = F.when(F.col("user_id") % 3 == 0, F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    key = F.coalesce(kind, F.concat(F.lit("request:"), F.col("event_id").cast("string"))).alias("request")
    flag = lambda v: F.max((F.col("event_type") == v).cast("int"))
    return t.events.groupBy(key).agg(F.max("ts").alias("at"), flag("error").alias("failed"), flag("click").alias("succeeded"))


@query("d13_outcomes_with_overflow", "SELECT outcome, sum(n)::BIGINT AS n FROM (SELECT event_type AS outcome, 1 AS n FROM events UNION ALL SELECT 'error', c_nationkey FROM customer UNION ALL SELECT 'busy', 1 FROM region) GROUP BY outcome")
def outcomes(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("outcome"), F.lit(1).cast("long").alias("n"))
    more = t.customer.select(F.lit("error").alias("outcome"), F.col("c_nationkey").cast("long").alias("n")).unionByName(t.region.select(F.lit("busy").alias("outcome"), F.lit(1).cast("long").alias("n")))
    return rows.unionByName(more).groupBy("outcome").agg(F.sum("n").alias("n"))


@query("d14_space_capacity", "SELECT lang, count(*) AS durable, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS ranked, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS excluded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def space_capacity(t: Tables) -> DataFrame:
    is_ = lambda v: F.sum(F.when(F.col("quality") == v, 1).otherwise(0))
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("durable"), is_(1).alias("ranked"), is_(0).alias("excluded"))


@query("d17_stage_timings", "SELECT event_type || '.k' AS stage, quantile_disc(json_extract(props, '$.k')::DOUBLE, 0.5) AS p50, quantile_disc(json_extract(props, '$.k')::DOUBLE, 0.95) AS p95 FROM events WHERE event_id % 17 <> 0 AND json_extract(props, '$.k') IS NOT NULL GROUP BY event_type")
def stage_timings(t: Tables) -> DataFrame:
    """Rows that are not JSON are skipped."""
    raw = F.when(F.col("event_id") % 17 == 0, "not json").otherwise(F.col("props"))
    rows = t.events.select("event_type", F.explode(F.from_json(raw, "map<string,double>")).alias("k", "v")).where("v is not null")
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)").alias(f"p{int(q * 100)}")
    return rows.groupBy(F.concat_ws(".", "event_type", "k").alias("stage")).agg(p(0.5), p(0.95))


@query("d18_first_samples", "SELECT event_type, count(*) AS count, list_sort(list(event_id) FILTER (n <= 3)) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) GROUP BY event_type")
def first_samples(t: Tables) -> DataFrame:
    return relational.first_samples(t.events.select("event_type", "event_id"), ["event_type"], "event_id", 3)


@query("k33_dispositions", "WITH r AS (SELECT lang, event_type, count(*) AS n FROM events JOIN documents ON doc_id = event_id GROUP BY ALL) SELECT event_type, sum(greatest(n, length(lang) * 20))::BIGINT AS count FROM r GROUP BY event_type")
def dispositions(t: Tables) -> DataFrame:
    """Per run the larger of what was declared and what was seen, summed."""
    seen = t.events.join(t.documents.select(F.col("doc_id").alias("event_id"), "lang"), "event_id").groupBy("lang", "event_type").agg(F.count("*").alias("n"))
    return seen.groupBy("event_type").agg(F.sum(F.greatest("n", (F.length("lang") * 20).cast("long"))).alias("count"))


@query(
    "d24_ranking_quality",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events), e AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id)
       SELECT round(avg((coalesce(rank, 9999999) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(rank, 9999999) <= 10)::INT), 6) AS recall_10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM e LEFT JOIN r ON r.user_id = e.user_id AND r.event_id = e.event_id AND rank <= 50""",
)
def ranking_quality(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "event_id")
    ranked = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.row_number().over(w).alias("rank")).where("rank <= 50")
    return relational.ranking_quality(ranked, t.events.groupBy(F.col("user_id").alias("query_id")).agg(F.min("event_id").alias("id")), (1, 10))


_LEVEL = "SELECT k // 1024 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d FROM {} GROUP BY 1"


@query("d26_catalog_digest", f"WITH a AS (SELECT o_orderkey AS k, sha256(o_orderkey || ':' || o_orderpriority) AS d FROM orders), b AS ({_LEVEL.format('a')}), c AS ({_LEVEL.format('b')}), e AS ({_LEVEL.format('c')}) SELECT d AS digest FROM e")
def catalog_digest(t: Tables) -> DataFrame:
    return relational.tree_digest(t.orders, "o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority"))


@query("d28_inbox_counts", "SELECT 'pending' AS source, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'toxic', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'none', count(*) FROM region WHERE r_regionkey < 0")
def inbox_counts(t: Tables) -> DataFrame:
    sources = {"pending": t.orders.where("o_orderstatus = 'P'"), "errors": t.events.where("event_type = 'error'"), "toxic": t.labels.where("toxic = 1"), "none": t.region.where("r_regionkey < 0")}
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, rows in sources.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("d29_readiness", "SELECT sum(n)::BIGINT AS backlog, sum(n) = 0 AS ready FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 UNION ALL SELECT count(*) FROM labels WHERE toxic = 1)")
def readiness(t: Tables) -> DataFrame:
    n = t.orders.where("o_totalprice < 0").agg(F.count("*").alias("n")).unionByName(t.labels.where("toxic = 1").agg(F.count("*").alias("n")))
    return n.agg(F.sum("n").alias("backlog"), (F.sum("n") == 0).alias("ready"))


@query("d30_states_in_window", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts < TIMESTAMP '2024-01-03' GROUP BY user_id")
def states_in_window(t: Tables) -> DataFrame:
    rows = t.events.where("ts >= timestamp'2024-01-01 06:00:00' AND ts < timestamp'2024-01-03'").groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.count(F.lit(1)))
    return rows.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "error")])


@query("e2_ordinals", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders WHERE o_orderkey % 3 <> 1")
def ordinals(t: Tables) -> DataFrame:
    return relational.ordinals(t.orders.where("o_orderkey % 3 <> 1").select("o_orderkey"), "o_orderkey")


@query("k34_ordinal_page", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders) WHERE ordinal >= 150 AND ordinal < 200")
def ordinal_page(t: Tables) -> DataFrame:
    return relational.ordinals(t.orders.select("o_orderkey"), "o_orderkey").where("ordinal >= 150 AND ordinal < 200").select("o_orderkey")


@query("f3_explicit_order", "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -3) DESC, c_mktsegment = 'HOUSEHOLD' DESC, c_custkey % 2, c_custkey)::INT AS position FROM customer) WHERE position <= 16")
def explicit_order(t: Tables) -> DataFrame:
    """Score, then the own project, then human authors, then id."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc(F.round("c_acctbal", -3)), F.desc(F.col("c_mktsegment") == "HOUSEHOLD"), F.col("c_custkey") % 2, "c_custkey")
    return t.customer.select("c_nationkey", "c_custkey", F.row_number().over(w).alias("position")).where("position <= 16")


@query("f4_automatic_order", "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0 DESC, event_id % 7 DESC, value DESC NULLS LAST, event_type = 'click' DESC, event_id)::INT AS position FROM events) WHERE position <= 6")
def automatic_order(t: Tables) -> DataFrame:
    """Band, score, similarity, project before global, id."""
    e = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy(F.desc(e % 3 == 0), F.desc(e % 7), F.desc_nulls_last("value"), F.desc(F.col("event_type") == "click"), e)
    return t.events.select("user_id", "event_id", F.row_number().over(w).alias("position")).where("position <= 6")


@query("f6_bound_page", """SELECT c_custkey, c_nationkey, sha256('{"b0":"query","b1":7}') AS binding FROM customer WHERE c_nationkey < 20 OR (c_nationkey = 20 AND c_custkey > 40) ORDER BY c_nationkey DESC, c_custkey LIMIT 16""")
def bound_page(t: Tables) -> DataFrame:
    return selection.page_after(t.customer.select("c_custkey", "c_nationkey"), [F.lit("query"), F.lit(7)], ["c_nationkey", "c_custkey"], {"c_nationkey": 20, "c_custkey": 40}, 16)


@query(
    "f9_scorer_selection",
    """WITH i AS (SELECT user_id, event_id, event_id AS position, CASE WHEN event_id % 3 = 0 THEN 'weak' ELSE 'high' END AS band, coalesce(CASE WHEN event_id % 11 <> 0 THEN (event_id % 101) / 100.0::DOUBLE END, 0) AS score FROM events),
       k AS (SELECT *, row_number() OVER (PARTITION BY user_id, band ORDER BY score DESC, position) AS w FROM i WHERE CASE WHEN band = 'weak' THEN score >= 0.6 ELSE score >= 0.5 END)
       SELECT * FROM (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, position)::INT AS position, band, score FROM k WHERE band <> 'weak' OR w <= 2) WHERE position <= 6""",
)
def scorer_selection(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.events.select(F.col("user_id").alias("query_id"), e.alias("id"), e.alias("position"), F.when(e % 3 == 0, "weak").otherwise("high").alias("band"), F.when(e % 11 != 0, e % 101 / 100).alias("score"))
    return selection.scorer_selection(rows)


@query("f10_confident", "SELECT event_id FROM events WHERE event_id % 40 = 0 OR (event_type = 'click' AND coalesce((event_id % 10) / 100.0 >= 0.05 OR user_id % 5 = 0, false))")
def confident(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.where(selection.confident(e % 40 == 0, F.when(F.col("event_type") == "click", "high").otherwise("probable"), e % 10 / 100, F.col("user_id") % 5 == 0)).select("event_id")


@query(
    "f11_fitting_groups",
    """WITH RECURSIVE g AS (SELECT c_nationkey AS owner, c_custkey AS id, c_custkey % 13 + 1 AS size, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 13 DESC, c_custkey) AS pos FROM customer),
       w AS (SELECT owner, id, pos, size <= 30 AS fits, CASE WHEN size <= 30 THEN size ELSE 0 END AS used FROM g WHERE pos = 1
       UNION ALL SELECT g.owner, g.id, g.pos, w.used + g.size <= 30, w.used + CASE WHEN w.used + g.size <= 30 THEN g.size ELSE 0 END FROM w JOIN g ON g.owner = w.owner AND g.pos = w.pos + 1)
       SELECT owner, id, max(used) OVER (PARTITION BY owner)::BIGINT AS used FROM w QUALIFY fits""",
)
def fitting_groups(t: Tables) -> DataFrame:
    return selection.fitting_groups(t.customer.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") % 13 + 1).cast("long").alias("size")), 30)


@query(
    "g2_explicit_terms",
    f"""WITH src AS (SELECT item_id AS id, text FROM benchmark), {texts._TERMS}, a AS (SELECT id, term, count(*) AS tf FROM sighting GROUP BY ALL),
        b AS (SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS w FROM src) WHERE length(w) >= 2 GROUP BY ALL)
        SELECT id, term, max(tf) AS tf FROM (FROM a UNION ALL FROM b) GROUP BY ALL""",
)
def explicit_terms(t: Tables) -> DataFrame:
    return retrieval.explicit_term_counts(t.benchmark, "item_id", "text")


@query(
    "g4_automatic_bm25",
    texts._BM25.replace("ORDER BY df, term) AS r", "ORDER BY df, length(term) DESC, term) AS r").replace("r <= 64", "r <= 256") + " SELECT * FROM lex WHERE rank <= 3",
)
def automatic_bm25(t: Tables) -> DataFrame:
    return retrieval.bm25(texts._items(t), texts._memories(t), retrieval.SearchPolicy(term_limit=256), longer_first=True, most=3)


@query("g17_candidates", "SELECT user_id AS query_id, event_id % 500 AS id, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS sources FROM events GROUP BY ALL")
def candidates(t: Tables) -> DataFrame:
    kinds = ("click", "error", "purchase", "signup", "view", "scroll", "login", "logout", "search")
    named = lambda k: t.events.where(F.col("event_type") == k).select(F.col("user_id").alias("query_id"), (F.col("event_id") % 500).alias("id"))
    return selection.candidates({k: named(k) for k in kinds}).select("query_id", "id", F.array_join("sources", "+").alias("sources"))


@query(
    "g27_omissions",
    """SELECT CASE WHEN event_id % 3 = 0 THEN coalesce(known, 'weak_relevance') WHEN user_id % 4 = 0 THEN 'already_present' WHEN event_type = 'error' THEN 'post_soft_ineligible' ELSE coalesce(known, 'item_limit') END AS reason, count(*) AS n
       FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'budget_not_fit' END AS known FROM events) GROUP BY 1""",
)
def omissions(t: Tables) -> DataFrame:
    e = F.col("event_id")
    reason = selection.omission(F.when(e % 3 == 0, "weak").otherwise("high"), F.when(e % 5 == 0, "budget_not_fit"), F.col("user_id") % 4 == 0, F.col("event_type") == "error")
    return t.events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("g30_vector_reuse", "SELECT vec_id, label = vec_id % 5 AND vec_id % 2 = 0 AS reused FROM embeddings")
def vector_reuse(t: Tables) -> DataFrame:
    """A vector is reused where id, revision and text hash are those it was made of; the others are to be embedded."""
    now = t.embeddings.select("vec_id", F.sha2(F.col("label").cast("string"), 256).alias("hash"))
    old = t.embeddings.where("vec_id % 2 = 0").select("vec_id", F.sha2((F.col("vec_id") % 5).cast("string"), 256).alias("hash"), F.lit(True).alias("held"))
    return now.join(old, ["vec_id", "hash"], "left").select("vec_id", F.coalesce("held", F.lit(False)).alias("reused"))


@query(
    "j6_eligible_sessions",
    """WITH e AS (SELECT *, user_id % 3 AS project FROM events), n AS (SELECT max(ts) AS now FROM events),
       h AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS home FROM e, n WHERE user_id IN (SELECT user_id FROM events, n WHERE ts >= now - INTERVAL 7 DAY) GROUP BY user_id),
       c AS (SELECT user_id, max(ts) AS after FROM events WHERE event_id % 2 = 0 AND user_id % 5 = 0 GROUP BY user_id)
       SELECT e.user_id, min(ts) AS first_at, max(ts) AS last_at FROM e JOIN h USING (user_id) LEFT JOIN c USING (user_id), n WHERE home = 'click' AND (after IS NULL OR ts > after) GROUP BY e.user_id, now
       HAVING max(ts) >= now - INTERVAL 7 DAY AND (max(CASE WHEN event_type = 'error' THEN ts END) = max(ts) OR max(ts) <= now - INTERVAL 30 MINUTE)""",
)
def eligible_sessions(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    rows = t.events.join(F.broadcast(now))  # one row
    home = rows.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("home"), F.bool_or(F.col("ts") >= F.col("now") - F.expr("interval 7 days")).alias("recent")).where("recent AND home = 'click'").select("user_id")
    cursor = t.events.where("event_id % 2 = 0 AND user_id % 5 = 0").groupBy("user_id").agg(F.max("ts").alias("after"))
    fresh = rows.join(home, "user_id", "left_semi").join(cursor, "user_id", "left").where("after is null OR ts > after")
    by = fresh.groupBy("user_id", "now").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("ended_at"))
    return by.where("last_at >= now - interval 7 days AND (ended_at = last_at OR last_at <= now - interval 30 minutes)").select("user_id", "first_at", "last_at")


@query("k4_corroborated", "SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 2 AND count(DISTINCT o_orderdate) >= 2 AND count(DISTINCT CASE WHEN o_totalprice > 50000 THEN o_totalprice END) >= 2")
def corroborated(t: Tables) -> DataFrame:
    """Two projects, two sources and two contents at least among assessed evidence."""
    by = t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("p"), F.count_distinct("o_orderdate").alias("s"), F.count_distinct(F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice"))).alias("c"))
    return by.where("p >= 2 AND s >= 2 AND c >= 2").select("o_custkey")


@query(
    "k5_due_expirations",
    """SELECT c_custkey, max(o_orderdate) + CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN INTERVAL 180 DAY ELSE INTERVAL 90 DAY END AS due_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment
       HAVING max(o_orderdate) + CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN INTERVAL 180 DAY ELSE INTERVAL 90 DAY END <= TIMESTAMP '1999-01-01'""",
)
def due_expirations(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    days = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.expr("interval 180 days")).otherwise(F.expr("interval 90 days"))
    return t.customer.join(last, "c_custkey").select("c_custkey", (F.col("last") + days).alias("due_at")).where("due_at <= timestamp'1999-01-01'")


@query("k6_tombstones", "SELECT c_custkey FROM customer WHERE c_acctbal < 3000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def tombstones(t: Tables) -> DataFrame:
    used = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where("c_acctbal < 3000").join(used, "c_custkey", "left_anti").join(t.supplier.select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("k26_bad_cases", "SELECT event_type || ':' || user_id AS signature, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, list_sort(list(event_id) FILTER (n <= 20)) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY event_type, user_id")
def bad_cases(t: Tables) -> DataFrame:
    """The last twenty samples of each signature."""
    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = t.events.withColumn("n", F.row_number().over(w))
    by = rows.groupBy("event_type", "user_id").agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_sort(F.collect_list(F.when(F.col("n") <= 20, F.col("event_id")))).alias("samples"))
    return by.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("signature"), "occurrences", "first_seen", "last_seen", "samples")


@query(
    "l2_checks",
    """SELECT 'orphan_items' AS "check", CASE WHEN count(*) > 0 THEN 'error' ELSE 'ok' END AS severity, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
       UNION ALL SELECT 'negative_balance', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT 'unlabelled', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def checks(t: Tables) -> DataFrame:
    orphans = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    found = (("orphan_items", "error", orphans), ("negative_balance", "warning", t.customer.where("c_acctbal < 0")), ("unlabelled", "warning", t.documents.join(t.labels, "doc_id", "left_anti")))
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.when(F.col("n") > 0, level).otherwise("ok").alias("severity"), "n") for name, level, rows in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
