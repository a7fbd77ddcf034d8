"""Scans, joins, aggregates, windows and sets; orders stand for receipts and lineitem for their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational
from .registry import Tables, query


@query("a1_scan", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars >= 500")
def scan(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en' AND n_chars >= 500").select("doc_id", "source")


@query("a13_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name), 0.0 FROM customer WHERE c_custkey % 3 = 0")
def upsert(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return relational.upsert(old, old.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal")), "c_custkey")


@query("a14_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 33")
def keyset_page(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey > 700").orderBy("o_orderkey").limit(33).select("o_orderkey", "o_custkey")


@query("a15_bucket_pages", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 16")
def bucket_pages(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("n", F.row_number().over(w)).where("n <= 16").select("o_orderpriority", "o_orderkey")


@query("b1_scope", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'project' ELSE 'global' END AS scope FROM documents WHERE lang = 'en' OR source IN ('src0', 'src1')")
def scope(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang").eqNullSafe("en") | F.col("source").isin("src0", "src1")).select("doc_id", F.when(F.col("lang") == "en", "project").otherwise("global").alias("scope"))


@query("b2_validity", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderdate > TIMESTAMP '1998-01-01', false) AND NOT coalesce(o_orderdate + INTERVAL 90 DAY < TIMESTAMP '1998-01-01', false)")
def validity(t: Tables) -> DataFrame:
    """Valid from the order date for ninety days, both ends included."""
    at = F.lit("1998-01-01").cast("timestamp")
    outside = lambda c: ~F.coalesce(c, F.lit(False))
    return t.orders.where(outside(F.col("o_orderdate") > at) & outside(F.col("o_orderdate") + F.expr("interval 90 days") < at)).select("o_orderkey")


@query("b7_order_key", "SELECT p_partkey, concat_ws(':', CASE WHEN p_brand = 'Brand#1' THEN '0' ELSE '1' END, lpad((999999 - p_size)::VARCHAR, 6, '0'), p_partkey::VARCHAR) AS order_key FROM part")
def order_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(":", F.when(F.col("p_brand") == "Brand#1", "0").otherwise("1"), F.lpad((999999 - F.col("p_size")).cast("string"), 6, "0"), F.col("p_partkey").cast("string")).alias("order_key"))


@query("b27_null_safe", "SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def null_safe(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").where(~F.col("quality").eqNullSafe(1)).select("doc_id")


@query("b30_capacity_state", "SELECT lang, count(*) AS active, CASE WHEN count(*) >= 600 THEN 'hard_limited' WHEN count(*) > 130 THEN 'pressured' ELSE 'available' END AS state FROM documents GROUP BY lang")
def capacity(t: Tables) -> DataFrame:
    from ..operators.lifecycle import capacity_state

    return t.documents.groupBy("lang").agg(F.count("*").alias("active")).withColumn("state", capacity_state(F.col("active"), 130, 600))


@query("c1_inner", "SELECT o_orderkey, o_custkey, l_linenumber, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000")
def inner(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 100000").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "l_linenumber", "l_returnflag")


@query("c2_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("c3_broken_references", "SELECT l.doc_id FROM documents l LEFT JOIN embeddings e ON l.doc_id = e.vec_id WHERE e.vec_id IS NULL")
def broken(t: Tables) -> DataFrame:
    return relational.broken_references(t.documents, t.embeddings, "doc_id", "vec_id").select("doc_id")


@query("c4_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW')")
def semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '5-LOW'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("c5_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("c7_other_end", "SELECT CASE WHEN l_partkey % 100 = 1 THEN l_suppkey ELSE l_partkey END AS other, count(*) AS n FROM lineitem WHERE l_partkey % 100 = 1 OR l_suppkey = 1 GROUP BY 1")
def other_end(t: Tables) -> DataFrame:
    near = t.lineitem.where("l_partkey % 100 = 1 OR l_suppkey = 1")
    return near.groupBy(F.when(F.col("l_partkey") % 100 == 1, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("other")).agg(F.count("*").alias("n"))


@query("c10_after_cursor", "WITH p AS (SELECT user_id, max(ts) AS after FROM events WHERE event_type = 'signup' AND user_id % 2 = 0 GROUP BY 1) SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN p USING (user_id) WHERE p.after IS NULL OR e.ts > p.after GROUP BY 1")
def after_cursor(t: Tables) -> DataFrame:
    cursor = t.events.where("event_type = 'signup' AND user_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("after"))
    return t.events.join(cursor, "user_id", "left").where("after IS NULL OR ts > after").groupBy("user_id").agg(F.count("*").alias("n"))


@query("c11_latest_event", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("c12_first_per_key", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id")
def first_of(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("c13_fewer_newer", "SELECT o_custkey, o_orderkey FROM orders o QUALIFY count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) < 2")
def fewer_newer(t: Tables) -> DataFrame:
    """Rows with fewer than two strictly newer ones of their customer: rank counts exactly those."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"))
    return t.orders.withColumn("newer", F.rank().over(w) - 1).where("newer < 2").select("o_custkey", "o_orderkey")


@query("c14_preferred_match", "SELECT c_custkey, s_suppkey, preference FROM (SELECT c_custkey, s_suppkey, preference, row_number() OVER (PARTITION BY c_custkey ORDER BY preference, s_suppkey) AS n FROM (SELECT c_custkey, s_suppkey, 1 AS preference FROM customer JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT c_custkey, s_suppkey, 2 FROM customer JOIN supplier ON c_nationkey = s_nationkey)) WHERE n = 1")
def preferred(t: Tables) -> DataFrame:
    return relational.preferred_match(t.customer, t.supplier, [("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey")], "c_custkey", "s_suppkey")


@query("c17_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part WHERE p_size > 25) AS large")
def counts(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(t.orders, "orders").crossJoin(one(t.customer, "customers")).crossJoin(one(t.part.where("p_size > 25"), "large"))


@query("c18_as_of", "WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def as_of(t: Tables) -> DataFrame:
    views = t.events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return relational.as_of(t.events.where("event_type = 'purchase'"), views, "user_id", "ts", "ts", "view_id").select("event_id", "view_id")


@query("d1_group_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("d2_conditional_counts", "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS high, count(*) FILTER (l_quantity < 10) AS small, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS open FROM lineitem GROUP BY 1")
def conditional(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("high"), F.count_if(F.col("l_quantity") < 10).alias("small"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)), 2).alias("open"))


@query("d5_distinct_share", "WITH g AS (SELECT source, count(DISTINCT lang) AS langs, count(*) AS n FROM documents GROUP BY source) SELECT source, langs, n >= 3 AND n * 10 >= sum(n) OVER () AS covered FROM g")
def distinct_share(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.count("*").alias("n"))
    total = t.documents.agg(F.count("*").alias("total"))
    return g.join(F.broadcast(total)).select("source", "langs", ((F.col("n") >= 3) & (F.col("n") * 10 >= F.col("total"))).alias("covered"))


@query("d7_edge_degree", "SELECT node, count(*) AS degree FROM (SELECT 'p' || l_partkey AS node FROM lineitem UNION ALL SELECT 's' || l_suppkey FROM lineitem) GROUP BY node")
def edge_degree(t: Tables) -> DataFrame:
    ends = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("node")).unionByName(t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


@query("d9_having", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60 AND max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1")
def having(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("e")).where("n >= 60 AND e").select("user_id", "n")


@query("d15_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def percentiles(t: Tables) -> DataFrame:
    """Nearest rank, not interpolated."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(q * 100)}")
    return t.events.groupBy("event_type").agg(p(0.5), p(0.95), p(0.99))


@query("d16_upper_median", "SELECT user_id, CASE WHEN count(*) < 8 THEN 0.83 ELSE list_sort(list(value))[count(*) // 2 + 1] END AS median FROM events GROUP BY user_id")
def upper_median(t: Tables) -> DataFrame:
    """The discrete median from above is the upper one."""
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").alias("m"))
    return g.select("user_id", F.when(F.col("n") < 8, F.lit(0.83)).otherwise(F.col("m")).alias("median"))


@query("d19_even_sample", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id FROM r WHERE n <= 9 OR i IN (SELECT floor(k * (n - 1) / 8 + 0.5)::BIGINT FROM range(9) x(k))")
def even_sample(t: Tables) -> DataFrame:
    return relational.evenly_spaced(t.events, "event_type", "event_id", 9).select("event_type", "event_id")


@query("d20_recall", "SELECT source, round(count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality IN (0, 1)), 0), 6) AS recall FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def recall(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.round(F.count_if(F.col("quality") == 1) / F.nullif(F.count("quality"), F.lit(0)), 6).alias("recall"))


@query("d27_running_bands", "WITH r AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER w AS total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, floor(greatest(0, total - 1) / 500000)::BIGINT AS band FROM r) SELECT o_custkey, o_orderkey, band, band > coalesce(lag(band) OVER (PARTITION BY o_custkey ORDER BY total), 0) AS warned FROM b")
def running_bands(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    total = F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = t.orders.withColumn("band", F.floor(F.greatest(F.lit(0), total - 1) / 500000).cast("long"))
    return rows.select("o_custkey", "o_orderkey", "band", (F.col("band") > F.coalesce(F.lag("band").over(w), F.lit(0))).alias("warned"))


@query("e1_newest_per_group", "SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) <= 2")
def newest(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), "event_id")
    return t.events.withColumn("n", F.row_number().over(w)).where("n <= 2").select("event_type", "user_id", "event_id")


@query("e3_group_windows", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS bytes, max(ts) OVER w AS last_at FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def group_windows(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type")
    return t.events.select("event_id", F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 4).alias("bytes"), F.max("ts").over(w).alias("last_at"))


@query("e7_byte_prefix", "WITH r AS (SELECT user_id, event_id, row_number() OVER w AS position, sum(value) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, position::INT AS position FROM r WHERE total <= 200 OR position = 1")
def byte_prefix(t: Tables) -> DataFrame:
    return relational.prefix_within(t.events, ["user_id"], ["ts", "event_id"], "value", 200).select("user_id", "event_id", "position")


@query("e8_round_robin", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY rn, source)::INT AS position FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)")
def round_robin(t: Tables) -> DataFrame:
    return relational.round_robin(t.documents.select("lang", "source", "doc_id"), "lang", "source", "doc_id").select("lang", "doc_id", F.col("position").cast("int").alias("position"))


@query("e9_continuations", "WITH w AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS e FROM events), f AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY user_id ORDER BY s) = s THEN 0 ELSE 1 END AS fresh FROM w), c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s) AS chain FROM f) SELECT user_id, s, row_number() OVER (PARTITION BY user_id, chain ORDER BY s)::INT AS run FROM c")
def continuations(t: Tables) -> DataFrame:
    days = t.events.select("user_id", F.date_trunc("day", "ts").alias("s")).distinct().withColumn("e", F.col("s") + F.expr("interval 1 day"))
    return relational.islands(days, "user_id", "s", "e").select("user_id", "s", "run")


@query("e10_prompt_history", "SELECT conv_id, turn, len(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))::INT AS n, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM conversations WHERE role = 'user' QUALIFY history IS NOT NULL")
def prompt_history(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return t.conversations.where("role = 'user'").withColumn("history", F.collect_list("turn").over(w)).where(F.size("history") > 0).select("conv_id", "turn", F.size("history").alias("n"), "history")


@query("f2_priority_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 2 ELSE 1 END, o_orderdate, o_orderkey)::INT AS position FROM orders ORDER BY position LIMIT 50")
def priority_sort(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(1)
    best = t.orders.select("o_orderkey", "o_orderdate", rank.alias("r")).orderBy("r", "o_orderdate", "o_orderkey").limit(50)
    return best.select("o_orderkey", F.row_number().over(Window.orderBy("r", "o_orderdate", "o_orderkey")).alias("position"))


@query("h2_protected_ids", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_suppkey FROM supplier")
def protected(t: Tables) -> DataFrame:
    parts = [t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), t.supplier.select(F.col("s_suppkey").alias("id"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("h3_neighbourhood", "WITH c AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_suppkey = 3), n AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_partkey IN (SELECT p FROM c)) SELECT 'p' || p AS node FROM c UNION SELECT 's' || s FROM n")
def neighbourhood(t: Tables) -> DataFrame:
    changed = t.lineitem.where("l_suppkey = 3").select("l_partkey").distinct()
    near = t.lineitem.join(changed, "l_partkey", "left_semi").select(F.concat(F.lit("s"), "l_suppkey").alias("node"))
    return changed.select(F.concat(F.lit("p"), "l_partkey").alias("node")).union(near).distinct()


@query("h5_changed_keys", "SELECT * FROM ((SELECT doc_id, 'gone' AS change FROM documents WHERE doc_id % 7 <> 0 EXCEPT SELECT doc_id, 'gone' FROM documents WHERE doc_id % 5 <> 0) UNION ALL (SELECT doc_id, 'new' FROM documents WHERE doc_id % 5 <> 0 EXCEPT SELECT doc_id, 'new' FROM documents WHERE doc_id % 7 <> 0))")
def changed_keys(t: Tables) -> DataFrame:
    old, new = t.documents.where("doc_id % 7 <> 0").select("doc_id"), t.documents.where("doc_id % 5 <> 0").select("doc_id")
    return old.exceptAll(new).select("doc_id", F.lit("gone").alias("change")).unionByName(new.exceptAll(old).select("doc_id", F.lit("new").alias("change")))
