"""Retrieval queries: documents are memories, lang their project, source their category; benchmark items are queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_query, statement_key, token_estimate
from ..operators import relational, retrieval
from .registry import Tables, query

_TERMS = r"""
tok AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_./:-]+')) AS t FROM src),
run AS (SELECT id, t, unnest(regexp_extract_all(t, '[a-z0-9_./:-]+')) AS r FROM tok WHERE length(t) >= 2),
sighting AS (SELECT id, t AS term FROM tok WHERE length(t) >= 2 UNION ALL SELECT id, r FROM run WHERE length(r) >= 2 AND r <> t)"""

_BM25 = f"""
WITH src AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark), {_TERMS},
tf AS (SELECT id, term, count(*) AS tf FROM sighting WHERE id LIKE 'd%' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT id AS qid, term FROM sighting WHERE id LIKE 'q%'),
qt AS (SELECT qid, term, df FROM (SELECT q.qid, term, df, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS r FROM q JOIN df USING (term)) WHERE r <= 64),
dl AS (SELECT 'd' || d.doc_id AS id, (SELECT count(*) FROM sighting s WHERE s.id = 'd' || d.doc_id) AS l FROM documents d),
c AS (SELECT count(*) AS n, avg(l) AS m FROM dl),
s AS (SELECT qid, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score
      FROM qt JOIN tf USING (term) JOIN dl USING (id), c GROUP BY qid, tf.id),
lex AS (SELECT substr(qid, 2)::BIGINT AS query_id, substr(id, 2)::BIGINT AS id, score,
        row_number() OVER (PARTITION BY qid ORDER BY score DESC, substr(id, 2)::BIGINT)::INT AS rank FROM s)"""


def _items(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _memories(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text")


@query("g1_term_counts", f"WITH src AS (SELECT item_id AS id, text FROM benchmark), {_TERMS} SELECT id, term, count(*) AS tf FROM sighting GROUP BY ALL")
def term_counts(t: Tables) -> DataFrame:
    return retrieval.term_counts(t.benchmark, "item_id", "text")


@query("retrieval_search", f"{_BM25} SELECT * FROM lex WHERE rank <= 10")
def search(t: Tables) -> DataFrame:
    return retrieval.bm25(_items(t), _memories(t), most=10)


@query(
    "g6_cosine_top",
    """SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) DESC, d.vec_id)::INT AS rank
       FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0) WHERE rank <= 10""",
)
def cosine_top(t: Tables) -> DataFrame:
    """Every twentieth vector is a query."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.cosine_top(asked, rows, 10)


@query(
    "g8_hybrid_search",
    f"""{_BM25},
sim AS (SELECT b.item_id AS query_id, d.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity
        FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id, embeddings d JOIN documents o ON o.doc_id = d.vec_id),
sem AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sim WHERE similarity > 0) WHERE rank <= 64),
f AS (SELECT query_id, id, round(coalesce(1 / (60 + l.rank), 0) + coalesce(1 / (60 + s.rank), 0), 9) AS rrf
      FROM (SELECT * FROM lex WHERE rank <= 128) l FULL JOIN sem s USING (query_id, id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id)::INT AS rank FROM f) WHERE rank <= 16""",
)
def hybrid(t: Tables) -> DataFrame:
    """An item's vector is the one with its number; semantic ranks count positive similarity only."""
    lexical = retrieval.bm25(_items(t), _memories(t), most=128)
    rows = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    semantic = retrieval.cosine_top(asked, rows, 64).where("similarity > 0")
    return retrieval.top_per_query(retrieval.fuse(lexical, semantic), "rrf", 16)


@query(
    "e5_top_and_margin",
    """WITH s AS (SELECT q.vec_id AS query_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC) AS n FROM s)
       SELECT query_id, max(similarity) FILTER (n = 1) AS top, round(max(similarity) FILTER (n = 1) - max(similarity) FILTER (n = 2), 6) AS margin FROM r GROUP BY query_id""",
)
def top_and_margin(t: Tables) -> DataFrame:
    """Every twentieth vector is a query, every other row a candidate. A query that is zero or not finite has NaN in both
    columns as far as there are candidates with a vector, one without a vector has nulls."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    best = retrieval.cosine_top(asked, rows, 2, apart=True)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("similarity")))
    found = best.groupBy("query_id").agg(F.lit(True).alias("met"), at(1).alias("top"), F.round(at(1) - at(2), 6).alias("margin"))
    every = asked.groupBy("query_id").agg(F.count("vector").alias("own")).join(found, "query_id", "left")
    totals = rows.where("id IS NOT NULL").agg(F.count("*").alias("rows"), F.count("vector").alias("vectors"))
    given = lambda c, n: F.when(F.col("met"), F.col(c)).when((F.col("own") > 0) & (F.col("vectors") - F.col("own") >= n), float("nan"))
    return every.crossJoin(F.broadcast(totals)).where("met OR rows > 1").select("query_id", given("top", 1).alias("top"), given("margin", 2).alias("margin"))


@query(
    "g5_near_duplicates",
    """SELECT l.vec_id AS left_id, r.vec_id AS right_id, round(list_dot_product(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS similarity
       FROM embeddings l JOIN embeddings r ON l.label = r.label AND l.vec_id < r.vec_id WHERE round(list_dot_product(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) >= 0.3""",
)
def near_duplicates(t: Tables) -> DataFrame:
    return retrieval.near_duplicates(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), ["label"], 0.3)


@query("g28_bigram_neighbours")
def bigram_neighbours(t: Tables) -> DataFrame:
    return retrieval.bigram_neighbours(t.benchmark.select("item_id", "text"), t.documents.select(F.col("doc_id").alias("memory_id"), "text"))


@query(
    "g12_term_weights",
    f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {_TERMS}, d AS (SELECT term, count(DISTINCT id) AS df FROM sighting GROUP BY term)
        SELECT term, df, round(ln(1 + (SELECT count(*) FROM documents) / greatest(1, df)), 6) AS weight,
               df <= greatest(1, floor(0.01 * (SELECT count(*) FROM documents))) AND length(term) >= 3 AS rare FROM d""",
)
def term_weights(t: Tables) -> DataFrame:
    """G12 and G13: document frequency, weight, and which terms are rare."""
    n = t.documents.agg(F.count("*").alias("n"))
    df = retrieval.term_counts(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n))
    rare = (F.col("df") <= F.greatest(F.lit(1), F.floor(0.01 * F.col("n")))) & (F.length("term") >= 3)
    return df.select("term", "df", F.round(F.log(1 + F.col("n") / F.greatest(F.lit(1), F.col("df"))), 6).alias("weight"), rare.alias("rare"))


@query(
    "e6_token_page",
    f"""{_BM25}, r AS (SELECT query_id, id, rank, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS tokens FROM lex JOIN documents ON id = doc_id WHERE rank <= 16),
        p AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS total FROM r)
        SELECT query_id, id, rank, tokens, total FROM p WHERE total <= 4096 OR rank = 1""",
)
def token_page(t: Tables) -> DataFrame:
    found = retrieval.bm25(_items(t), _memories(t), most=16).join(t.documents.select(F.col("doc_id").alias("id"), token_estimate(F.col("text")).alias("tokens")), "id")
    return relational.prefix_within(found, ["query_id"], ["rank"], "tokens", 4096).select("query_id", "id", "rank", "tokens", "total")


@query(
    "d25_exact_duplicates",
    r"""SELECT regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS key, lang, count(*) AS n, list_sort(list(doc_id)) AS ids FROM documents GROUP BY ALL HAVING count(*) > 1""",
)
def exact_duplicates(t: Tables) -> DataFrame:
    groups = t.documents.groupBy(normal_query(F.trim("text")).alias("key"), "lang").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return groups.where("n > 1")


@query("i3_statement_keys", r"SELECT item_id, regexp_replace(lower(text), '[\s\p{P}\p{S}]+', '', 'g') AS key FROM benchmark")
def statement_keys(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", statement_key(F.col("text")).alias("key"))


@query(
    "d22_auc",
    """WITH s AS (SELECT quality, n_chars AS score FROM labels JOIN documents USING (doc_id)),
       r AS (SELECT quality, avg(rn) OVER (PARTITION BY score) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM s))
       SELECT round((sum(rank) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM r""",
)
def auc(t: Tables) -> DataFrame:
    """Rank sums by distinct score: counts below plus half of the ties, no global order of rows."""
    return relational.area_under_curve(t.labels.join(t.documents, "doc_id"), "n_chars", "quality")


@query(
    "d21_precision_recall",
    """WITH s AS (SELECT quality, n_chars, source FROM labels JOIN documents USING (doc_id)), c AS (SELECT unnest([500, 1000, 2000, 4000]) AS threshold)
       SELECT threshold::BIGINT AS threshold, count(*) FILTER (n_chars >= threshold) AS served, round(count(*) FILTER (n_chars >= threshold AND quality = 1) / nullif(count(*) FILTER (n_chars >= threshold), 0), 6) AS precision,
              round(count(*) FILTER (n_chars >= threshold AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall,
              count(DISTINCT CASE WHEN n_chars >= threshold AND quality = 0 THEN source END) AS noisy FROM s, c GROUP BY threshold""",
)
def precision_recall(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").select("quality", "n_chars", "source", F.explode(F.array(*[F.lit(x).cast("long") for x in (500, 1000, 2000, 4000)])).alias("threshold"))
    served, good = F.col("n_chars") >= F.col("threshold"), F.col("quality") == 1
    return rows.groupBy("threshold").agg(
        F.count_if(served).alias("served"),
        F.round(F.count_if(served & good) / F.nullif(F.count_if(served), F.lit(0)), 6).alias("precision"),
        F.round(F.count_if(served & good) / F.nullif(F.count_if(good), F.lit(0)), 6).alias("recall"),
        F.count_distinct(F.when(served & ~good, F.col("source"))).alias("noisy"),
    )
