"""The corpus operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, divergence, jaccard, linededup, merkle, mix, quality, shard, tokencount, tokenfile

WORD_BPE, PIECE_BPE, BYTE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.hilbert_shards(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"))[1]


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.digest(chat.format_chats(turns.unionByName(more)))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    altered = [*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]]
    # a tampered row's leaf is that of the row with one more in n_chars
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = merkle.manifest(docs, fields, extra={"now": F.when(picked, merkle.leaf_digest(*altered))})
    rows = merkle.folded(rows.withColumn("now", F.coalesce("now", "digest")), "now")
    text = lambda c: F.lower(F.hex(c))
    return rows.select(F.col("id").alias("doc_id"), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("path").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_BPE)
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), path)
    rows = bpe.decode_documents(coded, path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_ann": op3_ann,
    "op4_shard": op4_shard,
    "op5_tokens": op5_tokens,
    "op6_mix": op6_mix,
    "op7_tokencount": op7_tokencount,
    "op8_chat": op8_chat,
    "op9_linededup": op9_linededup,
    "op10_jaccard": op10_jaccard,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_bpe": op13_bpe,
}

_WS = r"\x20\x09-\x0D"


def _leaf_sql(n_chars: str) -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: The reflected CRC-32 of a string of ASCII characters, bit by bit.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op6_mix": rf"""
WITH d AS (
  SELECT doc_id, coalesce('v' || source, 'z') AS src,
         coalesce(len(regexp_extract_all(text, '[^{_WS}]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS rk FROM d GROUP BY src),
w AS (SELECT *, [5.0, 2.0, 1.0][rk % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, row_number() OVER o AS co,
         (total - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM w
  WINDOW o AS (ORDER BY cap / weight, src), p AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, co) FROM l WHERE cap / weight >= level)), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
k AS (SELECT src, key, sum(size) AS size FROM d GROUP BY ALL),
c AS (SELECT k.src, key, sum(k.size) OVER (PARTITION BY k.src ORDER BY key ROWS UNBOUNDED PRECEDING) - k.size / 2.0 AS middle FROM k),
x AS (SELECT p.src, max(key) AS last_key FROM c JOIN p USING (src) WHERE middle <= target - whole * source_size AND target - whole * source_size > 0 GROUP BY p.src)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN key <= last_key THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p USING (src) LEFT JOIN x USING (src)""",
    "op8_chat": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(~*)(\|[A-Za-z_]{1,32}\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1~\2\3', 'g') AS et,
         regexp_replace(role, '([<\[])(~*)(\|[A-Za-z_]{1,32}\||/?s>|<SYS>>|</SYS>>|/?INST\])', '\1~\2\3', 'g') AS er,
         lag(role) OVER o IS DISTINCT FROM role AS opens, lead(role) OVER o IS DISTINCT FROM role AS closes
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(et) + CASE WHEN opens THEN 8 + length(er) + 8 ELSE 8 END + CASE WHEN closes THEN 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_linededup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[{_WS}]+|[{_WS}]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key FROM k WHERE key != '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g USING (key) GROUP BY r, doc_id""",
    "op11_merkle": f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS r, coalesce('v' || lang, '') AS tree, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql('(CAST(n_chars AS HUGEINT) + 1)')} END AS altered
  FROM documents),
p AS (SELECT r, doc_id, tree, leaf, coalesce(altered, leaf) AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
a AS (
  SELECT tree, 0 AS level, place, n, leaf AS h FROM p
  UNION ALL SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM a WHERE n > 1 GROUP BY tree, level, place // 2, n),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (
  SELECT 0 AS level, place, n, h FROM s
  UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM b WHERE n > 1 GROUP BY level, place // 2, n),
f AS (
  SELECT r, tree, 0 AS level, place, n, now AS h, '' AS proof FROM p
  UNION ALL
  SELECT f.r, f.tree, f.level + 1, f.place // 2, (f.n + 1) // 2,
         sha256(CASE WHEN f.place % 2 = 1 THEN a.h || f.h ELSE f.h || coalesce(a.h, '') END), f.proof || coalesce(a.h, '')
  FROM f LEFT JOIN a ON a.tree = f.tree AND a.level = f.level AND a.place = xor(f.place, 1) WHERE f.n > 1),
g AS (
  SELECT f.r, f.tree, 0 AS level, s.place, s.n, f.h, f.proof, s.h AS subroot FROM f JOIN s USING (tree) WHERE f.n = 1
  UNION ALL
  SELECT g.r, g.tree, g.level + 1, g.place // 2, (g.n + 1) // 2,
         sha256(CASE WHEN g.place % 2 = 1 THEN b.h || g.h ELSE g.h || coalesce(b.h, '') END), g.proof || coalesce(b.h, ''), g.subroot
  FROM g LEFT JOIN b ON b.level = g.level AND b.place = xor(g.place, 1) WHERE g.n > 1)
SELECT p.doc_id, p.leaf, g.subroot, b.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = b.h AS verified
FROM g JOIN p USING (r) JOIN b ON b.n = 1 WHERE g.n = 1""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o WHERE term != '' GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT o.lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
m AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + (1000000000 * (coalesce(c.c, 0) + 2)::HUGEINT) // (g.n + 2 * v.v)) AS p,
         (1 + (1000000000 * (k.total + 2)::HUGEINT) // (v.n + 2 * v.v)) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN m x ON x.lang = a.lang AND x.source = a.source LEFT JOIN m y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) AS rank FROM m WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, rank::INTEGER FROM terms WHERE rank <= 10""",
}
