"""Shards: whole values part, equal texts lie together, files are skipped by their ranges, the placing by hand."""

import random
import zlib

from pyspark.sql import functions as F

from recollect.llm import shard
from recollect.llm.workspace import new_path

SCHEMA = "doc_id long, text string, lang string, source string, size long, row string, slot2 int, h int, d0 string"


def corpus(spark, n=600):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", f"copy {i % 9}", "x" * rng.randrange(400)]), rng.choice([None, "en", "fr"]), rng.choice([None, "source_001", "source_002", "source_003"]), 7, "r", 1, 2, "d") for i in range(n)]
    rows += [rows[0]] * 3 + [(None, "null id", "en", "source_001", 7, "r", 1, 2, "d")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_every_row_has_its_place(spark):
    rows, docs = corpus(spark)
    got = shard.hilbert_shards(docs, 7).collect()
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(str((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for d, t, *_ in rows)
    base, longer = divmod(len(rows), 7)
    places = sorted((r["shard"], r["slot"]) for r in got)
    assert places == [(s, k) for s in range(7) for k in range(base + (s < longer))]
    # of equal texts all lie in a row: only a cut between shards parts them
    order = [r["text_crc32"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    runs = [c for k, c in enumerate(order) if not k or order[k - 1] != c]
    assert len(runs) == len(set(order))


def test_values_that_begin_alike_part(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("https://example.org/a/"), (F.col("id") % 4).cast("string")).alias("source"))
    found = shard.hilbert_shards(docs, 4).join(docs.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert sum(r["n"] for r in found) <= 8


def test_files_and_the_reader_that_skips(spark):
    rows, docs = corpus(spark)
    out = new_path(spark, "shards")
    shard.write_shards(docs, out, 12)
    ranges = spark.read.parquet(f"{out}/ranges")
    assert ranges.count() == 12
    for within in ({"source": ("source_002", "source_002")}, {"lang": ("fr", None), "size_": (None, 100)}, {"source": ("source_009", None)}, {"size_": (50, 60)}):
        got = shard.read_shards(SCHEMA, spark, out, within)
        at = {"source": 3, "lang": 2}
        value = lambda r, c: len((r[1] or "").encode()) + 8 if c == "size_" else r[at[c]]
        want = [r for r in rows if all(value(r, c) is not None and (low is None or value(r, c) >= low) and (high is None or value(r, c) <= high) for c, (low, high) in within.items())]
        assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r[0]) for r in want), within
    few = shard.read_shards(SCHEMA, spark, out, {"source": ("source_003", "source_003"), "lang": ("fr", "fr")})
    assert few.select("shard").distinct().count() < 12
    kept = shard.read_shards(SCHEMA, spark, out, {})
    assert kept.count() == len(rows) and set(docs.columns) <= set(kept.columns)
