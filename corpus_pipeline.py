"""The corpus pipeline: quality, near-duplicates, decontamination, mixture, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, jaccard, mix, quality, tokenfile
from recollect.llm.queries import WORD_BPE, table, tokenizer_path
from recollect.llm.workspace import let_go, materialize, scratch


#: Words whose ids a worker of the last stage remembers. The executors hold what the stages before left, and there is time.
TOKEN_CACHE_ROWS = 50_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those of docs that have labels, gives 0.5 or more.

    Null and empty texts are scored as texts of no words; rows with a null doc_id are scored but never fitted on;
    repeated rows fare alike; an empty table stays empty.
    """
    let_go(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of near-duplicates: the one with the smallest doc_id, null ids last.

    The rows are numbered first and compared by number, so that rows with a null or repeated doc_id are rows like
    others and of exact repeats one stays. Texts without words are nobody's copy: all of them stay, repeats too.
    """
    let_go(spark)
    number = "row"
    while number in (c.lower() for c in docs.columns):
        number += "_"
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    with scratch(spark):
        found = materialize(jaccard.jaccard_components(rows, id_col=number).where("n_links > 0").select(F.col("doc_id").alias("number"), "component_id"), "near-duplicates")
        ranked = rows.select(F.col(number).alias("number"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(number).alias("number")).alias("rank")).join(found, "number")
        first = ranked.groupBy("component_id").agg(F.min("rank")["number"].alias("number")).select("number")
        gone = materialize(found.select("number").join(first, "number", "left_anti"), "near-duplicates-gone", keep=True)
    return rows.join(gone, rows[number] == gone["number"], "left_anti").drop(number)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Whether a text holds one depends on the text alone, so it goes by the text's hash: rows with a null or repeated
    doc_id are judged like others. Null and empty texts hold nothing and stay; an empty table stays empty.
    """
    let_go(spark)
    named = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    with scratch(spark):
        gone = materialize(decontaminate.contaminated(named, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("hash")).distinct(), "contaminated", keep=True)
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["hash"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source of its own; null and empty texts have size 0 and are taken as often as others of their
    source; rows with equal id and text are taken alike; an empty table stays empty.
    """
    let_go(spark)
    return mix.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of what is left, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone, null ids come first, repeated rows stand each for themselves; an empty
    table gives no rows.
    """
    let_go(spark)
    return tokenfile.token_file(docs, tokenizer_path(WORD_BPE), cache_rows=TOKEN_CACHE_ROWS)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: Neither the classifier, the alignment nor the tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each one's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
