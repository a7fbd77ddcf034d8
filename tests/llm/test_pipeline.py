"""The pipeline's stages against brute force on a small corpus."""

import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from recollect.llm import decontaminate, jaccard, mix, quality, words
from tests.llm.test_corpus import jaccard_by_hand

ITEM = " ".join(f"item{i}" for i in range(30))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{rng.integers(3000)}" for _ in range(40)) + ".", f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, "BUY!! NOW$$ " * 30, "s1") for i in range(60)]
    base = rows[5][1]
    rows += [(200, base, "s0"), (None, base, "s0"), (201, base + " more", "s0"), (5, base, "s2"), (7, rows[8][1], "s2"), (None, None, None), (300, "", "s1"), (301, f"before {ITEM} after words", "s2"), (302, ITEM, "s1"), (None, ITEM + " again", "s1")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS row", "'x' AS `a.b`").repartition(3).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100)) for i in range(160)], "doc_id long, quality int").write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_begin_on_a_collected_heap(spark, corpus, name):
    """What the stages before left would else lie beside the workers of this one; in local mode the executor is this JVM."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    full = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus)
    assert full() > before


def test_stages_and_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.keep_quality(spark, docs, corpus)
    assert good.columns == columns
    kept = good.collect()
    assert not [r for r in kept if r["text"] and "BUY" in r["text"]] and {r["doc_id"] for r in kept} >= set(range(90))
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs.where("doc_id < 200"), spark.read.parquet(f"{corpus}/labels.parquet")).collect()}
    assert {i for i, s in scores.items() if s >= 0.5} == {r["doc_id"] for r in kept if r["doc_id"] is not None and r["doc_id"] < 200}

    once = corpus_pipeline.keep_one_of_each(spark, good, corpus)
    assert once.columns == columns
    rows = [(k, r["text"]) for k, r in enumerate(kept)]
    comp = jaccard_by_hand(rows)
    groups = {}
    for k, _ in rows:
        groups.setdefault(comp[k][1], []).append(k)
    rank = lambda k: (kept[k]["doc_id"] is None, kept[k]["doc_id"] or 0)
    want = sorted(str((kept[k]["doc_id"], kept[k]["text"])) for k in (min(g, key=rank) for g in groups.values()))
    assert sorted(str((r["doc_id"], r["text"])) for r in once.collect()) == want

    clean = corpus_pipeline.keep_uncontaminated(spark, once, corpus)
    assert clean.columns == columns
    assert sorted(str((r["doc_id"], r["text"])) for r in clean.collect()) == [s for s in want if "item7" not in s]

    mixed = corpus_pipeline.mix_sources(spark, clean, corpus)
    assert mixed.columns == columns
    taken = {(r["size"], r["doc_id"]): 0 for r in mix.mix(clean)[1].collect()}
    report = sum(r["taken"] for r in mix.mix(clean)[1].collect())
    assert report == sum(len((r["text"] or "").split()) for r in mixed.collect()) and taken

    final = corpus_pipeline.run(spark, corpus).collect()
    assert len(final) == mixed.count()
    from tokenizers import Tokenizer

    from recollect.llm.queries import WORD_BPE, tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    want = sorted(zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in mixed.collect())
    assert sorted(r["ids_crc32"] for r in final) == want


def test_stages_take_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_edited_copies_are_found(spark):
    """Recall over items of 10, 25 and 60 words with 10, 20 and 30 % of the words replaced, each in a document of its own."""
    rng = np.random.default_rng(3)
    rows, items = [], []
    for n in (10, 25, 60):
        for share in (0.1, 0.2, 0.3):
            for _ in range(15):
                item = [f"q{len(items)}_{k}" for k in range(n)]
                items.append((len(items), " ".join(item)))
                for k in rng.choice(n, int(n * share), replace=False):
                    item[k] = f"e{k}"
                rows.append((len(rows), " ".join([f"r{rng.integers(10**6)}" for _ in range(200)] + item + [f"r{rng.integers(10**6)}" for _ in range(200)]), n, share))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, share double")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(a == b for a, b in found)
    for n in (10, 25, 60):
        for share, least in ((0.1, 0.95), (0.2, 0.9), (0.3, 0.3 if n == 10 else 0.9)):
            ids = [i for i, _, m, s in rows if (m, s) == (n, share)]
            assert sum((i, i) in found for i in ids) >= least * len(ids), (n, share)


def test_prefix_and_pieces_are_bounded():
    assert jaccard.prefix_length(10) == 3 and words.PIECE_BYTES <= 1 << 20
