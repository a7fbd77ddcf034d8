"""Operators on rows small enough to read."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from recollect.functions.policy import SearchPolicy, WorkingSetPolicy
from recollect.functions.text import excerpt, headings, search_terms, statement_key, strip_tagged
from recollect.operators import candidates, intake, lifecycle, relational, retrieval, stages
from recollect.sources import snapshots
from recollect.streaming import intake as streams


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_search_terms_cut_latin_and_cjk_runs(spark):
    assert one(spark, "Use é_1 a x.y", search_terms) == ["use", "é_1", "_1", "x.y"]
    assert one(spark, "数据库", search_terms) == ["数据库", "数据", "据库"]
    assert sorted(one(spark, "sql数据", search_terms)) == sorted(["sql数据", "sql", "数据", "数据"])
    assert one(spark, None, search_terms) == []


def test_text_helpers(spark):
    assert one(spark, "Use  SQLite-WAL!", statement_key) == "usesqlitewal"
    assert one(spark, "# One #\ntext\n### Two", headings) == ["One", "Two"]
    assert one(spark, "a<p>x</p>b<p>y", lambda t: strip_tagged(t, "p")) == "ab"
    assert one(spark, "x" * 30, lambda t: excerpt(t, 15)) == "xxxxx ... xxxxx"


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([(1, "common words here"), (2, "common wal words"), (3, "common common")], "id long, text string")
    queries = spark.createDataFrame([(7, "common wal")], "query_id long, text string")
    assert [r["id"] for r in retrieval.bm25(queries, docs).orderBy("rank").collect()][0] == 2


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, since long, v string")
    got = {(r["k"], r["at"]): r["v"] for r in relational.as_of(left, right, "k", "at", "since", "v").collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_working_set_keeps_the_mandatory(spark):
    now = dt.datetime(2026, 1, 1)
    rows = [(i, "s", now - dt.timedelta(days=100 + i), i == 9, 0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, space string, last_activity timestamp, protected boolean, soft_score long")
    kept = lifecycle.working_set(df, F.lit(now), WorkingSetPolicy(5, 3, 90)).where("ranked")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 9]


def test_prefix_always_takes_the_first(spark):
    df = spark.createDataFrame([("k", 1, 100.0), ("k", 2, 1.0)], "k string, i long, size double")
    assert [r["i"] for r in relational.prefix_within(df, ["k"], ["i"], "size", 10).collect()] == [1]


def test_publish_flips_the_pointer_last(spark, tmp_path):
    root = str(tmp_path)
    snapshots.publish(spark.range(3), root, "r1")
    snapshots.publish(spark.range(5), root, "r2")
    assert snapshots.pinned(spark, root).count() == 5
    revisions = spark.createDataFrame([("r1", 1), ("r2", 2), ("r0", 0)], "revision string, built_at long")
    assert [r["revision"] for r in snapshots.retired(revisions, spark.read.parquet(f"{root}/pointer"), 1).collect()] == ["r0"]


def test_stream_drops_repeats_and_closes_sessions(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [("u", "d1", at), ("u", "d1", at + dt.timedelta(minutes=1)), ("u", "d2", at + dt.timedelta(hours=9)), ("w", "d3", at + dt.timedelta(hours=30))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "session string, dedup string, at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session string, dedup string, at timestamp").parquet(src)
    for name, frame in (("first", streams.accept_first(stream, ["dedup"])), ("sess", streams.sessions(stream))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert spark.table("first").count() == 3
    assert intake.sessions(spark.createDataFrame(rows, "session string, dedup string, at timestamp")).count() == 3
    assert {r["n"] for r in spark.table("sess").where("session = 'u'").collect()} == {1, 2}


def test_retired_only_needs_every_line_at_a_boundary(spark):
    from recollect.operators import admission

    cases = [
        (1, ["old/app.py: x", "see old/b"], ["old/"], True),
        (2, ["cold/app.py"], ["old/"], False),
        (3, ["old/a", "new/b"], ["old/"], False),
        (4, [], ["old/"], False),
        (5, ["[x]a.b+c"], ["a.b+"], True),
        (6, ["axb+c"], ["a.b+"], False),
    ]
    rows = spark.createDataFrame(cases, "id int, e array<string>, p array<string>, want boolean")
    got = {r["id"]: r["got"] for r in rows.select("id", admission.retired_only(F.col("e"), F.col("p")).alias("got")).collect()}
    assert got == {c[0]: c[3] for c in cases}


def test_unseen_and_recent_work(spark):
    from recollect.operators import admission, prompts

    rows = spark.createDataFrame([("e", 1, 1), ("e", 1, 2), ("f", 1, 1)], "epoch string, id int, revision int")
    given = spark.createDataFrame([("e", 1, 1)], "epoch string, id int, revision int")
    assert {tuple(r) for r in prompts.unseen(rows, given).collect()} == {("e", 1, 2), ("f", 1, 1)}
    # a: idle, no note; b: still busy; c: its note is as new as its work; d: two newer notes of its project; e: no prompt
    events = spark.sql(
        """SELECT session, project, timestamp(at) AS at, kind FROM VALUES ('a', 'p', '2024-01-02 00:00:00', 'prompt'), ('b', 'p', '2024-01-02 11:59:00', 'prompt'),
           ('c', 'p', '2024-01-02 03:00:00', 'prompt'), ('d', 'q', '2024-01-02 01:00:00', 'prompt'), ('e', 'p', '2024-01-02 01:00:00', 'stop') AS t(session, project, at, kind)"""
    )
    notes = spark.sql("SELECT session, project, timestamp(at) AS through_at FROM VALUES ('c', 'p', '2024-01-02 03:00:00'), ('x', 'q', '2024-01-02 02:00:00'), ('y', 'q', '2024-01-02 03:00:00') AS t(session, project, at)")
    found = admission.recent_work(events, notes, F.lit("2024-01-02 12:00:00").cast("timestamp"), 30, 7, 2)
    assert [r["session"] for r in found.collect()] == ["a"]


def test_bigram_neighbours_by_hand(spark):
    """The one query that DuckDB is too slow for on whole tables."""
    texts = {0: "Alpha beta, gamma!", 1: "alpha-beta gamma", 2: "delta", 3: "x", 4: None, 5: "Älpha bëta", 6: "alpha"}
    rows = spark.createDataFrame(list(texts.items()), "memory_id long, text string")
    got = {(r["item_id"], r["memory_id"]): r["similarity"] for r in retrieval.bigram_neighbours(rows.withColumnRenamed("memory_id", "item_id"), rows).collect()}
    key = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    grams = {i: {key(t)[k : k + 2] for k in range(len(key(t)) - 1)} for i, t in texts.items()}
    want = {}
    for i, a in grams.items():
        near = sorted(((-round(len(a & b) / len(a | b), 6), j) for j, b in grams.items() if a & b and len(a & b) / len(a | b) >= 0.08))[:5]
        want |= {(i, j): -s for s, j in near}
    assert got == want


def test_rules_take_nulls(spark):
    from recollect.functions import rules

    row = spark.createDataFrame([(None,)], "x string").select(rules.sensitivity(F.col("x")).alias("s"), rules.skip_reason(F.col("x")).alias("r"), rules.context_dependent(F.col("x")).alias("c"), rules.public_text(F.col("x")).alias("p"), rules.origin_key(F.col("x")).alias("o")).first()
    assert (row["s"]["state"], row["r"], row["c"], row["p"]["whole"], row["o"]) == ("normal", "empty_prompt", False, False, None)


def test_bm25_in_blocks_and_slices_against_a_plain_walk(spark, monkeypatch):
    rng, tables, plain = random.Random(4), [], retrieval.written
    words = [f"w{k}" for k in range(30)]
    texts = {k: None if k % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(12))) for k in range(60)}
    texts |= {k: texts[k % 5] for k in range(60, 80)}
    asked = {k: " ".join(rng.sample([*words, "unheard"], 6)) for k in range(7)}
    cut = {k: (t or "").split() for k, t in texts.items()}
    df, mean = {w: sum(w in c for c in cut.values()) for w in words}, sum(map(len, cut.values())) / len(cut)
    want = []
    for q, text in asked.items():
        terms = sorted({w for w in text.split() if df.get(w)}, key=lambda w: (df[w], w))[:4]
        weigh = lambda w, c: math.log(1 + (len(cut) - df[w] + 0.5) / (df[w] + 0.5)) * c.count(w) * 2.2 / (c.count(w) + 1.2 * (0.25 + 0.75 * len(c) / mean))
        scores = [(-round(sum(weigh(w, c) for w in terms), 6), k) for k, c in cut.items() if set(terms) & set(c)]
        want += [(q, k, -s, n + 1) for n, (s, k) in enumerate(sorted(scores))]
    monkeypatch.setattr(retrieval, "written", lambda rows, name: tables.append(plain(rows, name)) or tables[-1])
    queries, docs = spark.createDataFrame(list(asked.items()), "query_id long, text string"), spark.createDataFrame(list(texts.items()), "id long, text string")
    for most in (None, 5):
        got = retrieval.bm25(queries, docs, SearchPolicy(term_limit=4), most=most, block=3, slice_rows=16).select("query_id", "id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(w for w in want if most is None or w[3] <= most)
    # no table holds the documents' terms, only counts of those that are asked for
    assert not any("terms" in t.columns for t in tables)


def test_intake_deals_rows_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(stages, "TASK_ROWS", 50)
    new = spark.range(600).selectExpr("id AS candidate", "id % 40 AS fingerprint", "if(id % 2 = 0, 'long_term', 'uncertain') AS durability")
    evidence = spark.range(1200).selectExpr("id % 600 AS candidate", "id % 7 AS source", "id % 3 = 0 AS echo")
    tombstones = spark.range(20).selectExpr("id AS fingerprint", "id % 7 AS source")
    existing = spark.range(0).selectExpr("id AS fingerprint", "'uncertain' AS durability")
    got = candidates.intake(new, evidence, existing, tombstones)
    assert got.rdd.getNumPartitions() == 12 and got.count() == got.select("candidate").distinct().count() == 600
