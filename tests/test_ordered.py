"""Work along an order against plain walks: places, values carried on, cuts by two bounds, chains, batches, purge runs."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from recollect.operators import intake, ordered, purge
from recollect.sources import snapshots


def test_places_and_sums_with_a_hot_key_nulls_and_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(20), rng.choice([None, 1, 5])) for _ in range(600)]
    got = ordered.ranked(spark.createDataFrame(rows, "k string, o int, s int").repartition(5), ["k"], ["o"], ["s"]).collect()
    assert len(got) == len(rows)
    for key in ("hot", "a", None):
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(len(mine))) and [r["o"] for r in mine] == sorted(r["o"] for r in mine)
        before = 0
        for r in mine:
            assert r["before_s"] == before
            before += r["s"] or 0


def test_values_are_carried_over_tasks(spark):
    rows = [(k, i, i if i % 7 == 3 else None) for k in ("a", None) for i in range(200)]
    got = ordered.carried(spark.createDataFrame(rows, "k string, o int, v int").repartition(4), ["k"], ["o"], "v", "last").collect()
    assert all(r["last"] == ((r["o"] - 3) // 7 * 7 + 3 if r["o"] >= 3 else None) for r in got) and len(got) == 400


def plain_cut(sizes, most_rows, most_size):
    out, n, used = [], 0, 0
    for k, s in enumerate(sizes):
        if not n or n == most_rows or used + s > most_size:
            head, n, used = k, 0, 0
        out.append((k, head))
        n, used = n + 1, used + s
    return out


@pytest.mark.parametrize("most_rows", [1, 4, 64])
def test_cuts_by_rows_and_size(spark, most_rows):
    rng = random.Random(most_rows)
    keys = {"long": 300, "short": 3}
    sizes = {k: [rng.choice([0, 1, 5, 30, 200]) for _ in range(n)] for k, n in keys.items()}
    rows = [(k, i, s or None) for k, v in sizes.items() for i, s in enumerate(v)]
    got = ordered.cut_runs(spark.createDataFrame(rows, "k string, o int, s int").repartition(3), ["k"], ["o"], "s", most_rows, 100).collect()
    assert sorted((r["k"], r["place"], r["head"]) for r in got) == sorted((k, p, h) for k in keys for p, h in plain_cut(sizes[k], most_rows, 100))
    assert all(r["ordinal"] == r["place"] - r["head"] for r in got)


def test_chains_of_a_thousand_links_circles_and_lost_ends(spark):
    links = [(i, i + 1 if i < 1000 else None) for i in range(1001)] + [(2000, 2001), (2001, 2002), (2002, 2000)] + [(3000, 3001), (4000, None)]
    got = {r["id"]: (r["head"], r["steps"]) for r in ordered.chains(spark.createDataFrame(links, "id long, next long")).collect()}
    assert len(got) == len(links) and got[0] == (1000, 1000) and got[1000] == (1000, 0) and got[4000] == (4000, 0) and got[3000] == (3001, 1)
    assert got[2000] == got[2001] == got[2002] == (None, None)


def plain_batches(events, most_events, most_bytes):
    """One batch after the other, as a worker would take them."""
    left, out, count = sorted(events, key=lambda e: (e["at"], e["event_id"])), {}, {}
    while left:
        first = left[0]
        mine = [e for e in left if e["session"] == first["session"]]
        # ends count whether a batch has taken them or not
        ends = [e["at"] for e in events if e["session"] == first["session"] and e["kind"] == "SessionEnd" and e["at"] >= first["at"]]
        rows = [e for e in mine if e["at"] <= min(ends)] if ends else [e for e in mine if e["turn"] == first["turn"]]
        taken, used = [], 0
        for e in rows[:most_events]:
            if taken and used + e["bytes"] > most_bytes:
                break
            taken.append(e)
            used += e["bytes"]
        number = count.get(first["session"], 0)
        count[first["session"]] = number + 1
        projects = {e["project"] for e in taken} - {None}
        for k, e in enumerate(taken):
            out[e["event_id"]] = (first["session"], number, k, all(x["kind"] in intake.LIFECYCLE for x in taken), next(iter(projects)) if len(projects) == 1 else None)
        gone = {e["event_id"] for e in taken}
        left = [e for e in left if e["event_id"] not in gone]
    return out


def test_batches_as_a_worker_takes_them(spark):
    rng = random.Random(4)
    events = [
        {"event_id": i, "session": rng.choice(["one", "one", "two"]), "turn": rng.choice([None, 1, 2, 3]), "kind": rng.choices(["UserPromptSubmit", "SessionStart", "SessionEnd"], [20, 8, 1])[0], "at": rng.randrange(150), "bytes": rng.choice([0, 10, 60]), "project": rng.choice([None, 7, 7, 8])}
        for i in range(260)
    ]
    frame = spark.createDataFrame([tuple(e.values()) for e in events], "event_id int, session string, turn int, kind string, at int, bytes int, project int").repartition(4)
    got = {r["event_id"]: (r["session"], r["batch"], r["ordinal"], r["lifecycle_only"], r["project"]) for r in intake.batches(frame, 6, 150).collect()}
    assert got == plain_batches(events, 6, 150)
    lone = intake.batches(frame.withColumn("session", F.lit(None).cast("string")), 6, 150)
    assert lone.select("session", "batch").distinct().count() == 260
    assert intake.batches(frame.limit(0)).count() == 0


def plain_walk(rows, most_rows, most_size):
    out, used = [], 0
    for at, i, size in sorted(rows, key=lambda r: r[:2]):
        if len(out) < most_rows and used + (size or 0) <= most_size:
            out.append(i)
            used += size or 0
    return out


@pytest.mark.parametrize(("most_rows", "most_size"), [(5, 10_000), (40, 900), (1000, 500), (3, 0)])
def test_capped_walk(spark, most_rows, most_size):
    rng = random.Random(most_rows)
    rows = [(rng.randrange(50), i, rng.choice([None, 1, 40, 300, 2000])) for i in range(300)]
    got = purge.capped_walk(spark.createDataFrame(rows, "at int, id int, bytes int"), ["at", "id"], "bytes", most_rows, most_size)
    assert [r["id"] for r in got.orderBy("ordinal").collect()] == plain_walk(rows, most_rows, most_size)


def test_a_purge_run_is_taken_up_again(spark, tmp_path, monkeypatch):
    due = spark.createDataFrame([(i % 7, i, 10) for i in range(50)], "at int, id int, bytes int")
    plan = lambda: purge.capped_walk(due, ["at", "id"], "bytes", 30, 10**6)
    seen = []

    def recheck(rows):
        seen.append(1)
        return rows.select("id", "ordinal", F.when(F.col("id") % 5 == 0, "changed").otherwise("purged").alias("outcome"))

    whole = sorted(map(tuple, purge.run(plan, str(tmp_path / "a"), spark, recheck, step=7).collect()))
    assert len(whole) == 30
    root, gone = str(tmp_path / "b"), lambda: pytest.fail("the plan is made once")
    assert len(purge.run(plan, root, spark, recheck, step=7, most_steps=1).collect()) == 7
    real = purge.mark
    monkeypatch.setattr(purge, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost between the write and the mark")))
    with pytest.raises(RuntimeError):
        purge.run(gone, root, spark, recheck, step=7)
    monkeypatch.setattr(purge, "mark", real)
    assert sorted(map(tuple, purge.run(gone, root, spark, recheck, step=7).collect())) == whole
    before = len(seen)
    assert sorted(map(tuple, purge.run(gone, root, spark, recheck, step=7).collect())) == whole and len(seen) == before
    assert purge.run(lambda: plan().limit(0), str(tmp_path / "c"), spark, recheck).count() == 0


def test_of_two_writers_one_loses_and_says_so(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    snapshots.publish(spark.range(3), root, "r1")
    read, both, said = snapshots.token(spark, root), threading.Barrier(2), []
    real = snapshots._claim

    def together(*a):
        both.wait(60)
        return real(*a)

    monkeypatch.setattr(snapshots, "_claim", together)

    def write(n):
        try:
            said.append(snapshots.replace_if_changed(spark.range(n), root, read))
        except snapshots.Conflict:
            said.append("lost")

    writers = [threading.Thread(target=write, args=(n,)) for n in (5, 6)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(map(str, said)) == ["True", "lost"] and snapshots.pinned(spark, root).count() in (5, 6)
    monkeypatch.setattr(snapshots, "_claim", real)
    now = snapshots.token(spark, root)
    assert now == read + 1 and snapshots.replace_if_changed(snapshots.pinned(spark, root), root, now) is False and snapshots.token(spark, root) == now
    with pytest.raises(snapshots.Conflict):
        snapshots.replace_if_changed(spark.range(9), root, read)


def test_a_claim_that_was_given_up_is_passed_over(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    assert snapshots.exclusive(spark, f"{root}/claims/1") and not snapshots.exclusive(spark, f"{root}/claims/1")
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark.range(1), root, "r1", 0)
    monkeypatch.setattr(snapshots, "LEASE", -1.0)
    snapshots.publish(spark.range(2), root, "r2", 0)
    assert snapshots.token(spark, root) == 2 and snapshots.pinned(spark, root).count() == 2


def test_cuts_of_a_long_key_write_few_rows(spark, monkeypatch):
    rng, tables = random.Random(8), []
    sizes = {"long": [rng.choice([0, 1, 5, 30, 200]) for _ in range(20_000)], "block": [1] * 4096, "one more": [60] * 4097}
    rows = [(k, i, s) for k, v in sizes.items() for i, s in enumerate(v)]
    plain = ordered.written
    monkeypatch.setattr(ordered, "written", lambda found, name: tables.append(plain(found, name)) or tables[-1])
    got = ordered.cut_runs(spark.createDataFrame(rows, "k string, o int, s int").repartition(3), ["k"], ["o"], "s", 16, 100).collect()
    assert sorted((r["k"], r["place"], r["head"]) for r in got) == sorted((k, p, h) for k in sizes for p, h in plain_cut(sizes[k], 16, 100))
    # the rows and their order; pointers are for entries of blocks only
    assert sum(t.count() for t in tables) < 2.2 * len(rows)


def test_what_tasks_hand_on_is_a_row_each_whatever_the_keys(spark, monkeypatch):
    tables, plain = {}, ordered.written
    monkeypatch.setattr(ordered, "written", lambda found, name: tables.setdefault(name, plain(found, name)))
    rows = spark.range(2000).selectExpr("if(id < 900, 0, id div 2) AS k", "id AS o", "if(id % 50 = 0, id, null) AS v")
    got = ordered.ranked(rows, ["k"], ["o"], ["v"], "many").collect()
    assert all(r["place"] == (r["o"] if r["k"] == 0 else r["o"] % 2) for r in got) and len(got) == 2000
    got = ordered.carried(rows, ["k"], ["o"], "v", "last", "back").collect()
    assert all(r["last"] == (r["o"] // 50 * 50 if r["k"] == 0 else r["o"] - r["o"] % 2 if r["o"] % 50 < 2 else None) for r in got)
    assert tables["many-runs"].count() <= 4 and tables["back-runs"].count() <= 4


def test_batches_write_whole_rows_once_a_step(spark, monkeypatch):
    tables, plain = {}, ordered.written
    for module in (ordered, intake):
        monkeypatch.setattr(module, "written", lambda found, name: tables.setdefault(name, plain(found, name)))
    events = spark.range(3000).selectExpr("id AS event_id", "if(id % 3 = 0, 0, id) AS session", "id div 70 AS turn", "if(id % 500 = 0, 'SessionEnd', 'SessionStart') AS kind", "id div 2 AS at", "id % 90 AS bytes", "7 AS project")
    assert intake.batches(events, 6, 150).count() == 3000
    # the events along their sessions, along their groups, and cut; what numbers the batches is a row each
    long = {k: t.columns for k, t in tables.items() if t.count() >= 3000}
    assert set(long) == {"session-ends-order", "cut-places-order", "batch-events"}
    assert not {"kind", "turn", "until", "end_at"} & {*long["cut-places-order"], *long["batch-events"]}
    assert tables["batches-order"].count() == tables["batch-events"].where("ordinal = 0").count() < 3000
