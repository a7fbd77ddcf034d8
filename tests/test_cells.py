"""Cells of queries and docs: how many copies of rows cross an exchange, counts as one row, sums as in order."""

import numpy as np
import pyarrow as pa

from recollect.operators import prompts, retrieval


def test_copies_grow_with_the_tables_and_not_with_the_pairs():
    """From 50,000 to 600,000 docs a row goes to as many cells as before; beyond that blocks and slices stay in bounds."""
    for held in (50_000, 100_000, 600_000):
        blocks, slices = retrieval._cut(held // 20, held, 16384, 16384, 12)
        assert blocks * held + slices * (held // 20) < 5 * held and blocks * slices >= 96
    blocks, slices = retrieval._cut(10**6, 2 * 10**7, 16384, 16384, 12)
    assert 10**6 / blocks <= 16384 and 2 * 10**7 / slices <= 16384
    assert retrieval._cut(0, 0, 16384, 16384, 12) == (1, 1) and retrieval._cut(3, 60, 16384, 16384, 12) == (1, 1)


def test_lift_sends_few_copies_and_one_row_of_counts_a_query_and_cell(spark, monkeypatch):
    docs = spark.range(40_000).selectExpr("id", "array(cast(id % 37 as float), cast(1 as float)) AS vector")
    asked = docs.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    sent, counts, dealt, written = [], [], retrieval._dealt, retrieval.written

    def watched(*args):
        sides = dealt(*args)
        sent.append(sum(x.count() for x in sides))
        return sides

    monkeypatch.setattr(retrieval, "_dealt", watched)
    monkeypatch.setattr(retrieval, "written", lambda rows, name: counts.append(written(rows, name)) or counts[-1])
    found = retrieval.cosine_lift(asked, docs)
    assert max(sent) <= 5 * docs.count()
    assert all(c.count() <= 2000 for c in counts)
    assert found.where("query_id = 20").count() == 40_000


def test_sums_are_those_in_order():
    """What a product of matrices gives is the sum from the first component on, also where it ends in a half of a
    millionth, and for values that are not finite or so large that the order of a sum tells."""
    rng = np.random.default_rng(1)
    q, d = (rng.standard_normal((n, 64)).astype(np.float32) for n in (40, 700))
    q[0], d[:64] = np.eye(64)[0], rng.integers(-10**6, 10**6, (64, 1)) / 2e6 * np.eye(64)[0]
    d[1:5] = np.float32(0.0000005) * np.arange(1, 9, 2)[:, None]
    d[600], d[601], d[602, 3], d[603, 5], d[604] = 1e30 * d[600], 1e12 * d[601], np.inf, np.nan, 0
    norm = np.sqrt(np.square(q.astype(float)).sum(axis=1))
    lists = lambda x: pa.array(list(x), pa.list_(pa.float32()))
    got = np.full((40, 700), np.nan)
    for rows, cols, like in retrieval._products(pa.table({"q": lists(q), "norm": norm}), pa.table({"v": lists(d)})):
        got[np.ix_(rows, cols)] = like
    want = np.zeros((40, 700))
    with np.errstate(all="ignore"):
        for k in range(64):
            want += q[:, [k]].astype(float) * d[:, k].astype(float)
        want = want / norm[:, None] * 1e6
        want = np.trunc(want) + np.where(np.abs(want - np.trunc(want)) >= 0.5, np.sign(want), 0)
    want = np.where(np.isnan(want), 2e18, np.clip(want, -1e18, 1e18))
    assert (got == want).all() and not np.signbit(got[got == 0]).any()


def test_what_is_not_worth_a_row_is_weak(spark):
    """Every pair of a grid of features that `scored` gives two points or more may reach them, most others go; of lifts
    with a worth only its pairs are returned, the same as without."""
    grid = [(d, e, a, s, m, c, r, x, leads) for d in (0, 1) for e in (0, 1) for a in (0, 1) for s in (0, 1) for m in (1, 2) for c in (0.2, 0.3, 0.6) for r in (3, 10, 11) for x in (0.0, 0.01, 0.02, 0.03, float("nan"), None) for leads in (0, 1)]
    names = ["direct", "exact", "applicable", "signal", "matched", "coverage", "lexical_rank"]
    kinds = [bool, bool, bool, bool, int, float, int]
    rows = [tuple(k(v) for k, v in zip(kinds, g[:7], strict=True)) + (g[7], bool(g[8])) for g in grid]
    columns = "direct boolean, exact boolean, applicable boolean, signal boolean, matched long, coverage double, lexical_rank long, lift double, leads boolean"
    score = {tuple(map(repr, r[:9])): r["score"] for r in prompts.scored(spark.createDataFrame(rows, columns)).select(*names, "lift", "leads", "score").collect()}
    arrays = {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)}
    lift, leads = np.array([np.nan if r[7] is None else r[7] for r in rows]), np.array([r[8] for r in rows])
    may = prompts.may_reach(2, arrays, lift, leads)
    want = np.array([score[tuple(map(repr, r))] >= 2 for r in rows])
    assert may[want].all() and (may == want)[~np.isnan(lift) & ~leads].all()

    docs = spark.range(300).selectExpr("id - 5 AS id", "CASE WHEN id % 50 = 7 THEN NULL ELSE array(cast(id % 37 as float), cast(1 as float)) END AS vector")
    asked = docs.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    get = lambda f: {(r["query_id"], r["id"]): repr(r[2:]) for r in f.collect()}
    every = get(retrieval.cosine_lift(asked, docs))
    some = get(retrieval.cosine_lift(asked, docs, worth=lambda q, d, lift, leads: leads | (np.fmod(d, 7) == 0) | np.isnan(lift) & (q == 40)))
    assert some == {(q, d): v for (q, d), v in every.items() if "True" in v or d % 7 == 0 or q == 40 and "None" in v}
