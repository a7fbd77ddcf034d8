"""Nearest vectors in blocks against plain sums over every pair."""

import math

import pytest

from recollect.operators import retrieval


def _plain(a, b):
    if a is None or b is None or len(a) != len(b) or None in b:
        return None
    norm = math.sqrt(sum(x * x for x in a))
    x = sum(x * y for x, y in zip(a, b, strict=True)) / norm * 1e6
    return math.copysign(math.floor(abs(x) + 0.5), x) / 1e6


@pytest.fixture(scope="module")
def vectors():
    rows = [(k, [((k * 7919 + j * 104729) % 201 - 100) / 100 for j in range(5)]) for k in range(120)]
    rows += [(k, [1.0, 0.5, 0.25, 0.0, 0.0]) for k in range(120, 160)]  # copies: more than k tie
    return [*rows, (160, None), (161, [1.0, 2.0]), (162, [1.0, None, 0.0, 0.0, 0.0]), (163, [0.0] * 5), (164, [])]


def _asked(vectors):
    return [(k, v) for k, v in vectors if k % 5 == 0 and v and any(v)]


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("sizes", [(4096, 8192), (7, 30)])
def test_top_is_that_of_every_pair(spark, vectors, apart, sizes):
    docs = spark.createDataFrame(vectors, "id long, vector array<float>")
    vectors = [(r["id"], r["vector"]) for r in docs.collect()]
    asked = docs.where("id % 5 = 0 OR id = 161").withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieval.cosine_top(asked, docs, 10, apart, *sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    want = {}
    for q, a in [*_asked(vectors), (161, [1.0, 2.0])]:
        every = [(d, _plain(a, b)) for d, b in vectors if not (apart and d == q)]
        want[q] = sorted(every, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:10]
    assert got == want


def test_few_pairs_leave_the_tasks(spark):
    """Of 20 queries and 2,000 rows no more than the best of each slice go on, where every pair did before."""
    docs = spark.range(2000).selectExpr("id", "array(cast(id % 37 as float), cast(1 as float)) AS vector")
    found = retrieval.cosine_top(docs.where("id < 20").withColumnRenamed("id", "query_id"), docs, 3, slice_rows=1000)
    found.write.format("noop").mode("overwrite").save()
    assert found.count() == 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("sizes", [{}, {"block": 8, "slice_rows": 40, "bins": 7}])
def test_lift_is_that_of_every_pair(spark, vectors, sizes):
    docs = spark.createDataFrame(vectors, "id long, vector array<float>")
    plain = [(r["id"], r["vector"]) for r in docs.collect()]
    got = {(r["query_id"], r["id"]): (r["similarity"], r["lift"], r["leads"]) for r in retrieval.cosine_lift(docs.where("id % 5 = 0").withColumnRenamed("id", "query_id"), docs, **sizes).collect()}
    want = {}
    for q, a in _asked(plain):
        every = [(d, _plain(a, b)) for d, b in plain]
        known = sorted(x for _, x in every if x is not None)
        middle, best = known[len(known) // 2], min((-x, d) for d, x in every if x is not None)[1]
        want |= {(q, d): (x, None if x is None else pytest.approx(round(x - middle, 7), abs=1e-9), d == best) for d, x in every}
    assert got == want
