"""Components, project resolution, pages of neighbours and restored candidates against plain versions."""

import random

from recollect.operators import graphs


def plain_components(edges):
    of = {}
    for a, b in edges:
        for x in (a, b):
            of.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(of[a], of[b])
            changed |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


def test_components_of_paths_stars_and_circles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    got = {r["id"]: r["component"] for r in graphs.components(spark.createDataFrame([*edges, (None, 7), (9, 9)], "a long, b long").repartition(4)).collect()}
    assert got == {k: v for k, v in plain_components([e for e in edges if e[0] != e[1]]).items()}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_projects_by_shared_evidence(spark):
    rows = [(i, "path", f"/w/{i // 3}") for i in range(12)] + [(i, "name", "common") for i in (20, 21, 22)] + [(20, "origin", "x"), (2, "origin", "x"), (40, "origin", None), (41, "path", "/own"), (41, "path", "/own")]
    named, collisions = graphs.resolve_projects(spark.createDataFrame(rows, "project long, kind string, value string"))
    got = {r["project"]: (r["resolved"], r["members"]) for r in named.collect()}
    pieces = {}
    for p, k, v in rows:
        if v is not None:
            pieces.setdefault((k, v), set()).add(p)
    of = plain_components([(min(s), p) for s in pieces.values() for p in s])
    assert got == {p: (c, sum(x == c for x in of.values())) for p, c in of.items()} and got[20] == (0, 6)
    told = {(r["kind"], r["value"]): (r["projects"], r["resolved"], r["ambiguous"]) for r in collisions.collect()}
    counts = {p: sum(p in s for s in pieces.values()) for p in of}
    assert told == {k: (len(s), of[min(s)], any(counts[p] == 1 for p in s)) for k, s in pieces.items() if len(s) > 1}
    assert not told["origin", "x"][2] and told["name", "common"][2]


def test_related_pages(spark):
    rng = random.Random(3)
    edges = [(rng.choice([0, 0, 0, 1, 2, None]), rng.randrange(40), rng.choice("ab")) for _ in range(300)] + [(0, 0, "self")]
    docs = {i: (i % 5 == 0, rng.choice([None, "p", "q"]), rng.choice([1, 9, 40, 300])) for i in range(38)}
    asked = {0: "p", 1: None, 99: "p"}
    for direction in ("both", "outgoing", "incoming"):
        frame = graphs.related(spark.createDataFrame(list(asked.items()), "id long, project string"), spark.createDataFrame(edges, "source long, target long, type string"), spark.createDataFrame([(i, *d) for i, d in docs.items()], "id long, private boolean, project string, tokens long"), direction, 4, 50)
        got = sorted((r["asked"], r["page"], r["ordinal"], r["type"], r["id"], r["direction"]) for r in frame.collect())
        want = []
        for me, project in asked.items():
            mine = [(t, b, "outgoing") for a, b, t in edges if a == me and direction != "incoming"] + [(t, a, "incoming") for a, b, t in edges if b == me and a != me and a is not None and direction != "outgoing"]
            page = ordinal = used = 0
            for n, (t, other, way) in enumerate(sorted(x for x in mine if x[1] in docs and (not docs[x[1]][0] or docs[x[1]][1] in (None, project)))):
                size = docs[other][2]
                if n and (ordinal == 4 or used + size > 50):
                    page, ordinal, used = page + 1, 0, 0
                want.append((me, page, ordinal, t, other, way))
                ordinal, used = ordinal + 1, used + size
        assert got == sorted(want)


def test_restored_as_a_walk_would(spark):
    rng = random.Random(6)
    rows = [(s, i, 100 * s + i, rng.choice([None, f" st{rng.randrange(30)} "]), rng.choice([None, [], [rng.randrange(40), rng.randrange(40)], [7]]), rng.randrange(3)) for s in range(4) for i in range(90)]
    there, covered, explicit = [(s, f"st{s}") for s in range(4)], [(s, s) for s in range(3)], [(s, e) for s in range(4) for e in range(0, 40, 3)]
    want = []
    for s in range(4):
        statements, taken = {x for k, x in there if k == s}, {e for k, e in covered if k == s}
        for _, i, name, statement, evidence, signals in [r for r in rows if r[0] == s]:
            mine, own = (statement or "").strip(), set(evidence or [])
            if signals < 2 and not any((s, e) in explicit for e in own):
                continue
            if (statement and mine in statements) or own & taken:
                continue
            want.append((s, i, name))
            statements |= {mine} if statement else set()
            taken |= own
    frame = spark.createDataFrame(rows, "session int, ordinal int, id int, statement string, evidence array<int>, signals int").repartition(3)
    got = graphs.restore_unrepresented(frame, spark.createDataFrame(there, "session int, statement string"), spark.createDataFrame(covered, "session int, evidence int"), spark.createDataFrame(explicit, "session int, evidence int"))
    assert sorted(map(tuple, got.collect())) == want and 40 < len(want) < 360
