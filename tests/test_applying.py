"""Applied statements against a walk through each batch."""

import random

from recollect.operators import applying


def walked(items, known, decisions):
    out = {}
    for batch in {i["batch"] for i in items}:
        mine, memory = sorted((i for i in items if i["batch"] == batch), key=lambda i: i["ordinal"]), {}
        open_ = {}
        for i in mine:
            k = known.get(i["key"])
            if i["tier"] != "inject":
                out[i["id"]] = ["review_due", k[0], "verifier"] if k and k[1] else ["skipped", None, "no_dreaming_memory_to_review"]
            elif k:
                out[i["id"]] = ["observed", k[0], "same_statement"] if k[1] else ["skipped", k[0], "rolled_back_or_archived"]
            else:
                d = decisions.get(i["id"], ("new", None, None, False, False, None))
                decision, target, item, human, loaded, merged = d
                earlier = item if item in open_ else None
                target = target or memory.get(earlier)
                direct = d[1] is not None
                if decision != "new" and loaded:
                    state, at, why = "conflict_human" if decision == "conflicts" else "duplicate_human", None, decision
                elif decision == "new" or target is None:
                    state, at, why = "written", f"new:{i['id']}", "no_merged_statement" if decision == "refines" and not (merged or "").strip() else decision
                elif human and direct or human:
                    state, at, why = "conflict_human" if decision == "conflicts" else "duplicate_human", target, decision
                elif decision == "duplicate":
                    state, at, why = "observed", target, decision
                elif decision == "refines" and not (merged or "").strip():
                    state, at, why = "written", f"new:{i['id']}", "no_merged_statement"
                else:
                    state, at, why = "revised", target, decision
                out[i["id"]] = [state, at, why]
                open_[i["id"]] = True
                if at is not None:
                    memory[i["id"]] = at
        revised = set()
        for i in mine:
            state, at, _ = out[i["id"]]
            if state != "revised":
                continue
            if not i["fits"]:
                out[i["id"]] = ["written", f"new:{i['id']}", "too_long_merged"]
            elif at in revised:
                out[i["id"]] = ["written", f"new:{i['id']}", "revised_in_batch"]
            else:
                revised.add(at)
    return sorted((k, *v) for k, v in out.items())


def test_outcomes_of_batches(spark):
    rng = random.Random(3)
    items = [{"batch": b, "ordinal": o, "id": 100 * b + o, "tier": rng.choice(["inject"] * 6 + ["review"]), "key": rng.choice([f"k{rng.randrange(20)}", f"x{rng.randrange(10**6)}", f"x{rng.randrange(10**6)}"]), "fits": rng.random() < 0.8} for b in range(5) for o in range(60)]
    known = {f"k{i}": (f"m{i}", i % 3 > 0) for i in range(15)}
    decisions = {}
    for i in items:
        if rng.random() < 0.8:
            item = 100 * i["batch"] + rng.randrange(60) if rng.random() < 0.6 else None
            target = None if item is not None else rng.choice([None, "m1", "m2", "h1"])
            decisions[i["id"]] = (rng.choice(["new", "duplicate", "refines", "conflicts", "conflicts"]), target, item, target == "h1", rng.random() < 0.1, rng.choice([None, " ", "merged"]))
    frames = (
        spark.createDataFrame([tuple(i.values()) for i in items], "batch int, ordinal int, id int, tier string, key string, fits boolean").repartition(3),
        spark.createDataFrame([(k, *v) for k, v in known.items()], "key string, memory string, active boolean"),
        spark.createDataFrame([(k, *v) for k, v in decisions.items()], "id int, decision string, target_memory string, target_item int, human boolean, loaded boolean, merged string"),
    )
    got = sorted(tuple(r) for r in applying.apply_outcomes(*frames).collect())
    want = walked(items, known, decisions)
    assert got == want and {w[1] for w in want} == {"review_due", "skipped", "observed", "conflict_human", "duplicate_human", "written", "revised"}
    assert applying.apply_outcomes(frames[0].limit(0), frames[1], frames[2]).count() == 0
