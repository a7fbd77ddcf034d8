"""Session packs and conversation excerpts against plain walks."""

import random
import re

from recollect.functions.policy import ExcerptPolicy, SessionPolicy
from recollect.operators import packs

DOCS = "id int, project string, tier string, category string, startup string, order_key int, compact_valid boolean, compact_tokens int, identity_valid boolean, identity_tokens int, valid_from int, valid_until int"


def walked(project, at, docs, p):
    """Always first, tier by tier, one of each category in turn, each that fits."""
    out, used, always, named = [], p.header_tokens, 0, 0
    for startup in ("always", "auto"):
        for rank, _ in enumerate(packs.TIERS):
            mine = [d for d in docs if d["startup"] == startup and d["project"] in (None, project) and (d["valid_from"] or 0) <= at <= (d["valid_until"] or 10**9) and max(0, packs.TIERS.index(d["tier"]) - (d["project"] is not None)) == rank]
            lists = {}
            for d in sorted(mine, key=lambda d: (d["category"], d["order_key"], d["id"])):
                lists.setdefault(d["category"], []).append(d)
            while any(lists.values()):
                for category in sorted(lists):
                    if not lists[category]:
                        continue
                    d = lists[category].pop(0)
                    kind = "compact" if d["compact_valid"] and d["compact_tokens"] <= p.compact_limit else "identity" if rank < 2 and d["identity_valid"] and d["identity_tokens"] <= p.identity_limit else None
                    if kind is None:
                        continue
                    cost = p.item_tokens + d[f"{kind}_tokens"]
                    if len(out) < p.items and used + cost <= p.tokens and (startup == "auto" or always + cost <= p.always_tokens) and (kind == "compact" or named < p.identities):
                        out.append((d["id"], kind, cost))
                        used, always, named = used + cost, always + cost * (startup == "always"), named + (kind == "identity")
    return out


def test_session_packs(spark):
    rng = random.Random(8)
    docs = [
        {"id": i, "project": rng.choice([None, "p", "p", "q"]), "tier": rng.choice(packs.TIERS), "category": rng.choice("xyz"), "startup": rng.choice(["always", "auto", "auto", "never", None]), "order_key": rng.randrange(30),
         "compact_valid": rng.random() < 0.6, "compact_tokens": rng.randrange(5, 130), "identity_valid": rng.random() < 0.7, "identity_tokens": rng.randrange(5, 60), "valid_from": rng.choice([None, 5, 20]), "valid_until": rng.choice([None, 8, 50])}
        for i in range(700)
    ]
    requests = [("a", "p", 10), ("b", "q", 30), ("c", None, 6), ("d", "none", 10)]
    for policy in (SessionPolicy(), SessionPolicy(tokens=300, always_tokens=100, items=5, identities=1, header_tokens=0)):
        got = packs.pack_sessions(spark.createDataFrame(requests, "request_id string, project string, at int"), spark.createDataFrame([tuple(d.values()) for d in docs], DOCS).repartition(3), policy).collect()
        for name, project, at in requests:
            mine = [(r["id"], r["kind"], r["tokens"]) for r in sorted((r for r in got if r["request_id"] == name), key=lambda r: r["position"])]
            assert mine == walked(project, at, docs, policy), name
    none = spark.createDataFrame([], DOCS)
    assert packs.pack_sessions(spark.createDataFrame(requests, "request_id string, project string, at int"), none).count() == 0


def test_of_a_large_space_a_bounded_part_is_gathered(spark):
    docs = spark.range(20_000).selectExpr("cast(id AS int) id", "'p' project", "'normal' tier", "'x' category", "'auto' startup", "cast(id AS int) order_key", "true compact_valid", "cast(40 + id % 3 AS int) compact_tokens", "false identity_valid", "1 identity_tokens", "cast(null AS int) valid_from", "cast(null AS int) valid_until")
    drawn = packs.session_candidates(spark.createDataFrame([("a", "p", 1)], "request_id string, project string, at int"), docs)
    assert drawn.count() == 20_000
    got = packs.pack_sessions(spark.createDataFrame([("a", "p", 1)], "request_id string, project string, at int"), docs).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == list(range(12))


def excerpt(prompt, messages, budget, p=ExcerptPolicy()):
    """messages newest first as (role, text)."""
    estimate = lambda t: max(1, -(-len(t.encode()) // 4))
    last = [(r or "unknown", t or "") for r, t in messages[: p.messages]]
    if sum(estimate(t) + p.label_tokens for _, t in last) <= budget:
        return [(b + 1, t) for b, (_, t) in reversed(list(enumerate(last)))]
    terms = {w for w in re.findall(r"\w+", (prompt or "").lower()) if len(w) > 1 and w not in packs.GENERIC}
    newest = {r: next((b for b, m in enumerate(last) if m[0] == r), None) for r in ("assistant", "user")}
    found = []
    for back, (role, text) in enumerate(last):
        parts = [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]
        first = next((k for k, x in enumerate(parts) if len(re.sub(r"[*\s]", "", x)) > 8), 0)
        for k, x in enumerate(parts):
            score = p.recent / (1 + back * p.fade) + 3 * min(p.overlap, sum(w in x.lower() for w in terms)) + 1.5 * min(p.entities, len(re.findall(packs.ENTITY, x)))
            score += 4 * bool(re.search(packs.CONSTRAINT, x)) + 4 * bool(re.search(packs.PLAN, x)) + 3 * (k == 0)
            plan = back == newest["assistant"] and re.search(packs.ASKS_PLAN, prompt or "") and re.search(packs.PLAN, x)
            priority = 0 if plan else 1 if back == newest["assistant"] and k == first else 2 if back == newest["user"] and k == first else 3
            found.append((priority, -round(score / max(p.least_tokens, estimate(x)) ** 0.5, 6), back, k, role, x))
    taken, used, seen = [], 0, set()
    for _, _, back, k, role, x in sorted(found):
        if (role, x) not in seen and used + estimate(x) + p.label_tokens <= budget:
            used += estimate(x) + p.label_tokens
            taken.append((back, k, x))
            seen.add((role, x))
    return [(b + 1, x) for b, _, x in sorted(taken, key=lambda t: (-t[0], t[1]))]


def test_excerpts(spark):
    rng = random.Random(9)
    bits = ["I recommend plan B with `run_all`.", "Do not delete the table.", "short", "Words about apples and pears that go on for a while to fill the room.", "**", "方案 改为 MyParser unless told", "Same paragraph twice."]
    asked, rows, want = [], [], {}
    for q in range(40):
        prompt = rng.choice(["please follow the plan for apples", "what about pears", None, "按照 方案 做"])
        messages = [(rng.choice(["user", "assistant", "assistant", None]), rng.choice([None, "\n\n".join(rng.choices(bits, k=rng.randrange(1, 6))), "one\n \n\n two"])) for _ in range(rng.randrange(0, 9))]
        asked.append((q, prompt))
        rows += [(q, k + 1, *m) for k, m in enumerate(messages)]
        want[q] = excerpt(prompt, messages, 90)
    got = packs.conversation_excerpt(spark.createDataFrame(asked, "prompt_id int, prompt string"), spark.createDataFrame(rows, "prompt_id int, back int, role string, text string").repartition(3), 90).collect()
    for q in want:
        mine = [(r["message"], r["text"]) for r in sorted((r for r in got if r["prompt_id"] == q), key=lambda r: r["position"])]
        assert mine == want[q], q
