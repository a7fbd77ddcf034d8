"""Packs of an epoch's prompts against a plain walk, with repeats, soft targets, hard limits and upgrades."""

import random

from recollect.functions.policy import PromptPolicy
from recollect.operators import prompts

COLUMNS = "epoch int, prompt int, id int, revision int, band string, score int, similarity double, own boolean, anchored boolean, human boolean, tier string, direct boolean, exact boolean, compact_valid boolean, compact_tokens int, identity_valid boolean, identity_tokens int, standard_valid boolean, standard_tokens int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def walked(rows, p):
    out = []
    for epoch in sorted({r["epoch"] for r in rows}):
        total, injected = 0, set()
        for prompt in sorted({r["prompt"] for r in rows if r["epoch"] == epoch}):
            past = total >= p.epoch_soft
            ranked = [r for r in rows if r["epoch"] == epoch and r["prompt"] == prompt and r["band"] in ("high", "probable") and (r["id"], r["revision"]) not in injected]
            if past:
                ranked = [r for r in ranked if r["score"] >= 5 and r["anchored"] and (r["human"] or r["tier"] != "normal")]
            ranked.sort(key=lambda r: (r["band"] != "high", -r["score"], -r["similarity"], not r["own"], r["id"]))
            header, chosen, probable = p.later_tokens if total else p.header_tokens, [], 0
            cost = lambda items, header=header: header + sum(t + p.item_tokens for _, _, t in items)
            for r in ranked:
                if len(chosen) >= (2 if past else p.items):
                    break
                if r["band"] == "probable" and probable >= p.probable_items:
                    continue
                if r["compact_valid"] and r["compact_tokens"] <= 96:
                    form = ("compact", r["compact_tokens"])
                elif r["band"] == "high" and r["tier"] != "normal" and r["identity_valid"] and r["identity_tokens"] <= 48:
                    form = ("identity", r["identity_tokens"])
                elif r["band"] == "high" and not past and r["standard_valid"] and r["standard_tokens"] <= 96:
                    form = ("standard", r["standard_tokens"])
                else:
                    continue
                trial = [*chosen, (r, *form)]
                if cost(trial) > p.hard_limit or total + cost(trial) > p.epoch_hard:
                    continue
                chosen, probable = trial, probable + (r["band"] == "probable")
            if not past:
                for k, (r, _, _) in enumerate(chosen):
                    if r["band"] == "high" and r["standard_valid"] and r["standard_tokens"] <= 192 and (r["exact"] or r["direct"]):
                        trial = [*chosen[:k], (r, "standard", r["standard_tokens"]), *chosen[k + 1 :]]
                        if cost(trial) <= (p.hard_limit if r["direct"] else p.target):
                            chosen = trial
            out += [(epoch, prompt, k, r["id"], kind, t + p.item_tokens, cost(chosen), total, past) for k, (r, kind, t) in enumerate(chosen)]
            if chosen:
                total += cost(chosen)
                injected |= {(r["id"], r["revision"]) for r, _, _ in chosen}
    return sorted(out)


def test_packs_of_epochs(spark):
    rng, flag = random.Random(12), lambda p=0.5: rng.random() < p
    rows = []
    for epoch in range(4):
        for prompt in range(25):
            for i in rng.sample(range(60), rng.randrange(0, 14)):
                rows.append(dict(zip(NAMES, (epoch, prompt, i, rng.randrange(2), rng.choice(["high", "high", "probable", "weak"]), rng.randrange(2, 9), rng.randrange(5) / 4, flag(), flag(), flag(), rng.choice(["normal", "strong", "critical"]), flag(0.1), flag(0.4), flag(0.7), rng.randrange(5, 120), flag(), rng.randrange(5, 60), flag(0.8), rng.randrange(20, 260)), strict=True)))
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS).repartition(3)
    for policy in (PromptPolicy(), PromptPolicy(epoch_soft=900, epoch_hard=2000), PromptPolicy(hard_limit=300, target=200, epoch_soft=600)):
        got = sorted(map(tuple, prompts.epoch_packs(frame, policy).collect()))
        want = walked(rows, policy)
        assert got == want
    assert {k[4] for k in want} == {"compact", "identity", "standard"} and {k[8] for k in want} == {True, False}
    assert prompts.epoch_packs(frame.limit(0)).count() == 0


def test_null_flags_and_counts(spark):
    row = (0, 0, 1, None, "high", None, None, None, None, None, None, None, None, None, None, None, None, True, 40)
    (got,) = prompts.epoch_packs(spark.createDataFrame([row], COLUMNS)).collect()
    assert (got["id"], got["kind"], got["spent"], got["restricted"]) == (1, "standard", 0, False)
