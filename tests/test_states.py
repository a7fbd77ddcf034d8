"""Guarded changes with nulls and repeats; model health against a plain fold over whole histories."""

import datetime as dt
import random

from recollect.operators import states


def test_guarded_changes(spark):
    current = spark.createDataFrame([(1, 1, "active"), (2, 1, "archived"), (3, 2, "active"), (4, None, "active")], "id int, revision int, state string")
    rows = [(1, 1, "archive", 5), (1, 1, "review", 4), (2, 0, "archive", 1), (3, 1, "archive", 1), (4, 1, "archive", 1), (5, 1, "archive", 1), (1, 1, "review", 4)]
    got = sorted(map(tuple, states.apply_decisions(current, spark.createDataFrame(rows, "id int, revision int, action string, at int")).collect()))
    assert got == [(1, "applied", 2, "review_due"), (2, "unchanged", 1, "archived"), (3, "stale", 2, "active"), (4, "stale", None, "active"), (5, "unknown", None, None)]


def _plain(attempts):
    """The states of one model's attempts in turn, remembered from the first to the last."""
    state, fails, first, row, lone, out = "healthy", 0, None, 0, False, []
    for at, ok, category in sorted(attempts, key=lambda a: (a[0], a[1], a[2] or "")):
        if ok and (state == "healthy" or lone):
            state, fails, first, row, lone = "healthy", 0, None, 0, False
        elif ok:
            lone = True
        else:
            fails, lone, first = fails + 1, False, first or at
            row = row + 1 if category == "schema_invalid" else 0
            span = (at - first).total_seconds()
            state = "unavailable" if category == "account" or row >= 5 or span >= 1800 else "degraded" if fails >= 3 and span >= 120 else state
        out.append(state)
    return out


def test_model_health(spark):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = []
    for model in ("a", "b", "c", None):
        at = start
        for _ in range(300):
            at += dt.timedelta(seconds=rng.choice([1, 30, 90, 400]))
            ok = rng.random() < {"a": 0.3, "b": 0.6}.get(model, 0.8)
            rows.append((model, at, ok, None if ok else rng.choice(["schema_invalid", "schema_invalid", "timeout", "account" if rng.random() < 0.1 else "timeout"])))
    got = states.model_health(spark.createDataFrame(rows, "model string, at timestamp, ok boolean, category string"), ("account",)).collect()
    for model in ("a", "b", "c", None):
        mine = [r["state"] for r in sorted((r for r in got if r["model"] == model), key=lambda r: r["at"])]
        assert mine == _plain([r[1:] for r in rows if r[0] == model])
    assert {r["state"] for r in got} == {"healthy", "degraded", "unavailable"}


def test_model_health_of_nothing(spark):
    assert states.model_health(spark.createDataFrame([], "model string, at timestamp, ok boolean, category string")).collect() == []
