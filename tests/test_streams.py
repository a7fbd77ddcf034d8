"""Coalesced builds: a stream against the fold, and the fold against a walk by the minute."""

import datetime as dt
import random

from recollect.operators import coalescing
from recollect.streaming import coalescing as streamed

START = dt.datetime(2024, 1, 1)
SECOND = 1_000_000


def events(seed, keys=3, n=160):
    rng, rows = random.Random(seed), []
    for key in range(keys):
        at = START
        for _ in range(n):
            at += dt.timedelta(seconds=rng.choice([1, 5, 20, 40, 200, 900]))
            rows.append((key, at, rng.choice(["change", "change", "change", "built", "failed", None])))
    return rows


def walked(rows, policy, until):
    """Second by second: what happens at a second, then what is due at it."""
    out = []
    for key in {r[0] for r in rows}:
        c, mine = coalescing.Catalog(), sorted((int((at - START).total_seconds()), kind or "") for k, at, kind in rows if k == key)
        for now in range(until + 1):
            for kind in [k for at, k in mine if at == now]:
                c = coalescing.happened(c, kind, now * SECOND, policy)
            stale = c.dirty_at is not None and c.generation > c.published
            cool = all(x is None or x + policy.cool_down <= now * SECOND for x in (c.failed_at, c.started_at if c.building is not None else None))
            forced = c.force_at is not None and c.force_at <= now * SECOND
            if stale and cool and (forced or c.dirty_at + policy.quiet <= now * SECOND):
                c = coalescing.start(c, now * SECOND)
                out.append((key, now, c.generation, "force_due" if forced else "quiet_period"))
    return sorted(out)


def plain(rows):
    return sorted((r["catalog"], int((r["at"] - START).total_seconds()), r["generation"], r["reason"]) for r in rows)


def test_builds_by_the_second(spark):
    policy, rows = coalescing.CoalescePolicy(), events(1)
    until = 12_000
    end = int((START.replace(tzinfo=dt.timezone.utc) + dt.timedelta(seconds=until)).timestamp()) * SECOND
    frame = spark.createDataFrame(rows, "catalog int, at timestamp, kind string").repartition(3)
    want = walked(rows, policy, until)
    assert plain(coalescing.builds(frame, end).collect()) == want and len({w[3] for w in want}) == 2
    assert coalescing.builds(frame.limit(0), end).count() == 0


def test_recovery_waits_for_changes_or_time():
    policy = coalescing.CoalescePolicy(recovery_changes=3)
    c = coalescing.happened(coalescing.Catalog(), "change", 0, policy)
    assert coalescing.due(c, policy) == (policy.recovery_staleness, "recovery_staleness")
    for at in (1, 2):
        c = coalescing.happened(c, "change", at * SECOND, policy)
    assert coalescing.due(c, policy) == (2 * SECOND + policy.quiet, "recovery_batch")


def test_a_replayed_stream_equals_the_fold(spark, tmp_path):
    spark.conf.set(*streamed.STORE)
    rows = events(2)
    random.Random(5).shuffle(rows)
    # the last instants only move the watermark past all others
    end = max(at for _, at, _ in rows) + dt.timedelta(days=2)
    for k in range(4):
        part = sorted(rows, key=lambda r: r[1])[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, "catalog int, at timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(99, end, "none")], "catalog int, at timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("catalog int, at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streamed.builds(stream).writeStream.format("memory").queryName("coalesced").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = spark.table("coalesced").collect()
    mark = int((end.replace(tzinfo=dt.timezone.utc) - dt.timedelta(hours=2)).timestamp()) * SECOND
    want = coalescing.builds(spark.createDataFrame(rows, "catalog int, at timestamp, kind string"), mark).collect()
    assert len(got) > 50 and plain(got) == plain(want)
