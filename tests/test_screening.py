"""Keyed digests, and findings that keep nothing of what they found."""

import hashlib
import hmac

from pyspark.sql import functions as F

from recollect.functions.text import hmac_sha256
from recollect.operators import intake


def test_hmac_is_the_standards(spark):
    texts = ["", "a", "é\n", "x" * 1000, None]
    for key in (b"", b"short", b"k" * 64, b"long" * 40):
        got = {r["t"]: r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", hmac_sha256(F.col("t"), key).alias("d")).collect()}
        assert got == {t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts}


def test_findings_count_sources_once(spark):
    rows = [(1, "a", 5, "password = hunter2hunter2"), (2, "a", 9, "password = hunter2hunter2"), (3, "b", 7, "x password = hunter2hunter2"), (4, None, 1, "auth token Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9"), (5, "c", 2, None), (6, "c", 3, "commit 0123456789abcdef0123456789abcdef01234567")]
    kept, findings = intake.credential_findings(spark.createDataFrame(rows, "event_id int, source string, at int, text string"), b"k")
    assert sorted(r["event_id"] for r in kept.collect()) == [5, 6]
    got = {r["category"]: (r["state"], r["first_seen_at"], r["last_seen_at"], r["occurrences"]) for r in findings.collect()}
    assert got == {"credential_field": ("blocked_secret", 5, 7, 2), "contextual_credential": ("quarantined", 1, 1, 1)}
    assert not any("hunter2" in str(v) for r in findings.collect() for v in r)


def test_anomalies_continue_pause_and_repeat(spark):
    from recollect.operators import candidates

    schema = "key string, kind string, state string, evaluation string, start string, end string, count long"
    previous = [("a", "k", "provisional", "rolling", "1", "2", 1), ("b", "k", "persistent", "rolling", "0", "1", 4), ("c", "k", "resolved", "rolling", "1", "2", 3), ("d", "k", "persistent", "rolling", "2", "3", 2), ("e", "k", "provisional", "session", "1", "2", 1), ("f", "k", "persistent", "rolling", "1", "2", 5)]
    found = spark.createDataFrame([(k, "k") for k in "abcdeg"], "key string, kind string")
    got = {r["key"]: (r["state"], r["start"], r["count"]) for r in candidates.continued(spark.createDataFrame(previous, schema), found, "rolling", "2", "3").collect()}
    assert got == {"a": ("persistent", "2", 2), "b": ("provisional", "2", 1), "c": ("provisional", "2", 1), "d": ("persistent", "2", 2), "e": ("provisional", "2", 1), "f": ("resolved", "1", 5), "g": ("provisional", "2", 1)}
