"""Event intake in batch: first sightings, batches, sessions, turns, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried, cut_runs, ranked
from .stages import written

from ..functions.policy import BatchPolicy
from ..functions.rules import sensitivity
from ..functions.text import hmac_sha256
from .relational import first_per


def accept_first(events: DataFrame, dedup_key: list[str], order: list[str]) -> DataFrame:
    """One event per key, the first in order."""
    return first_per(events, dedup_key, *order)


def batch_readiness(events: DataFrame, as_of: Column, idle_minutes: int, policy: BatchPolicy) -> DataFrame:
    """Per (session, turn): counts, bytes and whether the batch is ready: full, stopped, ended or idle."""
    groups = events.groupBy("session", "turn").agg(
        F.count("*").alias("n"), F.round(F.sum("bytes"), 4).alias("bytes"), F.max("at").alias("last_at"),
        F.bool_or(F.col("kind") == policy.stop_kind).alias("stopped"), F.bool_or(F.col("kind") == policy.end_kind).alias("ended"),
    )
    idle = F.col("last_at") <= as_of - F.expr(f"interval {idle_minutes} minutes")
    return groups.withColumn("ready", (F.col("n") >= policy.max_events) | (F.col("bytes") >= policy.max_bytes) | F.col("stopped") | F.col("ended") | idle)


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(session, started_at, closed_at, n): runs of a session's events with no pause of gap or more."""
    return events.groupBy("session", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.max("at").alias("last_at")).select("session", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(session, prompt_turn, reply_turn): each prompt with the last reply before the next prompt."""
    w = Window.partitionBy("session").orderBy("turn")
    number = F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("k", number).where("k > 0").groupBy("session", "k").agg(F.min("turn").alias("prompt_turn"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply_turn")).drop("k")


def attempt_health(attempts: DataFrame, minutes: int = 15, least: int = 3, share: float = 0.02, volume: int = 20) -> DataFrame:
    """Per window of attempts(at, failed): failures, attempts and whether it is degraded: least failures or more, or the
    share of failures among volume attempts or more."""
    w = attempts.groupBy(F.window("at", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("attempts"), F.count_if("failed").alias("failures"))
    degraded = (F.col("failures") >= least) | ((F.col("attempts") >= volume) & (F.col("failures") >= share * F.col("attempts")))
    return w.select(F.col("w.start").alias("started_at"), "attempts", "failures", degraded.alias("degraded"))


# The kind that ends a session, and those that alone need no model.
SESSION_END, LIFECYCLE = "SessionEnd", ("SessionStart", "SessionEnd")


def batches(events: DataFrame, most_events: int = 64, most_bytes: int = 1 << 20) -> DataFrame:
    """(event_id, session, batch, ordinal, lifecycle_only, project): every event of events(event_id, session, turn, kind,
    at, bytes, project) in the batch that takes it, once all are due.

    A session's next batch begins with its first event that has none. If the session ends at that event or later, the
    batch takes events up to the end, else those of the same turn; in the order (at, event_id), at most most_events, and no
    more than most_bytes but for a first event that is larger. Batches of a session count from 0. A batch of lifecycle
    events alone needs no model; its project is that of its events if they name one only, else null. An event without
    a session is one of its own; a null turn is a turn.

    The end that an event falls under is carried back along the session; batches are cut by pointers, so that a
    session of any length is never gathered.
    """
    session = F.coalesce(F.col("session").cast("string"), F.concat(F.lit("event:"), F.col("event_id").cast("string")))
    turn = F.coalesce(F.concat(F.lit("turn:"), F.col("turn").cast("string")), F.lit("none"))
    lifecycle = F.coalesce(F.col("kind").isin(*LIFECYCLE), F.lit(False))
    ends = events.select("event_id", session.alias("session"), turn.alias("group"), "at", "bytes", "project", lifecycle.alias("lifecycle"), F.when(F.col("kind") == SESSION_END, F.col("at")).alias("end_at"))
    # backwards in time, an end before what happened at the same instant
    back = carried(ends, ["session"], [F.desc("at"), F.desc(F.col("end_at").isNotNull()), F.col("event_id")], "end_at", "until", "session-ends", unique=True)
    # what each step from here on deals out, sorts and hands to the workers is these seven
    rows = back.withColumn("group", F.coalesce(F.concat(F.lit("end:"), F.col("until").cast("string")), "group")).drop("until", "end_at")
    cut = written(cut_runs(rows, ["session", "group"], ["at", "event_id"], "bytes", most_events, most_bytes, unique=True), "batch-events")
    # batches follow each other by their first events
    batch = ["session", "group", "head"]
    numbered = ranked(cut.where("ordinal = 0").select(*batch, "at", "event_id"), ["session"], ["at", "event_id"], name="batches", unique=True).select(*batch, F.col("place").alias("batch"))
    # a batch has most_events rows at most
    own = Window.partitionBy(*batch)
    whole = cut.select("event_id", *batch, "ordinal", F.min("lifecycle").over(own).alias("lifecycle_only"), F.min("project").over(own).alias("least"), F.max("project").over(own).alias("most"))
    one = F.when(F.col("least") == F.col("most"), F.col("least"))
    return whole.join(numbered, batch).select("event_id", "session", "batch", "ordinal", "lifecycle_only", one.alias("project"))


# Outcomes that count as a failure, and the one that proves the whole path.
FAILED, COMPLETED = ("deadline_exceeded", "failed", "unavailable", "busy"), "completed"


def service_health(attempts: DataFrame, overflow: DataFrame, now: Column, window: str = "15 minutes", quiet: str = "10 minutes", successes: int = 5, least: int = 3, volume: int = 20, share: float = 0.02) -> DataFrame:
    """(service, state, last_failure_at, recent_failures, successes_since, quiet_until): how each service of
    attempts(service, request, at, outcome, late) stands at an instant.

    Rows of one request are one attempt: at its last instant, failed if any of them failed or went on late, succeeded if any
    completed. overflow(service, at, outcome, n) has failures that were only counted. healthy: never failed. recovered:
    nothing failed for the quiet time, and so many succeeded since the last failure. degraded: `least` failures in the window,
    or a share of at least `volume` attempts. Else recovering until the quiet time is over, then awaiting_verification.
    Nothing later than now counts; null requests are one of their service."""
    one = attempts.where(F.col("at") <= now).groupBy("service", "request").agg(
        F.max("at").alias("at"), F.max((F.col("outcome").isin(*FAILED) | F.coalesce(F.col("late") > 0, F.lit(False))).cast("int")).alias("failed"), F.max((F.col("outcome") == COMPLETED).cast("int")).alias("done")
    )
    counted = overflow.where((F.col("at") <= now) & F.col("outcome").isin(*FAILED))
    last = one.where("failed = 1").select("service", "at").unionByName(counted.select("service", "at")).groupBy("service").agg(F.max("at").alias("last_failure_at"))
    since = now - F.expr(f"interval {window}")
    rows = one.join(last, "service", "left")
    per = rows.groupBy("service").agg(
        F.count_if((F.col("at") >= since) & (F.col("failed") == 1)).alias("own"), F.count_if(F.col("at") >= since).alias("recent"),
        F.count_if((F.col("failed") == 0) & (F.col("done") == 1) & (F.col("last_failure_at").isNull() | (F.col("at") > F.col("last_failure_at")))).alias("successes_since"),
    )
    more = counted.groupBy("service").agg(F.coalesce(F.sum(F.when(F.col("at") >= since, F.col("n"))), F.lit(0)).alias("more"))
    every = per.join(more, "service", "full").join(last, "service", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    failures = (zero("own") + zero("more")).cast("long")
    until = F.col("last_failure_at") + F.expr(f"interval {quiet}")
    sustained = (failures >= least) | ((zero("recent") >= volume) & (failures >= share * zero("recent")))
    state = (
        F.when(F.col("last_failure_at").isNull(), "healthy")
        .when((now >= until) & (zero("successes_since") >= successes), "recovered")
        .when(sustained, "degraded")
        .when(now < until, "recovering")
        .otherwise("awaiting_verification")
    )
    return every.select("service", state.alias("state"), "last_failure_at", failures.alias("recent_failures"), zero("successes_since").alias("successes_since"), until.alias("quiet_until"))


def rendered_chunks(turns: DataFrame, limit: int) -> DataFrame:
    """(session, chunk, lines, text): the turns of each session of turns(session, at, role, text) as lines under the number of
    their turn, in chunks of at most `limit` characters.

    A user's row begins a turn. A line that would overfill its chunk begins the next; a longer one is cut to the limit. Null
    texts are empty, a role other than user or assistant stands as it is; sessions are rendered along their order, and only
    the lines of one chunk are put together."""
    role = F.upper(F.coalesce("role", F.lit("unknown")))
    rows = ranked(turns.select("session", "at", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), (F.col("role") == "user").cast("int").alias("opens")), ["session"], ["at", "role", "text"], ["opens"], "rendered")
    number = F.col("before_opens") + F.coalesce("opens", F.lit(0))
    head = F.concat(F.when(F.col("role") == "USER", "\n").otherwise(""), F.lit("### T"), F.lpad(number.cast("string"), 2, "0"), F.lit(" "), F.col("role"), F.lit("\n"))
    label = F.when(number > 99, F.concat(F.when(F.col("role") == "USER", "\n").otherwise(""), F.lit("### T"), number.cast("string"), F.lit(" "), F.col("role"), F.lit("\n"))).otherwise(head)
    lines = rows.select("session", F.col("place").alias("number"), F.concat(label, "text").alias("line")).withColumn("size", (F.length("line") + 1).cast("long"))
    # a line has its label at least
    cut = written(cut_runs(lines, ["session"], ["number"], "size", limit // len("### T00 X") + 2, limit + 1), "chunk-lines")
    whole = cut.groupBy("session", "head").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.substring("line", 1, limit).alias("line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))
    return ranked(whole, ["session"], ["head"], name="chunks").select("session", F.col("place").alias("chunk"), "lines", "text")


def credential_findings(events: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(the events that may be kept, (fingerprint, state, category, first_seen_at, last_seen_at, occurrences)) of
    events(event_id, source, at, text): what holds a secret is blocked, what may hold one is set apart, and of either only a
    keyed digest of category and match is kept, with no part of the text.

    A source counts once for a finding, at its first sighting; last_seen_at is that of the newest source. Null texts are
    kept; null sources are one. The verdict is made once a row, and findings are summed in the tasks before they move."""
    judged = events.withColumn("s_", sensitivity(F.col("text")))
    found = judged.where("s_.state <> 'normal'").select("source", "at", "s_.state", "s_.category", hmac_sha256(F.concat("s_.category", F.lit("\0"), "s_.matched"), key).alias("fingerprint"))
    sources = found.groupBy("fingerprint", "category", "source").agg(F.min("at").alias("at"), F.max("state").alias("state"))
    state = F.when(F.max("state") == "secret", "blocked_secret").otherwise("quarantined")
    findings = sources.groupBy("fingerprint", "category").agg(state.alias("state"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.count("*").alias("occurrences"))
    return judged.where("s_.state = 'normal'").drop("s_"), findings.select("fingerprint", "state", "category", "first_seen_at", "last_seen_at", "occurrences")
