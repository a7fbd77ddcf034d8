"""Candidates for memories: evidence, intake, promotion, anomalies, purge, and output checked against its input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import tasks_for

# Shapes of hashes, kinds of retention from lax to strict, what is not kept.
HASH, REVISION = r"^[0-9a-f]{64}$", r"^[0-9a-f]{40}([0-9a-f]{24})?$"
STRICTNESS = ("long_term", "project_phase", "uncertain", "session_only", "no_memory")
NOT_KEPT, HELD = ("task_local", "transient", "no_retention"), ("session_only", "project_phase")


@dataclass(frozen=True)
class AnomalyPolicy:
    session_rows: int = 12
    session_high: int = 10
    current_days: int = 30
    baseline_days: int = 90
    current_rows: int = 50
    baseline_rows: int = 100
    current_rate: float = 0.6
    rate_increase: float = 0.25
    cold_ceiling: int = 100
    cold_rows: int = 50
    cold_rate: float = 0.8
    tag_high: int = 20
    tag_rate: float = 0.8


def eligible_shape() -> Column:
    """Whether a row of evidence may count, by its class; a null where a value is due counts as no.

    Reads evidence_class, echo, truncated, integrity, content_hash, human_id, human_revision, human_hash, source,
    file_hash, file_path, repo_revision, repo_root, command, cwd, exit_code, result_hash.
    """
    c = F.col

    def hashed(name: str) -> Column:
        return c(name).rlike(HASH)

    unbound = c("repo_revision").isNull() & c("repo_root").isNull()
    bound = c("repo_revision").rlike(REVISION) & c("repo_root").startswith("/")
    kind = c("evidence_class")
    shape = (
        F.when(kind == "explicit_user_statement", hashed("content_hash"))
        .when(kind == "human_memory_reference", hashed("human_hash") & (c("source") == F.concat("human_id", F.lit(":"), "human_revision")))
        .when(kind == "code_or_configuration", hashed("file_hash") & c("file_path").startswith("/") & (unbound | bound))
        .when(kind == "command_outcome", (F.length("command") > 0) & c("cwd").startswith("/") & c("exit_code").isNotNull() & hashed("result_hash") & hashed("content_hash"))
    )
    return F.coalesce(~c("echo") & ~c("truncated") & (c("integrity") == "intact") & shape, F.lit(False))


def relevant_repositories(evidence: Column, paths: Column, baseline: Column, branches: Column) -> Column:
    """Repositories of the most specific source that names any: evidence lines `repo@commit`, then files read, then
    hits `repo:place` and `repo@branch`. Hits without their sign name none; a null array is an empty one."""
    none = F.array().cast("array<string>")

    def named(lines: Column, pattern: str) -> Column:
        found = F.transform(F.coalesce(lines, none), lambda x: F.regexp_extract(F.trim(x), pattern, 1))
        return F.array_distinct(F.filter(found, lambda x: x != ""))

    cited = named(evidence, r"^([^\s@\[\]]+)@[0-9a-f]{6,}")
    hits = F.array_distinct(F.concat(named(baseline, r"^(.*):[^:]*$"), named(branches, r"^([^@]*)@")))
    read = F.array_distinct(F.coalesce(paths, none))
    return F.when(F.size(cited) > 0, cited).when(F.size(read) > 0, read).otherwise(hits)


def promotion_gate() -> Column:
    """struct(decision, reason) of a candidate, by the first rule that holds.

    Reads verification_needed, conflict, assessed (null without an assessment), n_certain (rows of evidence that count by
    their shape), n_open (those that count only if assessed), n_cited (of those, the ones that the assessment cites),
    only_statements, stable_tag, is_global, n_evidence, certainty, disposition, private, authorized, n_projects, n_sources,
    n_contents (among the assessed), durability, space_full, total_full.
    """
    c = F.col
    assessed = c("assessed").isNotNull()
    supported = F.coalesce(c("assessed") == "supported", F.lit(False))
    full = c("is_global") | (c("n_evidence") > 1) | (c("certainty") != "asserted") | (c("n_open") > 0) | (c("only_statements") & ~c("stable_tag"))
    kept = F.coalesce("disposition", F.lit("legacy_unclassified"))
    shared = c("is_global") & ~c("authorized")

    def outcome(decision: str, reason: Column | str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    return (
        F.when(c("verification_needed"), outcome("wait", "verification_required"))
        .when(c("conflict"), outcome("conflict", "material_conflict"))
        .when(c("assessed") == "contradicted", outcome("rejected", "semantic_contradiction"))
        .when(c("n_certain") + c("n_open") == 0, outcome("wait", "insufficient_evidence"))
        .when(full & ~supported, outcome("wait", "semantic_assessment_required"))
        .when(c("n_certain") + c("n_cited") == 0, outcome("wait", "insufficient_evidence"))
        .when(assessed & kept.isin(*NOT_KEPT), outcome("rejected", F.concat(F.lit("non_durable_"), kept)))
        .when(assessed & (kept == "uncertain"), outcome("wait", "durability_uncertain"))
        .when(assessed & (kept == "legacy_unclassified"), outcome("wait", "durability_assessment_required"))
        .when(shared & c("private"), outcome("wait", "private_global_requires_human_authorization"))
        .when(shared & (F.least("n_projects", "n_sources", "n_contents") < 2), outcome("wait", "global_corroboration_missing"))
        .when(c("durability").isin(*HELD), outcome("wait", F.concat(F.lit("durability_"), "durability", F.lit("_hold"))))
        .when(c("space_full"), outcome("wait", "memory_space_capacity_hard_limit"))
        .when(c("total_full"), outcome("wait", "aggregate_active_capacity_limit"))
        .otherwise(outcome("promoted", F.lit(None).cast("string")))
    )


def _strictness(kind: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, STRICTNESS)), F.col(kind) if isinstance(kind, str) else kind)


def _kind(place: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, STRICTNESS)), place.cast("int"))


def intake(new: DataFrame, evidence: DataFrame, existing: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(candidate, outcome, durability) of every new candidate.

    new(candidate, fingerprint, durability), evidence(candidate, source, echo), existing(fingerprint, durability),
    tombstones(fingerprint, source). merged: the fingerprint is there already, or a smaller new candidate has it.
    suppressed: it has a tombstone and its evidence brings no source, other than an echo, that the tombstone had not.
    created otherwise. The strictest durability of all that share a fingerprint holds, without those suppressed.

    Rows are dealt to as many tasks as they need, so that what a task sorts does not grow with the tables.
    """
    many, some = tasks_for(evidence), tasks_for(new)
    fresh = (
        evidence.where("not echo")
        .select("candidate", "source")
        .repartition(many, "candidate")
        .join(new.select("candidate", "fingerprint").repartition(many, "candidate"), "candidate")
        .repartition(many, "fingerprint", "source")
        .join(tombstones.select("fingerprint", "source"), ["fingerprint", "source"], "left_anti")
        .select("candidate", F.lit(True).alias("fresh"))
        .repartition(some, "candidate")
        .distinct()
    )
    old = existing.groupBy("fingerprint").agg(F.max(_strictness("durability")).alias("old"))
    buried = tombstones.select("fingerprint", F.lit(True).alias("buried")).distinct()
    rows = new.repartition(some, "fingerprint").join(old, "fingerprint", "left").join(buried, "fingerprint", "left").repartition(some, "candidate").join(fresh, "candidate", "left")
    rows = rows.withColumn("suppressed", F.col("old").isNull() & F.col("buried").isNotNull() & F.col("fresh").isNull())
    rows = rows.repartition(some, "fingerprint")
    shared = rows.where("not suppressed").groupBy("fingerprint").agg(F.min("candidate").alias("first"), F.max(F.greatest(_strictness("durability"), "old")).alias("strictest"))
    outcome = F.when(F.col("suppressed"), "suppressed").when(F.col("old").isNotNull() | (F.col("candidate") != F.col("first")), "merged").otherwise("created")
    durability = F.when(F.col("suppressed"), F.col("durability")).otherwise(_kind(F.col("strictest")))
    return rows.join(shared, "fingerprint", "left").select("candidate", outcome.alias("outcome"), durability.alias("durability"))


def material_evidence(new: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, n, last_at) over new evidence that is eligible and brings both a source and a content that its
    candidate had not. new(candidate, source, content, at, eligible), known(candidate, source, content)."""
    fresh = new.where("eligible").join(known.select("candidate", "source").distinct(), ["candidate", "source"], "left_anti")
    fresh = fresh.join(known.select("candidate", "content").distinct(), ["candidate", "content"], "left_anti")
    return fresh.groupBy("candidate").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


def to_reevaluate(decisions: DataFrame, evidence: DataFrame, assessments: DataFrame, reason: str) -> DataFrame:
    """Candidates whose latest decision waits for a reason, that have evidence and no assessment.

    decisions(candidate, at, decision, reason); the latest by time, then by the greater decision and reason.
    """
    latest = decisions.groupBy("candidate").agg(F.max(F.struct("at", "decision", "reason")).alias("d"))
    waiting = latest.where((F.col("d.decision") == "wait") & (F.col("d.reason") == reason)).select("candidate")
    return waiting.join(evidence, "candidate", "left_semi").join(assessments, "candidate", "left_anti")


def anomalies(candidates: DataFrame, start: str, end: str, policy: AnomalyPolicy = AnomalyPolicy()) -> DataFrame:
    """(key, kind, n, n_high) of what is unusual in candidates(project, session, high, tags, created).

    session_burst: many candidates of a session in [start, end). project_rolling_change: the share of high ones of the last
    days against those before. cold_start: high ones in a project with little before. tag_dominance: one tag on most of
    the high ones. Null projects and sessions take no part; a tag counts once a candidate.
    """
    p, high, at = policy, F.col("high"), F.to_timestamp(F.lit(end))
    rows = candidates.withColumn("age", (F.unix_micros(at) - F.unix_micros("created")) / 86_400e6)
    now = F.col("age") <= p.current_days
    before = (F.col("age") > p.current_days) & (F.col("age") <= p.current_days + p.baseline_days)
    bursts = (
        candidates.where(F.col("session").isNotNull() & (F.col("created") >= F.to_timestamp(F.lit(start))) & (F.col("created") < at))
        .groupBy("session")
        .agg(F.count("*").alias("n"), F.count_if(high).alias("n_high"))
        .where((F.col("n") >= p.session_rows) & (F.col("n_high") >= p.session_high))
        .select(F.concat(F.lit("session_burst:"), "session").alias("key"), F.lit("session_burst").alias("kind"), "n", "n_high")
    )
    projects = (
        rows.where(F.col("project").isNotNull())
        .groupBy("project")
        .agg(
            F.count_if(now).alias("n"),
            F.count_if(now & high).alias("n_high"),
            F.count_if(before).alias("n_before"),
            F.count_if(before & high).alias("high_before"),
            F.count_if(~now).alias("n_past"),
        )
        .withColumn("rate", F.coalesce(F.try_divide("n_high", "n"), F.lit(0.0)))
        .withColumn("rate_before", F.coalesce(F.try_divide("high_before", "n_before"), F.lit(0.0)))
    )
    changed = (F.col("n") >= p.current_rows) & (F.col("n_before") >= p.baseline_rows) & (F.col("rate") >= p.current_rate) & (F.col("rate") - F.col("rate_before") >= p.rate_increase)
    cold = (F.col("n_past") < p.cold_ceiling) & (F.col("n") >= p.cold_rows) & (F.col("rate") >= p.cold_rate)
    kinds = F.array_compact(F.array(F.when(changed, F.lit("project_rolling_change")), F.when(cold, F.lit("cold_start"))))
    by_project = projects.select("project", "n", "n_high", F.explode(kinds).alias("kind")).select(F.concat("kind", F.lit(":"), "project").alias("key"), "kind", "n", "n_high")
    tags = rows.where(now & high & F.col("project").isNotNull()).select("project", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("project", "tag").agg(F.count("*").alias("n_tag"))
    dominant = (
        tags.join(projects.where(F.col("n_high") >= p.tag_high).select("project", "n_high"), "project")
        .where(F.col("n_tag") >= p.tag_rate * F.col("n_high"))
        .select(F.concat(F.lit("tag_dominance:"), "project", F.lit(":"), "tag").alias("key"), F.lit("tag_dominance").alias("kind"), F.col("n_tag").alias("n"), "n_high")
    )
    return bursts.unionByName(by_project).unionByName(dominant)


def continued(previous: DataFrame, found: DataFrame, evaluation: str, start: str, end: str) -> DataFrame:
    """(key, kind, state, evaluation, start, end, count) of all anomalies once the window [start, end) has been evaluated:
    previous(the same) with found(key, kind), as anomalies gives them, merged into it.

    What is found again in the window that follows the last one, of the same kind of evaluation, counts one more, and is
    persistent from two on; the same window evaluated again changes no count; anything else begins at one, provisional.
    What is not found is resolved and keeps its window and count. Keys are distinct on either side."""
    old = previous.select("key", F.col("kind").alias("old_kind"), F.col("state").alias("was"), F.col("evaluation").alias("last"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("count").alias("before"))
    both = old.join(found.select("key", "kind"), "key", "full")
    here = F.col("kind").isNotNull()
    same = (F.col("last") == evaluation) & (F.col("from") == F.lit(start)) & (F.col("to") == F.lit(end))
    follows = (F.col("was") != "resolved") & (F.col("last") == evaluation) & (F.col("to") == F.lit(start))
    count = F.when(~here, F.col("before")).when(same, F.col("before")).when(follows, F.col("before") + 1).otherwise(1).cast("long")
    now = lambda old_, new: F.when(here, F.lit(new)).otherwise(F.col(old_))
    rows = both.select("key", F.coalesce("kind", "old_kind").alias("kind"), here.alias("here"), count.alias("count"), now("last", evaluation).alias("evaluation"), now("from", start).alias("start"), now("to", end).alias("end"))
    state = F.when(~F.col("here"), "resolved").when(F.col("count") >= 2, "persistent").otherwise("provisional")
    return rows.select("key", "kind", state.alias("state"), "evaluation", "start", "end", "count")


def consolidation_ready(batches: DataFrame, cursors: DataFrame, running: DataFrame) -> DataFrame:
    """(session, through) of sessions to consolidate: up to the last unsplit batch that was selected or holds the
    session's end, if that lies beyond the cursor, every unsplit batch in between is completed and none is running.

    batches(session, ordinal, split, selected, has_end, state), cursors(session, through), running(session).
    """
    whole = batches.where("not split")
    cutoff = whole.where("selected or has_end").groupBy("session").agg(F.max("ordinal").alias("through"))
    done = cursors.groupBy("session").agg(F.max("through").alias("done"))
    ahead = cutoff.join(done, "session", "left").withColumn("done", F.coalesce("done", F.lit(-1))).where("through > done")
    between = whole.join(ahead, "session").where("ordinal > done and ordinal <= through")
    ready = between.groupBy("session").agg(F.max("through").alias("through"), F.bool_and(F.col("state") == "completed").alias("whole")).where("whole")
    return ready.join(running, "session", "left_anti").select("session", "through")


def purge_eligibility(archived: DataFrame, reviews: DataFrame, verifications: DataFrame, conflicts: DataFrame, months: int = 3) -> DataFrame:
    """(id, purge_at, reason): when an archived memory may go, or the first reason why it may not.

    archived(id, retain_forever, purge_after, pinned, archived_at), open reviews(id), open verifications(id), open
    conflicts(id, others). A row with neither purge_after nor archived_at is kept as undated.
    """
    disputed = conflicts.select("id").union(conflicts.select(F.explode("others")))
    flags = [("open_review", reviews.select("id")), ("open_verification", verifications.select("id")), ("open_conflict", disputed)]
    rows = archived
    for name, ids in flags:
        rows = rows.join(ids.distinct().withColumn(name, F.lit(True)), "id", "left")
    at = F.coalesce("purge_after", F.add_months("archived_at", months).cast("timestamp") + (F.col("archived_at") - F.date_trunc("day", "archived_at")))
    reason = F.when(F.col("retain_forever"), "retain_forever").when(F.col("purge_after").isNull() & F.col("pinned"), "pinned").when(at.isNull(), "undated")
    for name, _ in flags:
        reason = reason.when(F.col(name), name)
    rows = rows.withColumn("reason", reason)
    return rows.select("id", F.when(F.col("reason").isNull(), at).alias("purge_at"), "reason")


def clamp_retention(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """outputs(id, decision, evidence) no laxer than the strictest of inputs(decision, evidence) that share evidence:
    (id, decision, clamped). Those clamped to a kind that is not durable are left out."""
    cited = inputs.select(F.explode(F.array_distinct("evidence")).alias("e"), _strictness("decision").alias("place")).groupBy("e").agg(F.max("place").alias("place"))
    strictest = outputs.select("id", F.explode(F.array_distinct("evidence")).alias("e")).join(cited, "e").groupBy("id").agg(F.max("place").alias("strictest"))
    clamped = F.coalesce(F.col("strictest") > _strictness("decision"), F.lit(False))
    rows = outputs.join(strictest, "id", "left").withColumn("clamped", clamped)
    rows = rows.where(~F.col("clamped") | (F.col("strictest") <= STRICTNESS.index("project_phase") + 1))
    return rows.select("id", F.when(F.col("clamped"), _kind(F.col("strictest"))).otherwise(F.col("decision")).alias("decision"), "clamped")


def identity_faults(expected: DataFrame, returned: DataFrame, known: DataFrame) -> DataFrame:
    """(request, missing, extra, repeated, uncited): how an answer's ids and evidence differ from what was asked.

    expected(request, id), returned(request, id, evidence), known(request, evidence). Requests without a fault too.
    """
    both = expected.select("request", "id", F.lit(1).alias("asked"), F.lit(0).alias("given")).union(returned.select("request", "id", F.lit(0), F.lit(1)))
    ids = both.groupBy("request", "id").agg(F.max("asked").alias("asked"), F.sum("given").alias("given"))
    counts = ids.groupBy("request").agg(
        F.count_if((F.col("asked") == 1) & (F.col("given") == 0)).alias("missing"),
        F.count_if(F.col("asked") == 0).alias("extra"),
        F.count_if(F.col("given") > 1).alias("repeated"),
    )
    cited = returned.select("request", F.explode("evidence").alias("evidence")).distinct()
    uncited = cited.join(known, ["request", "evidence"], "left_anti").groupBy("request").agg(F.count("*").alias("uncited"))
    return counts.join(uncited, "request", "left").na.fill(0, ["uncited"])


def prompt_history(prompts: DataFrame, budget: int = 256, weights: tuple[int, ...] = (4, 2, 1)) -> DataFrame:
    """(session, ordinal, back, text): each prompt and those before it, newest first, cut to shares of a budget.

    prompts(session, ordinal, text); blank ones take no part. A share is a number of words, in place of tokens: by weight and
    rounded down, what is left for the oldest. A text over its share keeps head and tail around one ellipsis.
    """
    rows = prompts.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''")
    w = Window.partitionBy("session").orderBy("ordinal", "text")
    recent = F.array_compact(F.array(F.col("text"), *[F.lag("text", i).over(w) for i in range(1, len(weights))]))
    rows = rows.select("session", "ordinal", recent.alias("recent")).withColumn("n", F.size("recent"))
    rows = rows.select("session", "ordinal", "n", F.posexplode("recent").alias("back", "text"))
    shares = {n: [budget * weight // sum(weights[:n]) for weight in weights[: n - 1]] for n in range(1, len(weights) + 1)}
    limits = F.array(*[F.array(*map(F.lit, s + [budget - sum(s)])) for s in shares.values()])
    words = F.split("text", " ")
    room = F.col("limit") - 1
    head, tail = F.ceil(room / 2).cast("int"), F.floor(room / 2).cast("int")
    cut = F.concat(F.slice(words, F.lit(1), head), F.array(F.lit("…")), F.slice(words, F.size(words) - tail + 1, tail))
    rows = rows.withColumn("limit", limits[F.col("n") - 1][F.col("back")])
    return rows.select("session", "ordinal", "back", F.when(F.size(words) <= F.col("limit"), F.col("text")).otherwise(F.array_join(cut, " ")).alias("text"))
