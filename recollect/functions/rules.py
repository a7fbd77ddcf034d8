"""Decisions as column expressions: prompts, sensitivity, representations, priorities, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_tagged, token_estimate

# The patterns and word lists that decide.
AUTHORIZATION = r"""(?i)authorization\s*:\s*(?:bearer|basic)\s+[^\s"}]+"""
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
CREDENTIAL_FIELD = r"""(?i)(?:api[_-]?key|password|secret|session[_-]?cookie)\s*[:=]\s*["']?[^\s,"'}]{8,}"""
CONTEXTUAL = r"(?i)(?:credential|authentication|auth)[^0-9]{0,32}([A-Za-z0-9+/_=-]{24,})"
HARMLESS = (r"(?i)^[0-9a-f]{40}([0-9a-f]{24})?$", r"(?i)^[0-9a-f]{8}-[0-9a-f-]{27}$", r"(?i)^(test|example|dummy|placeholder)", r"^[_-]?[A-Za-z]+([_-][A-Za-z]+)+[_-]?$")
CONTINUATION = r"^(ok|okay|yes|sure|continue|好的?|可以|同意|继续|行了?|没问题)[。.!！]?$"
DEICTIC = r"这个|这些|这项|这条|这种|这套|这次|这里|这样|那个|那些|那项|那条|那种|那套|那次|那里|那样|那么|它|当前|现在|刚才|上述|前面|上面|继续|还是|\b(this|that|these|those|it|current|now|earlier|previous|above|continue)\b"
NOTIFICATION = r"^\s*<task-notification>"
PRIVATE_PREFIX = r"(?i)^\s*p\s*[：:]"
PROBE_SOURCE = r"(?i)(^|[:/_-])(probe|benchmark|latency-probe|exact-response)($|[:/_-])"
FILE_PATH = r"(?:[\w.@-]+/)+[\w.@-]+\.(?:ts|tsx|js|mjs|cjs|md|mdx|json|py|mm|h|hpp|c|cc|cpp|cfg|toml|ya?ml|sh|swift|kt|java|go|rs)\b"
IDENTIFIERS = (r"`([^`]{3,60})`", r"(\b[A-Za-z_][A-Za-z0-9_]*(?:[._][A-Za-z0-9_]+)+\b)", r"(\b[a-z]+[A-Z][A-Za-z0-9]{3,}\b|\b[A-Z][a-z]+[A-Z][A-Za-z0-9]+\b)")
COMMON_WORDS = ("return", "string", "number", "boolean", "undefined", "function", "default", "project", "preview", "session")
CRITICAL_TAGS, STRONG_TAG = ("safety", "architecture", "decision"), "constraint"
CONTRACTS, HAZARDS = ("preference_constraint", "architecture_contract"), ("failure_recovery_hazard", "workflow_environment_toolchain")
DETAILS = ("task_requirement", "artifact_detail", "run_result")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def sensitivity(text: Column) -> Column:
    """struct(state, category, matched): secret by three patterns in turn, else uncertain where a long token stands near
    a word for credentials and does not look like a hash, a UUID, a test value or an identifier, else normal. Null is
    normal."""
    near = found(text, CONTEXTUAL, 1)
    suspect = near.isNotNull()
    for pattern in HARMLESS:
        suspect &= ~near.rlike(pattern)
    verdict = lambda state, category, matched: F.struct(F.lit(state).alias("state"), F.lit(category).cast("string").alias("category"), matched.cast("string").alias("matched"))
    out = F.when(suspect, verdict("uncertain", "contextual_credential", near)).otherwise(verdict("normal", None, F.lit(None)))
    for category, pattern in reversed((("authorization_header", AUTHORIZATION), ("private_key", PRIVATE_KEY), ("credential_field", CREDENTIAL_FIELD))):
        out = F.when(text.rlike(pattern), verdict("secret", category, found(text, pattern))).otherwise(out)
    return out


def user_words(prompt: Column) -> Column:
    """What stands in user_message elements, trimmed and joined by a blank line; the prompt itself if there is none."""
    inside = F.regexp_extract_all(prompt, F.lit(r"(?s)<user_message>(.*?)</user_message>"), F.lit(1))
    return F.when(F.size(inside) > 0, F.array_join(F.transform(inside, lambda x: strip(x)), "\n\n")).otherwise(prompt)


def public_text(prompt: Column) -> Column:
    """struct(text, whole): the prompt without private spans; whole where all of it is private."""
    whole = F.coalesce(user_words(prompt).rlike(PRIVATE_PREFIX), F.lit(False))
    return F.struct(F.when(whole, "").otherwise(strip_tagged(prompt, "(?:private|pv)")).alias("text"), whole.alias("whole"))


def skip_reason(prompt: Column) -> Column:
    """Why a prompt asks for nothing: empty, a bare continuation, an agent's notification; else null."""
    plain = F.lower(strip(F.coalesce(prompt, F.lit(""))))
    return F.when(plain == "", "empty_prompt").when((F.length(plain) <= 12) & plain.rlike(CONTINUATION), "continuation_only").when(prompt.rlike(NOTIFICATION), "agent_notification")


def context_dependent(prompt: Column) -> Column:
    plain = F.lower(strip(prompt))
    return F.coalesce((F.length(plain) <= 160) & plain.rlike(DEICTIC), F.lit(False))


def file_paths(text: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_PATH), F.lit(0))), 1, most)


def identifiers(text: Column, most: int = 6) -> Column:
    """Code spans, dotted names and mixed-case names, in that order, of five characters or more."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in IDENTIFIERS])
    plain = F.transform(every, lambda x: F.regexp_replace(F.trim(x), r"^\(+|\)+$", ""))
    kept = F.filter(plain, lambda x: (F.length(x) >= 5) & ~F.lower(x).isin(*COMMON_WORDS) & ~(F.contains(x, F.lit(" ")) & (F.length(x) > 40)))
    return F.slice(F.array_distinct(kept), 1, most)


def references(prompt: Column) -> Column:
    """The numbers of M:<n> references."""
    return F.transform(F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\bM:([1-9][0-9]*)\b"), F.lit(1))), lambda x: x.cast("long"))


def authority_gate(authority: Column, policy: Column, validity: Column, human_only: bool, policy_version: str | None) -> Column:
    """Whether a memory may be injected without being asked for; policy_version admits agent memories of that policy."""
    admitted = F.lit(True)
    if human_only:
        admitted = authority == "human_authored"
        admitted = admitted | policy.eqNullSafe(policy_version) if policy_version else admitted
    return admitted & ~((authority == "agent_derived") & validity.eqNullSafe("review_due"))


def base_tier(category: Column, authority: Column, tags: Column) -> Column:
    critical = (category == "safety_data_integrity") | ((authority == "human_authored") & category.isin(*CONTRACTS)) | F.arrays_overlap(tags, F.array(*map(F.lit, CRITICAL_TAGS)))
    return F.when(critical, "critical").when(category.isin(*HAZARDS) | F.array_contains(tags, STRONG_TAG), "strong").otherwise("normal")


def effective_tier(base: Column, own_project: Column) -> Column:
    return F.when(own_project & (base == "normal"), "strong").when(own_project, "critical").otherwise(base)


def searchable_text(*parts: Column) -> Column:
    """Trimmed parts that are not empty, each once, in order, a line each; null parts are left out."""
    kept = F.filter(F.transform(F.array(*parts), lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(kept), "\n")


def representation_valid(text: Column, validated: Column, source_revision: Column, revision: Column, most: int) -> Column:
    return F.coalesce(validated & (source_revision == revision) & (strip(text) != "") & (token_estimate(text) <= most), F.lit(False))


def representation(compact: Column, compact_valid: Column, label: Column, label_valid: Column, tier: Column, allow_identity: Column) -> Column:
    """struct(kind, text): the compact form, else the label of a memory above normal, else null."""
    kind = lambda k, x: F.struct(F.lit(k).alias("kind"), x.alias("text"))
    return F.when(compact_valid, kind("compact", compact)).when(allow_identity & (tier != "normal") & label_valid, kind("identity", label))


def exact_compact(body: Column, qualifiers: Column, most: int = 96) -> Column:
    """Whether a body is short enough to stand for itself and holds every qualifier, space and case folded."""
    fold = lambda x: F.lower(F.regexp_replace(strip(x), r"\s+", " "))
    held = F.forall(F.filter(F.transform(qualifiers, fold), lambda q: q != ""), lambda q: F.contains(fold(body), q))
    return F.coalesce((strip(body) != "") & (token_estimate(strip(body)) <= most) & held, F.lit(False))


def retention_priority(priority: Column, current: Column, horizon: Column, kind: Column) -> Column:
    """An assessed priority, lowered to normal where it is unknown, of another policy, or too high for what it is of."""
    unsure = priority.isNull() | ~F.coalesce(current, F.lit(False)) | (horizon == "unknown") | (kind == "uncertain")
    inflated = (priority == "high") & ((horizon != "durable") | kind.isin(*DETAILS))
    return F.when(unsure | inflated, "normal").otherwise(priority)


def claim_category(claim: Column) -> Column:
    return F.when(claim.isin("preference", "decision_requirement"), "preference_constraint").when(claim.isin("workflow_process", "machine_state"), "workflow_environment_toolchain").otherwise("durable_reference")


def item_scope(requested: Column, scope: Column, explicit_user: Column, support: Column) -> Column:
    """global where it was asked for, or where nothing was and the user stated a lasting global rule; else project."""
    wide = F.when(requested.isNotNull(), requested == "global").otherwise((scope == "global") & explicit_user & (support == "user_stated_rule"))
    return F.when(wide, "global").otherwise("project")


def origin_key(origin: Column) -> Column:
    """A repository's origin in one form: the short user@host:path as ssh, no credentials, query, fragment, default port,
    trailing slash or .git, the host in lower case; null if it is no URL."""
    local = origin.rlike(r"^(/|\./|\.\./)")
    scp = (~F.contains(origin, F.lit("://"))) & origin.rlike(r"^([^@/]+@)?[^:/]+:.+$")
    url = F.when(scp, F.regexp_replace(origin, r"^(?:[^@/]+@)?([^:/]+):(.+)$", "ssh://$1/$2")).otherwise(origin)
    url = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-z]+://)[^@/]*@", "$1")
    scheme, host, port, path = (F.regexp_extract(url, r"^([a-z]+)://([^/:]+)(?::([0-9]+))?(/.*)?$", i) for i in (1, 2, 3, 4))
    usual = ((scheme == "ssh") & (port == "22")) | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/+", "/"), "/$", ""), r"\.git$", "")
    whole = F.concat(scheme, F.lit("://"), F.lower(host), F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port)), F.regexp_replace(path, "/$", ""))
    return F.when(local, F.concat(F.lit("file://"), origin)).when(scheme != "", whole)


def fused_score(direct: Column, ranks: list[Column], exact: Column, applicable: Column, offset: int = 60) -> Column:
    """One for a direct reference, the reciprocal of each rank there is, and the weight of a first rank for an exact
    term, half of it where the prompt applies."""
    total = direct.cast("int").cast("double")
    for rank in ranks:
        total += F.coalesce(1 / (offset + rank), F.lit(0.0))
    return total + F.when(exact, 1 / (offset + 1)).otherwise(0.0) + F.when(applicable, 0.5 / (offset + 1)).otherwise(0.0)


def explicit_admission(direct: Column, lexical: Column, leads: Column, similarity: Column, margin: Column) -> Column:
    """Why a row may stand among explicit results: its id, its words, its lead alone, or its nearness with words."""
    semantic = F.coalesce((leads & (similarity >= 0.82) & (margin >= 0.02)) | ((similarity >= 0.58) & lexical), F.lit(False))
    reasons = F.array(F.when(direct, "memory_identity"), F.when(lexical, "lexical_match"), F.when(semantic, "semantic_match"))
    return F.array_compact(reasons)


def recall_stage(outcome: Column, omission: Column) -> Column:
    """Where a relevant item was lost; null outcomes were never examined."""
    known = {"already_present": "already_present", "scorer_below_threshold": "scorer_rejected", "unfiltered_low_confidence": "scorer_unavailable", "weak_relevance": "local_weak", "representation_unavailable": "unavailable"}
    by = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(outcome.isNull(), "not_examined").when(outcome == "selected", "injected").otherwise(F.coalesce(by[omission], F.lit("limit")))


def index_wait(state: Column, started: Column, completed: Column, backlog: Column, cooldown_s: int) -> Column:
    """struct(reason, until): why an index build waits, and until when; null `until` when it is ready."""
    reason = F.when((state == "building") & started.isNotNull(), "building").when(completed.isNotNull() & (state == "failed"), "failure_cooldown").when(completed.isNotNull() & (state == "complete") & backlog, "backlog_coalescing").otherwise("ready")
    later = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(cooldown_s)))
    return F.struct(reason.alias("reason"), (F.when(reason == "building", started).when(reason != "ready", completed) + later).alias("until"))


def quote_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def cursor(*parts: Column) -> Column:
    """A page's last key in base64 that may stand in a URL."""
    return F.rtrim(F.translate(F.base64(F.array_join(F.array(*[p.cast("string") for p in parts]), "\x1f").cast("binary")), "+/", "-_"), F.lit("="))


def cursor_parts(value: Column) -> Column:
    return F.split(F.unbase64(F.translate(value, "-_", "+/")).cast("string"), "\x1f")


def halved_batch(attempts: Column, size: int = 16) -> Column:
    return F.greatest(F.lit(1), F.floor(size / F.pow(F.lit(2), attempts))).cast("int")


def due_dates(cadence: Column, first: Column, last: Column, anchor: str = "2026-09-11") -> Column:
    """The days a cadence falls on: before the anchor Mondays (monthly: the month's first), after it Mondays for monthly
    and every third day from the anchor for weekly."""
    day_of = lambda d: F.weekday(d) == 0
    at = F.lit(anchor).cast("date")
    early = lambda d: day_of(d) & ((cadence == "weekly") | (F.dayofmonth(d) <= 7))
    late = lambda d: F.when(cadence == "monthly", day_of(d)).otherwise(F.datediff(d, at) % 3 == 0)
    return F.filter(F.sequence(first, last), lambda d: F.when(d < at, early(d)).otherwise(late(d)))
