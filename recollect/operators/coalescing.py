"""When a catalog is rebuilt: changes are waited out, but not for ever, and failures pause it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CoalescePolicy:
    """In microseconds; with recovery a build also waits for so many changes, or so long since the last build."""

    quiet: int = 30_000_000
    staleness: int = 120_000_000
    cool_down: int = 300_000_000
    recovery_changes: int = 0
    recovery_staleness: int = 900_000_000


@dataclass(frozen=True)
class Catalog:
    """What is known of a catalog; times are null where nothing of the kind has happened since it mattered."""

    generation: int = 0
    published: int = 0
    building: int | None = None
    started_at: int | None = None
    dirty_at: int | None = None
    force_at: int | None = None
    completed_at: int | None = None
    failed_at: int | None = None
    seen_at: int | None = None  # the last instant at which something happened: nothing is due before it


def due(c: Catalog, policy: CoalescePolicy) -> tuple[int, str] | None:
    """When the next build starts, if nothing else happens, and why: the changes have been quiet, or have waited too long;
    not before a failure or a build without an outcome has cooled down."""
    if c.dirty_at is None or c.generation <= c.published:
        return None
    quiet = c.dirty_at + policy.quiet
    at, why = (c.force_at, "force_due") if c.force_at is not None and c.force_at <= quiet else (quiet, "quiet_period")
    waits = [c.seen_at] + ([c.failed_at + policy.cool_down] if c.failed_at is not None else [])
    if c.building is not None:
        waits.append(c.started_at + policy.cool_down)
    if policy.recovery_changes and c.generation - c.published < policy.recovery_changes:
        waits.append((c.completed_at if c.completed_at is not None else c.dirty_at) + policy.recovery_staleness)
        why = "recovery_staleness"
    elif policy.recovery_changes:
        why = "recovery_batch"
    at = max([at, *waits])
    if why == "quiet_period" and c.force_at is not None and c.force_at <= at:
        why = "force_due"
    return at, why


def start(c: Catalog, at: int) -> Catalog:
    return replace(c, building=c.generation, started_at=at, seen_at=at)


def happened(c: Catalog, kind: str, at: int, policy: CoalescePolicy) -> Catalog:
    """After a change, or the outcome of the build that runs; an outcome without a build is nobody's."""
    c = replace(c, seen_at=at)
    if kind == "change":
        return replace(c, generation=c.generation + 1, dirty_at=at, force_at=c.force_at if c.force_at is not None else at + policy.staleness)
    if c.building is None or kind not in ("built", "failed"):
        return c
    if kind == "failed":
        return replace(c, building=None, failed_at=at)
    done = c.building >= c.generation
    return replace(c, published=max(c.published, c.building), building=None, completed_at=at, failed_at=None, dirty_at=None if done else c.dirty_at, force_at=None if done else c.force_at)


def passes(c: Catalog, until: int, policy: CoalescePolicy, inclusive: bool) -> tuple[Catalog, list[tuple[int, int, str]]]:
    """The catalog once time has passed, and the builds started meanwhile as (at, generation, reason)."""
    out = []
    while (next_ := due(c, policy)) and (next_[0] < until or (inclusive and next_[0] == until)):
        c = start(c, next_[0])
        out.append((next_[0], c.generation, next_[1]))
    return c, out


def builds(events: DataFrame, until: int, policy: CoalescePolicy = CoalescePolicy()) -> DataFrame:
    """(catalog, at, generation, reason): the builds that events(catalog, at, kind) lead to, up to the instant `until` in
    microseconds. kind: change, built, failed; others and null kinds do nothing; what happens at one instant goes by kind,
    before a build that is due then. Null catalogs are one, rows with a null time are left out.

    A task reads a catalog's events in order and keeps a few numbers; catalogs are dealt out by hash."""
    rows = events.where("at IS NOT NULL").select("catalog", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.coalesce("kind", F.lit("")).alias("kind"))
    kind = rows.schema["catalog"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, c, out = None, None, []
        for batch in batches:
            for catalog, at, what in zip(batch["catalog"].astype(object).where(batch["catalog"].notna(), None), batch["at"].tolist(), batch["kind"], strict=True):
                if c is None or catalog != key:
                    if c is not None:
                        out += [(key, *b) for b in passes(c, until, policy, True)[1]]
                    key, c = catalog, Catalog()
                if at > until:
                    continue
                c, fired = passes(c, at, policy, False)
                out += [(key, *b) for b in fired]
                c = happened(c, what, at, policy)
            yield _frame(out)
            out = []
        if c is not None:
            yield _frame([(key, *b) for b in passes(c, until, policy, True)[1]])

    ordered = rows.repartition("catalog").sortWithinPartitions("catalog", "at", "kind")
    found = ordered.mapInPandas(run, f"catalog {kind}, at long, generation long, reason string")
    return found.withColumn("at", F.timestamp_micros("at"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["catalog", "at", "generation", "reason"])
