"""Policy constants (fixed values), one place to vary them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchPolicy:
    k1: float = 1.2
    b: float = 0.75
    term_limit: int = 64
    fusion_offset: int = 60
    page: int = 16
    target_tokens: int = 4096


@dataclass(frozen=True)
class RetryPolicy:
    delays: tuple[int, ...] = (30, 60, 120, 240, 480, 900)


@dataclass(frozen=True)
class WorkingSetPolicy:
    target: int = 2500
    low_water: int = 2000
    cold_days: int = 90


@dataclass(frozen=True)
class BatchPolicy:
    max_events: int = 64
    max_bytes: float = 65_536.0
    stop_kind: str = "Stop"
    end_kind: str = "SessionEnd"


@dataclass(frozen=True)
class ScorePolicy:
    rare_fraction: float = 0.01
    rare_length: int = 3
    applicable_coverage: float = 0.25
    rare_coverage: float = 0.15
    exact_coverage: float = 0.5
    lexical_coverage: float = 0.3
    strong_lift: float = 0.02
    weak_lift: float = 0.01
    standalone_lift: float = 0.03
    median_scope: int = 8
    typical_median: float = 0.83


@dataclass(frozen=True)
class PackPolicy:
    items: int = 6
    probable_items: int = 2
    hard_limit: int = 1024
    target: int = 600
    full_limit: int = 192


@dataclass(frozen=True)
class EpochPolicy:
    soft: int = 8192
    hard: int = 12_288


@dataclass(frozen=True)
class ArchivePolicy:
    space_high: int = 3000
    space_target: int = 2700
    total_high: int = 6000
    total_target: int = 5500
    cold_days: int = 14
    batch: int = 50


@dataclass(frozen=True)
class RecoveryPolicy:
    attempts: int = 7
    recoveries: int = 2
    pause_hours: int = 6


@dataclass(frozen=True)
class SessionPolicy:
    tokens: int = 1200
    always_tokens: int = 600
    items: int = 12
    identities: int = 4
    compact_limit: int = 96
    identity_limit: int = 48
    header_tokens: int = 120  # what stands before the items, and what each of them takes besides its text
    item_tokens: int = 24


@dataclass(frozen=True)
class ExcerptPolicy:
    messages: int = 6
    fade: float = 0.65
    recent: float = 12.0
    overlap: int = 3
    entities: int = 2
    least_tokens: int = 24
    label_tokens: int = 10  # of a fragment's label


@dataclass(frozen=True)
class PromptPolicy:
    items: int = 6
    soft_items: int = 2  # of a prompt once the epoch is past its soft target
    soft_score: int = 5
    probable_items: int = 2
    hard_limit: int = 1024
    target: int = 600
    compact_limit: int = 96
    identity_limit: int = 48
    plain_limit: int = 96  # of a full form that stands in for a missing short one
    full_limit: int = 192
    epoch_soft: int = 8192
    epoch_hard: int = 12_288
    header_tokens: int = 96  # what the first pack of an epoch has before its items, and each later one
    later_tokens: int = 12
    item_tokens: int = 24
