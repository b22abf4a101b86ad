"""Weights and thresholds of the scores. Each is a frozen value that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Image:
    best: float = 0.60
    top3: float = 0.25
    top5: float = 0.15


@dataclass(frozen=True)
class Video:
    best: float = 0.50
    top3: float = 0.30
    coverage: float = 0.20


@dataclass(frozen=True)
class Clip:
    top3: float = 0.35
    mean: float = 0.30
    coverage: float = 0.20
    rank: float = 0.15


@dataclass(frozen=True)
class Rerank:
    best: float = 0.25
    top5: float = 0.25
    temporal_best: float = 0.25
    temporal_top5: float = 0.15
    support: float = 0.10
    support_full: int = 10


@dataclass(frozen=True)
class Mode:
    clip: float
    top3: float
    mean: float
    coverage: float
    temporal: float
    ocr: float


@dataclass(frozen=True)
class Temporal:
    """Episode score with a normal and a credit-scene mode."""

    normal: Mode = field(default_factory=lambda: Mode(0.45, 0.20, 0.10, 0.10, 0.10, 0.05))
    credit: Mode = field(default_factory=lambda: Mode(0.25, 0.10, 0.05, 0.05, 0.20, 0.35))
    threshold: float = 0.35
    percentile: float = 0.60
    cluster_seconds: float = 12.0
    cluster_full: int = 4
    spread_seconds: float = 60.0
    cluster: float = 0.70
    spread: float = 0.30


@dataclass(frozen=True)
class Sequence:
    mean: float = 0.40
    least: float = 0.20
    consistency: float = 0.20
    ordering: float = 0.20
    deviation: float = 0.20
    dead_band: float = 0.01


@dataclass(frozen=True)
class SequenceRerank:
    base: float = 0.75
    sequence: float = 0.25
    best: float = 0.50
    top3: float = 0.30
    mean: float = 0.20
    group_seconds: float = 6.0


@dataclass(frozen=True)
class Fingerprint:
    radius: int = 2
    strong: float = 0.70
    local_best: float = 0.60
    local_mean: float = 0.25
    local_share: float = 0.15
    best: float = 0.35
    top3: float = 0.25
    mean: float = 0.15
    strongest_local: float = 0.15
    mean_local: float = 0.10


@dataclass(frozen=True)
class Prototype:
    best: float = 0.35
    top3: float = 0.35
    mean: float = 0.20
    share: float = 0.10
    strong: float = 0.70


@dataclass(frozen=True)
class Subtitle:
    best: float = 0.60
    top3: float = 0.25
    support: float = 0.15
    strong: float = 0.30
    support_full: int = 3
    window_seconds: float = 4.0
    line: float = 0.40
    around: float = 0.60
    around_seconds: float = 15.0
