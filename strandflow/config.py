"""Typed settings of the read pipeline; the defaults define its results."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .functions.consensus import backend


@dataclass(frozen=True)
class ReadSettings:
    anchor_edits: int = 12
    flank_bp: int = 30
    least_units: int = 15
    most_units: int = 160
    draft_reads: int = 24
    consensus: str = "partial_order"
    polish_rounds: int = 2
    polish_reads: int = 120
    run_vote: int = 4
    insertion_majority: float = 0.5
    het_af: float = 0.2
    het_reads: int = 5
    gap_factor: float = 1.5
    het_group: float = 0.15
    link_phi: float = 0.5
    link_sites: int = 2
    link_reads: int = 10
    #: About how many different reads of a peak a task lays together; all are counted.
    site_reads: int = 300
    site_run: int = 3
    run_background: float = 4.0
    run_safety: float = 2.0
    minor_alpha: float = 0.001
    minor_floor: float = 0.09
    strand_reads: int = 5
    strand_alpha: float = 0.001
    single_error: float = 0.02
    single_floor: float = 0.4
    single_alpha: float = 0.001
    quality_alpha: float = 0.0
    quality_af_alpha: float = 0.001
    quality_keep: float = 0.5
    quality_groups: int = 0
    group_apart_bp: float = 42.0
    fragment_bp: int = 1000
    margin: int = 3
    error_rate: float = 0.15
    residual_af: float = 0.25
    adequate_depth: int = 30
    low_depth: int = 10
    llr: float = 10.0
    event_reads: int = 20
    event_af: float = 0.30
    event_alternative: float = 0.25
    event_run: int = 4
    context_units: float = 1.0
    class_runs: int = 2
    class_reads: int = 200
    class_growth: float = 3.0
    confusion: float = 0.3
    longest_run: int = 16
    pseudo: float = 0.5

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "consensus":
                backend(v)
                continue
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not v == v or v < 0:
                raise ValueError(f"{f.name}: {v!r}")
        if self.least_units >= self.most_units or self.low_depth > self.adequate_depth:
            raise ValueError("bounds cross")


@dataclass(frozen=True)
class DecisionSettings:
    ambiguous_bases: int = 10
    legacy_reads: int = 30


def from_dict(kind, values: dict):
    """Settings from a mapping; unknown names are errors."""
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**values)
