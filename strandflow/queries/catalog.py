"""All queries of the engine's own operators."""

from __future__ import annotations

from . import aggregates, decision, jobs, joins, profile, quality, records, results, scoring, sequence, statistics

MODULES = (sequence, joins, aggregates, statistics, decision, quality, records, results, scoring, profile, jobs)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.R.oracles.items()}
