"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from . import evaluation, evaluation_sets, manifest, models, pairs, peptides, prepare, reach, regions, run_metrics, selection, signals, skewed, streams

MODULES = [skewed, reach, manifest, signals, evaluation, evaluation_sets, models, regions, run_metrics, prepare, pairs, peptides, selection, streams]


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(m.SQL)
    return out
