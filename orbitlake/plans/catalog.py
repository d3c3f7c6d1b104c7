"""All queries of the library outside ``llm``, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from orbitlake.operators import cases, evaluation, kernels, raster, records, reports, scenes, splits, statistics, text_search, vectors

MODULES = [text_search, evaluation, raster, kernels, statistics, vectors, splits, reports, scenes, records, cases]


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.SQL
    return found
