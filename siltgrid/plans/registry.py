"""All queries that do not belong to an optional subpackage."""

from __future__ import annotations

from siltgrid.plans import analysis, preparation


def queries() -> dict:
    return {**analysis.QUERIES, **preparation.queries()}


def oracle_sql() -> dict[str, str]:
    return {**analysis.SQL, **preparation.oracle_sql()}
