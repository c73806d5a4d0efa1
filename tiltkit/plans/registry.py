"""All registered queries and their DuckDB formulations."""

from __future__ import annotations

from . import catalog, discontinuity, reports, stored


def queries() -> dict:
    return {**catalog.QUERIES, **discontinuity.QUERIES, **reports.QUERIES, **stored.QUERIES}


def oracles() -> dict:
    return {k: f() for k, f in {**catalog.ORACLES, **discontinuity.ORACLES, **reports.ORACLES, **stored.ORACLES}.items()}
