"""Named queries and their DuckDB equivalents."""

from __future__ import annotations

from plumbline.plans import checks, evidence, metrics, migrations, nested, reports, scalars, transitions  # noqa: F401  they fill the registry
from plumbline.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
