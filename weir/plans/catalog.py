"""The query catalog: every registered query of the engine with its SQL."""

from __future__ import annotations

from weir.plans import learn, relational, reports, sequence, stats, text  # noqa: F401
from weir.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
