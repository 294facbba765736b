"""All named queries, gathered from the modules that define them."""

from __future__ import annotations

from ledgerloom.plans import (  # noqa: F401
    composites,
    ingestion_queries,
    question_queries,
    relational_queries,
    scalar_queries,
)
from ledgerloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
