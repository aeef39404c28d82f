"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from scoremon.plans import (  # noqa: F401
    calibration_queries,
    column_queries,
    monitor_queries,
    table_queries,
)
from scoremon.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
