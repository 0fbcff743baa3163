"""All queries of the library by name, with their SQL oracles."""

from __future__ import annotations

from lodestar.plans import decisions, features, reports, views  # noqa: F401  they register their queries
from lodestar.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
