"""All queries of the library's own operators; importing a query module registers its queries."""

from __future__ import annotations

from diffspark.plans import planning as _planning  # noqa: F401  (registers its queries)
from diffspark.plans import queries as _queries  # noqa: F401  (registers its queries)
from diffspark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
