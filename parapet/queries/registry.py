"""All queries of the risk operators."""

from __future__ import annotations

from parapet.queries import calibration, code, metadata, names, policy, sources  # noqa: F401
from parapet.queries.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
