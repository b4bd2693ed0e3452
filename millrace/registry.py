"""Every registered query of the library and its SQL twin."""

from __future__ import annotations

from .plans import evaluation, gates, scalars, sequences, studies, waves  # noqa: F401  registers their queries
from .plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
