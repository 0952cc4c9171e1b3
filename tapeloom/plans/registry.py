"""Collects the queries and SQL twins of the plan modules."""

from __future__ import annotations

from . import base, ledger, market, rules, streams  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.TWINS)
