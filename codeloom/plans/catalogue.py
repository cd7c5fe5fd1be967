"""All registered core queries and their SQL."""

from __future__ import annotations

from codeloom.plans import problems, reference

_MODULES = (problems, reference)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
