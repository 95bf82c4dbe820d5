"""All queries of the core with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from reelgrain.plans import frames, images, masks

MODULES = [frames, images, masks]


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
