"""Registered query set: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads whole tables and returns a
DataFrame; floating results are rounded to 6 decimals on both sides so the
order-insensitive value hash is stable.
"""

from __future__ import annotations

REGISTRY: dict[str, tuple] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query name {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple]:
    from tabloom.plans import (queries_relational, queries_profile, queries_clean,  # noqa: F401
                               queries_stats, queries_forecast, queries_ml)
    return REGISTRY
