"""Registry of the engine's queries: Spark callable + DuckDB oracle text.

Each entry reads the given tables through the adapter views, so its work
grows with the tables.  ``register`` keeps name, callable and oracle
together; modules under ``kappaflow.plans.q_*`` fill the registry on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import (q_agreement, q_annotate, q_grading, q_iterations, q_lexicon, q_models,  # noqa: F401
                   q_profile, q_stream, q_text)
