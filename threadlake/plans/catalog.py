"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Keys follow the operator inventory; the ``sql_*`` modules hold the matching SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from threadlake.plans import q_curation, q_index, q_integrity, q_scalars, q_threads  # noqa: F401
    return QUERIES
