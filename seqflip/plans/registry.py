"""Registered queries: one Spark builder and (where SQL can express it) one
oracle SQL string per operator.  Builders take ``(spark, sf_dir)``.

Output columns are aliased identically on both sides; token arrays are
compared in their comma-joined text form and scores rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import SequenceSpec
from .documents import DOC_KEYS

SPEC = SequenceSpec()
KEYS = DOC_KEYS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def _load_all() -> None:
    from . import (certificate_queries, document_queries, generator_queries, io_queries, model_queries,  # noqa: F401
                   search_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(SQL)
