"""Query registry: name -> (Spark plan builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ops: str  # SURVEY §2 operator ids covered, e.g. "M7 M12"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, ops: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from . import (q_masking, q_chat, q_audit, q_limiter, q_code, q_catalog,  # noqa: F401
                   q_streaming)
    return REGISTRY
