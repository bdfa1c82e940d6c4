"""DuckDB SQL builders for the oracle side (same semantics as the Spark
Column functions, written in DuckDB's dialect)."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.patterns import sql_literal as lit


def replace_sql(expr: str, kind: str) -> str:
    repl = P.PII_COLUMN if kind in P.NAME_PATTERNS else P.REDACTED
    return f"regexp_replace({expr}, {lit(P.duckdb_form(P.ALL_PATTERNS[kind]))}, {lit(repl)}, 'g')"


def mask_text_sql(expr: str) -> str:
    for kind in P.MASK_TEXT_ORDER + list(P.NAME_PATTERNS):
        expr = replace_sql(expr, kind)
    return expr


def sanitize_sql(expr: str) -> str:
    for kind in P.SANITIZE_ORDER:
        expr = replace_sql(expr, kind)
    return expr


def count_sql(expr: str, kind: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(P.duckdb_form(P.ALL_PATTERNS[kind]))}))"


def extract_sql(expr: str, kind: str) -> str:
    return f"regexp_extract_all({expr}, {lit(P.duckdb_form(P.ALL_PATTERNS[kind]))})"


def matches_sql(expr: str, kind: str) -> str:
    return f"regexp_matches({expr}, {lit(P.duckdb_form(P.ALL_PATTERNS[kind]))})"
