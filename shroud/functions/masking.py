"""Masking as Column expressions (JVM-side, whole-stage codegen friendly).

``mask_text`` and ``sanitize_prompt`` compose ``regexp_replace`` calls, so they
run inside the scan's projection with no Python in the hot path. ``mask_nested``
walks a DataFrame schema and rebuilds nested values with ``transform`` /
``transform_values`` / ``struct``, masking every string leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mask_pattern(col, kind: str) -> Column:
    """Replace every match of one named pattern (see ``patterns.ALL_PATTERNS``)."""
    repl = P.PII_COLUMN if kind in P.NAME_PATTERNS else P.REDACTED
    c = _c(col)
    out = F.regexp_replace(c, P.spark_form(P.ALL_PATTERNS[kind]), repl)
    if kind == "email":
        # an e-mail needs an '@': skip the regex scan for text without one
        return F.when(F.instr(c, "@") > 0, out).otherwise(c)
    return out


def mask_card(col) -> Column:
    return mask_pattern(col, "card")


def mask_ssn(col) -> Column:
    return mask_pattern(col, "ssn")


def mask_email(col) -> Column:
    return mask_pattern(col, "email")


def mask_ip(col) -> Column:
    return mask_pattern(col, "ip")


def mask_credentials(col) -> Column:
    return mask_pattern(col, "credential")


def mask_pii_names(col) -> Column:
    """Column names that hint at personal data -> '[PII_COLUMN]'.

    The three name patterns run as their union in one pass (identical result:
    whole words from disjoint lists, one replacement)."""
    return F.regexp_replace(_c(col), P.spark_form(P.PII_NAMES_ALL), P.PII_COLUMN)


def mask_text(col) -> Column:
    """Card, SSN, e-mail, IP -> '[REDACTED]'; then PII column names -> '[PII_COLUMN]'.

    Each pattern rewrites the output of the previous one (order matters)."""
    out = _c(col)
    for kind in P.MASK_TEXT_ORDER:
        out = mask_pattern(out, kind)
    return mask_pii_names(out)


def sanitize_prompt(col) -> Column:
    """Card, SSN, e-mail, IP, credentials -> '[REDACTED]' (no column names)."""
    out = _c(col)
    for kind in P.SANITIZE_ORDER:
        out = mask_pattern(out, kind)
    return out


def _mask_value(c: Column, dt: T.DataType, fn) -> Column:
    """Rebuild one value of type ``dt`` with every string leaf masked by ``fn``."""
    if isinstance(dt, T.StringType):
        return fn(c)
    if isinstance(dt, T.ArrayType):
        if not _has_string(dt.elementType):
            return c
        return F.transform(c, lambda x: _mask_value(x, dt.elementType, fn))
    if isinstance(dt, T.MapType):
        # keys are left untouched; only values are masked
        if not _has_string(dt.valueType):
            return c
        return F.transform_values(c, lambda k, v: _mask_value(v, dt.valueType, fn))
    if isinstance(dt, T.StructType):
        if not _has_string(dt):
            return c
        rebuilt = F.struct(*[_mask_value(c.getField(f.name), f.dataType, fn).alias(f.name)
                             for f in dt.fields])
        return F.when(c.isNotNull(), rebuilt)
    return c


def _has_string(dt: T.DataType) -> bool:
    if isinstance(dt, T.StringType):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_string(dt.elementType)
    if isinstance(dt, T.MapType):
        return _has_string(dt.valueType)
    if isinstance(dt, T.StructType):
        return any(_has_string(f.dataType) for f in dt.fields)
    return False


def mask_column(df: DataFrame, name: str, fn=mask_text) -> Column:
    """Masked version of column ``name`` of ``df`` (any nesting)."""
    return _mask_value(F.col(name), df.schema[name].dataType, fn).alias(name)


def mask_nested(df: DataFrame, cols: list[str] | None = None, fn=mask_text) -> DataFrame:
    """Mask string values inside the given (default: all) columns, keeping the
    schema. Arrays and map values are recursed into, struct fields rebuilt;
    map keys, numbers and booleans are left as they are."""
    targets = set(cols if cols is not None else df.columns)
    return df.select(*[mask_column(df, c, fn) if c in targets else F.col(c)
                       for c in df.columns])


def mask_table(df: DataFrame, fn=mask_text) -> DataFrame:
    """Mask every column of a table in one projection."""
    return mask_nested(df, None, fn)
