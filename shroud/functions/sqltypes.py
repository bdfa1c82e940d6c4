"""Normalise a declared SQL type to the catalog's type text.

The declared text is parsed once into (base name, precision, scale, time-zone
suffix); a rule table keyed by the base name then gives the output. The same
table generates the Spark Column expression and the DuckDB SQL used by the
oracle, so the two cannot drift apart.

A base name accepts only the argument shapes listed for it; anything else
(INTEGER, NUMERIC, REAL, TINYINT, BLOB, DOUBLE PRECISION, INT UNSIGNED, ...)
is UNKNOWN. Only the TIMESTAMPTZ / TIMETZ spellings get ' WITH TIME ZONE';
the spelled-out ``WITH TIME ZONE`` form is accepted and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import sql_literal

# Type families, accepted shapes and output forms.
# shape: "" no arguments, "p" optional (p), "ps" optional (p[, s]),
# "pz" optional (p) and optional WITH/WITHOUT TIME ZONE.
# template items: text, ("p"|"s", default) = the number or the default,
# ("opt", "p") = "(p)" when declared.
UNKNOWN = "UNKNOWN"
RULES: dict[str, tuple[str, list]] = {
    "CHAR": ("p", ["CHAR", ("opt", "p")]),
    "VARCHAR": ("p", ["VARCHAR", ("opt", "p")]),
    "TEXT": ("", ["TEXT"]),
    "INT": ("p", ["INT(", ("p", "11"), ")"]),
    "BIGINT": ("p", ["BIGINT(", ("p", "20"), ")"]),
    "SMALLINT": ("p", ["SMALLINT(", ("p", "6"), ")"]),
    "FLOAT": ("p", ["FLOAT(", ("p", "24"), ")"]),
    "DOUBLE": ("", ["DOUBLE"]),
    "DECIMAL": ("ps", ["DECIMAL(", ("p", "10"), ",", ("s", "0"), ")"]),
    "BOOLEAN": ("", ["BOOLEAN"]),
    "DATE": ("", ["DATE"]),
    "TIMETZ": ("p", ["TIME", ("opt", "p"), " WITH TIME ZONE"]),
    "TIME": ("pz", ["TIME", ("opt", "p")]),
    "TIMESTAMPTZ": ("p", ["TIMESTAMP", ("opt", "p"), " WITH TIME ZONE"]),
    "TIMESTAMP": ("pz", ["TIMESTAMP", ("opt", "p")]),
    "DATETIME": ("p", ["DATETIME", ("opt", "p")]),
    "JSON": ("", ["JSON"]),
    "UUID": ("", ["UUID"]),
}

SHAPE = (r"(?i)^\s*([A-Za-z]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?"
         r"(\s+WITH(?:OUT)?\s+TIME\s+ZONE)?\s*$")


def normalize_type(raw: Column) -> Column:
    """Declared type text -> normalised type (Spark Column).

    The text and its parse are bound as lambda variables, so each is computed
    once however many rules look at them."""
    parsed = F.transform(F.transform(F.array(raw), lambda r: F.struct(
        r.alias("raw"), r.rlike(SHAPE).alias("ok"), F.upper(F.regexp_extract(r, SHAPE, 1)).alias("base"),
        F.regexp_extract(r, SHAPE, 2).alias("p"), F.regexp_extract(r, SHAPE, 3).alias("s"),
        (F.regexp_extract(r, SHAPE, 4) != "").alias("z"))), lambda x: _normalized(x))
    return F.get(parsed, F.lit(0))


def _normalized(x: Column) -> Column:
    base, p, s, z = x["base"], x["p"], x["s"], x["z"]
    parts = {"p": p, "s": s}

    def render(tmpl) -> Column:
        out = []
        for item in tmpl:
            if isinstance(item, str):
                out.append(F.lit(item))
            elif item[0] == "opt":
                v = parts[item[1]]
                out.append(F.when(v != "", F.concat(F.lit("("), v, F.lit(")"))).otherwise(F.lit("")))
            else:
                out.append(F.when(parts[item[0]] != "", parts[item[0]]).otherwise(F.lit(item[1])))
        return F.concat(*out)

    def allowed(shape: str) -> Column:
        c = F.lit(True)
        if "p" not in shape:
            c = c & (p == "")
        if "s" not in shape:
            c = c & (s == "")
        if "z" not in shape:
            c = c & ~z
        return c

    out = F.lit(UNKNOWN)
    for name, (shape, tmpl) in reversed(list(RULES.items())):
        out = F.when((base == name) & allowed(shape), render(tmpl)).otherwise(out)
    return F.when(x["raw"].isNull(), F.lit(None)).when(~x["ok"], F.lit(UNKNOWN)).otherwise(out)


def normalize_type_sql(raw: str) -> str:
    """The same rules as DuckDB SQL over the expression ``raw``."""
    shp = sql_literal(SHAPE)
    base = f"upper(regexp_extract({raw}, {shp}, 1))"
    parts = {"p": f"regexp_extract({raw}, {shp}, 2)", "s": f"regexp_extract({raw}, {shp}, 3)"}
    z = f"(regexp_extract({raw}, {shp}, 4) <> '')"

    def render(tmpl) -> str:
        out = []
        for item in tmpl:
            if isinstance(item, str):
                out.append(sql_literal(item))
            elif item[0] == "opt":
                v = parts[item[1]]
                out.append(f"(CASE WHEN {v} <> '' THEN concat('(', {v}, ')') ELSE '' END)")
            else:
                v = parts[item[0]]
                out.append(f"(CASE WHEN {v} <> '' THEN {v} ELSE {sql_literal(item[1])} END)")
        return f"concat({', '.join(out)}, '')"

    def allowed(shape: str) -> str:
        c = ["true"]
        if "p" not in shape:
            c.append(f"{parts['p']} = ''")
        if "s" not in shape:
            c.append(f"{parts['s']} = ''")
        if "z" not in shape:
            c.append(f"NOT {z}")
        return " AND ".join(c)

    arms = " ".join(f"WHEN {base} = '{name}' AND {allowed(shape)} THEN {render(tmpl)}"
                    for name, (shape, tmpl) in RULES.items())
    return (f"(CASE WHEN {raw} IS NULL THEN NULL WHEN NOT regexp_matches({raw}, {shp}) THEN "
            f"{sql_literal(UNKNOWN)} ELSE (CASE {arms} ELSE {sql_literal(UNKNOWN)} END) END)")
