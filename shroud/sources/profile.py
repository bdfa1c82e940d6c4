"""S7, outputs from tables: constraints and relationships that their data show.

A table source has names and types; its keys and references must be found. One
scan per table gives each column's row and value counts and a HyperLogLog
sketch. Sketches merge, so they tell both how many values a column has and, as
the union with another's is no larger than that other, whether its values may
all occur there. What the sketches leave as candidates is confirmed exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Log2 of a sketch's buckets, and the slack of its estimates (some six standard errors).
LG_K, SLACK = 14, 0.05
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Profile:
    table: str
    column: str
    kind: str  # whole numbers or strings: only like with like is compared
    rows: int
    values: int  # not null
    distinct: int  # estimated
    sketch: bytes | None


def kind_of(t: T.DataType) -> str | None:
    return "whole" if isinstance(t, _WHOLE) else "string" if isinstance(t, T.StringType) else None


def _value(column: str, kind: str) -> Column:
    """What stands for a value in comparisons: a number as text, a string's digest."""
    return F.col(column).cast("string") if kind == "whole" else F.sha2(F.col(column), 256)


def profiles(load: Callable[[str], DataFrame], tables: list[str]) -> list[Profile]:
    """A profile of every column of whole numbers or strings: one row per table
    comes back, whatever its size."""
    out = []
    for t in tables:
        df = load(t)
        kinds = {f.name: k for f in df.schema.fields if (k := kind_of(f.dataType))}
        found = [F.count(c).alias(f"n{i}") for i, c in enumerate(kinds)]
        sketches = [F.hll_sketch_agg(F.col(c).cast("bigint") if k == "whole" else F.col(c), F.lit(LG_K)).alias(f"s{i}") for i, (c, k) in enumerate(kinds.items())]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *found, *sketches).select(
            "*", *[F.hll_sketch_estimate(f"s{i}").alias(f"e{i}") for i in range(len(kinds))]).first()
        out += [Profile(t, c, k, row["rows"], row[f"n{i}"], row[f"e{i}"], row[f"s{i}"]) for i, (c, k) in enumerate(kinds.items())]
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def keys(load: Callable[[str], DataFrame], found: list[Profile]) -> list[Profile]:
    """Columns without nulls and repeated values, of tables with rows."""
    maybe = [p for p in found if p.rows and p.values == p.rows and p.distinct >= (1 - SLACK) * p.rows]
    if not maybe:
        return []
    parts = [load(p.table).select(F.lit(i).alias("p"), _value(p.column, p.kind).alias("v")) for i, p in enumerate(maybe)]
    twice = _union(parts).groupBy("p", "v").count().where("count > 1").select("p").distinct().collect()  # a row per candidate at most
    return [p for i, p in enumerate(maybe) if i not in {r["p"] for r in twice}]


def inclusions(spark: SparkSession, load: Callable[[str], DataFrame], found: list[Profile], parents: list[Profile]) -> list[tuple[Profile, Profile]]:
    """Pairs of a column (with values) and another column of ``parents`` that
    holds all of its values."""
    pairs = [(a, b, p.sketch, q.sketch, q.distinct) for a, p in enumerate(found) for b, q in enumerate(parents)
             if p.values and p.kind == q.kind and (p.table, p.column) != (q.table, q.column) and p.distinct <= (1 + SLACK) * q.distinct]
    if not pairs:
        return []
    both = F.hll_sketch_estimate(F.hll_union("x", "y"))
    rows = spark.createDataFrame(pairs, "child int, parent int, x binary, y binary, n long")  # sketches of columns, not data
    maybe = written(rows.where(both <= (1 + SLACK) * F.col("n") + 1).select("child", "parent"), "inclusion-candidates")
    ids = maybe.collect()
    if not ids:
        return []
    values = {i: load(found[i].table).select(F.lit(i).alias("child"), _value(found[i].column, found[i].kind).alias("v")) for i in {r["child"] for r in ids}}
    there = {i: load(parents[i].table).select(F.lit(i).alias("parent"), _value(parents[i].column, parents[i].kind).alias("v")) for i in {r["parent"] for r in ids}}
    asked = _union([values[i] for i in sorted(values)]).where("v IS NOT NULL").distinct().join(F.broadcast(maybe), "child")
    have = _union([there[i] for i in sorted(there)])
    missing = {(r["child"], r["parent"]) for r in asked.join(have, ["parent", "v"], "left_anti").select("child", "parent").distinct().collect()}  # pairs of columns
    return [(found[r["child"]], parents[r["parent"]]) for r in ids if (r["child"], r["parent"]) not in missing]


def table_keys(spark: SparkSession, load: Callable[[str], DataFrame], tables: list[str]) -> DataFrame:
    """Constraints: ``name, table_name, constraint_type, columns`` of every
    single-column key that the data show."""
    rows = [(f"uq_{p.table}_{p.column}", p.table, "UNIQUE", [p.column]) for p in keys(load, profiles(load, tables))]
    return spark.createDataFrame(rows, "name string, table_name string, constraint_type string, columns array<string>")


def table_relationships(spark: SparkSession, load: Callable[[str], DataFrame], tables: list[str]) -> DataFrame:
    """Relationships: every column whose values all occur in a key of the same
    kind (unary inclusion dependencies)."""
    found = profiles(load, tables)
    rows = [(a.table, a.column, b.table, b.column, "INCLUSION") for a, b in inclusions(spark, load, found, keys(load, found))]
    return spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string, relationship_type string")
