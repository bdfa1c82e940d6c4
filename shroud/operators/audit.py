"""Data audits driven by catalog constraints (keys, NOT NULL, references,
CHECK predicates, inferred-FK evidence, hierarchy, sizes).

The catalog itself is metadata (a handful of rows per table) and may be
collected; all data work stays in Spark:

* key audit: one aggregation per key; NULL keys, duplicate keys and the rows
  they cover come out of the same pass.
* NOT NULL and CHECK audits: one scan per table, all columns/predicates
  evaluated in one aggregate.
* reference audit: child keys are pre-aggregated (map-side partial counts,
  so a hot key collapses before the shuffle) and left-joined with the distinct
  parent keys; the join strategy (broadcast vs. shuffle) is left to Catalyst/AQE,
  which broadcasts only sides whose measured size is under the threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, written

TableLoader = Callable[[str], DataFrame]


@dataclass
class Constraint:
    table: str
    name: str
    kind: str                      # PRIMARY KEY | UNIQUE | FOREIGN KEY | CHECK | NOT NULL
    columns: list[str] = field(default_factory=list)
    ref_table: str | None = None
    ref_columns: list[str] | None = None
    predicate: str | None = None   # CHECK: SQL boolean expression


def _reduce_union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def key_audit(load: TableLoader, constraints: list[Constraint]) -> DataFrame:
    """Q1: per PK/UNIQUE: rows, distinct keys, duplicate keys, rows in
    duplicate keys, rows with a NULL key part (PK only violates on NULL)."""
    out = []
    for c in constraints:
        if c.kind not in ("PRIMARY KEY", "UNIQUE"):
            continue
        t = load(c.table).select(*c.columns)
        null_key = F.greatest(*[F.col(k).isNull() for k in c.columns]) if len(c.columns) > 1 \
            else F.col(c.columns[0]).isNull()
        g = t.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("nk", null_key)
        out.append(g.agg(
            F.sum("n").alias("n_rows"),
            F.count(F.lit(1)).alias("n_keys"),
            F.coalesce(F.sum(F.when(~F.col("nk") & (F.col("n") > 1), 1)), F.lit(0)).cast("long")
            .alias("n_dup_keys"),
            F.coalesce(F.sum(F.when(~F.col("nk") & (F.col("n") > 1), F.col("n"))), F.lit(0)).cast("long")
            .alias("n_dup_rows"),
            F.coalesce(F.sum(F.when(F.col("nk"), F.col("n"))), F.lit(0)).cast("long")
            .alias("n_null_key_rows"))
            .select(F.lit(c.table).alias("table_name"), F.lit(c.name).alias("constraint_name"),
                    F.lit(c.kind).alias("constraint_type"), "*"))
    return _reduce_union(out)


def _key_text(cols: list[str]):
    """A key's parts as text, joined by ``|`` (NULL parts as ``null``)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])


def key_violations(load: TableLoader, constraints: list[Constraint]) -> DataFrame:
    """Q1 rows: the keys that break a PK or UNIQUE constraint, with their rows:
    (table_name, constraint_name, key, reason duplicate | null, n_rows)."""
    out = []
    for c in constraints:
        if c.kind not in ("PRIMARY KEY", "UNIQUE"):
            continue
        g = load(c.table).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n_rows"))
        null_key = F.lit(False)
        for k in c.columns:
            null_key = null_key | F.col(k).isNull()
        reason = F.when(null_key, F.lit("null") if c.kind == "PRIMARY KEY" else None).when(F.col("n_rows") > 1, "duplicate")
        out.append(g.withColumn("reason", reason).where("reason is not null").select(
            F.lit(c.table).alias("table_name"), F.lit(c.name).alias("constraint_name"), _key_text(c.columns).alias("key"), "reason", "n_rows"))
    return _reduce_union(out)


def reference_violations(load: TableLoader, constraints: list[Constraint]) -> DataFrame:
    """Q3 rows: the orphan keys of each FK with their child rows:
    (table_name, constraint_name, ref_table, key, n_rows)."""
    out = []
    for c in constraints:
        if c.kind != "FOREIGN KEY":
            continue
        whole = F.lit(True)
        for k in c.columns:
            whole = whole & F.col(k).isNotNull()
        keys = load(c.table).where(whole).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n_rows"))
        parent = load(c.ref_table).select(*[F.col(p).alias(k) for p, k in zip(c.ref_columns, c.columns)])
        out.append(keys.join(parent, c.columns, "left_anti").select(
            F.lit(c.table).alias("table_name"), F.lit(c.name).alias("constraint_name"), F.lit(c.ref_table).alias("ref_table"),
            _key_text(c.columns).alias("key"), "n_rows"))
    return _reduce_union(out)


def check_violations(load: TableLoader, constraints: list[Constraint], keys: dict[str, list[str]]) -> DataFrame:
    """Q4 rows: the keys of the rows where a CHECK is FALSE: (table_name,
    constraint_name, key). ``keys`` names each table's identifying columns; all
    predicates of a table are tested in one scan."""
    by_table: dict[str, list[Constraint]] = {}
    for c in constraints:
        if c.kind == "CHECK":
            by_table.setdefault(c.table, []).append(c)
    out = []
    for tname, cs in by_table.items():
        failed = F.filter(F.array(*[F.when(~F.expr(c.predicate), F.lit(c.name)) for c in cs]), lambda x: x.isNotNull())
        out.append(load(tname).select(F.lit(tname).alias("table_name"), F.explode(failed).alias("constraint_name"),
                                      _key_text(keys[tname]).alias("key")))
    return _reduce_union(out)


def not_null_audit(load: TableLoader, constraints: list[Constraint]) -> DataFrame:
    """Q2: NULL count per declared non-nullable column; one scan per table."""
    by_table: dict[str, list[str]] = {}
    for c in constraints:
        if c.kind in ("NOT NULL", "PRIMARY KEY"):
            for col in c.columns:
                cols = by_table.setdefault(c.table, [])
                if col not in cols:
                    cols.append(col)
    out = []
    for tname, cols in by_table.items():
        agg = load(tname).agg(*[F.sum(F.col(col).isNull().cast("long")).alias(col) for col in cols])
        stacked = F.expr("stack({}, {})".format(
            len(cols), ", ".join(f"'{col}', coalesce(`{col}`, 0L)" for col in cols)))
        out.append(agg.select(stacked.alias("column_name", "n_nulls"))
                   .select(F.lit(tname).alias("table_name"), "column_name", "n_nulls"))
    return _reduce_union(out)


def reference_audit(load: TableLoader, constraints: list[Constraint]) -> DataFrame:
    """Q3: per FK: child rows, rows with a NULL FK part (they pass), orphan rows
    and distinct orphan keys (no parent row with that key)."""
    out = []
    for c in constraints:
        if c.kind != "FOREIGN KEY":
            continue
        ch = load(c.table).select(*c.columns)
        any_null = F.greatest(*[F.col(k).isNull() for k in c.columns]) if len(c.columns) > 1 \
            else F.col(c.columns[0]).isNull()
        # Child keys are partially aggregated (a hot key collapses map-side),
        # then left-joined with the distinct parent keys; one aggregate gives
        # totals, NULL-key rows and orphans (no second pass, no cross join).
        keys = ch.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("nk", any_null)
        parent = (load(c.ref_table)
                  .select(*[F.col(p).alias(k) for p, k in zip(c.ref_columns, c.columns)])
                  .distinct().withColumn("found", F.lit(True)))
        orphan = ~F.col("nk") & F.col("found").isNull()
        out.append(keys.join(parent, c.columns, "left").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("nk"), F.col("n"))), F.lit(0)).alias("n_null_fk"),
            F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("n_orphan_rows"),
            F.count(F.when(orphan, F.lit(1))).alias("n_orphan_keys"))
            .select(F.lit(c.table).alias("table_name"), F.lit(c.name).alias("constraint_name"),
                    F.lit(c.ref_table).alias("ref_table"), "n_rows", "n_null_fk", "n_orphan_rows",
                    "n_orphan_keys"))
    return _reduce_union(out)


def check_audit(load: TableLoader, constraints: list[Constraint]) -> DataFrame:
    """Q4: rows where a CHECK predicate is FALSE (NULL passes); one scan per table."""
    by_table: dict[str, list[Constraint]] = {}
    for c in constraints:
        if c.kind == "CHECK":
            by_table.setdefault(c.table, []).append(c)
    out = []
    for tname, cs in by_table.items():
        agg = load(tname).agg(*[
            F.coalesce(F.sum(F.when(~F.expr(c.predicate), 1)), F.lit(0)).cast("long").alias(f"_{i}")
            for i, c in enumerate(cs)])
        stacked = F.expr("stack({}, {})".format(
            len(cs), ", ".join(f"'{c.name}', _{i}" for i, c in enumerate(cs))))
        out.append(agg.select(stacked.alias("constraint_name", "n_violations"))
                   .select(F.lit(tname).alias("table_name"), "constraint_name", "n_violations"))
    return _reduce_union(out)


def fk_evidence(load: TableLoader, edges: list[Constraint]) -> DataFrame:
    """Q5: per (child column -> parent column): distinct non-NULL child values
    and how many of them exist in the parent."""
    out = []
    for c in edges:
        k, p = c.columns[0], c.ref_columns[0]
        child = load(c.table).select(F.col(k).alias("v")).where(F.col("v").isNotNull()).distinct()
        parent = load(c.ref_table).select(F.col(p).alias("v")).distinct() \
            .withColumn("found", F.lit(1))
        out.append(child.join(parent, "v", "left").agg(
            F.count(F.lit(1)).alias("n_child_values"),
            F.coalesce(F.sum("found"), F.lit(0)).cast("long").alias("n_found"))
            .select(F.lit(c.table).alias("table_name"), F.lit(k).alias("column_name"),
                    F.lit(c.ref_table).alias("ref_table"), "n_child_values", "n_found"))
    return _reduce_union(out)


def table_sizes(load: TableLoader, tables: list[str]) -> DataFrame:
    """Q7: row count per table (parquet footers answer count() cheaply)."""
    return _reduce_union([load(t).agg(F.count(F.lit(1)).alias("n_rows"))
                          .select(F.lit(t).alias("table_name"), "n_rows") for t in tables])


def _large(df: DataFrame) -> DataFrame:
    """``df`` as a join side that grows with the tables: always shuffled. A broadcast
    would take it through the driver, once in each round."""
    return df.hint("merge")


def hierarchy(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Q6: level of each table in the FK graph. Level 0 = no parent; otherwise
    1 + max(level of parents). Tables on or below a cycle get NULL level and
    ``in_cycle`` = true.

    ``edges(child, parent)``, ``tables(table_name)``. A table's level is final
    once all its parents' are; each round finishes the tables whose last parent
    finished in the round before, until a round finishes none, so any depth is
    reached. A round is a join and an aggregation on the table name; lineage is
    cut by ``checkpoint()``."""
    spark: SparkSession = edges.sparkSession
    checkpoint_dir(spark)
    e = edges.where(F.col("child") != F.col("parent")).select("child", "parent").distinct().checkpoint()
    selfloops = edges.where(F.col("child") == F.col("parent")).select(
        F.col("child").alias("table_name")).distinct()
    names = tables.select("table_name").distinct()
    # parents still open and the highest level among the finished ones
    open_ = e.groupBy(F.col("child").alias("table_name")).agg(F.count(F.lit(1)).alias("np")).withColumn("ml", F.lit(-1)).checkpoint()
    front = names.join(_large(open_), "table_name", "left_anti").select("table_name", F.lit(0).alias("level")).checkpoint()
    done = front
    while not front.isEmpty():
        hit = (e.join(_large(front.withColumnRenamed("table_name", "parent")), "parent").groupBy(F.col("child").alias("table_name"))
               .agg(F.count(F.lit(1)).alias("nd"), F.max("level").alias("l")))
        step = (open_.join(_large(hit), "table_name", "left")
                .select("table_name", (F.col("np") - F.coalesce("nd", F.lit(0))).alias("np"),
                        F.greatest("ml", F.coalesce("l", F.lit(-1))).alias("ml")).checkpoint())
        open_ = step.where("np > 0")
        front = step.where("np = 0").select("table_name", (F.col("ml") + 1).alias("level"))
        done = done.unionByName(front)
    res = names.join(_large(done), "table_name", "left")
    return res.select("table_name", F.col("level").cast("long").alias("level"),
                      F.col("level").isNull().alias("in_cycle")).join(
        _large(selfloops.withColumn("self_ref", F.lit(True))), "table_name", "left").select(
        "table_name", "level", "in_cycle", F.coalesce("self_ref", F.lit(False)).alias("self_ref"))


def cycles(edges: DataFrame) -> DataFrame:
    """Q6: ``table_name, cycle, cycle_size`` of the tables that reach themselves
    over other tables; ``cycle`` is the smallest name among those that reach
    each other (a strongly connected component of ``edges(child, parent)``).

    Rounds of forward-backward colouring: edges that cannot lie on a cycle are
    trimmed off; every table takes the smallest name above it as its colour; the
    tables above a colour's own table, in that colour, are one component each.
    All components that are found go, and the rest is coloured again. Every step
    is a join or an aggregation on table names; the number of steps grows with
    the longest path inside what trimming leaves, not with the number of
    tables."""
    e = written(edges.where(F.col("child") != F.col("parent")).select("child", "parent").distinct(), "cycle-edges")
    found = written(e.select(F.col("child").alias("table_name"), F.col("child").alias("cycle")).limit(0), "cycles")
    while True:
        n = e.count()
        while n:
            e = written(e.join(_large(e.select(F.col("child").alias("parent")).distinct()), "parent", "left_semi")
                        .join(_large(e.select(F.col("parent").alias("child")).distinct()), "child", "left_semi"), "cycle-edges")
            left = e.count()
            if left == n:
                break
            n = left
        if not n:
            break
        colour = e.select(F.col("child").alias("table_name")).distinct().withColumn("colour", F.col("table_name"))
        while True:
            above = e.join(_large(colour.toDF("parent", "above")), "parent").groupBy(F.col("child").alias("table_name")).agg(F.min("above").alias("above"))
            step = written(colour.join(_large(above), "table_name").select("table_name", F.least("colour", "above").alias("colour"), (F.col("above") < F.col("colour")).alias("moved")), "cycle-colours")
            colour = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        same = written(e.join(_large(colour.toDF("child", "cycle")), "child").join(_large(colour.toDF("parent", "above")), "parent").where("cycle = above").drop("above"), "cycle-same")
        members = front = written(colour.where("table_name = colour").select("table_name", F.col("colour").alias("cycle")), "cycles")
        while not front.isEmpty():
            up = same.join(_large(front.withColumnRenamed("table_name", "child")), ["child", "cycle"]).select(F.col("parent").alias("table_name"), "cycle").distinct()
            front = written(up.join(_large(members), "table_name", "left_anti"), "cycles")
            members = members.unionByName(front)
        members = written(members, "cycles")
        found = found.unionByName(members)
        gone = members.select("table_name")
        e = written(e.join(_large(gone.withColumnRenamed("table_name", "child")), "child", "left_anti")
                    .join(_large(gone.withColumnRenamed("table_name", "parent")), "parent", "left_anti").select("child", "parent"), "cycle-edges")
    sizes = found.groupBy("cycle").agg(F.count(F.lit(1)).alias("cycle_size")).where("cycle_size > 1")
    return found.join(_large(sizes), "cycle").select("table_name", "cycle", "cycle_size")


def hierarchy_cycles(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Q6: :func:`hierarchy` with each table's ``cycle`` and ``cycle_size``, and
    ``below_cycle`` for those that only hang below one."""
    h = hierarchy(edges, tables)
    return h.join(_large(cycles(edges)), "table_name", "left").select(
        "table_name", "level", "self_ref", "cycle", "cycle_size", (F.col("in_cycle") & F.col("cycle").isNull()).alias("below_cycle"))
