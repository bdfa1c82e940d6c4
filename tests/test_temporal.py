"""As-of joins, chains, and catalogs of logs that are long, crowded or odd."""

import random

import pytest
from pyspark.sql import functions as F

from shroud.operators import ddl, replay, temporal
from shroud.sources import profile

LOG = "script_id string, seq long, op string, table_name string, column_name string, value string, constraint_type string, reference_table string"


@pytest.mark.parametrize(("width", "inclusive"), [(7, False), (7, True), (10_000, False)])
def test_next_event_equals_a_search(spark, width, inclusive):
    rng = random.Random(width)
    points = [(k, s, rng.randrange(3)) for k in "ab" for s in rng.sample(range(200), 60)]
    events = [(k, s, rng.randrange(3), f"e{s}") for k in "ab" for s in rng.sample(range(200), 25)]
    got = temporal.next_event(spark.createDataFrame(points, "k string, seq long, sub long"), spark.createDataFrame(events, "k string, seq long, sub long, v string"),
                              ["k"], ["v"], inclusive=inclusive, width=width).collect()
    want = {}
    for k, s, b in points:
        behind = [(s2, b2, v) for k2, s2, b2, v in events if k2 == k and ((s2, b2) >= (s, b) if inclusive else (s2, b2) > (s, b))]
        want[k, s, b] = min(behind) if behind else None
    assert {(r.k, r.seq, r["sub"]): tuple(r.next) if r.next else None for r in got} == want and len(got) == len(points)
    single = temporal.next_event(spark.createDataFrame(points, "k string, seq long, sub long"), spark.createDataFrame(events, "k string, seq long, sub long, v string"),
                                 ["k"], ["v"], inclusive=inclusive, last=199)
    assert {(r.k, r.seq, r["sub"]): tuple(r.next) if r.next else None for r in single.collect()} == want


def test_chains_of_any_length(spark):
    steps = [(i, i + 1 if i % 50 else None) for i in range(1, 101)]
    got = temporal.chains(spark.createDataFrame([("x", 1), ("y", 48), ("z", 51)], "start string, node int"), spark.createDataFrame(steps, "node int, next int"), "test-chains")
    assert sorted((r.start, r.node) for r in got.collect()) == [("x", i) for i in range(1, 51)] + [("y", i) for i in range(48, 51)] + [("z", i) for i in range(51, 101)]


def test_rename_chain_of_a_thousand_and_a_swap(spark):
    text = "CREATE TABLE t (c0 INT, a INT, b INT, CONSTRAINT u UNIQUE (a, b, c0)); " + "; ".join(
        f"ALTER TABLE t RENAME COLUMN c{i} TO c{i + 1}" for i in range(1000)) + "; ALTER TABLE t RENAME COLUMN a TO x; ALTER TABLE t RENAME COLUMN b TO a; ALTER TABLE t RENAME COLUMN x TO b"
    log = ddl.change_log(ddl.split_statements(spark.createDataFrame([("s", text)], "script_id string, content string")))
    out = replay.replay(log)
    assert [r.name for r in out["columns"].orderBy("ordinal").collect()] == ["c1000", "b", "a"]
    assert [r.columns for r in out["constraints"].collect()] == [["b", "a", "c1000"]]


def fold(rows):
    """Columns left by a log on one table, one change after the other: (name, default)."""
    cols = []
    for op, name, value in rows:
        hit = next((c for c in cols if c[0] == name), None)
        if op == "create_table":
            cols = [[name, None]]
        elif op == "add_column":
            cols.append([name, None])
        elif op == "drop_column":
            cols = [c for c in cols if c[0] != name]
        elif op == "rename_column" and hit:
            hit[0] = value
        elif op == "set_default" and hit:
            hit[1] = value
    return [tuple(c) for c in cols]


def test_columns_that_share_a_name_change_first_come_first(spark):
    rng, rows, want = random.Random(5), [], {}
    for t in range(12):
        changes = [("create_table", "a", "INT")]
        for _ in range(rng.randrange(4, 26)):
            op = rng.choice(["add_column", "add_column", "rename_column", "rename_column", "set_default", "drop_column" if rng.random() < 0.2 else "set_default"])
            changes.append((op, rng.choice("abc"), rng.choice("abc") if op == "rename_column" else f"v{rng.randrange(99)}"))
        rows += [("s", i, op, f"t{t}", name, value, None, None) for i, (op, name, value) in enumerate(changes)]
        want[f"t{t}"] = fold(changes)
    out = replay.replay(ddl.flat_log(spark.createDataFrame(rows, LOG)))["columns"].orderBy("table_name", "ordinal").collect()
    got = {t: [] for t in want}
    for r in out:
        got[r.table_name].append((r.name, r.default_value))
    assert got == want


def test_one_script_of_many_tables(spark):
    n = 40_000
    made = spark.range(n).select(F.lit("s").alias("script_id"), (F.col("id") * 2).alias("seq"), F.lit("create_table").alias("op"),
                                 F.concat(F.lit("t"), F.col("id").cast("string")).alias("table_name"), F.lit("c").alias("column_name"), F.lit("INT").alias("value"))
    stamped = spark.createDataFrame([("s", s, "create_schema", None, None, f"s{s}") for s in (101, 30_001, 70_001)], "script_id string, seq long, op string, table_name string, column_name string, value string")
    log = ddl.flat_log(made.unionByName(stamped).withColumns({"constraint_type": F.lit(None).cast("string"), "reference_table": F.lit(None).cast("string")}))
    got = {r.schema: r["count"] for r in replay.replay(log)["tables"].groupBy("schema").count().collect()}
    assert got == {"s101": 51, "s30001": 14_950, "s70001": 20_000, None: n - 35_001}


def test_keys_and_references_found_in_data(spark):
    tables = {"p": spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(500)], "id long, name string, g int"),
              "c": spark.createDataFrame([(i, i % 400, f"n{i % 7}", 1.5 * i) for i in range(2000)], "id int, p_id int, p_name string, x double"),
              "d": spark.createDataFrame([(i, None if i == 3 else i, 499 + i % 2) for i in range(50)], "a int, b int, far int"),
              "e": spark.createDataFrame([], "k int, s string")}
    found = profile.profiles(tables.get, list(tables))
    keys = profile.keys(tables.get, found)
    assert {(p.table, p.column) for p in keys} == {("p", "id"), ("p", "name"), ("c", "id"), ("d", "a")}
    got = {(a.table, a.column, b.table, b.column) for a, b in profile.inclusions(spark, tables.get, found, keys)}
    assert got == {("c", "p_id", "p", "id"), ("c", "p_id", "c", "id"), ("c", "p_name", "p", "name"), ("p", "id", "c", "id"), ("p", "g", "p", "id"), ("p", "g", "c", "id"), ("p", "g", "d", "a"),
                   ("d", "a", "p", "id"), ("d", "a", "c", "id"), ("d", "b", "p", "id"), ("d", "b", "c", "id"), ("d", "b", "d", "a"), ("d", "far", "c", "id")}
