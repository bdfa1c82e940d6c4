"""Schema catalog: hand-made scripts with the rows they must give."""

from pyspark.sql import functions as F

from shroud.operators import audit, ddl, replay
from shroud.sources import fixtures as FX

from conftest import SF_SMALL


def scripts(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "script_id string, content string")


def cat(spark, *texts, **kw):
    return replay.catalog(ddl.change_log(ddl.split_statements(scripts(spark, *texts))), **kw)


def test_split_keeps_quoted_semicolons(spark):
    st = ddl.split_statements(scripts(spark, "a 'p;q'; b")).collect()
    assert [r.stmt for r in st] == ["a 'p;q'", "b"]


def test_fddl_splits_into_five_per_script(spark):
    st = ddl.statements(FX.fixture(spark, SF_SMALL, "f_ddl"))
    per = st.groupBy("script_id").count().select(F.min("count"), F.max("count")).first()
    assert tuple(per) == (5, 5)
    assert st.where("kind = 'other'").count() == 0


def test_view_created_then_dropped(spark):
    c = cat(spark, "CREATE VIEW v (a) AS SELECT 1; DROP VIEW v")
    assert c["tables"].count() == 0 and c["columns"].count() == 0


def test_create_schema_stamps_existing_tables_only(spark):
    c = cat(spark, "CREATE TABLE a (x INT); CREATE SCHEMA s; CREATE TABLE b (x INT)")
    got = {r.name: r.schema for r in c["tables"].collect()}
    assert got == {"a": "s", "b": None}


def test_add_rename_drop_column(spark):
    c = cat(spark, "CREATE TABLE t (id INT); ALTER TABLE t ADD COLUMN x INT; "
                   "ALTER TABLE t RENAME COLUMN x TO y; ALTER TABLE t DROP COLUMN y")
    assert [r.name for r in c["columns"].collect()] == ["id"]


def test_self_reference_inferred_unless_dropped(spark):
    ddl_text = "CREATE TABLE employee (employee_id INT PRIMARY KEY, name TEXT)"
    rel = cat(spark, ddl_text)["relationships"].collect()
    assert [(r.from_table, r.from_column, r.to_table, r.to_column, r.relationship_type) for r in rel] == \
        [("employee", "employee_id", "employee", "employee_id", "INFERRED_FK")]


def test_types_and_constraints(spark):
    c = cat(spark, "CREATE TABLE p (id BIGINT, amt DECIMAL(10,2), d DECIMAL, n NUMERIC, "
                   "ts TIMESTAMPTZ(3), f FLOAT, v VARCHAR(9) NOT NULL DEFAULT 'a;b', "
                   "CONSTRAINT pk PRIMARY KEY (id), "
                   "FOREIGN KEY (amt) REFERENCES q (x) ON DELETE CASCADE, CHECK (amt > 0 AND lower(v) <> 'x'))")
    cols = {r.name: r for r in c["columns"].collect()}
    assert [cols[k].data_type for k in ["id", "amt", "d", "n", "ts", "f", "v"]] == [
        "BIGINT(20)", "DECIMAL(10,2)", "DECIMAL(10,0)", "UNKNOWN", "TIMESTAMP(3) WITH TIME ZONE",
        "FLOAT(24)", "VARCHAR(9)"]
    assert cols["id"].is_primary_key and not cols["v"].nullable and cols["v"].default_value == "'a;b'"
    assert cols["amt"].is_foreign_key and cols["amt"].references == "q.x"
    cons = {r.constraint_type: r for r in c["constraints"].collect()}
    assert cons["FOREIGN KEY ON DELETE CASCADE"].name == "unnamed_fk"
    assert cons["CHECK"].columns == ["amt"] and cons["PRIMARY KEY"].name == "pk"


# --- replay: hand-made scripts with the catalog they must leave -----------------

def left(spark, text, **kw):
    """The five outputs of one script, as sorted tuples."""
    c = cat(spark, text, infer=False, **kw)
    return {
        "tables": sorted((r.name, r.schema, r.table_type, r.estimated_rows) for r in c["tables"].collect()),
        "columns": [(r.table_name, r.name, r.nullable, r.default_value, r.is_primary_key, r.is_foreign_key, r.references)
                    for r in sorted(c["columns"].collect(), key=lambda r: (r.table_name, r.ordinal))],
        "edges": sorted((r.from_table, r.from_column, r.to_table, r.to_column) for r in c["relationships"].collect()),
        "indexes": sorted((r.table_name, r.name, tuple(r.columns), r.unique) for r in c["indexes"].collect()),
        "constraints": sorted((r.table_name, r.name, r.constraint_type, tuple(r.columns)) for r in c["constraints"].collect())}


TWO = ("CREATE TABLE a (id INT PRIMARY KEY, n TEXT DEFAULT 'x'); "
       "CREATE TABLE b (id INT, a_ref INT, k INT, CONSTRAINT f FOREIGN KEY (a_ref) REFERENCES a (id), CONSTRAINT u UNIQUE (k), PRIMARY KEY (id)); "
       "CREATE INDEX ix ON b (k, a_ref); ")


def test_replay_of_creates(spark):
    assert left(spark, TWO) == {
        "tables": [("a", None, "TABLE", None), ("b", None, "TABLE", None)],
        "columns": [("a", "id", True, None, True, False, None), ("a", "n", True, "'x'", False, False, None),
                    ("b", "id", True, None, True, False, None), ("b", "a_ref", True, None, False, True, "a.id"),
                    ("b", "k", True, None, False, False, None)],
        "edges": [("b", "a_ref", "a", "id")],
        "indexes": [("b", "ix", ("k", "a_ref"), False)],
        "constraints": [("b", "f", "FOREIGN KEY", ("a_ref",)), ("b", "u", "UNIQUE", ("k",)), ("b", "unnamed_pk", "PRIMARY KEY", ("id",))]}


def test_drop_table_takes_edges_of_either_end(spark):
    got = left(spark, TWO + "DROP TABLE a")
    assert got["edges"] == [] and [t[0] for t in got["tables"]] == ["b"]
    assert ("b", "a_ref", True, None, False, True, "a.id") in got["columns"]  # the column's own flag stays
    got = left(spark, TWO + "DROP TABLE b")
    assert got["edges"] == [] and got["indexes"] == [] and got["constraints"] == []


def test_recreated_table_starts_anew(spark):
    got = left(spark, TWO + "DROP TABLE b; CREATE TABLE b (z INT); TRUNCATE TABLE b; TRUNCATE gone")
    assert got["tables"] == [("a", None, "TABLE", None), ("b", None, "TABLE", 0)]
    assert [c[:2] for c in got["columns"]] == [("a", "id"), ("a", "n"), ("b", "z")]


def test_rename_reaches_lists_and_both_ends_of_edges(spark):
    got = left(spark, TWO + "ALTER TABLE b RENAME COLUMN a_ref TO r; ALTER TABLE a RENAME COLUMN id TO key1; ALTER TABLE b RENAME COLUMN k TO kk")
    assert got["edges"] == [("b", "r", "a", "key1")]
    assert got["indexes"] == [("b", "ix", ("kk", "r"), False)]
    assert ("b", "f", "FOREIGN KEY", ("r",)) in got["constraints"] and ("b", "u", "UNIQUE", ("kk",)) in got["constraints"]
    assert ("b", "r", True, None, False, True, "a.id") in got["columns"]  # references keeps the old name


def test_drop_column_takes_what_contains_it(spark):
    got = left(spark, TWO + "ALTER TABLE b DROP COLUMN a_ref")
    assert got["edges"] == [] and got["indexes"] == [] and [c[1] for c in got["constraints"]] == ["u", "unnamed_pk"]
    got = left(spark, TWO + "ALTER TABLE a DROP COLUMN id")
    assert got["edges"] == [] and [c[1] for c in got["constraints"]] == ["f", "u", "unnamed_pk"]


def test_alter_column_last_change_counts(spark):
    got = left(spark, "CREATE TABLE t (x INT, y INT NOT NULL DEFAULT 1); ALTER TABLE t ALTER COLUMN x SET NOT NULL; "
                      "ALTER TABLE t ALTER COLUMN y DROP NOT NULL; ALTER TABLE t ALTER COLUMN x SET DEFAULT 5; "
                      "ALTER TABLE t ALTER COLUMN x SET DEFAULT 7; ALTER TABLE t ALTER COLUMN y DROP DEFAULT")
    assert got["columns"] == [("t", "x", False, "7", False, False, None), ("t", "y", True, None, False, False, None)]


def test_drop_constraint_keeps_edges_and_rederives_flags(spark):
    got = left(spark, TWO + "ALTER TABLE b DROP CONSTRAINT f")
    assert got["edges"] == [("b", "a_ref", "a", "id")]
    assert ("b", "a_ref", True, None, False, False, None) in got["columns"] and ("b", "id", True, None, True, False, None) in got["columns"]
    got = left(spark, TWO + "ALTER TABLE b ADD CONSTRAINT g FOREIGN KEY (a_ref) REFERENCES a (id) ON DELETE CASCADE; ALTER TABLE b DROP CONSTRAINT f")
    assert ("b", "a_ref", True, None, False, True, "a.id") in got["columns"]


def test_views_and_schemas(spark):
    got = left(spark, "CREATE TABLE t (x INT); CREATE VIEW v (p, q) AS SELECT 1, 2; CREATE SCHEMA s1; CREATE MATERIALIZED VIEW m AS SELECT 1; "
                      "CREATE SCHEMA s2; DROP VIEW v; CREATE TABLE late (x INT)")
    assert got["tables"] == [("late", None, "TABLE", None), ("m", "s2", "MATERIALIZED VIEW", None), ("t", "s1", "TABLE", None)]
    assert [c[:2] for c in got["columns"]] == [("late", "x"), ("t", "x")]


def test_changes_to_unknown_tables_are_ignored(spark):
    got = left(spark, "ALTER TABLE no ADD COLUMN x INT; DROP TABLE no; ALTER TABLE no ALTER COLUMN x SET NOT NULL; CREATE TABLE t AS SELECT 1; ALTER TABLE t ADD COLUMN y INT")
    assert got["tables"] == [("t", None, "TABLE", None)] and [c[:2] for c in got["columns"]] == [("t", "y")]


def test_ddl_as_people_write_it(spark):
    text = ("-- users; and more\nCREATE TABLE `users` (\n id INT, -- the key\n `name`\n  TEXT,\n KEY ix (id), UNIQUE KEY uq (name, id),\n"
            " b INT CHECK (b IS NOT NULL), d TEXT DEFAULT 'it''s; ok', CHECK (((b > 0) AND ((id < 9)))), x DECIMAL(4, 2) /* a, b */\n"
            ") PARTITION BY RANGE (id);\nALTER TABLE users ADD INDEX iy (id), ADD COLUMN y INT; # end;\n")
    got = left(spark, text)
    assert [(c[1], c[2], c[3]) for c in got["columns"]] == [("id", True, None), ("name", True, None), ("b", True, None),
                                                            ("d", True, "'it''s; ok'"), ("x", True, None), ("y", True, None)]
    assert got["constraints"] == [("users", "unnamed_check", "CHECK", ("b", "id")), ("users", "uq", "UNIQUE", ("name", "id"))]
    assert [r.item for r in ddl.rejects(ddl.split_statements(scripts(spark, text))).collect()] == ["KEY ix (id)"]


def test_statements_of_any_depth_are_read(spark):
    deep = "(" * 30 + "1, ')(' " + ")" * 30
    check = "(" * 40 + "b > 0" + ")" * 40
    st = ddl.split_statements(scripts(spark, f"CREATE TABLE t (a INT, b INT DEFAULT {deep}, c INT, CHECK {check}); ALTER TABLE u ADD COLUMN x INT DEFAULT {deep}; ALTER TABLE u ADD COLUMN y INT"))
    assert [(r.op, r.column_name, r.value) for r in ddl.change_log(st).orderBy("seq", "sub").collect()] == [
        ("create_table", None, None), ("add_column", "a", None), ("add_column", "b", deep), ("add_column", "c", None), ("add_constraint", None, "unnamed_check"),
        ("add_column", "x", deep), ("add_column", "y", None)]
    assert [r.columns for r in ddl.change_log(st).where("op = 'add_constraint'").collect()] == [["b"]]
    assert ddl.rejects(st).count() == 0 and [r.kind for r in ddl.statements(scripts(spark, f"CREATE TABLE t (a INT DEFAULT {deep})")).collect()] == ["create_table"]
    open_ = ddl.split_statements(scripts(spark, f"CREATE TABLE t (a INT DEFAULT {deep[:-5]}; CREATE TABLE v (b INT)"))
    assert [r.table_name for r in ddl.change_log(open_).where("op = 'create_table'").collect()] == ["v"] and ddl.rejects(open_).count() == 1


def test_long_statements_do_not_overflow(spark):
    value = "v;x(" * 300_000
    wide = ", ".join(f"c{i} DECIMAL(10,2) DEFAULT 'a,{i}'" for i in range(2_000))
    st = ddl.statements(scripts(spark, f"INSERT INTO t VALUES ('{value}'); CREATE TABLE w ({wide}); {'x' * 1_000_000}"))
    assert [(r.seq, r.kind) for r in st.orderBy("seq").collect()] == [(1, "other"), (2, "create_table"), (3, "other")]
    log = ddl.change_log(st.drop("kind"))
    assert log.where("op = 'add_column'").count() == 2_000


def test_hierarchy_of_any_depth(spark):
    n = 66
    edges = spark.createDataFrame([(f"t{i + 1}", f"t{i}") for i in range(n)], "child string, parent string")
    names = spark.createDataFrame([(f"t{i}",) for i in range(n + 1)], "table_name string")
    got = {r.table_name: (r.level, r.in_cycle) for r in audit.hierarchy(edges, names).collect()}
    assert got == {f"t{i}": (i, False) for i in range(n + 1)}


def test_inference_skips_tables_without_pk(spark):
    rel = cat(spark, "CREATE TABLE dept (x INT); CREATE TABLE depts (id INT PRIMARY KEY); "
                     "CREATE TABLE emp (id INT, dept_id INT)")["relationships"].collect()
    assert [(r.from_table, r.from_column, r.to_table, r.to_column) for r in rel] == \
        [("emp", "dept_id", "depts", "id")]


def test_explicit_fk_is_not_inferred_again(spark):
    rel = cat(spark, "CREATE TABLE dept (id INT PRIMARY KEY); "
                     "CREATE TABLE emp (dept_id INT, FOREIGN KEY (dept_id) REFERENCES dept (id))")
    got = sorted((r.from_column, r.relationship_type) for r in rel["relationships"].collect())
    assert got == [("dept_id", "FOREIGN_KEY")]


def test_hierarchy_levels_and_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"),
                                   ("z", "x"), ("s", "s")], "child string, parent string")
    names = spark.createDataFrame([(t,) for t in "abcxyzs"], "table_name string")
    got = {r.table_name: (r.level, r.in_cycle, r.self_ref) for r in audit.hierarchy(edges, names).collect()}
    assert got["a"] == (0, False, False) and got["b"] == (1, False, False) and got["c"] == (2, False, False)
    assert got["x"][1] and got["y"][1] and got["z"][1]
    assert got["s"] == (0, False, True)


def test_cycles_are_listed_with_their_members(spark):
    pairs = [("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("m", "n"), ("n", "o"), ("o", "m"), ("o", "p"), ("p", "n"), ("x", "m"),
             ("w", "z"), ("m", "a"), ("e", "d"), ("d", "e"), ("d", "x"), ("e", "e")] + [(f"k{i}", f"k{(i + 1) % 12}") for i in range(12)]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    got = {r.table_name: (r.cycle, r.cycle_size) for r in audit.cycles(edges).collect()}
    assert got == {"x": ("x", 2), "y": ("x", 2), "d": ("d", 2), "e": ("d", 2), **{t: ("m", 4) for t in "mnop"}, **{f"k{i}": ("k0", 12) for i in range(12)}}
    assert audit.cycles(edges.where("child = 'b'")).count() == 0
    names = spark.createDataFrame([(t,) for t in "abcxyzswmnopde"], "table_name string")
    rows = {r.table_name: (r.level, r.below_cycle) for r in audit.hierarchy_cycles(edges, names).collect()}
    assert rows["c"] == (2, False) and rows["z"] == rows["w"] == (None, True) and rows["x"] == (None, False) and rows["s"] == (0, False)


def test_inference_with_duplicate_and_case_variant_tables(spark):
    rel = cat(spark, "CREATE TABLE Dept (x INT); CREATE TABLE dept (id INT PRIMARY KEY); "
                     "CREATE TABLE dept (id INT PRIMARY KEY); CREATE TABLE emp (dept_id INT)")
    got = [(r.from_table, r.from_column, r.to_table, r.to_column) for r in rel["relationships"].collect()]
    assert got == [("emp", "dept_id", "dept", "id")]


def test_scripts_of_one_file_are_parsed_in_many_tasks(spark):
    # a table of one row group is one task: its scripts are dealt before they are parsed
    for name in ("f_ddl", "f_views"):
        scripts = FX.fixture(spark, SF_SMALL, name)
        at = scripts.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(at) == max(4, spark.sparkContext.defaultParallelism)
        assert sum(r.n for r in at) == 150 and max(r.n for r in at) <= 150 // len(at) + 2


def test_texts_of_a_definition_are_cut_once(spark):
    # below a lambda function every use of an expression is evaluated anew: once for CREATE, once for ALTER
    log = ddl.change_log(ddl.split_statements(FX.fixture(spark, SF_SMALL, "f_ddl")))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(ddl._INSIDE + ", ()") == 2
    assert plan.count(ddl._TABLE_CONSTRAINT + ", 1)") == 2
