"""Sources (S1, S7) and hand-made code-fact cases (C16, C17, C19, C21), G19 strict mode."""

import os

from shroud.operators import codefacts as CF
from shroud.operators import ddl, replay
from shroud.session import checkpoint_dir
from shroud.sources import tables as T

from conftest import SF_SMALL


def test_text_corpus_reads_whole_files_by_glob(spark):
    base = os.path.join(checkpoint_dir(spark).replace("file:", ""), "corpus-test")
    os.makedirs(os.path.join(base, "sub"), exist_ok=True)
    files = {"a.sql": "CREATE TABLE t (id INT);\nCREATE INDEX i ON t (id);",
             "sub/b.ddl": "DROP TABLE t", "c.txt": "ignored"}
    for name, text in files.items():
        with open(os.path.join(base, name), "w") as fh:
            fh.write(text)
    df = T.text_corpus(spark, base, T.DDL_GLOB)
    got = {os.path.basename(r.path): r.content for r in df.collect()}
    assert got == {"a.sql": files["a.sql"], "b.ddl": files["sub/b.ddl"]}
    st = ddl.statements(df.withColumnRenamed("path", "script_id"))
    assert sorted(r.kind for r in st.collect()) == ["create_index", "create_table", "drop"]


def test_schema_catalog_lists_columns_in_order(spark):
    cat = T.schema_catalog(spark, SF_SMALL, ["region", "nation"]).collect()
    assert [(r.table_name, r.ordinal, r.name) for r in cat] == [
        ("region", 1, "r_regionkey"), ("region", 2, "r_name"),
        ("nation", 1, "n_nationkey"), ("nation", 2, "n_name"), ("nation", 3, "n_regionkey")]


CODE = '''import numpy as np
TOTAL = 0


@app.route("/x")
@cached
def handler(req, *args, key=None) -> dict:
    """Doc."""
    arr = np.array([1, 2])
    global_like = 3
    return {"q": "SELECT 1 FROM t"}


class K(Base, Mixin):
    """Class doc."""
    a = b = 1
    def m(self):
        x = self.spark.read.parquet("p")
        return x
'''


def test_hand_made_code_facts(spark):
    files = spark.createDataFrame([("pkg/mod.py", CODE), ("pkg/bad.py", None)], "path string, content string")
    fn = {r.name: r for r in CF.functions(files).collect()}
    h = fn["handler"]
    assert h.args == ["req"] and h.returns == "dict" and h.in_functions and not h.is_method
    assert h.decorators == ['app.route("/x")', "cached"] and h.has_docstring
    assert h.calls_made == ["np.array"] and h.data_operations == ["np.array"]
    assert h.sql_queries == ["SELECT 1 FROM t"]
    m = fn["m"]
    assert m.is_method and m.class_name == "K" and not m.in_functions and not m.has_docstring
    assert m.data_operations == ["self.spark.read.parquet"]
    k = CF.classes(files).collect()[0]
    assert (k.name, k.bases, k.attributes, k.methods) == ("K", ["Base", "Mixin"], ["a", "b"], ["m"])
    asg = CF.assignments(files).collect()
    glob = sorted(n for r in asg for n in r.global_names)
    assert glob == ["TOTAL", "arr", "global_like"]     # function locals count, class body does not
    ops = sorted((r.target, r.data_op_method) for r in asg if r.is_data_op)
    assert ops == [("arr", "np.array"), ("x", "self.spark.read.parquet")]
    met = {r.path: r for r in CF.file_metrics(files).collect()}
    assert met["pkg/bad.py"].error == "unreadable content" and met["pkg/bad.py"].total_lines is None
    assert met["pkg/mod.py"].function_count == 2 and met["pkg/mod.py"].class_count == 1


def test_drop_constraint_strict_and_default(spark):
    text = ("CREATE TABLE t (id INT PRIMARY KEY, r INT, u INT, "
            "CONSTRAINT f FOREIGN KEY (r) REFERENCES p (id) ON DELETE CASCADE, CONSTRAINT q UNIQUE (u)); "
            "ALTER TABLE t DROP CONSTRAINT q")
    scripts = spark.createDataFrame([("s", text)], "script_id string, content string")
    log = ddl.change_log(ddl.split_statements(scripts))
    for strict, want in [(False, {"id": (True, False), "r": (False, True)}),
                         (True, {"id": (False, False), "r": (False, False)})]:
        cols = {r.name: (r.is_primary_key, r.is_foreign_key)
                for r in replay.replay(log, strict=strict)["columns"].collect()}
        assert {k: cols[k] for k in want} == want


def test_fixtures_leave_no_temp_views(spark):
    from shroud.sources import fixtures as FX
    before = {t.name for t in spark.catalog.listTables()}
    assert FX.fixture(spark, SF_SMALL, "f_text").count() > 0
    after = {t.name for t in spark.catalog.listTables()}
    assert after == before


def test_shared_folder_is_required_outside_local_sessions():
    import types

    import pytest

    from shroud import session

    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                                    getConf=lambda: types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda *_: None)))


def test_hierarchy_joins_go_past_the_driver(spark):
    # names grow with the tables: no join of a round may broadcast them
    from shroud.operators import audit
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", "e"), ("f", "f")], "child string, parent string")
    names = spark.createDataFrame([(x,) for x in "abcdef"], "table_name string")
    got = audit.hierarchy_cycles(edges, names)
    rows = {r.table_name: (r.level, r.self_ref, r.cycle, r.cycle_size, r.below_cycle) for r in got.collect()}
    assert rows == {"a": (None, False, "a", 2, False), "b": (None, False, "a", 2, False), "c": (None, False, None, None, True),
                    "d": (1, False, None, None, False), "e": (0, False, None, None, False), "f": (0, True, None, None, False)}
    assert "Broadcast" not in got._jdf.queryExecution().toString()
