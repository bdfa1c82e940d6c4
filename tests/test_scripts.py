"""Scripts of any size: byte ranges give the statements of whole texts."""

import pytest

from shroud.operators import ddl
from shroud.sources import fixtures as FX
from shroud.sources import scripts as S

from conftest import SF_SMALL

TEXTS = {
    "quotes.sql": "a 'p;q'; b ';;' ; c '' '';'' ; d 'it''s; ok';\n" * 12,
    "comments.sql": ("-- x; 'y\nSELECT 1 /* ; ' ; */; # it's; fine\nSELECT `a;b`, 'c -- d; /* e' ; SELECT 2 - 1 / 3 -- end;\n;\n") * 12,
    "escapes.ddl": "x 'a\\'; b\\\\'; y \\; z; w;" * 20,
    "long.sql": "INSERT INTO t VALUES ('" + "v;w(" * 500 + "'); SELECT 1; /* " + "c; " * 300 + "*/ SELECT 2",
    "empty.sql": "", "blank.sql": " ;\n; -- nothing\n;", "one.sql": "SELECT 1", "ünï.sql": "é;ü 'ö;€';😀" * 60, "skipped.txt": "no;no"}


@pytest.mark.parametrize("size", ["400", "128m"])
def test_ranges_equal_whole_texts(spark, tmp_path, size):
    for name, text in TEXTS.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r.path.rpartition("/")[2], r.seq, r.stmt) for r in S.script_statements(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    from urllib.parse import unquote
    whole = spark.createDataFrame([(n, t) for n, t in TEXTS.items() if not n.endswith("txt")], "script_id string, content string")
    want = sorted((r.script_id, r.seq, r.stmt) for r in ddl.split_statements(whole).collect())
    assert sorted((unquote(n), q, s) for n, q, s in got) == want and len(want) > 200


def test_dump_files_equal_rows(spark, tmp_path):
    dump = FX.fixture(spark, SF_SMALL, "f_dump").limit(60)
    from pyspark.sql import functions as F
    S.write_files(dump.select(F.concat("script_id", F.lit(".sql")).alias("name"), "content"), str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        got = {(r.path.rpartition("/")[2][:-4], r.seq): r.stmt for r in S.script_statements(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(r.script_id, r.seq): r.stmt for r in ddl.split_statements(dump).collect()}
    assert S.script_statements(spark, str(tmp_path), "*.nothing").count() == 0


def test_automaton_states():
    assert [S.step("N", x) for x in ("a", "a 'b", "a `b", "a -- b", "a # b", "a /* b", "a \\", "a '\\", "a - b / c")] == list("NSBDDCESN")
    assert [S.step(s, "x' y") for s in "SBDC"] == ["N", "B", "D", "C"] and S.step("D", "x\n'") == "S" and S.step("C", "*/ `") == "B"
