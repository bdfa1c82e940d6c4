"""Chat-request operators: hand-made cases."""

import hashlib
import json
import math

from pyspark.sql import functions as F

from shroud.operators import chat


def test_clamp_temperature(spark):
    vals = [None, 0.0, float("nan"), 0.2, 0.9, -1.0]
    df = spark.createDataFrame([(v,) for v in vals], "t double")
    got = [r.c for r in df.select(chat.clamp_temperature(F.col("t")).alias("c")).collect()]
    assert got == [0.1, 0.1, 0.1, 0.2, 0.3, -1.0]


def test_validate_and_status(spark):
    df = spark.createDataFrame(
        [(1, None), (2, []), (3, [("user", None)]), (4, [("user", "hi")])],
        "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: r.s for r in df.select("id", chat.status(F.lit(True), F.col("messages")).alias("s")).collect()}
    assert got == {1: 400, 2: 200, 3: 500, 4: 200}
    rl = df.select("id", chat.status(F.lit(False), F.col("messages")).alias("s")).collect()
    assert {r.s for r in rl} == {429}


def test_fingerprint_matches_sha256_of_json(spark):
    msgs = [("user", 'say "hi"\nnow'), ("assistant", "é ok")]
    df = spark.createDataFrame([(msgs,)], "m array<struct<role:string,content:string>>")
    got = df.select(chat.fingerprint(F.col("m")).alias("f")).first().f
    body = json.dumps([{"role": r, "content": c} for r, c in msgs], separators=(",", ":"),
                      ensure_ascii=False)
    assert got == hashlib.sha256(body.encode()).hexdigest()[:16]


def test_parse_response_fallback_and_missing_keys(spark):
    df = spark.createDataFrame([("oops",), ("{}",), ('{"fields": ["a"]}',)], "t string")
    rows = df.select(chat.parse_response("kpi", F.col("t")).alias("p")).collect()
    assert rows[0].p.fields == "[]" and rows[0].p.consistency == "[]"
    assert rows[1].p.fields is None
    assert rows[2].p.fields == '["a"]' and rows[2].p.tables is None
    db = spark.createDataFrame([("not json",)], "t string").select(
        chat.parse_response("database", F.col("t")).alias("p")).first().p
    assert json.loads(db.recommendations) == ["Failed to parse LLM response"]


def test_sanitize_response_first_choice_only(spark):
    df = spark.createDataFrame(
        [([(0, ("assistant", "mail a@b.com")), (1, ("assistant", "mail a@b.com"))],)],
        "c array<struct<index:int,message:struct<role:string,content:string>>>")
    r = df.select(chat.sanitize_response(F.col("c")).alias("c")).first().c
    assert r[0].message.content == "mail [REDACTED]"
    assert r[1].message.content == "mail a@b.com"


def test_oversize_request_is_flagged_and_kept_whole(spark):
    rows = [(1, i, "user", "x" * 100, 0.2) for i in range(5)] + [(2, 0, "user", "y", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, temperature double")
    r = {x.conv_id: x for x in chat.assemble_requests(df, limit_bytes=300).collect()}
    assert r[1].oversize and len(r[1].messages) == r[1].n_messages == 5
    assert not r[2].oversize and r[2].messages[0].content == "y"
    assert not math.isnan(r[1].body_bytes)
