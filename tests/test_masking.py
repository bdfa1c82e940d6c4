"""Masking: hand-made quirks (FIXTURES.md) and properties."""

from pyspark.sql import functions as F

from shroud.functions import masking as M
from shroud.operators import pii
from shroud.sources.tables import table

from conftest import SF_MID, SF_SMALL


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("m")).first().m


def test_ascii_boundary_non_ascii_letters(spark):
    assert one(spark, "é1.2.3.4é", M.mask_ip) == "é[REDACTED]é"


def test_email_pipe_in_tld_class(spark):
    assert one(spark, "a@b.c|m x .a@b.com|", M.mask_email) == "[REDACTED] x .[REDACTED]|"


def test_sanitize_order_email_before_credential(spark):
    assert one(spark, "password: a@b.co x", M.sanitize_prompt) == "password: [REDACTED] x"


def test_credential_word_boundary(spark):
    assert one(spark, "api_key=abc key=abc", M.mask_credentials) == "api_key=abc [REDACTED]"


def test_card_ssn_and_names(spark):
    s = "card 4111 1111 1111 1111, ssn 123-45-6789, Customer_ID and dob"
    # "ssn" is itself a PII column name
    assert one(spark, s, M.mask_text) == "card [REDACTED], [PII_COLUMN] [REDACTED], [PII_COLUMN] and [PII_COLUMN]"


def test_mask_is_idempotent_on_documents(spark):
    d = table(spark, SF_MID, "documents").select("doc_id", M.mask_text("text").alias("m"))
    twice = d.select("doc_id", "m", M.mask_text("m").alias("mm"))
    assert twice.where(F.col("m") != F.col("mm")).count() == 0


def test_known_counts_sf001(spark):
    docs = table(spark, SF_MID, "documents")
    r = pii.pii_report(docs, "text", ["source"]).where("grouping_level = 1").first()
    assert (r.n_ip, r.n_card, r.n_email, r.n_ssn) == (32, 30, 12, 0)


def test_mask_nested_keeps_keys_and_numbers(spark):
    df = spark.createDataFrame(
        [(1, {"a@b.com": "x a@b.com"}, ["1.2.3.4", None], (5, "ssn 123-45-6789"))],
        "id int, m map<string,string>, a array<string>, s struct<n:int,t:string>")
    r = M.mask_nested(df).first()
    assert r.id == 1
    assert r.m == {"a@b.com": "x [REDACTED]"}
    assert r.a == ["[REDACTED]", None]
    assert r.s.n == 5 and r.s.t == "[PII_COLUMN] [REDACTED]"


def test_null_struct_stays_null(spark):
    df = spark.createDataFrame([(None,)], "s struct<t:string>")
    assert M.mask_nested(df).first().s is None


def test_pii_columns(spark):
    df = spark.createDataFrame([("customer_id",), ("First_Name",), ("wage",), ("note",)], "name string")
    got = {r.name: r.pii_group for r in pii.pii_columns(df).collect()}
    assert got == {"customer_id": 1, "First_Name": 2, "wage": 3, "note": None}


def test_stream_mask_equals_batch(spark):
    from shroud.streaming import streams as S
    src = (spark.readStream.schema("doc_id long, text string")
           .option("pathGlobFilter", "documents.parquet").parquet("/root/testdata/sf0.001"))
    out, ckpt = S.stream_location(spark, "test_mask")
    S.run_available_now(S.mask_stream(src, "doc_id", ["text"], partitions=2), out, ckpt)
    stream = {(r.doc_id, r.text) for r in spark.read.parquet(out).collect()}
    batch = {(r.doc_id, r.m) for r in table(spark, "/root/testdata/sf0.001", "documents")
             .select("doc_id", M.mask_text("text").alias("m")).collect()}
    assert stream == batch


def test_pages_are_scanned_whole(spark, tmp_path):
    from shroud.functions import patterns as P
    from shroud.plans import registry

    rows = [(1, "http://a.example/?mail=ann@mail.example.com", "<p>password=abcdef123 date of birth ssn user_id</p>"), (2, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.load_all()["pii_scan_pages_all"].fn(spark, str(tmp_path)).collect()
    assert {(r.page_id, r.column_name, r.kind) for r in got} >= {(1, "url", "email"), (1, "html", "credential")}
    assert any(r.kind in P.NAME_PATTERNS for r in got)


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    # a table is one file or a folder of files; an empty one gives no rows
    from shroud.plans.q_streaming import mask_stream_documents
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {(r.doc_id, r.text) for r in mask_stream_documents(spark, SF_SMALL).collect()}
    assert len(want) == docs.count()
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    got = [(r.doc_id, r.text) for r in mask_stream_documents(spark, str(tmp_path / "many")).collect()]
    assert len(got) == len(want) and set(got) == want
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert mask_stream_documents(spark, str(tmp_path / "none")).count() == 0
