"""Registered queries of this package: ``opN_*`` and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convtrie, exactdedup, hardneg, mixing, neardup, packing, pii, quality, secrets, simhash, tokenfile, urlfilter, warc

#: Fixed values of the contract: id of the tokenizer files, end ids, URL rules.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Margins and topics of the mix, also used by the pipeline.
MARGINS = [mixing.Margin("source", 0.5), mixing.Margin("lang", 0.7), mixing.Margin("topic", 0.8)]
TOPICS = [("law", r"[Ll]icen[cs]e|[Rr]ights reserved|[Cc]opyright"), ("access", r"password|token|AKIA"),
          ("contact", r"@|\+[0-9]"), ("table", r" \| ")]
MIX_KEEP, MIX_ROUNDS, MIX_SEED = 0.8, 20, "mix"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file: below $TOKENIZER_DIR, else as installed."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = packing.pack_documents(docs, vocabulary(BYTE_BPE), spaces="leading", end_id=0)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                    "tier", "step_group")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = tokenfile.token_folder(spark)
    manifest = tokenfile.write_token_files(docs, vocabulary(WORD_BPE), folder, spaces="dropped", end_id=2)
    rows = tokenfile.read_token_files(manifest, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    rows = warc.read_pages(spark, folder)
    return rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, rules, default="allow").select("page_id", "host", "path", "rule", "verdict")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with topic, tokens and the mix's draw, at production parameters."""
    from .common import text_or_empty

    d = docs.withColumn("topic", mixing.topic_of(text_or_empty(), TOPICS))
    return mixing.mix(d, MARGINS, keep=MIX_KEEP, rounds=MIX_ROUNDS, seed=MIX_SEED)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return m.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("cell_weight", 9).alias("cell_weight"),
                    F.round("probability", 9).alias("probability"), "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pii.train(docs)
    return pii.digest(pii.find_pii(docs, model))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = quality.rate(docs, table(spark, sf_dir, "labels"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    F.round("llr", 6).alias("llr"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = secrets.train(docs, table(spark, sf_dir, "labels"))
    d = secrets.find_secrets(docs, ratio).drop("text")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secrets.span_text(F.filter("secrets", lambda x: x["kind"] != "random"))
    return d.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"),
                    secrets.span_text(F.col("secrets")).alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exactdedup.dedup_exact(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = convtrie.ordered_turns(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id").cast("long")
    both, ids = convtrie.rebuilt(turns, base=c - c % 20, taken=(F.crc32(c.cast("string").cast("binary")) % 4).cast("int"), most=3)
    return convtrie.prefix_trie(both, ids)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, distance=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    v = (table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
         .withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))
    return hardneg.hard_negatives(v, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=5, low=80, high=100)


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_token_files, op3_warc, op4_url_filter, op5_mixing, op6_pii,
                                    op7_quality_rules, op8_secrets, op9_exact_dedup, op10_near_duplicates, op11_prefix_trie, op12_simhash, op13_hard_negatives)}


# ------------------------------------------------------------------ SQL
_OP3 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_OP4 = """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                          WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                          WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                          WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def mix_sql(docs: str, columns: str, where: str = "") -> str:
    """DuckDB SQL of :func:`mixed` over the relation ``docs``."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'general' END"
    parts = [f"d AS (SELECT *, {topic} AS topic, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens "
             f"FROM (SELECT *, coalesce(text, '') AS t FROM {docs}))",
             "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"]
    for m in MARGINS:
        parts.append(f"g_{m.column} AS (SELECT v, t ** {m.exponent} / sum(t ** {m.exponent}) OVER () AS goal FROM "
                     f"(SELECT {m.column} AS v, sum(tokens) AS t FROM c GROUP BY ALL) WHERE t > 0)")
    parts.append("w0 AS (SELECT c.*, " + ", ".join(f"coalesce(g_{m.column}.goal, 0) AS goal_{m.column}" for m in MARGINS)
                 + ", CASE WHEN sum(tokens) OVER () > 0 THEN tokens / sum(tokens) OVER () ELSE 0 END AS w FROM c "
                 + " ".join(f"LEFT JOIN g_{m.column} ON c.{m.column} IS NOT DISTINCT FROM g_{m.column}.v" for m in MARGINS) + ")")
    step = 0
    for _ in range(MIX_ROUNDS):
        for m in MARGINS:
            held = f"sum(w) OVER (PARTITION BY {m.column})"
            parts.append(f"w{step + 1} AS (SELECT * REPLACE (CASE WHEN {held} > 0 THEN w * goal_{m.column} / {held} ELSE 0 END AS w) FROM w{step})")
            step += 1
    parts += [
        f"r AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM w{step})",
        "o AS (SELECT *, row_number() OVER (ORDER BY ratio DESC) AS k FROM r WHERE tokens > 0 AND ratio > 0)",
        f"b AS (SELECT *, {MIX_KEEP} * (SELECT sum(tokens) FROM c) - coalesce(sum(tokens) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget, "
        "sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o)",
        "x AS (SELECT arg_min(budget / rest, k) AS factor FROM b WHERE budget / rest * ratio <= 1)",
        "p AS (SELECT source, lang, topic, w, CASE WHEN tokens = 0 THEN 1.0 WHEN ratio > 0 THEN least(1.0, (SELECT factor FROM x) * ratio) ELSE 0.0 END AS probability FROM r)",
        "m AS (SELECT d.* EXCLUDE (t), p.w AS cell_weight, p.probability, "
        f"CAST(('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 < p.probability AS kept "
        "FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic)"]
    return "WITH " + ",\n".join(parts) + f"\nSELECT {columns} FROM m {where}"


_OP9 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


#: CRC-32 of a decimal number's digits, bit by bit (the polynomial is a fixed value).
_CRC = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))))")

_OP11 = f"""
WITH u AS (SELECT conv_id, turn, coalesce(CAST(role AS VARCHAR), '') AS role, coalesce(CAST(text AS VARCHAR), '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     k AS (SELECT *, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS turn_key FROM u),
     t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), turn_key) - 1 AS pos FROM k),
     c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM t GROUP BY conv_id),
     r AS (SELECT c.conv_id, b.pos, b.turn_key, b.text FROM c JOIN t b ON b.conv_id = c.base AND b.pos < c.h
           UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.turn_key, t.text
           FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h LEFT JOIN c b ON b.conv_id = c.base),
     m AS (SELECT conv_id, 0 AS depth, CAST([] AS VARCHAR[]) AS path, '' AS text FROM c
           UNION ALL SELECT conv_id, pos + 1, list(turn_key) OVER (PARTITION BY conv_id ORDER BY pos), text FROM r),
     e AS (SELECT conv_id, max(depth) AS ends FROM m GROUP BY conv_id),
     v AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
                  coalesce(string_agg(CASE WHEN depth = ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids
           FROM m JOIN e USING (conv_id) GROUP BY path, depth),
     p AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
     w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN p USING (path)),
     s AS (SELECT w.path[1:d] AS path, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
           FROM w, unnest(range(0, w.depth + 1)) x(d) GROUP BY ALL)
SELECT w.conv_id, w.depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN s USING (path) LEFT JOIN v o ON w.depth > 0 AND o.path = w.path[1:w.depth - 1]
"""


_OP13 = """
WITH r AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.k AS anchor, a.vec_id AS anchor_id, r.k, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
           FROM r a JOIN r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(r.v) = len(a.v)),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id) AS rank
           FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _OP3, "op11_prefix_trie": _OP11, "op13_hard_negatives": _OP13, "op4_url_filter": _OP4,
            "op5_mixing": mix_sql("documents", "doc_id, source, lang, topic, n_tokens, round(cell_weight, 9) AS cell_weight, "
                                               "round(probability, 9) AS probability, kept"),
            "op9_exact_dedup": _OP9}
