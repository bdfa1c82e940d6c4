"""Masking and PII queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masking as M
from ..functions import patterns as P
from ..operators import pii
from ..sources import fixtures as FX
from ..sources.tables import spread, table
from . import oracle as O
from .registry import register

# --- M7 + M12: the flagship report -----------------------------------------

_report_cols = ", ".join(
    [f"CAST(sum({O.count_sql('text', k)}) AS BIGINT) AS n_{k}" for k in pii.REPORT_KINDS])
_names = " + ".join(O.count_sql("text", k) for k in P.NAME_PATTERNS)
_any = " + ".join([O.count_sql("text", k) for k in pii.REPORT_KINDS] + [_names])

PII_REPORT_SQL = f"""
SELECT source, lang, CAST(GROUPING(source, lang) AS BIGINT) AS grouping_level,
       count(*) AS n_docs, {_report_cols},
       CAST(sum({_names}) AS BIGINT) AS n_pii_name,
       CAST(sum(CASE WHEN ({_any}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_docs_flagged,
       CAST(sum(length(text)) AS BIGINT) AS chars_in,
       CAST(sum(length({O.mask_text_sql('text')})) AS BIGINT) AS chars_out
FROM documents GROUP BY ROLLUP (source, lang)
"""


def pii_report_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("source", "lang", "text"))
    return pii.pii_report(docs, "text", ["source", "lang"])


register("pii_report_documents", PII_REPORT_SQL, "S1 M1 M2 M3 M4 M6 M7 M12")(pii_report_documents)


# --- M7 over documents and F-text -------------------------------------------

@register("mask_text_documents",
          f"SELECT doc_id, {O.mask_text_sql('text')} AS masked FROM documents",
          "M1 M2 M3 M4 M6 M7")
def mask_text_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", M.mask_text("text").alias("masked"))


@register("mask_text_ftext",
          f"WITH {FX.cte('f_text')} SELECT doc_id, {O.mask_text_sql('text')} AS masked FROM f_text",
          "M6 M7")
def mask_text_ftext(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "f_text").select("doc_id", M.mask_text("text").alias("masked"))


# --- M8 -----------------------------------------------------------------------

@register("sanitize_prompt_ftext",
          f"WITH {FX.cte('f_text')} SELECT doc_id, {O.sanitize_sql('text')} AS sanitized FROM f_text",
          "M5 M8")
def sanitize_prompt_ftext(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "f_text").select(
        "doc_id", M.sanitize_prompt("text").alias("sanitized"))


@register("sanitize_prompt_documents",
          f"SELECT doc_id, {O.sanitize_sql('text')} AS sanitized FROM documents",
          "M8")
def sanitize_prompt_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", M.sanitize_prompt("text").alias("sanitized"))


# --- M1..M6 one at a time -------------------------------------------------------

_single = ", ".join([f"{O.replace_sql('text', k)} AS {k}_masked" for k in
                     ["card", "ssn", "email", "ip", "credential"]])
_names_only = "text"
for _k in P.NAME_PATTERNS:
    _names_only = O.replace_sql(_names_only, _k)


@register("mask_single_patterns_ftext",
          f"WITH {FX.cte('f_text')} SELECT doc_id, {_single}, {_names_only} AS names_masked FROM f_text",
          "M1 M2 M3 M4 M5 M6")
def mask_single_patterns_ftext(spark, sf_dir):
    t = F.col("text")
    return FX.fixture(spark, sf_dir, "f_text").select(
        "doc_id",
        M.mask_card(t).alias("card_masked"), M.mask_ssn(t).alias("ssn_masked"),
        M.mask_email(t).alias("email_masked"), M.mask_ip(t).alias("ip_masked"),
        M.mask_credentials(t).alias("credential_masked"),
        M.mask_pii_names(t).alias("names_masked"))


# --- M9: nested values (array, map, struct) -----------------------------------

def _nested_input(spark, sf_dir):
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conv.select(
        "conv_id", "turn",
        F.struct(F.col("role"), F.col("text").alias("content"),
                 F.array(F.col("text"), F.concat(F.col("role"), F.lit(" user_id=1.2.3.4"))).alias("parts"),
                 F.create_map(F.lit("role"), F.col("role"), F.lit("body"), F.col("text")).alias("meta"),
                 F.col("turn").alias("n")).alias("msg"))


_mt = O.mask_text_sql


@register("mask_nested_conversations",
          f"""SELECT conv_id, turn, {_mt('role')} AS role, {_mt('text')} AS content,
                 {_mt('text')} AS part_0, {_mt("concat(role, ' user_id=1.2.3.4')")} AS part_1,
                 {_mt('role')} AS meta_role, {_mt('text')} AS meta_body, turn AS n
              FROM conversations""",
          "M9")
def mask_nested_conversations(spark, sf_dir):
    masked = M.mask_nested(_nested_input(spark, sf_dir), ["msg"])
    m = F.col("msg")
    return masked.select(
        "conv_id", "turn", m.role.alias("role"), m.content.alias("content"),
        m.parts[0].alias("part_0"), m.parts[1].alias("part_1"),
        m.meta["role"].alias("meta_role"), m.meta["body"].alias("meta_body"), m.n.alias("n"))


# --- M10: a whole table ---------------------------------------------------------

@register("mask_table_pages",
          f"SELECT page_id, {_mt('url')} AS url, {_mt('html')} AS html FROM pages",
          "M10")
def mask_table_pages(spark, sf_dir):
    return M.mask_table(spread(table(spark, sf_dir, "pages")))


# --- M11: per-match scan --------------------------------------------------------

def _scan_sql(src: str, id_col: str, col: str, kinds: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {id_col}, '{col}' AS column_name, '{k}' AS kind, {O.extract_sql(col, k)} AS ms FROM {src}"
        for k in kinds)
    return (f"SELECT {id_col}, column_name, kind, generate_subscripts(ms, 1) AS match_no, "
            f"unnest(ms) AS match FROM ({parts}) s")


@register("pii_scan_documents",
          _scan_sql("documents", "doc_id", "text", list(P.ALL_PATTERNS)), "M11")
def pii_scan_documents(spark, sf_dir):
    return pii.pii_scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")),
                        "doc_id", ["text"])


@register("pii_scan_ftext",
          f"WITH {FX.cte('f_text')} " + _scan_sql("f_text", "doc_id", "text", list(P.ALL_PATTERNS)),
          "M11")
def pii_scan_ftext(spark, sf_dir):
    return pii.pii_scan(FX.fixture(spark, sf_dir, "f_text"), "doc_id", ["text"])


_PAGES_SQL = " UNION ALL ".join(_scan_sql("pages", "page_id", c, list(P.ALL_PATTERNS)) for c in ("url", "html"))


@register("pii_scan_pages", _PAGES_SQL, "M11")
def pii_scan_pages(spark, sf_dir):
    """Both text columns of the pages, all patterns."""
    return pii.pii_scan(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")),
                        "page_id", ["url", "html"], list(P.ALL_PATTERNS))


register("pii_scan_pages_all", _PAGES_SQL, "M11")(pii_scan_pages)  # its name in earlier rounds
