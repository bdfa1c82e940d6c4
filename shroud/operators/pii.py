"""PII detection jobs: per-match scan, per-group report, catalog column classes.

All passes are a single scan of the input: every pattern is evaluated in one
projection, so adding patterns adds CPU, not table scans or shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking as M
from ..functions import patterns as P


def _count(col: Column, kind: str) -> Column:
    n = F.regexp_count(col, F.lit(P.spark_form(P.ALL_PATTERNS[kind])))
    if kind == "email":
        return F.when(F.instr(col, "@") > 0, n).otherwise(F.lit(0))
    return n


def pii_scan(df: DataFrame, id_col: str, cols: list[str],
             kinds: list[str] | None = None) -> DataFrame:
    """One row per match: (id, column_name, kind, match_no (1-based), match).

    Patterns run independently on the original text (a scan, not a rewrite)."""
    kinds = kinds or list(P.ALL_PATTERNS)
    found = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"),
                 F.regexp_extract_all(F.col(c), F.lit(P.spark_form(P.ALL_PATTERNS[k])), 0)
                 .alias("matches"))
        for c in cols for k in kinds])
    return (df.select(F.col(id_col), F.inline(found))
            .select(id_col, "column_name", "kind",
                    F.posexplode("matches").alias("pos", "match"))
            .select(id_col, "column_name", "kind",
                    (F.col("pos") + 1).cast("long").alias("match_no"), "match"))


REPORT_KINDS = ["card", "ssn", "email", "ip", "credential"]


def pii_report(df: DataFrame, text_col: str, by: list[str]) -> DataFrame:
    """Counts per group with ROLLUP totals.

    Per group: documents, matches of each value/secret pattern, matches of the
    column-name patterns, documents with at least one hit, characters before
    and after ``mask_text``. ``grouping_level`` tells subtotal rows apart.
    Partial aggregation happens map-side; the shuffle carries one row per group
    per task."""
    t = F.col(text_col)
    per_row = [_count(t, k).alias(f"n_{k}") for k in REPORT_KINDS]
    names = F.regexp_count(t, F.lit(P.spark_form(P.PII_NAMES_ALL))).alias("n_pii_name")
    rows = df.select(*by, *per_row, names,
                     F.length(t).alias("chars_in"),
                     F.length(M.mask_text(t)).alias("chars_out"))
    hit = sum((F.col(f"n_{k}") for k in REPORT_KINDS), F.col("n_pii_name")) > 0
    return (rows.rollup(*by).agg(
        F.grouping_id(*by).alias("grouping_level"),
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(f"n_{k}").alias(f"n_{k}") for k in REPORT_KINDS],
        F.sum("n_pii_name").alias("n_pii_name"),
        F.sum(hit.cast("long")).alias("n_docs_flagged"),
        F.sum("chars_in").alias("chars_in"),
        F.sum("chars_out").alias("chars_out")))


def pii_columns(columns: DataFrame, name_col: str = "name") -> DataFrame:
    """Classify catalog column names by the three PII-name groups.

    Adds ``pii_group`` (1, 2, 3 or NULL: first group that matches) and
    ``is_pii``; every input row is kept."""
    n = F.col(name_col)
    grp = F.lit(None).cast("int")
    for i, kind in reversed(list(enumerate(P.NAME_PATTERNS, start=1))):
        grp = F.when(n.rlike(P.spark_form(P.ALL_PATTERNS[kind])), F.lit(i)).otherwise(grp)
    return columns.withColumn("pii_group", grp).withColumn("is_pii", F.col("pii_group").isNotNull())
