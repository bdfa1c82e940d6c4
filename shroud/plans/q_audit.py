"""Data-audit queries over the star schema.

The constraints (``STAR``) are a small catalog of the driver tables; it is
metadata and stays on the driver, while every audit runs over the full tables.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.audit import Constraint as C
from ..sources import profile
from ..sources.tables import TABLES, schema_catalog, table
from .registry import register

STAR = [
    C("region", "pk_region", "PRIMARY KEY", ["r_regionkey"]),
    C("region", "uq_region_name", "UNIQUE", ["r_name"]),
    C("nation", "pk_nation", "PRIMARY KEY", ["n_nationkey"]),
    C("nation", "uq_nation_name", "UNIQUE", ["n_name"]),
    C("nation", "fk_nation_region", "FOREIGN KEY", ["n_regionkey"], "region", ["r_regionkey"]),
    C("customer", "pk_customer", "PRIMARY KEY", ["c_custkey"]),
    C("customer", "fk_customer_nation", "FOREIGN KEY", ["c_nationkey"], "nation", ["n_nationkey"]),
    C("customer", "nn_customer", "NOT NULL", ["c_name", "c_nationkey", "c_mktsegment"]),
    C("customer", "ck_acctbal", "CHECK", ["c_acctbal"], predicate="c_acctbal >= -1000"),
    C("supplier", "pk_supplier", "PRIMARY KEY", ["s_suppkey"]),
    C("supplier", "fk_supplier_nation", "FOREIGN KEY", ["s_nationkey"], "nation", ["n_nationkey"]),
    C("part", "pk_part", "PRIMARY KEY", ["p_partkey"]),
    C("part", "ck_size", "CHECK", ["p_size"], predicate="p_size > 0"),
    C("part", "ck_price", "CHECK", ["p_retailprice"], predicate="p_retailprice > 0"),
    C("orders", "pk_orders", "PRIMARY KEY", ["o_orderkey"]),
    C("orders", "fk_orders_customer", "FOREIGN KEY", ["o_custkey"], "customer", ["c_custkey"]),
    C("orders", "nn_orders", "NOT NULL", ["o_custkey", "o_orderdate", "o_orderstatus"]),
    C("orders", "ck_totalprice", "CHECK", ["o_totalprice"], predicate="o_totalprice >= 0"),
    C("orders", "ck_status", "CHECK", ["o_orderstatus"], predicate="o_orderstatus IN ('F', 'O', 'P')"),
    C("lineitem", "pk_lineitem", "PRIMARY KEY", ["l_orderkey", "l_linenumber"]),
    C("lineitem", "fk_lineitem_orders", "FOREIGN KEY", ["l_orderkey"], "orders", ["o_orderkey"]),
    C("lineitem", "fk_lineitem_part", "FOREIGN KEY", ["l_partkey"], "part", ["p_partkey"]),
    C("lineitem", "fk_lineitem_supplier", "FOREIGN KEY", ["l_suppkey"], "supplier", ["s_suppkey"]),
    C("lineitem", "nn_lineitem", "NOT NULL", ["l_quantity", "l_extendedprice", "l_shipdate"]),
    C("lineitem", "ck_quantity", "CHECK", ["l_quantity"], predicate="l_quantity > 0"),
    C("lineitem", "ck_discount", "CHECK", ["l_discount"], predicate="l_discount BETWEEN 0 AND 0.1"),
    C("lineitem", "ck_tax", "CHECK", ["l_tax"], predicate="l_tax >= 0 AND l_tax < 0.08"),
    C("lineitem", "ck_flag", "CHECK", ["l_returnflag"], predicate="l_returnflag IN ('A', 'N', 'R')"),
    C("events", "pk_events", "PRIMARY KEY", ["event_id"]),
    C("events", "nn_events", "NOT NULL", ["ts", "user_id", "event_type"]),
    C("documents", "pk_documents", "PRIMARY KEY", ["doc_id"]),
    C("documents", "ck_chars", "CHECK", ["n_chars", "text"], predicate="n_chars = length(text)"),
    C("labels", "fk_labels_documents", "FOREIGN KEY", ["doc_id"], "documents", ["doc_id"]),
    C("labels", "ck_quality", "CHECK", ["quality"], predicate="quality IN (0, 1)"),
    C("conversations", "pk_conversations", "PRIMARY KEY", ["conv_id", "turn"]),
    C("pages", "pk_pages", "PRIMARY KEY", ["page_id"]),
]


def _loader(spark, sf_dir):
    return partial(table, spark, sf_dir)


# --- oracle SQL, generated from the same constraint list ---------------------------

def _any_null(cols):
    return " OR ".join(f"{c} IS NULL" for c in cols)


def _key_sql():
    parts = []
    for c in STAR:
        if c.kind not in ("PRIMARY KEY", "UNIQUE"):
            continue
        cols = ", ".join(c.columns)
        parts.append(
            f"SELECT '{c.table}' AS table_name, '{c.name}' AS constraint_name, '{c.kind}' AS constraint_type, "
            f"CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, "
            f"CAST(coalesce(sum(CASE WHEN NOT nk AND n > 1 THEN 1 END), 0) AS BIGINT) AS n_dup_keys, "
            f"CAST(coalesce(sum(CASE WHEN NOT nk AND n > 1 THEN n END), 0) AS BIGINT) AS n_dup_rows, "
            f"CAST(coalesce(sum(CASE WHEN nk THEN n END), 0) AS BIGINT) AS n_null_key_rows "
            f"FROM (SELECT count(*) AS n, ({_any_null(c.columns)}) AS nk FROM {c.table} GROUP BY {cols}) g")
    return " UNION ALL ".join(parts)


def _not_null_sql():
    seen, parts = set(), []
    for c in STAR:
        if c.kind in ("NOT NULL", "PRIMARY KEY"):
            for col in c.columns:
                if (c.table, col) in seen:
                    continue
                seen.add((c.table, col))
                parts.append(f"SELECT '{c.table}' AS table_name, '{col}' AS column_name, "
                             f"CAST(count(*) - count({col}) AS BIGINT) AS n_nulls FROM {c.table}")
    return " UNION ALL ".join(parts)


def _ref_sql():
    parts = []
    for c in STAR:
        if c.kind != "FOREIGN KEY":
            continue
        k, p = c.columns[0], c.ref_columns[0]
        parts.append(
            f"SELECT '{c.table}' AS table_name, '{c.name}' AS constraint_name, '{c.ref_table}' AS ref_table, "
            f"(SELECT count(*) FROM {c.table}) AS n_rows, "
            f"(SELECT count(*) FROM {c.table} WHERE {k} IS NULL) AS n_null_fk, "
            f"(SELECT count(*) FROM {c.table} x WHERE {k} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {c.ref_table} y WHERE y.{p} = x.{k})) AS n_orphan_rows, "
            f"(SELECT count(DISTINCT {k}) FROM {c.table} x WHERE {k} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {c.ref_table} y WHERE y.{p} = x.{k})) AS n_orphan_keys")
    return " UNION ALL ".join(parts)


def _check_sql():
    parts = []
    for c in STAR:
        if c.kind == "CHECK":
            parts.append(f"SELECT '{c.table}' AS table_name, '{c.name}' AS constraint_name, "
                         f"CAST(count(*) FILTER (WHERE NOT ({c.predicate})) AS BIGINT) AS n_violations "
                         f"FROM {c.table}")
    return " UNION ALL ".join(parts)


def _evidence_sql():
    parts = []
    for c in STAR:
        if c.kind != "FOREIGN KEY":
            continue
        k, p = c.columns[0], c.ref_columns[0]
        parts.append(
            f"SELECT '{c.table}' AS table_name, '{k}' AS column_name, '{c.ref_table}' AS ref_table, "
            f"count(*) AS n_child_values, CAST(count(y.v) AS BIGINT) AS n_found "
            f"FROM (SELECT DISTINCT {k} AS v FROM {c.table} WHERE {k} IS NOT NULL) x "
            f"LEFT JOIN (SELECT DISTINCT {p} AS v FROM {c.ref_table}) y ON x.v = y.v")
    return " UNION ALL ".join(parts)


def _sizes_sql():
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES)


register("audit_keys", _key_sql(), "Q1")(
    lambda spark, sf_dir: A.key_audit(_loader(spark, sf_dir), STAR))
register("audit_not_null", _not_null_sql(), "Q2")(
    lambda spark, sf_dir: A.not_null_audit(_loader(spark, sf_dir), STAR))
register("audit_references", _ref_sql(), "Q3")(
    lambda spark, sf_dir: A.reference_audit(_loader(spark, sf_dir), STAR))
register("audit_checks", _check_sql(), "Q4")(
    lambda spark, sf_dir: A.check_audit(_loader(spark, sf_dir), STAR))
register("audit_fk_evidence", _evidence_sql(), "Q5")(
    lambda spark, sf_dir: A.fk_evidence(_loader(spark, sf_dir), [c for c in STAR if c.kind == "FOREIGN KEY"]))
register("audit_table_sizes", _sizes_sql(), "Q7")(
    lambda spark, sf_dir: A.table_sizes(_loader(spark, sf_dir), TABLES))


# --- violating rows: orders with planted duplicates, orphans, NULLs and bad prices -------

_BAD = [C("aud", "pk_aud", "PRIMARY KEY", ["id"]), C("aud", "uq_aud", "UNIQUE", ["id", "cust"]),
        C("aud", "fk_aud", "FOREIGN KEY", ["cust"], "customer", ["c_custkey"]),
        C("aud", "ck_price", "CHECK", ["price"], predicate="price >= 0"), C("aud", "ck_cust", "CHECK", ["cust"], predicate="cust < 1000000000")]
_BAD_KEYS = {"aud": ["id", "price"]}
_AUD = """SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 40 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS cust,
       CASE WHEN o_orderkey % 23 = 0 THEN -1 WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 1000 END AS price FROM {orders}"""


def _bad_loader(spark, sf_dir):
    def load(name):
        if name == "aud":
            return spark.sql(_AUD, orders=table(spark, sf_dir, "orders"))
        return table(spark, sf_dir, name)
    return load


_AUD_SQL = f"WITH aud AS ({_AUD.format(orders='orders')})"


def _text(*cols):
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in cols) + ")"


register("audit_key_violations", f"""{_AUD_SQL}
SELECT 'aud' AS table_name, 'pk_aud' AS constraint_name, {_text('id')} AS key, CASE WHEN id IS NULL THEN 'null' ELSE 'duplicate' END AS reason, count(*) AS n_rows
FROM aud GROUP BY id HAVING id IS NULL OR count(*) > 1
UNION ALL
SELECT 'aud', 'uq_aud', {_text('id', 'cust')}, 'duplicate', count(*) FROM aud WHERE id IS NOT NULL AND cust IS NOT NULL GROUP BY id, cust HAVING count(*) > 1""", "Q1")(
    lambda spark, sf_dir: A.key_violations(_bad_loader(spark, sf_dir), _BAD))
register("audit_reference_violations", f"""{_AUD_SQL}
SELECT 'aud' AS table_name, 'fk_aud' AS constraint_name, 'customer' AS ref_table, {_text('cust')} AS key, count(*) AS n_rows
FROM aud WHERE cust IS NOT NULL AND cust NOT IN (SELECT c_custkey FROM customer) GROUP BY cust""", "Q3")(
    lambda spark, sf_dir: A.reference_violations(_bad_loader(spark, sf_dir), _BAD))
register("audit_check_violations", f"""{_AUD_SQL}
SELECT 'aud' AS table_name, 'ck_price' AS constraint_name, {_text('id', 'price')} AS key FROM aud WHERE NOT price >= 0
UNION ALL SELECT 'aud', 'ck_cust', {_text('id', 'price')} FROM aud WHERE NOT cust < 1000000000""", "Q4")(
    lambda spark, sf_dir: A.check_violations(_bad_loader(spark, sf_dir), _BAD, _BAD_KEYS))


# --- S7: the tables' own schemas as a catalog, matched with what the data hold ------------

register("schema_catalog_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name AS name, CAST(row_number() OVER () AS INTEGER) AS ordinal, "
    f"(SELECT count(*) FROM {t}) AS n_rows FROM (DESCRIBE {t})" for t in TABLES), "S7 Q7")(
    lambda spark, sf_dir: schema_catalog(spark, sf_dir).select("table_name", "name", "ordinal").join(
        A.table_sizes(_loader(spark, sf_dir), TABLES), "table_name"))


# --- S7: constraints and relationships of the tables, from their data -----------------

#: Columns of whole numbers (w) and strings (s) of the driver's tables.
_COMPARED = {"region": "w r_regionkey s r_name", "nation": "w n_nationkey n_regionkey s n_name", "customer": "w c_custkey c_nationkey s c_name c_mktsegment",
             "supplier": "w s_suppkey s_nationkey s s_name", "part": "w p_partkey p_size s p_name p_brand p_type", "orders": "w o_orderkey o_custkey s o_orderstatus o_orderpriority",
             "lineitem": "w l_orderkey l_partkey l_suppkey l_linenumber s l_returnflag l_linestatus", "events": "w event_id user_id s event_type props",
             "documents": "w doc_id n_chars s text lang source", "embeddings": "w vec_id label", "pages": "w page_id s url html", "benchmark": "w item_id s text",
             "labels": "w doc_id quality toxic", "conversations": "w conv_id turn s role text"}


def _compared() -> list[tuple[str, str, str]]:
    out = []
    for t, text in _COMPARED.items():
        kind = ""
        for word in text.split():
            if word in ("w", "s"):
                kind = word
            else:
                out.append((t, word, kind))
    return out


_KEYS_SQL = " UNION ALL ".join(f"SELECT 'uq_{t}_{c}' AS name, '{t}' AS table_name, 'UNIQUE' AS constraint_type, to_json(['{c}']) AS columns FROM {t} "
                               f"HAVING count(*) > 0 AND count(DISTINCT {c}) = count(*)" for t, c, _ in _compared())
_INCLUSION_SQL = ("WITH d AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
                                                     for t, c, k in _compared())
                  + f"), keys AS ({_KEYS_SQL}), p AS (SELECT d.* FROM d JOIN keys ON keys.name = 'uq_' || d.t || '_' || d.c), "
                  "n AS (SELECT t, c, count(*) AS n FROM d GROUP BY t, c), "
                  "m AS (SELECT d.t, d.c, p.t AS pt, p.c AS pc, count(*) AS n FROM d JOIN p ON d.k = p.k AND d.v = p.v AND (d.t, d.c) <> (p.t, p.c) GROUP BY ALL) "
                  "SELECT m.t AS from_table, m.c AS from_column, m.pt AS to_table, m.pc AS to_column, 'INCLUSION' AS relationship_type FROM m JOIN n USING (t, c, n)")


@register("table_catalog_constraints", _KEYS_SQL, "S7 Q1")
def table_catalog_constraints(spark, sf_dir):
    return profile.table_keys(spark, lambda t: table(spark, sf_dir, t), TABLES).withColumn("columns", F.to_json("columns"))


@register("table_catalog_relationships", _INCLUSION_SQL, "S7 Q5")
def table_catalog_relationships(spark, sf_dir):
    return profile.table_relationships(spark, lambda t: table(spark, sf_dir, t), TABLES)
