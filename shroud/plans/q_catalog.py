"""Schema-catalog queries on F-ddl, F-log, F-cat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.patterns import sql_literal as lit
from ..functions.sqltypes import normalize_type_sql
from ..operators import audit, ddl, pii, replay
from ..sources import fixtures as FX
from . import catalog_sql as K
from .registry import register


def _scripts(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "f_ddl")


def _log_fddl(spark, sf_dir):
    return ddl.change_log(ddl.split_statements(_scripts(spark, sf_dir)))


def _log_fviews(spark, sf_dir):
    return ddl.change_log(ddl.split_statements(FX.fixture(spark, sf_dir, "f_views")))


def _log_flog(spark, sf_dir):
    return ddl.flat_log(FX.fixture(spark, sf_dir, "f_log"))


# --- DuckDB pieces ------------------------------------------------------------------

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
def rx(pattern: str) -> str:
    """A pattern of the DDL reader as a literal for RE2."""
    return lit(ddl.re2(pattern))


_PLAIN = f"regexp_replace(x, {rx(ddl.BACKTICK)}, '\\1', 'g')"
_SPLIT = (f"list_filter(list_transform(regexp_extract_all(regexp_replace(content, {rx(ddl.COMMENT)}, '\\1', 'g'), "
          f"{rx(ddl.STATEMENT_TOKEN)}, 1), lambda x: {_STRIP.format(x=_PLAIN)}), lambda x: x <> '')")
_KINDS = [(ddl._CT, "create_table"), (ddl._CI, "create_index"), (ddl._CV, "create_view"),
          (ddl._CS, "create_schema"), (ddl._AT, "alter_table"), (ddl._DR, "drop"),
          (ddl._TR, "truncate")]
_KIND_SQL = ("CASE " + " ".join(f"WHEN regexp_matches(stmt, {rx(p)}) THEN '{k}'" for p, k in _KINDS)
             + " ELSE 'other' END")


def stmts_sql(fixture: str) -> str:
    """CTEs up to ``stk``: the classified statements of a fixture."""
    return f"""{FX.cte(fixture)},
sp AS (SELECT script_id, {_SPLIT} AS st FROM {fixture}),
stmts AS (SELECT script_id, CAST(generate_subscripts(st, 1) AS BIGINT) AS seq, unnest(st) AS stmt FROM sp),
stk AS (SELECT *, {_KIND_SQL} AS kind FROM stmts)"""


def _inside_sql(x: str) -> str:
    return f"substr({x}, 2, greatest(length({x}) - 2, 0))"


def _list_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, {rx(ddl.LIST_ITEM)}, 1), lambda x: {_STRIP.format(x='x')}), lambda x: x <> '')"


def items_sql(fixture: str) -> str:
    """CTEs up to ``its``: the items of the CREATE TABLE lists, and ``every`` with the rejected ones."""
    bare = f"regexp_replace(item, {rx(ddl.QUOTED)}, '', 'g')"
    bal = f"len(regexp_extract_all({bare}, '\\(')) = len(regexp_extract_all({bare}, '\\)'))"
    return f"""{stmts_sql(fixture)},
ct AS (SELECT script_id, seq, regexp_extract(stmt, {rx(ddl._CT)}, 1) AS t,
              {_list_sql(_inside_sql(f"regexp_extract(stmt, {rx(ddl._CT)}, 2)"))} AS items
       FROM stk WHERE kind = 'create_table'),
it AS (SELECT script_id, seq, t, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM ct),
every AS (SELECT *, regexp_matches(item, {lit(ddl._TABLE_CONSTRAINT)}) AS is_con,
                 regexp_matches(item, {lit(ddl._INDEX_ITEM)}) OR NOT ({bal}) AS rejected FROM it),
its AS (SELECT * FROM every WHERE NOT rejected)"""


_STMTS, _ITEMS = stmts_sql("f_ddl"), items_sql("f_ddl")


@register("ddl_statements_fddl", f"WITH {_STMTS} SELECT script_id, seq, stmt, kind FROM stk", "S1 G1 G2")
def ddl_statements_fddl(spark, sf_dir):
    return ddl.statements(_scripts(spark, sf_dir))


def _raw_type_sql(item: str) -> str:
    rest = f"regexp_extract({item}, '(?s)^\\S+\\s*(.*)$', 1)"
    return _STRIP.format(x=f"regexp_extract({rest}, {lit('(?is)^(.*?)(?:\\s+(?:' + ddl._COL_KEYWORDS + ')\\b.*)?$')}, 1)")


def columns_sql(fixture: str) -> str:
    said = f"regexp_replace(item, {rx(ddl._INSIDE)}, '()', 'g')"
    return f"""WITH {items_sql(fixture)}
SELECT script_id, seq, t AS table_name, CAST(pos AS BIGINT) AS ordinal,
       regexp_extract(item, '^(\\S+)', 1) AS column_name,
       {normalize_type_sql(_raw_type_sql('item'))} AS data_type,
       NOT regexp_matches({said}, '(?i)\\bNOT\\s+NULL\\b') AS nullable,
       CASE WHEN regexp_matches({said}, '(?i)\\bDEFAULT\\b') THEN nullif(regexp_extract(item, {rx(ddl._DEFAULT)}, 1), '') END
         AS default_value,
       regexp_matches({said}, '(?i)\\bPRIMARY\\s+KEY\\b') AS is_primary_key
FROM its WHERE NOT is_con"""


_COLS_SQL = columns_sql("f_ddl")


@register("ddl_columns_fddl", _COLS_SQL, "G3 G4")
def ddl_columns_fddl(spark, sf_dir):
    return _columns(_log_fddl(spark, sf_dir))


def _columns(log):
    return log.where((F.col("op") == "add_column") & (F.col("stmt_kind") == "create_table")).select(
        "script_id", "seq", "table_name", F.col("sub").alias("ordinal"), "column_name", "data_type",
        "nullable", F.col("value").alias("default_value"), "is_primary_key")


def _expr_cols_sql(e: str) -> str:
    e = f"regexp_replace({e}, '''[^'']*''', '0', 'g')"
    e = f"regexp_replace({e}, '(?i)\\b(and|or|not|in)\\s*\\(', '\\1 , (', 'g')"
    for _ in range(3):
        e = f"regexp_replace({e}, '\\b[A-Za-z_][A-Za-z0-9_]*\\s*\\([^()]*\\)', '0', 'g')"
    kws = "[" + ", ".join(lit(k) for k in ddl.EXPR_KEYWORDS) + "]"
    return (f"list_filter(regexp_extract_all({e}, '\\b(?:[A-Za-z_][A-Za-z0-9_]*\\.)*([A-Za-z_][A-Za-z0-9_]*)\\b', 1), "
            f"lambda x: NOT list_contains({kws}, upper(x)))")


def _idents_sql(pattern: str, group: int) -> str:
    return (f"list_filter(list_transform(string_split(regexp_extract(item, {lit(pattern)}, {group}), ','), "
            f"lambda x: {_STRIP.format(x='x')}), lambda x: x <> '')")


_FK = r"(?is)FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+([^\s(]+)\s*\(([^)]*)\)"


def constraints_sql(fixture: str, more: str = "") -> str:
    def action(on: str) -> str:
        found = f"regexp_extract(item, {lit(rf'(?i)ON\s+{on}\s+' + ddl._ACTION)}, 1)"
        return f"CASE WHEN {found} <> '' THEN concat(' ON {on} ', upper(regexp_replace({found}, '\\s+', ' ', 'g'))) ELSE '' END"

    return f"""WITH {items_sql(fixture)},
c AS (SELECT *, upper(regexp_replace(regexp_extract(item, {lit(ddl._TABLE_CONSTRAINT)}, 1), '\\s+', ' ', 'g')) AS k
      FROM (SELECT *, count(*) OVER (PARTITION BY script_id, seq) AS n_items FROM its) WHERE is_con)
SELECT script_id, seq, t AS table_name, {more + ',' if more else ''}
       coalesce(nullif(regexp_extract(item, '(?i)^CONSTRAINT\\s+(\\S+)', 1), ''),
                CASE WHEN k = 'UNIQUE' THEN nullif(regexp_extract(item, {lit(ddl._UNIQUE_LIST)}, 1), '') END,
                CASE k WHEN 'PRIMARY KEY' THEN 'unnamed_pk' WHEN 'UNIQUE' THEN 'unnamed_unique'
                       WHEN 'FOREIGN KEY' THEN 'unnamed_fk' ELSE 'unnamed_check' END) AS name,
       CASE WHEN k = 'FOREIGN KEY' THEN concat(k, {action('DELETE')}, {action('UPDATE')}) ELSE k END AS constraint_type,
       to_json(CASE k WHEN 'PRIMARY KEY' THEN {_idents_sql(r"(?i)PRIMARY\s+KEY\s*\(([^)]*)\)", 1)}
                      WHEN 'UNIQUE' THEN {_idents_sql(ddl._UNIQUE_LIST, 2)}
                      WHEN 'FOREIGN KEY' THEN {_idents_sql(_FK, 1)}
                      ELSE {_expr_cols_sql(_inside_sql(f"regexp_extract(item, {rx(ddl._CHECK)}, 1)"))} END) AS columns,
       CASE WHEN k = 'FOREIGN KEY' THEN nullif(regexp_extract(item, {lit(_FK)}, 2), '') END AS reference_table,
       CASE WHEN k = 'FOREIGN KEY' THEN to_json({_idents_sql(_FK, 3)}) END AS reference_columns
FROM c"""


def _constraints(log):
    return log.where((F.col("op") == "add_constraint") & (F.col("stmt_kind") == "create_table")).select(
        "script_id", "seq", "table_name", F.col("value").alias("name"), "constraint_type",
        F.to_json("columns").alias("columns"), "reference_table", F.to_json("reference_columns").alias("reference_columns"))


@register("ddl_constraints_fddl", constraints_sql("f_ddl"), "G10 G11")
def ddl_constraints_fddl(spark, sf_dir):
    return _constraints(_log_fddl(spark, sf_dir))


# --- F-dump: DDL as dump tools write it --------------------------------------------

def _log_fdump(spark, sf_dir):
    return ddl.change_log(ddl.split_statements(FX.fixture(spark, sf_dir, "f_dump")))


@register("ddl_statements_fdump", f"""WITH {stmts_sql('f_dump')}
SELECT script_id, seq, length(stmt) AS n_chars, sha256(stmt) AS stmt_sha256, kind FROM stk""", "G1 G2")
def ddl_statements_fdump(spark, sf_dir):
    """Statements of any length (each script holds a document's whole text
    three times over as an INSERT), by length and digest."""
    st = ddl.statements(FX.fixture(spark, sf_dir, "f_dump"))
    return st.select("script_id", "seq", F.length("stmt").cast("long").alias("n_chars"),
                     F.sha2("stmt", 256).alias("stmt_sha256"), "kind")


@register("ddl_columns_fdump", columns_sql("f_dump"), "G3 G4")
def ddl_columns_fdump(spark, sf_dir):
    return _columns(_log_fdump(spark, sf_dir))


@register("ddl_constraints_fdump", constraints_sql("f_dump"), "G5 G6 G7 G10 G11")
def ddl_constraints_fdump(spark, sf_dir):
    return _constraints(_log_fdump(spark, sf_dir))


@register("ddl_rejects_fdump", f"""WITH {items_sql('f_dump')}
SELECT script_id, seq, item FROM every WHERE rejected
UNION ALL SELECT script_id, seq, sha256(stmt) FROM stk WHERE kind = 'other'""", "G2 G3")
def ddl_rejects_fdump(spark, sf_dir):
    """What is not read: index items, and statements of other kinds (by digest)."""
    st = ddl.split_statements(FX.fixture(spark, sf_dir, "f_dump"))
    other = F.col("stmt")
    items = ddl.rejects(st.where(ddl.classify(other) != "other"))
    rest = st.where(ddl.classify(other) == "other").select("script_id", "seq", F.sha2("stmt", 256).alias("item"))
    return items.unionByName(rest)


def indexes_sql(fixture: str) -> str:
    return f"""WITH {stmts_sql(fixture)}
SELECT script_id, seq, regexp_extract(stmt, {rx(ddl._CI)}, 3) AS table_name,
       coalesce(nullif(regexp_extract(stmt, {rx(ddl._CI)}, 2), ''), 'unnamed_index') AS name,
       to_json({_list_sql(_inside_sql(f"regexp_extract(stmt, {rx(ddl._CI)}, 4)"))}) AS columns,
       regexp_extract(stmt, {rx(ddl._CI)}, 1) <> '' AS is_unique
FROM stk WHERE kind = 'create_index'"""


_IDX_SQL = indexes_sql("f_ddl")


@register("ddl_indexes_fddl", _IDX_SQL, "G12")
def ddl_indexes_fddl(spark, sf_dir):
    log = _log_fddl(spark, sf_dir)
    return log.where(F.col("op") == "create_index").select(
        "script_id", "seq", "table_name", F.col("value").alias("name"), F.to_json("columns").alias("columns"),
        "is_unique")


# --- replayed catalogs ---------------------------------------------------------------

def _cat(log_fn, part: str, infer: bool = True, strict: bool = False):
    def run(spark, sf_dir):
        out = replay.catalog(log_fn(spark, sf_dir), strict=strict, infer=infer)[part]
        return out.withColumns({c: F.to_json(c) for c, t in out.dtypes if t == "array<string>"})
    return run


_FVIEWS, _FDDL, _FLOG = K.script_log_sql("f_views"), K.script_log_sql("f_ddl"), K.flat_log_sql("f_log")

for _part in ["tables", "columns", "relationships"]:
    register(f"catalog_{_part}_fviews", K.part_sql(_FVIEWS, _part, infer=True), "G13 G15 G17 G18 G22 G26 G27")(_cat(_log_fviews, _part))

for _part in ["tables", "columns", "relationships", "indexes", "constraints"]:
    register(f"catalog_{_part}_fddl", K.part_sql(_FDDL, _part, infer=True), "G5 G8 G9 G14 G16 G20 G25 G26 G27")(_cat(_log_fddl, _part))
    register(f"catalog_{_part}_flog", K.part_sql(_FLOG, _part),
             "G5 G8 G9 G12 G14 G16 G17 G18 G19 G21 G22 G23 G24 G25")(_cat(_log_flog, _part, infer=False))


register("catalog_columns_strict_flog", K.part_sql(_FLOG, "columns", strict=True), "G19")(_cat(_log_flog, "columns", infer=False, strict=True))


# --- G26 on F-cat -----------------------------------------------------------------

def _fcat_inferred(spark, sf_dir):
    t = FX.fixture(spark, sf_dir, "f_cat_tables")
    c = FX.fixture(spark, sf_dir, "f_cat_columns")
    targets = t.where("is_primary_key").select(
        F.lit("fcat").alias("script_id"), F.col("pos").alias("table_pos"), "table_name",
        F.col("column_name").alias("pk_column"))
    cand = c.select(F.lit("fcat").alias("script_id"), F.col("table_name").alias("from_table"),
                    F.lit(0).alias("from_pos"), "ordinal", "column_name", "is_foreign_key")
    return replay.infer_foreign_keys(cand, targets)


_INFER_CTES = f"""{FX.cte('f_cat_tables')}, {FX.cte('f_cat_columns')},
c AS (SELECT table_name AS from_table, ordinal, column_name,
             lower(substr(column_name, 1, length(column_name) - 3)) AS stem
      FROM f_cat_columns WHERE ends_with(column_name, '_id') AND NOT is_foreign_key),
j AS (SELECT c.*, t.table_name AS to_table, t.column_name AS pk,
             row_number() OVER (PARTITION BY c.ordinal ORDER BY t.pos) AS rk
      FROM c JOIN f_cat_tables t ON t.is_primary_key
           AND lower(t.table_name) IN (c.stem, c.stem || 's', c.stem || 'es'))"""
_INFER_SQL = f"""WITH {_INFER_CTES}
SELECT from_table, column_name AS from_column, to_table, pk AS to_column,
       'INFERRED_FK' AS relationship_type, ordinal FROM j WHERE rk = 1"""


@register("infer_fk_fcat", _INFER_SQL, "G26")
def infer_fk_fcat(spark, sf_dir):
    return _fcat_inferred(spark, sf_dir).select(
        "from_table", "from_column", "to_table", "to_column", "relationship_type", "ordinal")


_HIER_SQL = f"""WITH RECURSIVE {_INFER_CTES},
e AS (SELECT DISTINCT from_table AS child, to_table AS parent FROM j WHERE rk = 1 AND from_table <> to_table),
names AS (SELECT table_name FROM f_cat_tables UNION SELECT table_name FROM f_cat_columns),
reach(a, b) AS (SELECT parent, child FROM e UNION SELECT reach.a, e.child FROM reach JOIN e ON e.parent = reach.b),
stuck AS (SELECT b FROM reach WHERE a IN (SELECT a FROM reach WHERE a = b)),
lv(table_name, level) AS (
  SELECT table_name, 0 FROM names WHERE table_name NOT IN (SELECT child FROM e)
  UNION ALL SELECT e.child, lv.level + 1 FROM e JOIN lv ON e.parent = lv.table_name
  WHERE e.child NOT IN (SELECT b FROM stuck))
SELECT n.table_name, CAST(max(lv.level) AS BIGINT) AS level, max(lv.level) IS NULL AS in_cycle,
       false AS self_ref
FROM names n LEFT JOIN lv ON lv.table_name = n.table_name GROUP BY n.table_name"""


@register("hierarchy_fcat", _HIER_SQL, "Q6")
def hierarchy_fcat(spark, sf_dir):
    edges = _fcat_inferred(spark, sf_dir).select(F.col("from_table").alias("child"),
                                                 F.col("to_table").alias("parent"))
    names = (FX.fixture(spark, sf_dir, "f_cat_tables").select("table_name")
             .unionByName(FX.fixture(spark, sf_dir, "f_cat_columns").select("table_name")))
    return audit.hierarchy(edges, names)


_CYCLE_SQL = f"""WITH RECURSIVE {FX.cte('f_refs')},
e AS (SELECT DISTINCT child, parent FROM f_refs WHERE child <> parent),
names AS (SELECT child AS table_name FROM f_refs UNION SELECT parent FROM f_refs),
up(a, b) AS (SELECT child, parent FROM e UNION SELECT up.a, e.parent FROM up JOIN e ON e.child = up.b),
scc AS (SELECT x.a AS table_name, min(x.b) AS cycle FROM up x JOIN up y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
size AS (SELECT cycle, count(*) AS cycle_size FROM scc GROUP BY cycle),
stuck AS (SELECT table_name FROM scc UNION SELECT a FROM up WHERE b IN (SELECT table_name FROM scc)),
lv(table_name, level) AS (
  SELECT table_name, 0 FROM names WHERE table_name NOT IN (SELECT child FROM e)
  UNION ALL SELECT e.child, lv.level + 1 FROM e JOIN lv ON e.parent = lv.table_name WHERE e.child NOT IN (SELECT table_name FROM stuck))
SELECT n.table_name, CAST(max(lv.level) AS BIGINT) AS level, n.table_name IN (SELECT child FROM f_refs WHERE child = parent) AS self_ref, any_value(scc.cycle) AS cycle,
       any_value(size.cycle_size) AS cycle_size, max(lv.level) IS NULL AND any_value(scc.cycle) IS NULL AS below_cycle
FROM names n LEFT JOIN lv ON lv.table_name = n.table_name LEFT JOIN scc ON scc.table_name = n.table_name LEFT JOIN size ON size.cycle = scc.cycle GROUP BY n.table_name"""


@register("hierarchy_cycles_frefs", _CYCLE_SQL, "Q6")
def hierarchy_cycles_frefs(spark, sf_dir):
    """Levels, cycles with their members, and tables below cycles."""
    refs = FX.fixture(spark, sf_dir, "f_refs")
    names = refs.select(F.col("child").alias("table_name")).unionByName(refs.select(F.col("parent").alias("table_name")))
    return audit.hierarchy_cycles(refs, names)


# --- M13: PII classes of catalog column names ---------------------------------------

_PII_GROUP_SQL = ("CASE " + " ".join(
    f"WHEN regexp_matches(column_name, {lit(P.ALL_PATTERNS[k])}) THEN {i}"
    for i, k in enumerate(P.NAME_PATTERNS, start=1)) + " END")


def _pii_sql(fixture: str) -> str:
    return f"""WITH {items_sql(fixture)},
cols AS (SELECT script_id, t AS table_name, regexp_extract(item, '^(\\S+)', 1) AS column_name
         FROM its WHERE NOT is_con)
SELECT script_id, table_name, column_name, {_PII_GROUP_SQL} AS pii_group,
       ({_PII_GROUP_SQL}) IS NOT NULL AS is_pii FROM cols"""


@register("pii_columns_fddl", _pii_sql("f_ddl"), "M13")
def pii_columns_fddl(spark, sf_dir):
    cols = ddl_columns_fddl(spark, sf_dir).select("script_id", "table_name", "column_name")
    return pii.pii_columns(cols, "column_name")


@register("pii_columns_fdump", _pii_sql("f_dump"), "M13")
def pii_columns_fdump(spark, sf_dir):
    cols = ddl_columns_fdump(spark, sf_dir).select("script_id", "table_name", "column_name")
    return pii.pii_columns(cols, "column_name")


# --- X10: database-analysis prompt per table (masked, whole analysis) -----------------

_DB_PARTS = {"columns": (_COLS_SQL, ["column_name", "data_type", "nullable", "is_primary_key"], ["seq", "ordinal"]),
             "constraints": (constraints_sql("f_ddl"), ["name", "constraint_type", "columns", "reference_table", "reference_columns"], ["seq", "name"]),
             "indexes": (_IDX_SQL, ["name", "columns", "is_unique"], ["seq", "name"])}


_JSON_TEXT = {"columns", "reference_columns"}


def _field(c: str) -> str:
    """A payload field; JSON lists stay text, as in the Spark rows."""
    return f"{c} := CAST({c} AS VARCHAR)" if c in _JSON_TEXT else f"{c} := {c}"


def _db_prompt_sql() -> str:
    from ..operators import chat
    from . import oracle as O
    before, after = chat.TEMPLATES["database"].split("{payload}")
    ctes, joins, fields = [f"t AS (SELECT DISTINCT script_id, table_name FROM ({_COLS_SQL}) q)"], [], ["table_name := t.table_name"]
    for part, (sql, cols, order) in _DB_PARTS.items():
        ctes.append(f"p_{part} AS (SELECT script_id, table_name, list(struct_pack({', '.join(_field(x) for x in cols)}) "
                    f"ORDER BY {', '.join(order)}) AS l FROM ({sql}) q GROUP BY script_id, table_name)")
        joins.append(f"LEFT JOIN p_{part} ON p_{part}.script_id = t.script_id AND p_{part}.table_name = t.table_name")
        fields.append(f"{part} := coalesce(p_{part}.l, [])")
    payload = O.mask_text_sql(f"CAST(to_json(struct_pack({', '.join(fields)})) AS VARCHAR)")
    return (f"WITH {', '.join(ctes)} SELECT t.script_id, t.table_name, concat({lit(before)}, {payload}, {lit(after)}) AS prompt "
            f"FROM t {' '.join(joins)}")


@register("chat_database_prompt_fddl", _db_prompt_sql(), "X10")
def chat_database_prompt_fddl(spark, sf_dir):
    """One prompt per declared table: columns, constraints (with references) and
    indexes, masked before they go into the prompt. The scripts are read once;
    a table's changes meet in one aggregation, and its payload is bounded by the
    table's definition."""
    from ..functions.masking import mask_text
    from ..operators import chat
    log = _log_fddl(spark, sf_dir)
    declared = F.col("stmt_kind") == "create_table"
    fields = {"columns": ((F.col("op") == "add_column") & declared, [F.col("column_name"), F.col("data_type"), F.col("nullable"), F.col("is_primary_key")], ["seq", "sub"]),
              "constraints": ((F.col("op") == "add_constraint") & declared,
                              [F.col("value").alias("name"), F.col("constraint_type"), F.to_json("columns").alias("columns"), F.col("reference_table"),
                               F.to_json("reference_columns").alias("reference_columns")], ["seq", "value"]),
              "indexes": (F.col("op") == "create_index", [F.col("value").alias("name"), F.to_json("columns").alias("columns"), F.col("is_unique")], ["seq", "value"])}
    items = [F.collect_list(F.when(which, F.struct(*order, F.struct(*cols).alias("v")))).alias(part) for part, (which, cols, order) in fields.items()]
    out = (log.where(F.col("op").isin("add_column", "add_constraint", "create_index")).groupBy("script_id", "table_name").agg(*items).where(F.size("columns") > 0)
           .select("script_id", "table_name", *[F.transform(F.array_sort(part), lambda x: x["v"]).alias(part) for part in fields]))
    payload = F.to_json(F.struct("table_name", *fields), {"ignoreNullFields": "false"})
    return out.select("script_id", "table_name", chat.render_prompt("database", mask_text(payload)).alias("prompt"))


@register("ddl_statements_fviews", f"WITH {stmts_sql('f_views')} SELECT script_id, seq, stmt, kind FROM stk", "G1 G2 G13")
def ddl_statements_fviews(spark, sf_dir):
    return ddl.statements(FX.fixture(spark, sf_dir, "f_views"))


@register("pii_columns_catalog_fviews", f"""SELECT script_id, table_name, name, {_PII_GROUP_SQL.replace('column_name', 'name')} AS pii_group,
       ({_PII_GROUP_SQL.replace('column_name', 'name')}) IS NOT NULL AS is_pii FROM ({K.part_sql(_FVIEWS, 'columns')})""", "M13 G22")
def pii_columns_catalog_fviews(spark, sf_dir):
    """PII classes of the replayed catalog's column names (renames applied)."""
    cols = replay.catalog(_log_fviews(spark, sf_dir), infer=False)["columns"]
    return pii.pii_columns(cols.select("script_id", "table_name", "name"), "name")
