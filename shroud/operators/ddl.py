"""DDL scripts -> statements -> typed change log (G1–G13, G20 extraction).

A documented DDL subset is read with native regex, one statement per row
(no SQL grammar): CREATE TABLE / INDEX / [MATERIALIZED] VIEW / SCHEMA,
ALTER TABLE (ADD COLUMN, ADD CONSTRAINT, DROP CONSTRAINT, DROP COLUMN,
RENAME COLUMN, ALTER COLUMN SET/DROP NOT NULL, SET/DROP DEFAULT), DROP
TABLE/VIEW, TRUNCATE. Anything else is classified ``other`` and kept in the
statements output (rejects), never silently lost.

The change log has one row per change: ``(script_id, seq, sub, op,
table_name, column_name, value, data_type, nullable, is_primary_key,
constraint_type, columns, reference_table, reference_columns, is_unique)``.
``seq`` is the statement number, ``sub`` orders the changes one statement
makes (a CREATE TABLE: the table, then its columns, then its constraints).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltypes import normalize_type

# The patterns are written with possessive quantifiers: java.util.regex recurses
# once per repetition of an ordinary group and would overflow its stack on long
# statements. ``re2`` gives the form for RE2 (DuckDB), which has no such limit.
def re2(pattern: str) -> str:
    return pattern.replace("++", "+").replace("*+", "*")


QUOTED = r"'(?:[^'\\]++|\\[\s\S]|'')*+'"
BACKTICKED = r"`[^`]*+`"
# Outside quotes: '-- ...', '# ...' and '/* ... */' (group 1 keeps the quoted text).
COMMENT = rf"({QUOTED}|{BACKTICKED})|--[^\n]*+|#[^\n]*+|/\*[\s\S]*?\*/"
BACKTICK = rf"({QUOTED})|`"
# Statement tokens: runs of non-separators; quoted strings, backtick
# identifiers and backslash escapes may contain ';'.
STATEMENT_TOKEN = rf"((?:[^;'`\\]++|\\[\s\S]|{QUOTED}|{BACKTICKED})++)"
MAX_DEPTH = 9


def _parens(depth: int) -> str:
    """Balanced parentheses, nested up to ``depth``; quotes may hold others."""
    inner = f"|{_parens(depth - 1)}" if depth > 1 else ""
    return rf"\((?:[^()']++|{QUOTED}{inner})*+\)"


PARENS = _parens(MAX_DEPTH)
# Depth-0 comma items. What is nested deeper has its inner parentheses replaced
# while it is read (see ``shallow``).
LIST_ITEM = rf"((?:[^,()']++|{QUOTED}|{PARENS})++)"

_TABLE_HEAD = (r"(?is)^CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?TABLE\s+"
               r"(?:IF\s+NOT\s+EXISTS\s+)?([^\s(]+)")
_CT = rf"{_TABLE_HEAD}\s*(?:({PARENS})|\s(?:AS|LIKE)\b)"
_CI = (r"(?is)^CREATE\s+(UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:([^\s(]+)\s+)?"
       rf"ON\s+([^\s(]+)\s*(?:USING\s+\S+\s*)?({PARENS})")
_CV = (r"(?is)^CREATE\s+(?:OR\s+REPLACE\s+)?(MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?"
       r"([^\s(]+)\s*(?:\(([^)]*)\))?\s*AS\s")
_CS = r"(?is)^CREATE\s+SCHEMA\s+(?:IF\s+NOT\s+EXISTS\s+)?(\S+)"
_AT = r"(?is)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?(\S+)\s+(.*)$"
_DR = r"(?is)^DROP\s+(TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?(.+?)(?:\s+(?:CASCADE|RESTRICT))?\s*$"
_TR = r"(?is)^TRUNCATE\s+(?:TABLE\s+)?(\S+)"

_TABLE_CONSTRAINT = r"(?i)^(?:CONSTRAINT\s+\S+\s+)?(PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK)\b"
_COL_KEYWORDS = (r"NOT\s+NULL|NULL|DEFAULT|PRIMARY\s+KEY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|"
                 r"AUTO_INCREMENT|AUTOINCREMENT|COLLATE|GENERATED")
# What a definition says outside its parentheses and quotes.
_INSIDE = rf"{QUOTED}|{PARENS}"
# List items that are neither columns nor constraints.
_INDEX_ITEM = r"(?i)^(?:(?:FULLTEXT|SPATIAL)\s+(?:KEY|INDEX)|KEY|INDEX)\b"
_UNIQUE_LIST = r"(?is)UNIQUE(?:\s+(?:KEY|INDEX))?\s*([^\s(]+)?\s*\(([^)]*)\)"
_DEFAULT = rf"(?is)\bDEFAULT\s+('(?:[^']|'')*+'|{PARENS}|[^\s,]+(?:\([^()]*+\))?)"
_CHECK = rf"(?is)CHECK\s*({PARENS})"
_ACTION = r"(CASCADE|SET\s+NULL|SET\s+DEFAULT|RESTRICT|NO\s+ACTION)"

# Names given to unnamed objects.
UNNAMED = {"PRIMARY KEY": "unnamed_pk", "UNIQUE": "unnamed_unique", "FOREIGN KEY": "unnamed_fk",
           "CHECK": "unnamed_check", "INDEX": "unnamed_index"}
INDEX_TYPE = "BTREE"

# Words that are not column references inside a CHECK expression.
EXPR_KEYWORDS = ["AND", "OR", "NOT", "IN", "IS", "NULL", "BETWEEN", "LIKE", "ILIKE", "CASE",
                 "WHEN", "THEN", "ELSE", "END", "CAST", "AS", "TRUE", "FALSE", "EXISTS",
                 "ESCAPE", "SIMILAR", "TO", "DISTINCT", "FROM"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _ws(c: Column) -> Column:
    """Collapse runs of whitespace to one space and upper-case."""
    return F.upper(F.regexp_replace(c, r"\s+", " "))


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _held(col: Column) -> Column:
    """``col``, evaluated once per row where it is defined: the (always true)
    partition test keeps the optimizer from putting the expression in place of
    each use, which would parse a list anew for each of its elements."""
    return F.when(F.spark_partition_id() >= 0, col)


def _once(value: Column, body) -> Column:
    """``body(value)``, where ``value`` is evaluated once for all of its uses: an
    expression below a lambda function is evaluated anew at each of them."""
    return F.transform(F.array(value), body)[0]


def _inside(c: Column) -> Column:
    """The text between a text's outer parentheses (empty for an empty text)."""
    return F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))


def balanced(item: Column) -> Column:
    """False for a text whose parentheses do not match."""
    bare = F.regexp_replace(item, QUOTED, "")
    return F.regexp_count(bare, F.lit(r"\(")) == F.regexp_count(bare, F.lit(r"\)"))


def too_deep(text: Column) -> Column:
    """True for a text with parentheses that :data:`PARENS` does not cover."""
    return F.regexp_replace(F.regexp_replace(text, PARENS, ""), QUOTED, "").rlike(r"[()]")


#: Stand for parentheses that are nested too deep for the patterns (private-use signs).
_OPEN, _CLOSE = "\ue000", "\ue001"
_PAREN_TOKEN = rf"({QUOTED}|[()]|[^()']++|')"


def shallow(text: Column) -> Column:
    """``text`` with the parentheses replaced that are nested too deep for
    :data:`PARENS`; :func:`deep` puts them back. Only a CREATE or ALTER that has
    such parentheses is walked, token by token with the depth as a running sum."""
    def step(a: Column, t: Column) -> Column:
        after = a["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        kept = F.when((t == "(") & (after > MAX_DEPTH), _OPEN).when((t == ")") & (a["depth"] > MAX_DEPTH), _CLOSE).otherwise(t)
        return F.struct(after.alias("depth"), F.array_append(a["out"], kept).alias("out"))

    tokens = F.regexp_extract_all(text, F.lit(_PAREN_TOKEN), 1)
    walked = F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out")), step)["out"]
    return F.when(text.rlike(r"(?i)^(CREATE|ALTER)\s") & too_deep(text), F.array_join(walked, "")).otherwise(text)


def deep(text: Column) -> Column:
    return F.translate(text, _OPEN + _CLOSE, "()")


def split_list(c: Column) -> Column:
    """Depth-0 comma split, items trimmed, empties dropped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(LIST_ITEM), 1), lambda x: _strip(x)),
                    lambda x: x != "")


def clean(stmt: Column) -> Column:
    """A statement's text without comments, identifiers' backticks and outer white space."""
    return _strip(F.regexp_replace(F.regexp_replace(stmt, COMMENT, "$1"), BACKTICK, "$1"))


def split_statements(scripts: DataFrame, key: str = "script_id", content: str = "content") -> DataFrame:
    """G1: (script_id, seq 1-based, stmt). ';' inside quotes/backticks does not
    split; comments and the backticks of identifiers are removed."""
    plain = F.regexp_replace(F.col(content), COMMENT, "$1")
    toks = F.filter(F.transform(F.regexp_extract_all(plain, F.lit(STATEMENT_TOKEN), 1),
                                lambda x: _strip(F.regexp_replace(x, BACKTICK, "$1"))), lambda x: x != "")
    return (scripts.select(key, F.posexplode(toks).alias("pos", "stmt"))
            .select(key, (F.col("pos") + 1).cast("long").alias("seq"), "stmt"))


def classify(stmt: Column) -> Column:
    """Statement kind."""
    rules = [(_CT, "create_table"), (_CI, "create_index"), (_CV, "create_view"),
             (_CS, "create_schema"), (_AT, "alter_table"), (_DR, "drop"), (_TR, "truncate")]
    out = F.lit("other")
    for pat, name in reversed(rules):
        out = F.when(stmt.rlike(pat), F.lit(name)).otherwise(out)
    return out


def expr_columns(expr: Column) -> Column:
    """Identifiers referenced by an expression (last part of dotted names),
    in order, duplicates kept; string literals and function calls removed."""
    e = F.regexp_replace(expr, r"'[^']*'", "0")
    e = F.regexp_replace(e, r"(?i)\b(and|or|not|in)\s*\(", "$1 , (")
    for _ in range(3):  # calls, the innermost first
        e = F.regexp_replace(e, r"\b[A-Za-z_][A-Za-z0-9_]*\s*\([^()]*\)", "0")
    ids = F.regexp_extract_all(e, F.lit(r"\b(?:[A-Za-z_][A-Za-z0-9_]*\.)*([A-Za-z_][A-Za-z0-9_]*)\b"), 1)
    kw = F.array(*[F.lit(k) for k in EXPR_KEYWORDS])
    return F.filter(ids, lambda x: ~F.array_contains(kw, F.upper(x)))


def _ident_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: _strip(x)), lambda x: x != "")


def _column_text(item: Column) -> Column:
    """What the fields of one column definition are read from."""
    rest = F.regexp_extract(item, r"(?s)^\S+\s*(.*)$", 1)
    raw_type = F.regexp_extract(rest, rf"(?is)^(.*?)(?:\s+(?:{_COL_KEYWORDS})\b.*)?$", 1)
    return F.struct(item.alias("item"), F.regexp_replace(item, _INSIDE, "()").alias("said"), _strip(raw_type).alias("raw_type"))


def _column_fields(text: Column) -> dict[str, Column]:
    item, said = text["item"], text["said"]
    default = F.when(said.rlike(r"(?i)\bDEFAULT\b"), F.regexp_extract(item, _DEFAULT, 1))
    return {
        "column_name": F.regexp_extract(item, r"^(\S+)", 1),
        "raw_type": text["raw_type"],
        "data_type": normalize_type(text["raw_type"]),
        "nullable": ~said.rlike(r"(?i)\bNOT\s+NULL\b"),
        "value": _nz(default),
        "is_primary_key": said.rlike(r"(?i)\bPRIMARY\s+KEY\b"),
    }


def column_def(item: Column) -> dict[str, Column]:
    """G3 fields of one column definition text."""
    return _column_fields(_column_text(item))


def _constraint_text(item: Column) -> Column:
    """What the fields of one table constraint are read from."""
    return F.struct(item.alias("item"), _ws(F.regexp_extract(item, _TABLE_CONSTRAINT, 1)).alias("kind"))


def _constraint_fields(text: Column) -> dict[str, Column]:
    item, kind = text["item"], text["kind"]
    name = F.coalesce(_nz(F.regexp_extract(item, r"(?i)^CONSTRAINT\s+(\S+)", 1)),
                      F.when(kind == "UNIQUE", _nz(F.regexp_extract(item, _UNIQUE_LIST, 1))))
    pk_cols = _ident_list(F.regexp_extract(item, r"(?i)PRIMARY\s+KEY\s*\(([^)]*)\)", 1))
    uq_cols = _ident_list(F.regexp_extract(item, _UNIQUE_LIST, 2))
    fk = r"(?is)FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+([^\s(]+)\s*\(([^)]*)\)"
    fk_cols = _ident_list(F.regexp_extract(item, fk, 1))
    on_del = _nz(_ws(F.regexp_extract(item, rf"(?i)ON\s+DELETE\s+{_ACTION}", 1)))
    on_upd = _nz(_ws(F.regexp_extract(item, rf"(?i)ON\s+UPDATE\s+{_ACTION}", 1)))
    check = _inside(F.regexp_extract(item, _CHECK, 1))
    ctype = F.when(kind == "FOREIGN KEY", F.concat_ws(
        " ", F.lit("FOREIGN KEY"), F.when(on_del.isNotNull(), F.concat(F.lit("ON DELETE "), on_del)),
        F.when(on_upd.isNotNull(), F.concat(F.lit("ON UPDATE "), on_upd)))).otherwise(kind)
    unnamed = F.create_map(*[x for k, v in UNNAMED.items() for x in (F.lit(k), F.lit(v))])
    return {
        "value": F.coalesce(name, unnamed[kind]),
        "constraint_type": ctype,
        "columns": (F.when(kind == "PRIMARY KEY", pk_cols).when(kind == "UNIQUE", uq_cols)
                    .when(kind == "FOREIGN KEY", fk_cols).otherwise(expr_columns(check))),
        "reference_table": F.when(kind == "FOREIGN KEY", _nz(F.regexp_extract(item, fk, 2))),
        "reference_columns": F.when(kind == "FOREIGN KEY", _ident_list(F.regexp_extract(item, fk, 3))),
        "check_expr": F.when(kind == "CHECK", check),
    }


def table_constraint(item: Column) -> dict[str, Column]:
    """G5–G7, G10 fields of one table-constraint text."""
    return _constraint_fields(_constraint_text(item))


LOG_COLUMNS = ["script_id", "seq", "sub", "op", "table_name", "column_name", "value", "data_type",
               "nullable", "is_primary_key", "constraint_type", "columns", "reference_table",
               "reference_columns", "is_unique", "stmt_kind"]

_NULLS = {"column_name": "string", "value": "string", "data_type": "string", "nullable": "boolean",
          "is_primary_key": "boolean", "constraint_type": "string", "columns": "array<string>",
          "reference_table": "string", "reference_columns": "array<string>", "is_unique": "boolean"}
_CHANGE_TYPE = ("struct<sub:bigint,op:string,table_name:string," +
                ",".join(f"{k}:{v}" for k, v in _NULLS.items()) + ">")


def _mk(op, sub, table, **cols) -> Column:
    """One change as a struct (fields in log order, script_id/seq added later)."""
    fields = [F.lit(sub).cast("long").alias("sub") if not isinstance(sub, Column) else sub.cast("long").alias("sub"),
              (op if isinstance(op, Column) else F.lit(op)).alias("op"),
              table.cast("string").alias("table_name")]
    for name, t in _NULLS.items():
        fields.append((cols[name] if name in cols else F.lit(None)).cast(t).alias(name))
    return F.struct(*fields)


def _no_raw(d: dict) -> dict:
    return {k: v for k, v in d.items() if k not in ("raw_type", "check_expr")}


def _add_column(sub, table: Column, item: Column) -> Column:
    return _once(_column_text(item), lambda x: _mk("add_column", sub, table, **_no_raw(_column_fields(x))))


def _add_constraint(sub, table: Column, item: Column) -> Column:
    return _once(_constraint_text(item), lambda x: _mk("add_constraint", sub, table, **_no_raw(_constraint_fields(x))))


def _alter_change(a: Column, i: Column, t: Column) -> Column:
    """One ALTER TABLE operation -> change struct (NULL when not understood)."""
    add_con = r"(?is)^ADD\s+((?:CONSTRAINT\s+\S+\s+)?(?:PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK)\b.*)$"
    add_col = r"(?is)^ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(.*)$"
    drop_con = r"(?is)^DROP\s+CONSTRAINT\s+(?:IF\s+EXISTS\s+)?(\S+)"
    drop_col = r"(?is)^DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?(\S+)"
    alter = r"(?is)^ALTER\s+(?:COLUMN\s+)?(\S+)\s+"
    sd = alter + r"SET\s+DEFAULT\s+(.*?)\s*$"
    rn = r"(?is)^RENAME\s+COLUMN\s+(\S+)\s+TO\s+(\S+)\s*$"
    ex = lambda p, g=1: F.regexp_extract(a, p, g)
    simple = {"set_not_null": alter + r"SET\s+NOT\s+NULL\s*$",
              "drop_not_null": alter + r"DROP\s+NOT\s+NULL\s*$",
              "drop_default": alter + r"DROP\s+DEFAULT\s*$"}
    index = r"(?is)^ADD\s+(?:(?:UNIQUE|FULLTEXT|SPATIAL)\s+)?(?:KEY|INDEX)\b"
    out = (F.when(a.rlike(index), F.lit(None).cast(_CHANGE_TYPE))
           .when(a.rlike(add_con), _add_constraint(i, t, ex(add_con)))
           .when(a.rlike(drop_con), _mk("drop_constraint", i, t, value=ex(drop_con)))
           .when(a.rlike(drop_col), _mk("drop_column", i, t, column_name=ex(drop_col)))
           .when(a.rlike(rn), _mk("rename_column", i, t, column_name=ex(rn), value=ex(rn, 2)))
           .when(a.rlike(sd), _mk("set_default", i, t, column_name=ex(sd), value=ex(sd, 2))))
    for op, pat in simple.items():
        out = out.when(a.rlike(pat), _mk(op, i, t, column_name=ex(pat)))
    return out.when(a.rlike(add_col), _add_column(i, t, ex(add_col)))


def list_items(st: Column) -> Column:
    """The items of a CREATE TABLE's list: struct(pos, item, is_con, rejected)."""
    return F.transform(split_list(_inside(F.regexp_extract(st, _CT, 2))), lambda x, i: F.struct(
        (i + 1).alias("pos"), x.alias("item"), x.rlike(_TABLE_CONSTRAINT).alias("is_con"),
        (x.rlike(_INDEX_ITEM) | ~balanced(x)).alias("rejected")))


def table_items(st: Column) -> Column:
    """Those of :func:`list_items` that are columns or constraints."""
    return F.filter(list_items(st), lambda x: ~x["rejected"])


def rejects(stmts: DataFrame) -> DataFrame:
    """(script_id, seq, item): statements of no known kind, and list items that
    are neither column nor constraint or whose parentheses do not match."""
    st = F.col("stmt")
    kept = stmts.select("script_id", "seq", _held(shallow(st)).alias("stmt")).withColumn("kind", classify(st))
    items = F.transform(F.filter(list_items(st), lambda x: x["rejected"]), lambda x: x["item"])
    return kept.select("script_id", "seq", F.explode(F.when(F.col("kind") == "create_table", items).when(
        (F.col("kind") == "other") | ((F.col("kind") == "alter_table") & too_deep(st)), F.array(st)).otherwise(F.array().cast("array<string>"))).alias("item")).withColumn("item", deep(F.col("item")))


def change_log(stmts: DataFrame) -> DataFrame:
    """G2–G13, G18–G24 extraction: statements -> typed change log.

    One pass: every statement yields an array of change structs which is
    exploded once (no per-kind scans or unions)."""
    st = F.col("stmt")
    # classify and cut lists once; the branches below reference the columns
    stmts = stmts.withColumn("stmt", _held(shallow(st))).withColumn("_kind", _held(classify(st)))
    kind = F.col("_kind")
    stmts = stmts.where(kind != "other").withColumn("_items", _held(F.when(kind == "create_table", table_items(st))))
    # the lists' length and the table's name, which every change of a statement has
    names = F.when(kind == "create_table", F.regexp_extract(st, _CT, 1)).when(kind == "alter_table", F.regexp_extract(st, _AT, 1))
    stmts = stmts.withColumn("_n", _held(F.size("_items"))).withColumn("_table", _held(names.when(kind == "create_view", F.regexp_extract(st, _CV, 2))))
    empty = F.array().cast(f"array<{_CHANGE_TYPE}>")

    # CREATE TABLE: the table, its columns (in order), then its table constraints
    table, items = F.col("_table"), F.col("_items")
    ct = F.concat(
        F.array(_mk("create_table", 0, table)),
        F.transform(F.filter(items, lambda x: ~x["is_con"]),
                    lambda x: _add_column(x["pos"], table, x["item"])),
        F.transform(F.filter(items, lambda x: x["is_con"]),
                    lambda x: _add_constraint(x["pos"] + F.col("_n"), table, x["item"])))  # behind all columns
    ci = F.array(_mk("create_index", 0, F.regexp_extract(st, _CI, 3),
                     value=F.coalesce(_nz(F.regexp_extract(st, _CI, 2)), F.lit(UNNAMED["INDEX"])),
                     columns=split_list(_inside(F.regexp_extract(st, _CI, 4))),
                     is_unique=F.regexp_extract(st, _CI, 1) != ""))
    vt = F.when(F.regexp_extract(st, _CV, 1) != "", F.lit("MATERIALIZED VIEW")).otherwise(F.lit("VIEW"))
    cv = F.concat(F.array(_mk("create_view", 0, table, value=vt)),
                  F.transform(_ident_list(F.regexp_extract(st, _CV, 3)),
                              lambda c, i: _mk("add_column", i + 1, table, column_name=c,
                                               data_type=F.lit("UNKNOWN"), nullable=F.lit(True),
                                               is_primary_key=F.lit(False))))
    cs = F.array(_mk("create_schema", 0, F.lit(None), value=F.regexp_extract(st, _CS, 1)))
    tr = F.array(_mk("truncate", 0, F.regexp_extract(st, _TR, 1)))
    dop = F.when(F.upper(F.regexp_extract(st, _DR, 1)) == "VIEW", F.lit("drop_view")).otherwise(F.lit("drop_table"))
    dr = F.transform(_ident_list(F.regexp_extract(st, _DR, 2)), lambda n, i: _mk(dop, i, n))
    at = F.filter(F.transform(split_list(F.regexp_extract(st, _AT, 2)),
                              lambda a, i: _alter_change(a, i, table)), lambda c: c.isNotNull())
    changes = (F.when(kind == "create_table", ct).when(kind == "create_index", ci)
               .when(kind == "create_view", cv).when(kind == "create_schema", cs)
               .when(kind == "truncate", tr).when(kind == "drop", dr)
               .when((kind == "alter_table") & ~too_deep(st), at).otherwise(empty))
    return (stmts.select(F.col("script_id").cast("string").alias("script_id"),
                         F.col("seq").cast("long").alias("seq"), F.col("_kind").alias("stmt_kind"),
                         F.explode(changes).alias("c"))
            .select("script_id", "seq", "c.*", "stmt_kind").withColumn("value", deep(F.col("value"))))


def statements(scripts: DataFrame) -> DataFrame:
    """G1 + G2: (script_id, seq, stmt, kind); kind 'other' rows are the rejects."""
    st = split_statements(scripts)
    return st.withColumn("_shallow", _held(shallow(F.col("stmt")))).withColumn("kind", classify(F.col("_shallow"))).drop("_shallow")


def flat_log(events: DataFrame) -> DataFrame:
    """A flat change feed -> typed change log.

    Input: ``(script_id, seq, op, table_name, column_name, value,
    constraint_type, reference_table)``. ``value`` holds, by op: the type of a
    created table's first column or of an added column, the new name
    (rename_column), the default (set_default), the schema name
    (create_schema), the index or constraint name (create_index,
    add_constraint, drop_constraint). Single-column constraints and indexes
    apply to ``column_name``; a foreign key references the same column name
    in ``reference_table``."""
    e = events.withColumn("script_id", F.col("script_id").cast("string"))
    op, col = F.col("op"), F.col("column_name")
    is_fk = F.col("constraint_type").startswith("FOREIGN KEY")
    created = _mk("add_column", F.lit(1), F.col("table_name"),
                  column_name=col, data_type=normalize_type(F.col("value")),
                  nullable=F.lit(True), is_primary_key=F.lit(False))
    main = _mk(
        op, F.lit(0), F.when(op != "create_schema", F.col("table_name")),
        column_name=F.when(op != "create_table", col),
        value=F.when(op.isin("add_column", "create_table"), F.lit(None)).otherwise(F.col("value")),
        data_type=F.when(op == "add_column", normalize_type(F.col("value"))),
        nullable=F.when(op == "add_column", F.lit(True)),
        is_primary_key=F.when(op == "add_column", F.lit(False)),
        constraint_type=F.when(op == "add_constraint", F.col("constraint_type")),
        columns=F.when(op.isin("add_constraint", "create_index"), F.array(col)),
        reference_table=F.when((op == "add_constraint") & is_fk, F.col("reference_table")),
        reference_columns=F.when((op == "add_constraint") & is_fk, F.array(col)),
        is_unique=F.when(op == "create_index", F.lit(False)))
    # one pass: a created table also gets its first column (sub 1)
    changes = F.when(op == "create_table", F.array(main, created)).otherwise(F.array(main))
    return (e.select("script_id", F.col("seq").cast("long").alias("seq"), F.explode(changes).alias("c"))
            .select("script_id", "seq", "c.*", F.lit(None).cast("string").alias("stmt_kind")))
