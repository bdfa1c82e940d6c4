"""Code-corpus mining over ``(path, content)`` rows.

Facts are arrays on the file's own row, built with native regex and
higher-order functions and exploded at the end: nothing is shuffled before the
dependency edges and the corpus report. One small helper runs in Python: the
indentation walk that gives every logical line its parent and every block its
last line (a stack over a file's lines — linear, but not expressible with
built-in functions without quadratic array rebuilding). It is an Arrow-batched
pandas UDF over the ``content`` column: each file is already one row, so no
group is ever collected.

Regex facts see code inside strings and comments too; they are not an AST
(see README). Functions, classes and assignments are read from logical lines
(continuation lines joined, comments cut).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

# ---------------------------------------------------------------------------
# Fixed values (must match the reference's behaviour).
W = r"[\p{L}\p{N}_]"                       # Python's Unicode \w, portable form
SQL_PATTERNS = [                           # per line, in this order
    rf"(?is)SELECT\s+.*?FROM\s+{W}+",
    rf"(?i)INSERT\s+INTO\s+{W}+",
    rf"(?i)UPDATE\s+{W}+\s+SET",
    rf"(?i)DELETE\s+FROM\s+{W}+",
    rf"(?i)CREATE\s+TABLE\s+{W}+",
    rf"(?i)DROP\s+TABLE\s+{W}+",
]
SQL_TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE", "UNKNOWN", "UNKNOWN"]
DATA_LIBS = ["pandas", "pd", "numpy", "np", "spark", "pyspark"]
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE"]
KIND_BY_EXT = {".py": "python", ".sql": "sql", ".js": "javascript", ".ts": "javascript"}
PY_KEYWORDS = ["and", "as", "assert", "async", "await", "del", "elif", "else", "except",
               "for", "from", "if", "import", "in", "is", "lambda", "not", "or", "pass",
               "raise", "return", "while", "with", "yield", "print"]
# ---------------------------------------------------------------------------

# a leading dot: called on another call's result. The look-behind and the possessive
# run keep a long word from being tried at each of its characters; RE2 needs neither.
CALL_RE2 = r"(\.?[\p{L}\p{N}_][\p{L}\p{N}_.]*)\s*\("
CALL_RE = r"(?<![\p{L}\p{N}_.])(\.?[\p{L}\p{N}_][\p{L}\p{N}_.]*+)\s*\("
# Possessive runs: java.util.regex would recurse once per character of an
# alternation under *. ``re2`` in ddl.py gives the form for RE2.
_STR = r"\"(?:[^\"\\]++|\\[\s\S])*+\"|'(?:[^'\\]++|\\[\s\S])*+'"
STRING_RE = rf"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|{_STR}"


# What is not code: string literals and comments.
NOT_CODE = rf"{STRING_RE}|#[^\n]*"


def _brackets(depth: int) -> str:
    """Balanced brackets of any kind, nested up to ``depth``."""
    inner = f"|{_brackets(depth - 1)}" if depth > 1 else ""
    return rf"[(\[{{](?:[^()\[\]{{}}\"']++|{_STR}{inner})*+[)\]}}]"


BRACKETS = _brackets(6)
ARGUMENT = rf"((?:[^,()\[\]{{}}\"']++|{_STR}|{BRACKETS})++)"
# the name never depends on what follows it
DEF_NAME = r"^\s*def\s+([\p{L}\p{N}_]+)"
DEF_RE = rf"^\s*def\s+[\p{{L}}\p{{N}}_]+\s*({BRACKETS})\s*(?:->\s*([\s\S]*?))?\s*:(?:\s|$)"
KEYWORD_ITEM = r"^[\p{L}\p{N}_]+\s*="                       # metaclass=M is no base
CLASS_NAME = r"^\s*class\s+([\p{L}\p{N}_]+)"
CLASS_RE = rf"^\s*class\s+[\p{{L}}\p{{N}}_]+\s*({BRACKETS})"
DATA_OP_RE = r"^\s*([^=]+?)\s*=(?!=)\s*([\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)+)\s*\("


def file_kind(path: Column) -> Column:
    """S3: route by extension (case-sensitive): python, sql, javascript, else generic."""
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    out = F.lit("generic")
    for e, k in reversed(list(KIND_BY_EXT.items())):
        out = F.when(ext == e, F.lit(k)).otherwise(out)
    return out


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _inside(c: Column) -> Column:
    """The text between a text's outer brackets."""
    return F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))


def _items(c: Column) -> Column:
    """Depth-0 comma split, items trimmed, empties dropped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(ARGUMENT), F.lit(1)), lambda x: _strip(x)), lambda x: x != "")


def file_metrics(files: DataFrame, *keep: str) -> DataFrame:
    """C1, C8, C9, C20, C21 per file, with no shuffle (array functions per row);
    columns of ``keep`` go along.

    Python files get line, comment, def, class, import counts and branch
    complexity; other files get their line count only; NULL content gives an
    error row instead of metrics."""
    lines = F.split(F.col("content"), "\n", -1)
    py = F.col("kind") == "python"

    def count(pred) -> Column:
        return F.size(F.filter(lines, pred)).cast("long")

    def when_py(c: Column) -> Column:
        return F.when(py & F.col("content").isNotNull(), c)

    comment = lambda l: _strip(l).startswith("#")
    # branches are counted in the code without its strings and comments
    code = F.col("_code")
    branches = F.size(F.filter(F.split(code, "\n", -1), lambda l: l.rlike(
        r"^\s*(if|elif|while|for|async\s+for|except|with)\b"))).cast("long")
    comp = (F.regexp_count(code, F.lit(r"\S[ \t]+for[ \t]")) - F.regexp_count(code, F.lit(r"async[ \t]+for[ \t]")))
    return files.withColumns({"kind": file_kind(F.col("path")), "_code": F.regexp_replace("content", NOT_CODE, "_")}).select(
        "path", "kind",
        F.when(F.col("content").isNotNull(), F.size(lines).cast("long")).alias("total_lines"),
        when_py(count(lambda l: (_strip(l) != "") & ~comment(l))).alias("lines_of_code"),
        when_py(count(comment)).alias("comment_lines"),
        when_py(count(lambda l: l.rlike(r"^\s*def\s"))).alias("function_count"),
        when_py(count(lambda l: l.rlike(r"^\s*class\s"))).alias("class_count"),
        when_py(count(lambda l: l.rlike(r"^\s*(import\s|from\s+\S+\s+import\b)"))).alias("import_count"),
        when_py(F.lit(1) + branches + comp).cast("long").alias("cyclomatic_complexity"),
        F.when(F.col("content").isNull(), F.lit("unreadable content")).alias("error"), *keep)


def code_lines(files: DataFrame) -> DataFrame:
    """(path, kind, line_no, text, stripped, indent)."""
    return (files.select("path", file_kind(F.col("path")).alias("kind"),
                         F.posexplode(F.split(F.col("content"), "\n", -1)).alias("pos", "text"))
            .select("path", "kind", (F.col("pos") + 1).alias("line_no"), "text",
                    _strip(F.col("text")).alias("stripped"),
                    F.length(F.regexp_extract("text", r"^([ \t]*)", 1)).alias("indent")))


def fragment_facts(content: Column) -> Column:
    """C2–C4 of one file: array of struct(line_no, pattern_no, match_no, query,
    query_type, table_name, context) in order of line, pattern, match."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), lambda t, i: F.struct((i + 1).alias("line_no"), t.alias("text"))),
                     lambda x: x["text"].rlike(r"(?i)select|insert|update|delete|create|drop"))

    def one(x: Column, k: int) -> Column:
        table = rf"(?i)^UPDATE\s+({W}+)" if k == 2 else rf"({W}+)$"
        return F.transform(F.regexp_extract_all(x["text"], F.lit(SQL_PATTERNS[k]), 0), lambda q, i: F.struct(
            x["line_no"].alias("line_no"), F.lit(k + 1).alias("pattern_no"), (i + 1).alias("match_no"), _strip(q).alias("query"),
            F.lit(SQL_TYPES[k]).alias("query_type"), F.regexp_extract(q, table, 1).alias("table_name"), _strip(x["text"]).alias("context")))

    return F.flatten(F.transform(lines, lambda x: F.flatten(F.array(*[one(x, k) for k in range(len(SQL_PATTERNS))]))))


def sql_fragments(files: DataFrame) -> DataFrame:
    """SQL fragments found per line of Python files.

    Row per match: (path, line_no, pattern_no, match_no, query, query_type,
    table_name, context); order is line, pattern, match."""
    return _python(files).select("path", F.inline(fragment_facts(F.col("content"))))


def _python(files: DataFrame) -> DataFrame:
    return files.where(file_kind(F.col("path")) == "python")


IMPORT_LINE = r"^\s*(?:import|from)\s"
PLAIN_IMPORT = r"^\s*import\s+([\s\S]*)$"
FROM_IMPORT = r"^\s*from\s+\.*([\p{L}\p{N}_.]*)\s+import\s*(?:\(([^)]*)|([^\n]*))"
OPEN_LIST = r"import\s*\([^)]*$"


def import_facts(content: Column) -> Column:
    """C5, C6 of one file: array of struct(line_no, module, names, alias), one
    per ``import a as b`` alias and per ``from m import x, y``. A list in
    parentheses may go on over further lines; comments are cut."""
    ls = F.split(content, "\n", -1)
    found = F.filter(F.transform(ls, lambda t, i: F.struct((i + 1).alias("line_no"), t.alias("text"))),
                     lambda x: x["text"].rlike(IMPORT_LINE))
    whole = F.transform(found, lambda x: F.struct(x["line_no"].alias("line_no"), F.regexp_replace(
        F.when(x["text"].rlike(OPEN_LIST), F.array_join(F.slice(ls, x["line_no"], F.size(ls)), "\n")).otherwise(x["text"]),
        r"#[^\n]*", "").alias("text")))

    def plain(x: Column) -> Column:
        return F.transform(F.split(F.regexp_extract(x["text"], PLAIN_IMPORT, 1), ","), lambda item: F.struct(
            x["line_no"].alias("line_no"), F.regexp_extract(item, r"^\s*([\p{L}\p{N}_.]+)", 1).alias("module"),
            F.array(F.regexp_extract(item, r"^\s*([\p{L}\p{N}_.]+)", 1)).alias("names"),
            F.nullif(F.regexp_extract(item, r"\sas\s+([\p{L}\p{N}_]+)", 1), F.lit("")).alias("alias")))

    def listed(x: Column) -> Column:
        items = F.concat(F.regexp_extract(x["text"], FROM_IMPORT, 2), F.regexp_extract(x["text"], FROM_IMPORT, 3))
        names = F.filter(F.transform(F.split(items, ","), lambda y: F.regexp_extract(y, r"^\s*([\p{L}\p{N}_*]+)", 1)), lambda y: y != "")
        return F.array(F.struct(x["line_no"].alias("line_no"), F.regexp_extract(x["text"], FROM_IMPORT, 1).alias("module"), names.alias("names"),
                                F.lit(None).cast("string").alias("alias")))

    none = F.array().cast("array<struct<line_no:int,module:string,names:array<string>,alias:string>>")
    each = F.transform(whole, lambda x: F.when(x["text"].rlike(r"^\s*import\s"), plain(x)).when(
        x["text"].rlike(r"^\s*from\s+\.*[\p{L}\p{N}_.]*\s+import\b"), listed(x)).otherwise(none))
    return F.filter(F.flatten(each), lambda x: x["module"] != "")


def imports(files: DataFrame) -> DataFrame:
    """One row per ``import a as b`` alias, one per ``from m import x, y``.

    (path, line_no, module, names, alias); ``from . import x`` (no module) is
    skipped. Array functions on the file's row; only its imports are exploded."""
    return _python(files).select("path", F.inline(import_facts(F.col("content"))))


def dependencies(files: DataFrame) -> DataFrame:
    """C7 + C22: (path, dependencies) — sorted distinct first module segments."""
    imp = imports(files)
    return (imp.groupBy("path")
            .agg(F.array_sort(F.collect_set(F.split(F.col("module"), r"\.")[0])).alias("dependencies")))


# --- block structure (the one Python helper) -----------------------------------

_HEADER = re.compile(r"^\s*(async\s+def|def|class)\s+(\w+)")
_LITERAL = re.compile(r"(\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|#[^\n]*")
_BRACKET = re.compile(r"[()\[\]{}]")


def _masked(text: str) -> tuple[str, str]:
    """The text without its comments, and the same with the contents of string
    literals blanked (line ends in them as NUL); both keep all positions."""
    plain = _LITERAL.sub(lambda m: m[0] if m[1] is not None else " " * len(m[0]), text)
    code = _LITERAL.sub(lambda m: " " * len(m[0]) if m[1] is None else re.sub(r"[^\n]", "_", m[1]).replace("\n", "\0"), text)
    return plain, code


def _walk_blocks(text: str | None) -> list[dict] | None:
    """The logical lines (continuation lines joined, comments cut), each with the
    place of the header that encloses it (``parent``, -1 without) and of the last
    line of its own block (``last``), the decorator lines right before it, and
    whether it is ``visited`` and ``in_class`` (see :func:`structured_lines`).

    A logical line goes on while a bracket or a string is open, or after a
    backslash. An indentation stack gives each line its parent."""
    if text is None:
        return None
    plain, code = _masked(text)
    out: list[dict] = []
    stack: list[tuple[int, int]] = []        # (indent, place)
    parts: list[str] = []
    at, no, first, depth, decorators = 0, 1, 1, 0, 0
    for raw in code.split("\n"):
        if not parts:
            first = no
        piece = plain[at:at + len(raw)].rstrip()
        for m in _BRACKET.finditer(raw):
            depth = max(0, depth + (1 if m[0] in "([{" else -1))
        at, no = at + len(raw) + 1, no + 1 + raw.count("\0")
        parts.append(piece.removesuffix("\\") if not parts else piece.removesuffix("\\").strip())
        if (depth or raw.rstrip().endswith("\\")) and at <= len(code):
            continue
        line, parts, depth = " ".join(p for p in parts if p.strip()), [], 0
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip(" \t"))
        while stack and stack[-1][0] >= indent:
            out[stack.pop()[1]]["last"] = len(out) - 1
        m = _HEADER.match(line)
        kind = ("def" if m[1] == "def" else "class" if m[1] == "class" else "async def") if m else (
            "block" if line.endswith(":") else "stmt")
        up = out[stack[-1][1]] if stack else None
        out.append({"line_no": first, "kind": kind, "text": line, "parent": stack[-1][1] if stack else -1, "last": len(out), "decorators": decorators,
                    "visited": up is None or up["visited"] and (up["kind"] != "class" or kind == "def"),
                    "in_class": up is not None and (up["in_class"] or up["kind"] == "class")})
        decorators = decorators + 1 if line.lstrip().startswith("@") else 0
        if kind != "stmt":
            stack.append((indent, len(out) - 1))
    for _, place in stack:
        out[place]["last"] = len(out) - 1
    return out


_BLOCKS_TYPE = T.ArrayType(T.StructType([
    T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("parent", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("decorators", T.IntegerType()), T.StructField("visited", T.BooleanType()), T.StructField("in_class", T.BooleanType())]))


#: Characters of file text whose lines a Python worker holds at once.
SLICE_CHARS = 1 << 20


def _slices(contents: Iterator[pd.Series], chars: int) -> Iterator[pd.Series]:
    """The lines of each file, given back whenever the files' text has reached
    ``chars``: a batch's rows say nothing about the size of their lines."""
    for batch in contents:
        out, size = [], 0
        for text in batch:
            out.append(_walk_blocks(text))
            size += len(text or "")
            if size >= chars:
                yield pd.Series(out, dtype=object)
                out, size = [], 0
        if out:
            yield pd.Series(out, dtype=object)


@F.pandas_udf(_BLOCKS_TYPE)
def block_structure(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _slices(contents, SLICE_CHARS)


def structured_files(files: DataFrame, *keep: str) -> DataFrame:
    """``path, ls`` of the Python files, one row each: ``ls`` is the array of
    logical lines with their block structure. ``visited``: the line is reached
    by the reference's visitor, under a class only through a method (a def
    directly in its body); ``in_class``: a class is above it. A block's lines
    are those behind its header up to place ``last``."""
    ship_package(files.sparkSession)   # the UDF's helpers must import on workers
    return _python(files).select("path", block_structure(F.col("content")).alias("ls"), *keep)


def _under(ls: Column, place: Column, line: Column) -> Column:
    """The lines of a block, nested ones included."""
    return F.slice(ls, place + 2, line["last"] - place)


def _headers(ls: Column, kind: str) -> Column:
    """struct(i, l) of the visited headers of ``kind``."""
    return F.filter(F.transform(ls, lambda l, i: F.struct(i.alias("i"), l.alias("l"))), lambda x: (x["l"]["kind"] == kind) & x["l"]["visited"])


def _positional_args(header_params: Column) -> Column:
    """Names of positional parameters (ast ``args.args``): after a bare '/',
    before the first '*' item; annotations and defaults dropped."""
    names = F.transform(_items(header_params),
                        lambda p: F.regexp_extract(p, r"^\s*([\p{L}\p{N}_*/]+)", 1))
    slash = F.array_position(names, "/")
    after = F.when(slash > 0, F.slice(names, (slash + 1).cast("int"), F.size(names))).otherwise(names)
    first_star = F.array_position(F.transform(after, lambda a: a.startswith("*")), True)
    upto = F.when(first_star > 0, F.slice(after, 1, (first_star - 1).cast("int"))).otherwise(after)
    return F.filter(upto, lambda a: a != "")


def function_facts(ls: Column) -> Column:
    """C10, C12–C15, C18, C19, C22 of one file's logical lines: an array of
    structs as the rows of :func:`functions`. A function's facts are read from
    the lines of its block, a slice of the file's array."""
    lib_re = "|".join(DATA_LIBS)
    quoted = f'^(?:{chr(34) * 3}|{chr(39) * 3})'

    def calls(line: Column) -> Column:
        return F.filter(F.regexp_extract_all(line["text"], F.lit(CALL_RE), 1), lambda c: ~c.isin(*PY_KEYWORDS) & ~c.startswith("."))

    def queries(line: Column) -> Column:
        inner = F.transform(F.regexp_extract_all(line["text"], F.lit(STRING_RE), 0), lambda x: F.when(
            x.rlike(quoted), F.substr(x, F.lit(4), F.length(x) - 6)).otherwise(F.substr(x, F.lit(2), F.length(x) - 2)))
        return F.filter(inner, lambda x: F.upper(x).rlike("|".join(SQL_WORDS)))

    def one(x: Column) -> Column:
        d, i = x["l"], x["i"]
        body = F.filter(_under(ls, i, d), lambda y: ~y["kind"].isin("def", "class", "async def"))
        up = F.get(ls, d["parent"])
        method = (d["parent"] >= 0) & (up["kind"] == "class")
        below = F.get(ls, i + 1)
        marks = F.slice(ls, i + 1 - d["decorators"], d["decorators"])
        return F.struct(
            F.regexp_extract(d["text"], DEF_NAME, 1).alias("name"), d["line_no"].cast("long").alias("line_no"),
            _positional_args(_inside(F.regexp_extract(d["text"], DEF_RE, 1))).alias("args"),
            F.nullif(F.regexp_extract(d["text"], DEF_RE, 2), F.lit("")).alias("returns"),
            F.transform(marks, lambda y: F.regexp_replace(_strip(y["text"]), "^@", "")).alias("decorators"),
            F.coalesce((d["last"] > i) & _strip(below["text"]).rlike(r"^[rRuUbBfF]{0,2}(\"|')"), F.lit(False)).alias("has_docstring"),
            F.when(method, F.regexp_extract(up["text"], CLASS_NAME, 1)).alias("class_name"),
            F.coalesce(method, F.lit(False)).alias("is_method"), (~d["in_class"]).alias("in_functions"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(body, calls)))).alias("calls_made"),
            F.flatten(F.transform(body, queries)).alias("sql_queries"))

    found = F.transform(_headers(ls, "def"), one)
    return F.transform(found, lambda f: F.struct(
        *[f[c].alias(c) for c in ("name", "line_no", "args", "returns", "decorators", "has_docstring", "class_name", "is_method", "in_functions", "calls_made")],
        F.filter(f["calls_made"], lambda c: c.contains(".") & c.rlike(lib_re)).alias("data_operations"), f["sql_queries"].alias("sql_queries")))


def functions(files: DataFrame) -> DataFrame:
    """One row per visited ``def``.

    (path, name, line_no, args, returns, decorators, has_docstring,
    class_name (direct class of a method), is_method, in_functions (listed as
    a top-level function: no class above it), calls_made, data_operations,
    sql_queries). Calls, data operations and SQL strings are gathered from
    every line under the def (nested blocks included). No shuffle: a file's
    facts come from its own row."""
    return structured_files(files).select("path", F.inline(function_facts(F.col("ls"))))


_TARGETS = r"(?:^|(?<==))\s*([\p{L}\p{N}_]+)\s*=(?!=)"


def class_facts(ls: Column) -> Column:
    """C11 of one file's logical lines: structs as the rows of :func:`classes`."""
    def one(x: Column) -> Column:
        c, i = x["l"], x["i"]
        own = F.filter(_under(ls, i, c), lambda y: y["parent"] == i)
        return F.struct(
            F.regexp_extract(c["text"], CLASS_NAME, 1).alias("name"), c["line_no"].cast("long").alias("line_no"),
            F.filter(_items(_inside(F.regexp_extract(c["text"], CLASS_RE, 1))), lambda y: ~y.rlike(KEYWORD_ITEM)).alias("bases"),
            F.flatten(F.transform(F.filter(own, lambda y: y["kind"] == "stmt"), lambda y: F.regexp_extract_all(y["text"], F.lit(_TARGETS), 1))).alias("attributes"),
            F.transform(F.filter(own, lambda y: y["kind"] == "def"), lambda y: F.regexp_extract(y["text"], DEF_NAME, 1)).alias("methods"))

    return F.transform(_headers(ls, "class"), one)


def classes(files: DataFrame) -> DataFrame:
    """C11: visited classes: (path, name, line_no, bases, attributes, methods)."""
    return structured_files(files).select("path", F.inline(class_facts(F.col("ls"))))


def assignment_facts(ls: Column) -> Column:
    """C16, C17 of one file's logical lines: structs as the rows of :func:`assignments`."""
    lib_re = "|".join(DATA_LIBS)

    def one(x: Column) -> Column:
        s = _strip(x["text"])
        target, method = (F.regexp_extract(s, DATA_OP_RE, k) for k in (1, 2))
        op = (method != "") & method.rlike(lib_re)
        return F.struct(
            x["line_no"].cast("long").alias("line_no"),
            F.when(~x["in_class"], F.regexp_extract_all(s, F.lit(_TARGETS), 1)).otherwise(F.array().cast("array<string>")).alias("global_names"),
            F.nullif(target, F.lit("")).alias("target"), F.when(op, method).alias("data_op_method"), s.alias("context"), op.alias("is_data_op"))

    return F.transform(F.filter(ls, lambda x: (x["kind"] == "stmt") & x["visited"] & _strip(x["text"]).rlike(r"^[^=]+=(?!=)")
                                & ~_strip(x["text"]).rlike(r"^[^=]*[-+*/%&|^<>!:@]=|^\s*(if|while|return|assert)\b")), one)


def assignments(files: DataFrame) -> DataFrame:
    """Visited assignment lines: (path, line_no, global_names, target,
    data_op_method, context, is_data_op). ``global_names`` are the plain names
    assigned outside any class (function locals included, as the reference
    does)."""
    return structured_files(files).select("path", F.inline(assignment_facts(F.col("ls"))))


def module_edges(files: DataFrame) -> DataFrame:
    """Import edges between files of the corpus.

    An import of module ``a.b`` in ``x/y/f.py`` resolves to the nearest of
    ``x/y/a/b.py``, ``x/y/a/b/__init__.py``, ``x/a/b.py``, ..., ``a/b.py``
    (the importing directory and its ancestors, a package before a module at
    the same level). The candidates per import are bounded by the path depth
    and matched by an equi-join on the exact path, so a popular module name
    never pairs every importer with every file of that name: each import
    yields at most one edge."""
    py = files.where(file_kind(F.col("path")) == "python").select(F.col("path").alias("to_path"))
    imp = imports(files).select(F.col("path").alias("from_path"), "line_no", "module")
    dirs = F.slice(F.split("from_path", "/"), 1, F.size(F.split("from_path", "/")) - 1)
    rel = F.regexp_replace("module", r"\.", "/")
    cand = (imp.select("*", F.explode(F.sequence(F.lit(0), F.size(dirs))).alias("depth"))
            .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pkg"))
            .select("from_path", "line_no", "module", "depth", "pkg",
                    F.concat(F.when(F.col("depth") > 0,
                                    F.concat(F.array_join(F.slice(dirs, 1, F.col("depth")), "/"), F.lit("/")))
                             .otherwise(F.lit("")),
                             rel, F.when(F.col("pkg") == 1, F.lit("/__init__.py")).otherwise(F.lit(".py")))
                    .alias("to_path")))
    found = cand.join(py, "to_path")
    return (found.groupBy("from_path", "line_no", "module")
            .agg(F.max(F.struct("depth", "pkg", "to_path")).alias("best"))
            .select("from_path", "line_no", "module", F.col("best.to_path").alias("to_path")))


def corpus_report(metrics: DataFrame) -> DataFrame:
    """Per kind with a ROLLUP total: files, lines, LOC, functions,
    classes, max and average complexity."""
    return (metrics.rollup("kind").agg(
        F.grouping_id("kind").alias("grouping_level"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("total_lines").alias("total_lines"),
        F.sum("lines_of_code").alias("lines_of_code"),
        F.sum("function_count").alias("function_count"),
        F.sum("class_count").alias("class_count"),
        F.max("cyclomatic_complexity").alias("max_complexity"),
        F.avg("cyclomatic_complexity").alias("avg_complexity")))


def most_complex(metrics: DataFrame, k: int) -> DataFrame:
    """The ``k`` files of highest complexity (ties by path), ranked."""
    top = (metrics.where(F.col("cyclomatic_complexity").isNotNull()).select("path", "cyclomatic_complexity", "lines_of_code")
           .orderBy(F.col("cyclomatic_complexity").desc(), "path").limit(k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cyclomatic_complexity").desc(), "path")))
