"""Code-corpus queries on the F-code fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import sql_literal as lit
from ..operators import codefacts as CF
from ..operators.ddl import re2
from ..sources import fixtures as FX
from .registry import register


def _files(spark, sf_dir):
    return FX.fixture(spark, sf_dir, "f_code")


_KIND = ("CASE regexp_extract(path, '[^/](\\.[^./]*)$', 1) WHEN '.py' THEN 'python' "
         "WHEN '.sql' THEN 'sql' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'javascript' "
         "ELSE 'generic' END")
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_BASE = f"""{FX.cte('f_code')},
k AS (SELECT path, content, {_KIND} AS kind, string_split(content, chr(10)) AS ls,
             regexp_replace(content, {lit(re2(CF.NOT_CODE))}, '_', 'g') AS code FROM f_code),
lines AS (SELECT path, kind, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS text FROM k),
ln AS (SELECT *, {_STRIP.format(x='text')} AS stripped,
              length(regexp_extract(text, '^([ \\t]*)', 1)) AS indent FROM lines)"""


def _cnt(pred: str) -> str:
    return f"CAST(len(list_filter(ls, lambda l: {pred})) AS BIGINT)"


_SL = _STRIP.format(x="l")
_METRICS_SQL = f"""WITH {_BASE}
SELECT path, kind, CAST(len(ls) AS BIGINT) AS total_lines,
  CASE WHEN kind = 'python' THEN {_cnt(f"{_SL} <> '' AND NOT starts_with({_SL}, '#')")} END AS lines_of_code,
  CASE WHEN kind = 'python' THEN {_cnt(f"starts_with({_SL}, '#')")} END AS comment_lines,
  CASE WHEN kind = 'python' THEN {_cnt("regexp_matches(l, '^\\s*def\\s')")} END AS function_count,
  CASE WHEN kind = 'python' THEN {_cnt("regexp_matches(l, '^\\s*class\\s')")} END AS class_count,
  CASE WHEN kind = 'python' THEN {_cnt("regexp_matches(l, '^\\s*(import\\s|from\\s+\\S+\\s+import\\b)')")} END
    AS import_count,
  CASE WHEN kind = 'python' THEN CAST(1 + len(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '^\\s*(if|elif|while|for|async\\s+for|except|with)\\b')))
    + len(regexp_extract_all(code, '\\S[ \\t]+for[ \\t]'))
    - len(regexp_extract_all(code, 'async[ \\t]+for[ \\t]')) AS BIGINT) END AS cyclomatic_complexity,
  CASE WHEN content IS NULL THEN 'unreadable content' END AS error
FROM k"""


@register("code_file_metrics_fcode", _METRICS_SQL, "S2 S3 C1 C8 C9 C20 C21")
def code_file_metrics_fcode(spark, sf_dir):
    return CF.file_metrics(_files(spark, sf_dir))


@register("code_lines_fcode", f"""WITH {_BASE}
SELECT path, kind, CAST(line_no AS INTEGER) AS line_no, stripped, CAST(indent AS INTEGER) AS indent FROM ln""",
          "S6")
def code_lines_fcode(spark, sf_dir):
    return CF.code_lines(_files(spark, sf_dir)).select("path", "kind", "line_no", "stripped", "indent")


def _frag_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT path, line_no, stripped AS context, {i + 1} AS pattern_no, "
        f"regexp_extract_all(text, {lit(p)}) AS m FROM ln WHERE kind = 'python'"
        for i, p in enumerate(CF.SQL_PATTERNS))
    types = "[" + ", ".join(lit(t) for t in CF.SQL_TYPES) + "]"
    return f"""WITH {_BASE}, fr AS ({parts}),
q AS (SELECT path, line_no, context, pattern_no, generate_subscripts(m, 1) AS match_no,
             unnest(m) AS query FROM fr)
SELECT path, CAST(line_no AS INTEGER) AS line_no, pattern_no, CAST(match_no AS INTEGER) AS match_no,
       {_STRIP.format(x='query')} AS query, {types}[pattern_no] AS query_type,
       CASE WHEN pattern_no = 3 THEN regexp_extract(query, '(?i)^UPDATE\\s+({CF.W}+)', 1)
            ELSE regexp_extract(query, '({CF.W}+)$', 1) END AS table_name, context
FROM q"""


@register("code_sql_fragments_fcode", _frag_sql(), "C2 C3 C4")
def code_sql_fragments_fcode(spark, sf_dir):
    return CF.sql_fragments(_files(spark, sf_dir)).select(
        "path", F.col("line_no").cast("int").alias("line_no"), F.col("pattern_no").cast("int"),
        F.col("match_no").cast("int"), "query", "query_type", "table_name", "context")


_IMPORTS_CTES = f"""{_BASE},
il AS (SELECT path, unnest(list_filter(list_transform(ls, lambda t, i: struct_pack(n := i, t := CASE
         WHEN regexp_matches(t, {lit(CF.OPEN_LIST)}) THEN array_to_string(ls[i:], chr(10)) ELSE t END)),
         lambda x: regexp_matches(x.t, {lit(CF.IMPORT_LINE)}))) AS x FROM k WHERE kind = 'python'),
is_ AS (SELECT path, x.n AS line_no, regexp_replace(x.t, '#[^\\n]*', '', 'g') AS text FROM il),
pl AS (SELECT path, line_no, unnest(string_split(regexp_extract(text, {lit(CF.PLAIN_IMPORT)}, 1), ',')) AS item
       FROM is_ WHERE regexp_matches(text, '^\\s*import\\s')),
fr AS (SELECT path, line_no, regexp_extract(text, {lit(CF.FROM_IMPORT)}, 1) AS module,
              concat(regexp_extract(text, {lit(CF.FROM_IMPORT)}, 2), regexp_extract(text, {lit(CF.FROM_IMPORT)}, 3)) AS rest
       FROM is_ WHERE regexp_matches(text, '^\\s*from\\s+\\.*[\\p{{L}}\\p{{N}}_.]*\\s+import\\b')),
imp AS (SELECT path, CAST(line_no AS INTEGER) AS line_no, m AS module, [m] AS names,
       nullif(regexp_extract(item, '\\sas\\s+([\\p{{L}}\\p{{N}}_]+)', 1), '') AS alias
FROM (SELECT *, regexp_extract(item, '^\\s*([\\p{{L}}\\p{{N}}_.]+)', 1) AS m FROM pl) WHERE m <> ''
UNION ALL
SELECT path, CAST(line_no AS INTEGER), module,
       list_filter(list_transform(string_split(rest, ','),
                      lambda x: regexp_extract(x, '^\\s*([\\p{{L}}\\p{{N}}_*]+)', 1)), lambda x: x <> ''),
       CAST(NULL AS VARCHAR)
FROM fr WHERE module <> '')"""
_IMPORTS_SQL = f"WITH {_IMPORTS_CTES} SELECT * FROM imp"


# Query outputs render arrays as compact JSON text in both engines, so the
# comparison does not depend on how each engine's client represents lists.
@register("code_imports_fcode", f"WITH {_IMPORTS_CTES} SELECT path, line_no, module, "
          "to_json(names) AS names, alias FROM imp", "C5 C6")
def code_imports_fcode(spark, sf_dir):
    return (CF.imports(_files(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("int"))
            .withColumn("names", F.to_json("names")))


@register("code_dependencies_fcode", f"""WITH {_IMPORTS_CTES}
SELECT path, to_json(list_sort(list_distinct(list(split_part(module, '.', 1))))) AS dependencies
FROM imp GROUP BY path""", "C7 C22")
def code_dependencies_fcode(spark, sf_dir):
    return CF.dependencies(_files(spark, sf_dir)).withColumn("dependencies", F.to_json("dependencies"))


_EDGES_SQL = f"""WITH {_IMPORTS_CTES},
py AS (SELECT path AS to_path FROM f_code WHERE {_KIND} = 'python'),
d AS (SELECT path AS from_path, line_no, module, string_split(path, '/')[1:-2] AS dirs FROM imp),
c AS (SELECT from_path, line_no, module, depth, pkg,
             concat(CASE WHEN depth > 0 THEN concat(array_to_string(dirs[1:depth], '/'), '/') ELSE '' END,
                    replace(module, '.', '/'), CASE WHEN pkg = 1 THEN '/__init__.py' ELSE '.py' END) AS to_path
      FROM (SELECT *, unnest(generate_series(0, len(dirs))) AS depth FROM d),
           (SELECT unnest([0, 1]) AS pkg))
SELECT c.from_path, c.line_no, c.module, arg_max(c.to_path, c.depth * 2 + c.pkg) AS to_path
FROM c JOIN py ON c.to_path = py.to_path GROUP BY c.from_path, c.line_no, c.module"""


@register("code_module_edges_fcode", _EDGES_SQL, "C23")
def code_module_edges_fcode(spark, sf_dir):
    return CF.module_edges(_files(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("int"))


@register("code_corpus_report_fcode", f"""WITH m AS ({_METRICS_SQL})
SELECT kind, CAST(GROUPING(kind) AS BIGINT) AS grouping_level, count(*) AS n_files,
       CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(lines_of_code) AS BIGINT) AS lines_of_code,
       CAST(sum(function_count) AS BIGINT) AS function_count, CAST(sum(class_count) AS BIGINT) AS class_count,
       max(cyclomatic_complexity) AS max_complexity, avg(cyclomatic_complexity) AS avg_complexity
FROM m GROUP BY ROLLUP (kind)""", "C24")
def code_corpus_report_fcode(spark, sf_dir):
    return CF.corpus_report(CF.file_metrics(_files(spark, sf_dir)))


@register("code_most_complex_fcode", f"""WITH m AS ({_METRICS_SQL})
SELECT path, cyclomatic_complexity, lines_of_code,
       CAST(row_number() OVER (ORDER BY cyclomatic_complexity DESC, path) AS INTEGER) AS rank
FROM m WHERE cyclomatic_complexity IS NOT NULL ORDER BY rank LIMIT 20""", "C24")
def code_most_complex_fcode(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return CF.most_complex(CF.file_metrics(_files(spark, sf_dir)), 20)


# --- block-structure facts: checked against Python's ast in tests ------------------

# Block structure in SQL (valid code without continuation lines, as in F-code):
# a logical line's parent is the nearest earlier logical line with a smaller
# indent; ancestors by recursion; a node is visited when every class above it
# is entered through a method (a def directly in the class body).
_BLOCKS = f"""{_BASE},
lg AS (SELECT path, line_no, text, stripped, indent,
              CASE WHEN regexp_matches(text, '^\\s*async\\s+def\\s+\\w+') THEN 'async def'
                   WHEN regexp_matches(text, '^\\s*def\\s+\\w+') THEN 'def'
                   WHEN regexp_matches(text, '^\\s*class\\s+\\w+') THEN 'class'
                   WHEN ends_with(stripped, ':') THEN 'block' ELSE 'stmt' END AS lk
       FROM ln WHERE kind = 'python' AND stripped <> '' AND NOT starts_with(stripped, '#')),
par AS (SELECT a.*, (SELECT max(b.line_no) FROM lg b WHERE b.path = a.path AND b.line_no < a.line_no
                                                     AND b.indent < a.indent) AS parent FROM lg a),
anc(path, line_no, a_line, depth) AS (
  SELECT path, line_no, parent, 1 FROM par WHERE parent IS NOT NULL
  UNION ALL
  SELECT anc.path, anc.line_no, p.parent, anc.depth + 1 FROM anc
  JOIN par p ON p.path = anc.path AND p.line_no = anc.a_line WHERE p.parent IS NOT NULL),
bad AS (SELECT DISTINCT a.path, a.line_no FROM anc a
        JOIN par ak ON ak.path = a.path AND ak.line_no = a.a_line AND ak.lk = 'class'
        LEFT JOIN anc c ON c.path = a.path AND c.line_no = a.line_no AND c.depth = a.depth - 1
        JOIN par ck ON ck.path = a.path AND ck.line_no = coalesce(c.a_line, a.line_no)
        WHERE ck.lk <> 'def')"""

def _items_sql(pattern: str, text: str) -> str:
    found = f"regexp_extract({text}, {lit(re2(pattern))}, 1)"
    inside = f"substr({found}, 2, greatest(length({found}) - 2, 0))"
    return (f"list_filter(list_transform(regexp_extract_all({inside}, {lit(re2(CF.ARGUMENT))}, 1), "
            f"lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')")


def _functions_sql() -> str:
    kws = ", ".join(lit(k) for k in CF.PY_KEYWORDS)
    libs = "|".join(CF.DATA_LIBS)
    words = "|".join(CF.SQL_WORDS)
    strip = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"""WITH RECURSIVE {_BLOCKS},
defs AS (SELECT p.* FROM par p LEFT JOIN bad b ON b.path = p.path AND b.line_no = p.line_no
         WHERE p.lk = 'def' AND b.path IS NULL),
clsanc AS (SELECT DISTINCT a.path, a.line_no FROM anc a
           JOIN par ak ON ak.path = a.path AND ak.line_no = a.a_line AND ak.lk = 'class'),
body AS (SELECT a.path, a.a_line AS def_line, p.line_no, p.text FROM anc a
         JOIN par p ON p.path = a.path AND p.line_no = a.line_no
         WHERE p.lk NOT IN ('def', 'class', 'async def')),
calls AS (SELECT path, def_line, unnest(regexp_extract_all(text, {lit(CF.CALL_RE2)}, 1)) AS call FROM body),
cs AS (SELECT path, def_line, list_sort(list_distinct(list(call))) AS calls_made,
              list_sort(list_distinct(list(call) FILTER (WHERE contains(call, '.')
                                                       AND regexp_matches(call, {lit(libs)})))) AS ops
       FROM calls WHERE call NOT IN ({kws}) AND NOT starts_with(call, '.') GROUP BY path, def_line),
lits AS (SELECT path, def_line, line_no, generate_subscripts(m, 1) AS pos, unnest(m) AS lit
         FROM (SELECT path, def_line, line_no, regexp_extract_all(text, {lit(re2(CF.STRING_RE))}, 0) AS m FROM body)),
sq AS (SELECT path, def_line, list(s ORDER BY line_no, pos) AS sql_queries
       FROM (SELECT *, CASE WHEN starts_with(lit, repeat(chr(34), 3)) OR starts_with(lit, repeat(chr(39), 3)) THEN substr(lit, 4, length(lit) - 6)
                     ELSE substr(lit, 2, length(lit) - 2) END AS s FROM lits)
       WHERE regexp_matches(upper(s), {lit(words)}) GROUP BY path, def_line),
deco AS (SELECT d.path, d.line_no, substr(d.stripped, 2) AS deco,
                (SELECT min(o.line_no) FROM lg o WHERE o.path = d.path AND o.line_no > d.line_no
                                                   AND NOT starts_with(o.stripped, '@')) AS owner
         FROM lg d WHERE starts_with(d.stripped, '@')),
decos AS (SELECT path, owner AS line_no, list(deco ORDER BY line_no) AS decorators FROM deco GROUP BY path, owner),
fc AS (SELECT path, parent AS line_no,
              regexp_matches(arg_min(stripped, line_no), '^[rRuUbBfF]{{0,2}}("|'')') AS has_doc
       FROM par WHERE parent IS NOT NULL GROUP BY path, parent),
a1 AS (SELECT d.*, list_transform({_items_sql(CF.DEF_RE, 'd.text')},
                                  lambda x: regexp_extract(x, '^\\s*([\\p{{L}}\\p{{N}}_*/]+)', 1)) AS names
       FROM defs d),
a2 AS (SELECT *, CASE WHEN list_position(names, '/') IS NOT NULL
                      THEN names[list_position(names, '/') + 1:] ELSE names END AS after FROM a1),
a3 AS (SELECT *, list_position(list_transform(after, lambda x: starts_with(x, '*')), true) AS fs FROM a2),
a4 AS (SELECT *, list_filter(CASE WHEN fs IS NOT NULL THEN after[1:fs - 1] ELSE after END,
                             lambda x: x <> '') AS args FROM a3)
SELECT d.path, regexp_extract(d.text, {lit(CF.DEF_NAME)}, 1) AS name, CAST(d.line_no AS BIGINT) AS line_no,
       to_json(d.args) AS args, nullif(regexp_extract(d.text, {lit(re2(CF.DEF_RE))}, 2), '') AS returns,
       to_json(coalesce(decos.decorators, [])) AS decorators,
       coalesce(fc.has_doc, false) AS has_docstring,
       CASE WHEN pk.lk = 'class' THEN regexp_extract(pk.text, {lit(CF.CLASS_NAME)}, 1) END AS class_name,
       coalesce(pk.lk = 'class', false) AS is_method, ca.path IS NULL AS in_functions,
       to_json(coalesce(cs.calls_made, [])) AS calls_made, to_json(coalesce(cs.ops, [])) AS data_operations,
       to_json(coalesce(sq.sql_queries, [])) AS sql_queries
FROM a4 d
LEFT JOIN par pk ON pk.path = d.path AND pk.line_no = d.parent
LEFT JOIN clsanc ca ON ca.path = d.path AND ca.line_no = d.line_no
LEFT JOIN cs ON cs.path = d.path AND cs.def_line = d.line_no
LEFT JOIN sq ON sq.path = d.path AND sq.def_line = d.line_no
LEFT JOIN decos ON decos.path = d.path AND decos.line_no = d.line_no
LEFT JOIN fc ON fc.path = d.path AND fc.line_no = d.line_no"""


@register("code_functions_fcode", _functions_sql(), "C10 C12 C13 C14 C15 C18 C19 C22")
def code_functions_fcode(spark, sf_dir):
    f = CF.functions(_files(spark, sf_dir))
    arrays = ["args", "decorators", "calls_made", "data_operations", "sql_queries"]
    return f.select(*[F.to_json(c).alias(c) if c in arrays else F.col(c) for c in f.columns])


_ATTR_TARGETS = ("list_transform(list_filter(string_split(replace(c.stripped, '==', chr(1) || chr(1)), '=')[1:-2], "
                 "lambda x: regexp_matches(x, '^\\s*[\\p{L}\\p{N}_]+\\s*$')), "
                 "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))")
_CLASSES_SQL = f"""WITH RECURSIVE {_BLOCKS},
cls AS (SELECT p.* FROM par p LEFT JOIN bad b ON b.path = p.path AND b.line_no = p.line_no
        WHERE p.lk = 'class' AND b.path IS NULL),
attrs AS (SELECT c.path, c.parent AS line_no,
                 flatten(list({_ATTR_TARGETS} ORDER BY c.line_no)) AS attributes
          FROM par c WHERE c.lk = 'stmt' GROUP BY c.path, c.parent),
meths AS (SELECT c.path, c.parent AS line_no,
                 list(regexp_extract(c.text, {lit(CF.DEF_NAME)}, 1) ORDER BY c.line_no) AS methods
          FROM par c WHERE c.lk = 'def' GROUP BY c.path, c.parent)
SELECT cls.path, regexp_extract(cls.text, {lit(CF.CLASS_NAME)}, 1) AS name, CAST(cls.line_no AS BIGINT) AS line_no,
       to_json(list_filter({_items_sql(CF.CLASS_RE, 'cls.text')}, lambda x: NOT regexp_matches(x, {lit(CF.KEYWORD_ITEM)}))) AS bases,
       to_json(coalesce(attrs.attributes, [])) AS attributes,
       to_json(coalesce(meths.methods, [])) AS methods
FROM cls LEFT JOIN attrs ON attrs.path = cls.path AND attrs.line_no = cls.line_no
LEFT JOIN meths ON meths.path = cls.path AND meths.line_no = cls.line_no"""


@register("code_classes_fcode", _CLASSES_SQL, "C11 C12")
def code_classes_fcode(spark, sf_dir):
    c = CF.classes(_files(spark, sf_dir))
    return c.select("path", "name", "line_no", F.to_json("bases").alias("bases"),
                    F.to_json("attributes").alias("attributes"), F.to_json("methods").alias("methods"))


def _assignments_sql() -> str:
    libs = "|".join(CF.DATA_LIBS)
    op_re = CF.DATA_OP_RE.replace("=(?!=)", "=")   # the look-ahead is redundant there
    assert op_re != CF.DATA_OP_RE
    ex = lambda g: f"regexp_extract(s.stripped, {lit(op_re)}, {g})"
    names = ("list_transform(list_filter(string_split(replace(s.stripped, '==', chr(1) || chr(1)), '=')[1:-2], "
             "lambda x: regexp_matches(x, '^\\s*[\\p{L}\\p{N}_]+\\s*$')), "
             "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))")
    return f"""WITH RECURSIVE {_BLOCKS},
clsanc AS (SELECT DISTINCT a.path, a.line_no FROM anc a
           JOIN par ak ON ak.path = a.path AND ak.line_no = a.a_line AND ak.lk = 'class'),
st AS (SELECT p.* FROM par p LEFT JOIN bad b ON b.path = p.path AND b.line_no = p.line_no
       WHERE p.lk = 'stmt' AND b.path IS NULL)
SELECT s.path, CAST(s.line_no AS BIGINT) AS line_no,
       to_json(CASE WHEN ca.path IS NULL THEN {names} ELSE [] END) AS global_names,
       nullif({ex(1)}, '') AS target,
       CASE WHEN {ex(2)} <> '' AND regexp_matches({ex(2)}, {lit(libs)}) THEN {ex(2)} END AS data_op_method,
       s.stripped AS context,
       ({ex(2)} <> '' AND regexp_matches({ex(2)}, {lit(libs)})) AS is_data_op
FROM st s LEFT JOIN clsanc ca ON ca.path = s.path AND ca.line_no = s.line_no
WHERE regexp_matches(s.stripped, '^[^=]+=([^=]|$)')
  AND NOT regexp_matches(s.stripped, '^[^=]*[-+*/%&|^<>!:@]=|^\\s*(if|while|return|assert)\\b')"""


@register("code_assignments_fcode", _assignments_sql(), "C16 C17")
def code_assignments_fcode(spark, sf_dir):
    a = CF.assignments(_files(spark, sf_dir))
    return a.withColumn("global_names", F.to_json("global_names"))


# --- S4 + S5: JSON records out and back in ------------------------------------------

@register("code_metrics_json_roundtrip", _METRICS_SQL, "S4 S5")
def code_metrics_json_roundtrip(spark, sf_dir):
    """F-code written as JSON-lines records {filePath, content} (S5) to the
    shared checkpoint folder, read back with an explicit schema (S4) and
    analysed: the same result as analysing the table directly."""
    from ..session import checkpoint_dir
    from ..sources.tables import json_records, write_json
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/json/fcode-{uuid.uuid4().hex[:8]}"
    write_json(_files(spark, sf_dir).select(F.col("path").alias("filePath"), "content"), path)
    back = json_records(spark, path).select(F.col("filePath").alias("path"), "content")
    return CF.file_metrics(back)


# --- X11: code-analysis prompt per file (masked, whole analysis) ---------------------

_JSON = {"ignoreNullFields": "false"}
# part of the payload -> (query, its fields, their order)
_PARTS = {"functions": ("code_functions_fcode", ["name", "line_no", "args", "calls_made"], ["line_no", "name"]),
          "classes": ("code_classes_fcode", ["name", "line_no", "bases", "methods"], ["line_no", "name"]),
          "imports": ("code_imports_fcode", ["line_no", "module", "names"], ["line_no", "module"]),
          "sql": ("code_sql_fragments_fcode", ["line_no", "query_type", "table_name", "query"], ["line_no", "pattern_no", "match_no"]),
          "operations": ("code_assignments_fcode", ["line_no", "data_op_method"], ["line_no", "context"])}
_METRIC_FIELDS = ["path", "kind", "total_lines", "lines_of_code", "function_count", "class_count", "import_count",
                  "cyclomatic_complexity", "error"]


_JSON_TEXT = {"args", "calls_made", "bases", "methods", "names"}


def _field(c: str) -> str:
    """A payload field; JSON lists stay text, as in the Spark rows."""
    return f"{c} := CAST({c} AS VARCHAR)" if c in _JSON_TEXT else f"{c} := {c}"


def _code_prompt_sql() -> str:
    from ..operators import chat
    from . import oracle as O
    from .registry import REGISTRY
    before, after = chat.TEMPLATES["code"].split("{payload}")
    ctes, joins, fields = [f"m AS ({_METRICS_SQL})"], [], [f"{f} := m.{f}" for f in _METRIC_FIELDS]
    for part, (name, cols, order) in _PARTS.items():
        where = " WHERE is_data_op" if part == "operations" else ""
        ctes.append(f"p_{part} AS (SELECT path, list(struct_pack({', '.join(_field(c) for c in cols)}) "
                    f"ORDER BY {', '.join(order)}) AS l FROM ({REGISTRY[name].sql}) q{where} GROUP BY path)")
        joins.append(f"LEFT JOIN p_{part} ON p_{part}.path = m.path")
        fields.append(f"{part} := coalesce(p_{part}.l, [])")
    payload = O.mask_text_sql(f"CAST(to_json(struct_pack({', '.join(fields)})) AS VARCHAR)")
    return (f"WITH {', '.join(ctes)} SELECT m.path, concat({lit(before)}, {payload}, {lit(after)}) AS prompt "
            f"FROM m {' '.join(joins)}")


@register("chat_code_prompt_fcode", _code_prompt_sql(), "X11")
def chat_code_prompt_fcode(spark, sf_dir):
    """One prompt per file of any kind; the whole analysis is masked before it
    goes into the prompt. All parts are arrays on the file's row, bounded by the
    file they come from; it is read and parsed once."""
    from ..functions.masking import mask_text
    from ..operators import chat
    from ..session import ship_package
    ship_package(spark)
    python = CF.file_kind(F.col("path")) == "python"
    files = _files(spark, sf_dir).withColumn("ls", CF.block_structure(F.when(python, F.col("content"))))
    facts = {"functions": CF.function_facts(F.col("ls")), "classes": CF.class_facts(F.col("ls")), "imports": CF.import_facts(F.when(python, F.col("content"))),
             "sql": CF.fragment_facts(F.when(python, F.col("content"))),
             "operations": F.filter(CF.assignment_facts(F.col("ls")), lambda x: x["is_data_op"])}
    out = CF.file_metrics(files.withColumns({f"_{part}": F.coalesce(fact, F.array()) for part, fact in facts.items()}), *[f"_{part}" for part in facts])

    def listed(part: str):
        _, cols, order = _PARTS[part]
        items = F.transform(f"_{part}", lambda x: F.struct(*[x[c].alias(f"o{i}") for i, c in enumerate(order)], F.struct(
            *[(F.to_json(x[c]) if c in _JSON_TEXT else x[c]).alias(c) for c in cols]).alias("v")))
        return F.transform(F.array_sort(items), lambda x: x["v"]).alias(part)

    payload = F.to_json(F.struct(*_METRIC_FIELDS, *[listed(part) for part in _PARTS]), _JSON)
    return out.select("path", chat.render_prompt("code", mask_text(payload)).alias("prompt"))


# --- S1, S2: directories of text files ---------------------------------------------

def _folder(spark, name):
    import uuid

    from ..session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/text/{name}-{uuid.uuid4().hex[:8]}"


@register("sources_ddl_scripts", """SELECT CAST(c_custkey // 500 AS VARCHAR) AS id, count(*) AS n_create, count(DISTINCT c_nationkey) AS n_tables
FROM customer GROUP BY 1""", "S1 G1 G2")
def sources_ddl_scripts(spark, sf_dir):
    """Scripts written as .sql files to the shared folder and read back in byte
    ranges: one CREATE TABLE per customer, 500 a script."""
    from ..operators import ddl
    from ..sources import scripts as S
    from ..sources import tables as T
    cust = T.table(spark, sf_dir, "customer").select("c_custkey", F.concat(
        F.lit("CREATE TABLE n"), F.col("c_nationkey").cast("string"), F.lit(" (id INT, note TEXT DEFAULT 'a;b');")).alias("stmt"))
    folder = _folder(spark, "ddl")
    name = F.concat(F.floor(F.col("c_custkey") / 500).cast("string"), F.lit(".sql"))
    S.write_files(cust.groupBy(name.alias("name")).agg(F.array_join(F.sort_array(F.collect_list("stmt")), "\n").alias("content")), folder)
    st = S.script_statements(spark, folder).withColumn("id", F.regexp_extract("path", "([0-9]+)[.]sql$", 1))
    return (st.where(ddl.classify(F.col("stmt")) == "create_table")
            .groupBy("id").agg(F.count(F.lit(1)).alias("n_create"), F.countDistinct(F.regexp_extract("stmt", ddl._CT, 1)).alias("n_tables")))


def _dump_files_sql() -> str:
    from .q_catalog import _SPLIT
    return f"""WITH {FX.cte('f_dump')},
files AS (SELECT CAST(CAST(script_id AS BIGINT) // 50 AS VARCHAR) AS id, string_agg(content, ';' || chr(10) ORDER BY CAST(script_id AS BIGINT)) AS content FROM f_dump GROUP BY 1),
sp AS (SELECT id, {_SPLIT} AS st FROM files)
SELECT id, CAST(generate_subscripts(st, 1) AS BIGINT) AS seq, length(unnest(st)) AS n_chars, sha256(unnest(st)) AS stmt_sha256 FROM sp"""


@register("sources_ddl_statements_fdump", _dump_files_sql(), "S1 G1")
def sources_ddl_statements_fdump(spark, sf_dir):
    """F-dump as .sql files of 50 scripts each, cut into statements in byte ranges."""
    from ..sources import scripts as S
    dump = FX.fixture(spark, sf_dir, "f_dump").withColumn("n", F.col("script_id").cast("long"))
    folder = _folder(spark, "dump")
    name = F.concat(F.floor(F.col("n") / 50).cast("string"), F.lit(".sql"))
    parts = dump.groupBy(name.alias("name")).agg(F.sort_array(F.collect_list(F.struct("n", "content"))).alias("c"))
    S.write_files(parts.select("name", F.array_join(F.transform("c", lambda x: x["content"]), ";\n").alias("content")), folder)
    return S.script_statements(spark, folder).select(F.regexp_extract("path", "([0-9]+)[.]sql$", 1).alias("id"), "seq",
                                                     F.length("stmt").cast("long").alias("n_chars"), F.sha2("stmt", 256).alias("stmt_sha256"))


@register("sources_code_files", f"""WITH {_BASE}
SELECT path, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(t)) AS BIGINT) AS n_chars
FROM (SELECT path, unnest(ls) AS t FROM k WHERE content IS NOT NULL) GROUP BY path""", "S2 S6")
def sources_code_files(spark, sf_dir):
    """F-code written as one file per path, under its own name, and read back whole."""
    from ..sources import scripts as S
    from ..sources import tables as T
    folder = _folder(spark, "code")
    S.write_files(_files(spark, sf_dir).where("content is not null").select(F.col("path").alias("name"), "content"), folder)
    read = T.text_corpus(spark, folder).select(F.regexp_extract("path", "(src/.*)$", 1).alias("path"), F.split("content", "\n", -1).alias("ls"))
    return read.select("path", F.size("ls").cast("long").alias("n_lines"), F.aggregate(
        "ls", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))
