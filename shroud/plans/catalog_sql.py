"""DuckDB SQL of the replayed catalogs: an ordered replay of the change log, one
change after the other, as a recursive query whose state is the whole catalog.

The Spark side never replays (see ``operators/replay.py``), so this is an
independent statement of what the outputs are."""

from __future__ import annotations

from ..functions.patterns import sql_literal as lit
from ..functions.sqltypes import normalize_type_sql
from ..sources import fixtures as FX

_NO_COLUMN = "NULL::VARCHAR AS column_name, NULL::VARCHAR AS value, NULL::VARCHAR AS data_type, NULL::BOOLEAN AS nullable, NULL::BOOLEAN AS pk"
_NO_LIST = "NULL::VARCHAR AS ctype, NULL::VARCHAR[] AS cols, NULL::VARCHAR AS ref_table, NULL::VARCHAR[] AS ref_cols, NULL::BOOLEAN AS uniq"


def flat_log_sql(fixture: str) -> str:
    """CTEs up to ``log`` for a flat change feed (see ``ddl.flat_log``)."""
    typed = normalize_type_sql("value")
    fk = "op = 'add_constraint' AND constraint_type LIKE 'FOREIGN KEY%'"
    return f"""{FX.cte(fixture)},
log AS (SELECT CAST(script_id AS VARCHAR) AS script_id, CAST(seq AS BIGINT) AS seq, 0::BIGINT AS sub, op,
               CASE WHEN op <> 'create_schema' THEN table_name END AS table_name, CASE WHEN op <> 'create_table' THEN column_name END AS column_name,
               CASE WHEN op NOT IN ('add_column', 'create_table') THEN value END AS value, CASE WHEN op = 'add_column' THEN {typed} END AS data_type,
               CASE WHEN op = 'add_column' THEN true END AS nullable, CASE WHEN op = 'add_column' THEN false END AS pk,
               CASE WHEN op = 'add_constraint' THEN constraint_type END AS ctype, CASE WHEN op IN ('add_constraint', 'create_index') THEN [column_name] END AS cols,
               CASE WHEN {fk} THEN reference_table END AS ref_table, CASE WHEN {fk} THEN [column_name] END AS ref_cols,
               CASE WHEN op = 'create_index' THEN false END AS uniq FROM {fixture}
        UNION ALL SELECT CAST(script_id AS VARCHAR), CAST(seq AS BIGINT), 1, 'add_column', table_name, column_name, NULL, {typed}, true, false, NULL, NULL, NULL, NULL, NULL
        FROM {fixture} WHERE op = 'create_table')"""


def script_log_sql(fixture: str) -> str:
    """CTEs up to ``log`` for a fixture of scripts, from the SQL of its statements, columns, constraints and indexes."""
    from . import q_catalog as Q
    strip = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    def names(x: str) -> str:
        return f"list_filter(list_transform(string_split({x}, ','), lambda x: {strip.format(x='x')}), lambda x: x <> '')"

    at = f"regexp_extract(stmt, {Q.rx(Q.ddl._AT)}, {{g}})"
    op = strip.format(x=at.format(g=2))
    add = "'(?is)^ADD\\s+COLUMN\\s+(\\S+)\\s+(.*)$'"
    fk = "'(?is)^ADD\\s+CONSTRAINT\\s+(\\S+)\\s+FOREIGN\\s+KEY\\s*\\(([^)]*)\\)\\s*REFERENCES\\s+([^\\s(]+)\\s*\\(([^)]*)\\)\\s*(.*)$'"
    rename = "'(?is)^RENAME\\s+COLUMN\\s+(\\S+)\\s+TO\\s+(\\S+)\\s*$'"
    typed = normalize_type_sql(strip.format(x=f"regexp_extract(a, {add}, 2)"))
    view = f"regexp_extract(stmt, {Q.rx(Q.ddl._CV)}, {{g}})"
    drop = f"regexp_extract(stmt, {Q.rx(Q.ddl._DR)}, {{g}})"
    return f"""cols0 AS ({Q.columns_sql(fixture)}), cons0 AS ({Q.constraints_sql(fixture, 'pos + n_items AS sub')}), idx0 AS ({Q.indexes_sql(fixture)}),
stm AS (WITH {Q.stmts_sql(fixture)} SELECT * FROM stk),
alt AS (SELECT script_id, seq, {at.format(g=1)} AS t, {op} AS a FROM stm WHERE kind = 'alter_table'),
vw AS (SELECT script_id, seq, {view.format(g=2)} AS t, CASE WHEN {view.format(g=1)} <> '' THEN 'MATERIALIZED VIEW' ELSE 'VIEW' END AS kind, {names(view.format(g=3))} AS cs
       FROM stm WHERE kind = 'create_view'),
dr AS (SELECT script_id, seq, CASE WHEN upper({drop.format(g=1)}) = 'VIEW' THEN 'drop_view' ELSE 'drop_table' END AS op, {names(drop.format(g=2))} AS ts FROM stm WHERE kind = 'drop'),
log AS (
 SELECT script_id, seq, 0::BIGINT AS sub, 'create_table' AS op, regexp_extract(stmt, {Q.rx(Q.ddl._CT)}, 1) AS table_name, {_NO_COLUMN}, {_NO_LIST} FROM stm WHERE kind = 'create_table'
 UNION ALL SELECT script_id, seq, ordinal, 'add_column', table_name, column_name, default_value, data_type, nullable, is_primary_key, NULL, NULL, NULL, NULL, NULL FROM cols0
 UNION ALL SELECT script_id, seq, sub, 'add_constraint', table_name, NULL, name, NULL, NULL, NULL, constraint_type, CAST(columns AS VARCHAR[]), reference_table, CAST(reference_columns AS VARCHAR[]), NULL FROM cons0
 UNION ALL SELECT script_id, seq, 0, 'create_index', table_name, NULL, name, NULL, NULL, NULL, NULL, CAST(columns AS VARCHAR[]), NULL, NULL, is_unique FROM idx0
 UNION ALL SELECT script_id, seq, 0, 'create_view', t, NULL, kind, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM vw
 UNION ALL SELECT script_id, seq, generate_subscripts(cs, 1), 'add_column', t, unnest(cs), NULL, 'UNKNOWN', true, false, NULL, NULL, NULL, NULL, NULL FROM vw
 UNION ALL SELECT script_id, seq, 0, 'create_schema', NULL, NULL, regexp_extract(stmt, {Q.rx(Q.ddl._CS)}, 1), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM stm WHERE kind = 'create_schema'
 UNION ALL SELECT script_id, seq, 0, 'truncate', regexp_extract(stmt, {Q.rx(Q.ddl._TR)}, 1), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM stm WHERE kind = 'truncate'
 UNION ALL SELECT script_id, seq, generate_subscripts(ts, 1) - 1, op, unnest(ts), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dr
 UNION ALL SELECT script_id, seq, 0, 'add_column', t, regexp_extract(a, {add}, 1), NULL, {typed}, true, false, NULL, NULL, NULL, NULL, NULL FROM alt WHERE regexp_matches(a, {add})
 UNION ALL SELECT script_id, seq, 0, 'rename_column', t, regexp_extract(a, {rename}, 1), regexp_extract(a, {rename}, 2), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
           FROM alt WHERE regexp_matches(a, {rename})
 UNION ALL SELECT script_id, seq, 0, 'add_constraint', t, NULL, regexp_extract(a, {fk}, 1), NULL, NULL, NULL, concat_ws(' ', 'FOREIGN KEY', nullif(upper(regexp_extract(a, {fk}, 5)), '')),
                  {names(f"regexp_extract(a, {fk}, 2)")}, regexp_extract(a, {fk}, 3), {names(f"regexp_extract(a, {fk}, 4)")}, NULL FROM alt WHERE regexp_matches(a, {fk}))"""


def replay_sql(log: str, strict: bool = False) -> str:
    """CTEs up to ``final``: one row per script with the lists ``tabs, cols,
    edges, idx, cons`` that the changes leave, in the order of the lists."""
    col = "struct_pack(t := c.t, name := {name}, dt := c.dt, nul := {nul}, def := {dflt}, pk := {pk}, inl := c.inl, fk := {fk}, ref := {ref})"
    same = {"name": "c.name", "nul": "c.nul", "dflt": "c.def", "pk": "c.pk", "fk": "c.fk", "ref": "c.ref"}

    def put(**kw: str) -> str:
        return col.format(**{**same, **kw})

    def at_first(**kw: str) -> str:
        return f"list_transform(cols, lambda c, i: CASE WHEN i = hit THEN {put(**kw)} ELSE c END)"

    def within(cond: str, **kw: str) -> str:
        return f"list_transform(cols, lambda c: CASE WHEN c.t = tn AND {cond} THEN {put(**kw)} ELSE c END)"

    renamed = "list_transform({x}, lambda y: CASE WHEN y = cn THEN v ELSE y END)"
    is_fk = "k.type = 'FOREIGN KEY'" if strict else "k.type LIKE 'FOREIGN KEY%'"

    def uncovered(kind: str) -> str:
        return f"len(list_filter(cons2, lambda k: k.t = tn AND {kind} AND list_contains(k.cols, c.name))) = 0"

    no_fk, no_pk = f"c.ref IS NOT NULL AND {uncovered(is_fk)}", f"c.pk AND {uncovered(chr(107) + '.type = ' + lit('PRIMARY KEY'))}"
    dropped = within("true", fk=f"CASE WHEN {no_fk} THEN false ELSE c.fk END", ref=f"CASE WHEN {no_fk} THEN NULL ELSE c.ref END",
                     pk=f"CASE WHEN {no_pk} THEN {'false' if strict else 'c.inl'} ELSE c.pk END")
    return f"""{log},
numbered AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY seq, sub) AS n FROM log),
fold(script_id, n, maps, tabs, cols, edges, idx, cons) USING KEY (script_id) AS (
 SELECT DISTINCT script_id, 0::BIGINT, []::VARCHAR[], []::STRUCT(name VARCHAR, sch VARCHAR, type VARCHAR, est BIGINT, seq BIGINT, sub BIGINT)[],
        []::STRUCT(t VARCHAR, name VARCHAR, dt VARCHAR, nul BOOLEAN, def VARCHAR, pk BOOLEAN, inl BOOLEAN, fk BOOLEAN, ref VARCHAR)[],
        []::STRUCT(ft VARCHAR, fc VARCHAR, tt VARCHAR, tc VARCHAR, seq BIGINT, sub BIGINT, i BIGINT)[],
        []::STRUCT(t VARCHAR, name VARCHAR, cols VARCHAR[], uniq BOOLEAN, seq BIGINT)[],
        []::STRUCT(t VARCHAR, name VARCHAR, type VARCHAR, cols VARCHAR[], rt VARCHAR, rc VARCHAR[], seq BIGINT, sub BIGINT)[] FROM log
 UNION
 SELECT script_id, n,
  CASE WHEN op IN ('create_table', 'create_view') THEN list_distinct(list_append(maps, tn)) WHEN op IN ('drop_table', 'drop_view') THEN list_filter(maps, lambda m: m <> tn) ELSE maps END,
  CASE WHEN op IN ('create_table', 'create_view') THEN list_append(tabs, struct_pack(name := tn, sch := NULL::VARCHAR, type := CASE WHEN op = 'create_table' THEN 'TABLE' ELSE v END, est := NULL::BIGINT, seq := seq, sub := sub))
       WHEN op IN ('drop_table', 'drop_view') THEN list_filter(tabs, lambda t: t.name <> tn)
       WHEN op = 'truncate' THEN list_transform(tabs, lambda t, i: CASE WHEN i = list_position(list_transform(tabs, lambda u: u.name), tn)
            THEN struct_pack(name := t.name, sch := t.sch, type := t.type, est := 0::BIGINT, seq := t.seq, sub := t.sub) ELSE t END)
       WHEN op = 'create_schema' THEN list_transform(tabs, lambda t: struct_pack(name := t.name, sch := coalesce(t.sch, v), type := t.type, est := t.est, seq := t.seq, sub := t.sub))
       ELSE tabs END,
  CASE WHEN op IN ('create_table', 'create_view', 'drop_table', 'drop_view') THEN list_filter(cols, lambda c: c.t <> tn)
       WHEN op = 'add_column' AND list_contains(maps, tn) THEN list_append(cols, struct_pack(t := tn, name := cn, dt := data_type, nul := coalesce(nullable, true), def := v,
            pk := coalesce(pk, false), inl := coalesce(pk, false), fk := false, ref := NULL::VARCHAR))
       WHEN op = 'drop_column' THEN list_filter(cols, lambda c: NOT (c.t = tn AND c.name = cn))
       WHEN op = 'rename_column' THEN {at_first(name='v')}
       WHEN op = 'set_not_null' THEN {at_first(nul='false')} WHEN op = 'drop_not_null' THEN {at_first(nul='true')}
       WHEN op = 'set_default' THEN {at_first(dflt='v')} WHEN op = 'drop_default' THEN {at_first(dflt='NULL::VARCHAR')}
       WHEN op = 'add_constraint' AND ctype LIKE 'FOREIGN KEY%' THEN {within("list_contains(lc, c.name)", fk='true', ref="concat(ref_table, '.', coalesce(ref_cols[1], ''))")}
       WHEN op = 'add_constraint' AND ctype = 'PRIMARY KEY' THEN {within("list_contains(lc, c.name)", pk='true')}
       WHEN op = 'drop_constraint' THEN {dropped}
       ELSE cols END,
  CASE WHEN op = 'drop_table' THEN list_filter(edges, lambda e: e.ft <> tn AND e.tt <> tn)
       WHEN op = 'drop_column' THEN list_filter(edges, lambda e: NOT ((e.ft = tn AND e.fc = cn) OR (e.tt = tn AND e.tc = cn)))
       WHEN op = 'rename_column' THEN list_transform(edges, lambda e: struct_pack(ft := e.ft, fc := CASE WHEN e.ft = tn AND e.fc = cn THEN v ELSE e.fc END, tt := e.tt,
            tc := CASE WHEN e.tt = tn AND e.tc = cn THEN v ELSE e.tc END, seq := e.seq, sub := e.sub, i := e.i))
       WHEN op = 'add_constraint' AND ctype LIKE 'FOREIGN KEY%' THEN list_concat(edges, list_transform(range(1, least(len(lc), coalesce(len(ref_cols), 0)) + 1),
            lambda i: struct_pack(ft := tn, fc := lc[i], tt := ref_table, tc := ref_cols[i], seq := seq, sub := sub, i := i - 1)))
       ELSE edges END,
  CASE WHEN op = 'drop_table' THEN list_filter(idx, lambda x: x.t <> tn)
       WHEN op = 'drop_column' THEN list_filter(idx, lambda x: NOT (x.t = tn AND list_contains(x.cols, cn)))
       WHEN op = 'rename_column' THEN list_transform(idx, lambda x: CASE WHEN x.t = tn THEN struct_pack(t := x.t, name := x.name, cols := {renamed.format(x='x.cols')}, uniq := x.uniq, seq := x.seq) ELSE x END)
       WHEN op = 'create_index' THEN list_append(idx, struct_pack(t := tn, name := v, cols := lc, uniq := coalesce(uniq, false), seq := seq))
       ELSE idx END,
  cons2
 FROM (SELECT f.script_id, l.n, l.seq, l.sub, l.op, l.table_name AS tn, l.column_name AS cn, l.value AS v, l.data_type, l.nullable, l.pk, l.ctype, l.ref_table, l.ref_cols, l.uniq,
              coalesce(l.cols, []) AS lc, f.maps, f.tabs, f.cols, f.edges, f.idx,
              list_position(list_transform(f.cols, lambda c: c.t = l.table_name AND c.name = l.column_name), true) AS hit,
              CASE WHEN l.op = 'drop_table' THEN list_filter(f.cons, lambda k: k.t <> l.table_name)
                   WHEN l.op = 'drop_constraint' THEN list_filter(f.cons, lambda k: NOT (k.t = l.table_name AND k.name = l.value))
                   WHEN l.op = 'drop_column' THEN list_filter(f.cons, lambda k: NOT (k.t = l.table_name AND list_contains(k.cols, l.column_name)))
                   WHEN l.op = 'rename_column' THEN list_transform(f.cons, lambda k: CASE WHEN k.t = l.table_name THEN struct_pack(t := k.t, name := k.name, type := k.type,
                        cols := list_transform(k.cols, lambda y: CASE WHEN y = l.column_name THEN l.value ELSE y END), rt := k.rt, rc := k.rc, seq := k.seq, sub := k.sub) ELSE k END)
                   WHEN l.op = 'add_constraint' THEN list_append(f.cons, struct_pack(t := l.table_name, name := l.value, type := l.ctype, cols := coalesce(l.cols, []), rt := l.ref_table,
                        rc := l.ref_cols, seq := l.seq, sub := l.sub))
                   ELSE f.cons END AS cons2
       FROM fold f JOIN numbered l ON l.script_id = f.script_id AND l.n = f.n + 1)),
final AS (SELECT * FROM fold)"""


_COLUMNS = """cl AS (SELECT script_id, x.t AS table_name, row_number() OVER (PARTITION BY script_id, x.t ORDER BY i) AS ordinal, x.name AS name, x.dt AS data_type, x.nul AS nullable,
       x.def AS default_value, x.pk AS is_primary_key, x.fk AS is_foreign_key, x.ref AS "references" FROM (SELECT script_id, generate_subscripts(cols, 1) AS i, unnest(cols) AS x FROM final))"""
_TABLES = """tb AS (SELECT script_id, x.name AS name, x.sch AS "schema", x.type AS table_type, x.est AS estimated_rows, x.seq AS created_seq, x.sub AS created_sub, i
       FROM (SELECT script_id, generate_subscripts(tabs, 1) AS i, unnest(tabs) AS x FROM final))"""
_EDGES = "ed AS (SELECT script_id, unnest(edges) AS x FROM final)"
_LIST = "CASE WHEN {x} IS NOT NULL THEN to_json({x}) END"


def part_sql(log: str, part: str, strict: bool = False, infer: bool = False) -> str:
    """SQL of one output."""
    head = f"WITH RECURSIVE {replay_sql(log, strict)},\n{_COLUMNS},\n{_TABLES},\n{_EDGES}"
    if part == "tables":
        return f'{head} SELECT script_id, name, "schema", table_type, estimated_rows, created_seq, created_sub FROM tb'
    if part == "columns":
        return f"{head} SELECT * FROM cl"
    if part == "indexes":
        return (f"{head} SELECT script_id, x.name AS name, x.t AS table_name, to_json(x.cols) AS columns, x.uniq AS \"unique\", 'BTREE' AS index_type, x.seq AS created_seq "
                "FROM (SELECT script_id, unnest(idx) AS x FROM final)")
    if part == "constraints":
        return (f"{head} SELECT script_id, x.name AS name, x.t AS table_name, x.type AS constraint_type, to_json(x.cols) AS columns, x.rt AS reference_table, "
                f"{_LIST.format(x='x.rc')} AS reference_columns, x.seq AS created_seq, x.sub AS created_sub FROM (SELECT script_id, unnest(cons) AS x FROM final)")
    edges = "SELECT script_id, x.ft AS from_table, x.fc AS from_column, x.tt AS to_table, x.tc AS to_column, 'FOREIGN_KEY' AS relationship_type"
    if not infer:
        return f"{head} {edges}, x.seq AS created_seq, x.sub AS created_sub, x.i AS created_i FROM ed"
    return f"""{head},
target AS (SELECT tb.script_id, tb.i, tb.name, arg_min(cl.name, cl.ordinal) AS pk FROM tb JOIN cl ON cl.script_id = tb.script_id AND cl.table_name = tb.name AND cl.is_primary_key GROUP BY ALL),
stem AS (SELECT tb.script_id, tb.i AS fi, cl.table_name, cl.ordinal, cl.name, lower(substr(cl.name, 1, length(cl.name) - 3)) AS s
         FROM tb JOIN cl ON cl.script_id = tb.script_id AND cl.table_name = tb.name WHERE ends_with(cl.name, '_id') AND NOT cl.is_foreign_key),
guess AS (SELECT stem.*, target.name AS to_table, target.pk FROM stem JOIN target ON target.script_id = stem.script_id AND lower(target.name) IN (s, s || 's', s || 'es')
          QUALIFY row_number() OVER (PARTITION BY stem.script_id, fi, ordinal ORDER BY target.i) = 1)
{edges} FROM ed UNION ALL SELECT script_id, table_name, name, to_table, pk, 'INFERRED_FK' FROM guess"""
