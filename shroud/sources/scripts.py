"""Scripts of any size (S1 + G1): files -> statements, in parallel within a file.

A file is read in byte ranges as records that end at ``;``. Whether a ``;`` ends
a statement depends on the quotes and comments open there, so

1. each range gives the transition table of a small automaton: the state behind
   its last record for each state before its first;
2. the tables of a file, one row per range, are applied in order, which fixes
   the state at each range's start;
3. ranges are then cut into statements independently; a statement that crosses
   ranges is put together from its fragments, at most two a range.

States: ``N`` (a statement begins), ``E`` (inside a statement, outside quotes),
``S`` (in a quoted string), ``B`` (in backticks), ``D`` (in a comment that ends
with the line), ``C`` (in a ``/* */`` comment). No record is longer than a
statement, and no task needs more than a range at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ddl
from ..session import open_folder, ship_package, written
from .tables import DDL_GLOB

STATES = "NESBDC"
# whole tokens from a place outside quotes and comments
_OUTSIDE = re.compile(r"(?:[^'`#/\\-]++|'(?:[^'\\]++|\\.|'')*+'|`[^`]*+`|--[^\n]*+\n|#[^\n]*+\n|/\*.*?\*/|\\.|-(?!-)|/(?!\*))*+", re.S)
# how each state ends inside a record
_ENDS = {"S": re.compile(r"(?:[^'\\]++|\\.|'')*+'", re.S), "B": re.compile(r"[^`]*+`"), "D": re.compile(r"[^\n]*+\n"), "C": re.compile(r".*?\*/", re.S)}


def step(state: str, record: str) -> str:
    """The state behind ``record`` and the ``;`` that ends it."""
    at = 0
    if state in _ENDS:
        m = _ENDS[state].match(record)
        if not m:
            return state
        at = m.end()
    at = _OUTSIDE.match(record, at).end()
    rest = record[at:at + 2]
    if not rest:
        return "N"
    if rest[0] == "\\":  # the ';' is escaped
        return "E"
    return {"'": "S", "`": "B", "#": "D", "-": "D", "/": "C"}[rest[0]]


def _ranges(batches: Iterator) -> Iterator:
    """``path, block, value`` in order -> ``path, block, table`` of each range."""
    import pyarrow as pa

    def row(key, now):
        return pa.RecordBatch.from_pylist([{"path": key[0], "block": key[1], "table": "".join(now[s] for s in STATES)}])

    key, now = None, {}
    for batch in batches:
        for *k, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k != key:
                if key:
                    yield row(key, now)
                key, now = k, {s: s for s in STATES}
            then = {s: step(s, value) for s in set(now.values())}
            now = {s: then[x] for s, x in now.items()}
    if key:
        yield row(key, now)


def _fragments(batches: Iterator) -> Iterator:
    """``path, block, value, state`` -> fragments of statements, numbered in their range."""
    import pyarrow as pa

    names = ["path", "block", "k", "goes_on", "open", "text"]

    def made(rows):
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([
            ("path", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("goes_on", pa.bool_()), ("open", pa.bool_()), ("text", pa.string())]))

    key, state, k, goes_on, held, out, size = None, "N", 0, False, [], [], 0
    for batch in batches:
        for path, block, value, begins in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (path, block) != key:
                if held:
                    out.append((*key, k, goes_on, True, ";".join(held)))
                key, state, k, goes_on, held = (path, block), begins, 0, begins != "N", []
            held.append(value)
            size += len(value)
            state = step(state, value)
            if state == "N":
                out.append((*key, k, goes_on, False, ";".join(held)))
                k, goes_on, held = k + 1, False, []
            if size > 4 << 20 and out:
                yield made(out)
                out, size = [], 0
    if held:
        out.append((*key, k, goes_on, True, ";".join(held)))
    if out:
        yield made(out)


def script_statements(spark: SparkSession, path: str, glob: str = DDL_GLOB) -> DataFrame:
    """``path, seq, stmt`` of all files below ``path`` that match ``glob``: what
    ``ddl.split_statements`` gives for whole texts, without a file ever being
    one row. A quote or comment that never closes holds the file's rest."""
    ship_package(spark)
    records = (spark.read.text(path, lineSep=";", pathGlobFilter=glob, recursiveFileLookup=True)
               .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"))
    tables = written(records.mapInArrow(_ranges, "path string, block long, table string"), "script-ranges")
    # one row per range of a file: the state before each is what the tables before it lead to from N
    states = tables.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "table"))).alias("r")).select("path", F.explode(F.expr(f"""
        aggregate(r, named_struct('s', 'N', 'out', CAST(array() AS ARRAY<STRUCT<block: BIGINT, s: STRING>>)), (a, x) -> named_struct(
            's', substr(x.table, instr('{STATES}', a.s), 1), 'out', array_append(a.out, named_struct('block', x.block, 's', a.s)))).out""")).alias("x"))
    known = F.broadcast(states.select("path", F.col("x.block").alias("block"), F.col("x.s").alias("state")))  # a row per range
    fragments = written(records.join(known, ["path", "block"]).select("path", "block", "value", "state")
                        .mapInArrow(_fragments, "path string, block long, k long, goes_on boolean, open boolean, text string"), "script-fragments")
    whole = fragments.where("NOT goes_on AND NOT open").select("path", "block", "k", "text")
    by_file = Window.partitionBy("path").orderBy("block", "k")
    part = (fragments.where("goes_on OR open").withColumn("n", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(by_file))  # two a range at most
            .groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("block", "k", "text"))).alias("f"))
            .select("path", F.col("f")[0]["block"].alias("block"), F.col("f")[0]["k"].alias("k"), F.array_join(F.transform("f", lambda x: x["text"]), ";").alias("text")))
    cleaned = whole.unionByName(part).withColumn("stmt", ddl.clean(F.col("text"))).where("stmt <> ''").drop("text")
    kept = written(cleaned.withColumn("at", F.row_number().over(Window.partitionBy("path", "block").orderBy("k"))), "script-statements")
    counts = kept.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("path", "block", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return kept.join(F.broadcast(before), ["path", "block"]).select("path", (F.col("before") + F.col("at")).cast("long").alias("seq"), "stmt")


def _writer(folder: str):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, at = open_folder(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1), strict=True):
                if "/" in name:
                    store.create_dir(f"{at}/{name.rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{at}/{name}", compression=None) as out:
                    out.write((content.as_py() or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return write


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row of ``files`` (``name, content``) as a file of ``folder``;
    returns the names. A row written twice (a repeated task) is the same file."""
    ship_package(files.sparkSession)
    return written(files.select("name", "content").mapInArrow(_writer(folder), "name string"), "files-written")
