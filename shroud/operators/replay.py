"""Schema change log -> five catalog tables (G5, G8, G9, G13-G27), by temporal joins.

Only what still stands at the log's end is built, and each output from the
events that can still matter to it:

* lifetimes: per table name, its last CREATE, DROP and TRUNCATE. Columns begin
  anew with each CREATE (the reference overwrites the list); constraints,
  indexes and edges go with DROP TABLE only.
* names: a name in a table is held until the next RENAME from it or DROP COLUMN
  of it (an as-of join). Renames link such holdings into chains, which are
  closed by doubling jumps. A column's id is the event that added it.
* ALTER COLUMN: the last setting per column id (max of a struct of time and
  value, so that NULL defaults count).
* flags: the last key constraint that covered a column id, unless a later DROP
  CONSTRAINT fell into a gap between the intervals in which some constraint of
  that kind covered it (intervals merged by a running maximum of their ends).
* edges: alive while neither end's table or column is dropped, each end's name
  followed by itself.
* CREATE SCHEMA: the first one after the table's creation (an as-of join).

Changes to unknown tables or columns have no effect, as in the reference. A
RENAME or ALTER COLUMN of a name that several columns of a table share (no
database lets a table have such) changes the first of them: see
:meth:`Catalog.holdings`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .temporal import after, at, chains, next_event

_TABLE = ["script_id", "table_name"]
_NAME = [*_TABLE, "name"]
_LOG = ["script_id", "seq", "sub", "op", "table_name", "column_name", "value", "data_type", "nullable", "is_primary_key",
        "constraint_type", "columns", "reference_table", "reference_columns", "is_unique"]


def _id(seq: str = "seq", sub: str = "sub") -> Column:
    """An event's id; ids of one table sort by time."""
    return F.struct("script_id", "table_name", F.col(seq).alias("seq"), F.col(sub).alias("sub"))


def _time(x: str) -> Column:
    return F.when(F.col(x).isNotNull(), at(f"{x}.seq", f"{x}.sub"))


class Catalog(Mapping):
    """The outputs of one change log, each built when it is asked for.

    ``strict=True`` reproduces the reference exactly when a constraint is
    dropped: flags survive only under a remaining constraint typed exactly
    'FOREIGN KEY' / 'PRIMARY KEY' (so FKs with ON DELETE and inline PKs lose
    them); the default keeps FK flags under any remaining FK constraint and
    keeps inline PK flags. ``infer`` appends inferred edges to the
    relationships."""

    PARTS = ("tables", "columns", "relationships", "indexes", "constraints")

    def __init__(self, log: DataFrame, strict: bool = False, infer: bool = False):
        self._source, self.strict, self.infer = log, strict, infer

    def __getitem__(self, part: str) -> DataFrame:
        if part not in self.PARTS:
            raise KeyError(part)
        if part == "relationships" and self.infer:
            names = ["script_id", "from_table", "from_column", "to_table", "to_column", "relationship_type"]
            return self.relationships.select(*names).unionByName(self.inferred.select(*names))
        return getattr(self, part)

    def __iter__(self) -> Iterator[str]:
        return iter(self.PARTS)

    def __len__(self) -> int:
        return len(self.PARTS)

    # ------------------------------------------------------------ lifetimes
    @cached_property
    def log(self) -> DataFrame:
        return written(self._source.select(*_LOG).withColumn("at", at()), "catalog-log")

    @cached_property
    def lives(self) -> DataFrame:
        """Per table name: last ``created``, ``gone`` (dropped as table or
        view), ``wiped`` (dropped as table) and ``emptied``."""
        def last(*ops: str) -> Column:
            return F.max(F.when(F.col("op").isin(*ops), F.col("at")))

        per = self.log.where("table_name IS NOT NULL").groupBy(*_TABLE).agg(
            last("create_table", "create_view").alias("created"), last("drop_table", "drop_view").alias("gone"),
            last("drop_table").alias("wiped"), last("truncate").alias("emptied"))
        return written(per, "catalog-lives")

    @cached_property
    def _last(self) -> int | None:
        """The log's largest statement number, if none is negative."""
        low, high = self.log.agg(F.min("seq"), F.max("seq")).first()
        return high if low is not None and low >= 0 else None

    def _next(self, points: DataFrame, events: DataFrame, keys: list[str], payload: list[str], name: str = "next", inclusive: bool = False) -> DataFrame:
        return next_event(points, events, keys, payload, name, inclusive, last=self._last)

    def _events(self, *ops: str) -> DataFrame:
        return self.log.where(F.col("op").isin(*ops))

    def _current(self, *ops: str) -> DataFrame:
        """Events on the column list that a table has at the end."""
        lists = self.lives.where(F.col("created").isNotNull() & after(F.col("created"), F.col("gone")))
        return (self._events(*ops).join(lists.select(*_TABLE, "created"), _TABLE).where(F.col("at") > F.col("created")).drop("created"))

    def _standing(self, *ops: str) -> DataFrame:
        """Events since the last DROP TABLE of their table."""
        return (self._events(*ops).join(self.lives.select(*_TABLE, "wiped"), _TABLE).where(after(F.col("at"), F.col("wiped"))).drop("wiped"))

    @cached_property
    def tables(self) -> DataFrame:
        made = (self._events("create_table", "create_view").join(self.lives, _TABLE).where(after(F.col("at"), F.col("gone")))
                .select(*_TABLE, "seq", "sub", "at", "emptied", F.when(F.col("op") == "create_table", F.lit("TABLE")).otherwise(F.col("value")).alias("table_type")))
        first = made.groupBy(*_TABLE).agg(F.min("at").alias("first"))
        stamped = self._next(made, self._events("create_schema"), ["script_id"], ["value"])
        return stamped.join(first, _TABLE).select(
            "script_id", F.col("table_name").alias("name"), F.col("next.value").alias("schema"), "table_type",
            F.when((F.col("at") == F.col("first")) & (F.col("emptied") > F.col("at")), F.lit(0)).cast("long").alias("estimated_rows"),
            F.col("seq").alias("created_seq"), F.col("sub").alias("created_sub"))

    # ---------------------------------------------------------------- names
    @staticmethod
    def _named(events: DataFrame, name: str, *more) -> DataFrame:
        return events.select(*_TABLE, F.col(name).alias("name"), "seq", "sub", *more)

    @staticmethod
    def _onward(next_: str = "next") -> Column:
        """Id of the rename that ends a holding; null if something else does."""
        return F.when(F.col(f"{next_}.op") == "rename_column", _id(f"{next_}.seq", f"{next_}.sub"))

    @cached_property
    def holdings(self) -> DataFrame:
        """``column`` (id), ``name``, ``start``, ``next`` (the event that ends
        the holding) of all columns of the current lists.

        A holding begins with the column's ADD or with a RENAME to the name, and
        ends with the next RENAME from it or DROP of it. Where two columns hold
        a name at once, both would take the same RENAME; the first column has
        it, and the others hold on. Such events are settled in order of time,
        the first of each table in each round, as who holds a name there depends
        on earlier ones: no round where names are unique."""
        adds, renames, drops = self._current("add_column"), self._current("rename_column"), self._current("drop_column")
        points = (self._named(adds, "column_name", F.lit(True).alias("added"))
                  .unionByName(self._named(renames, "value", F.lit(False).alias("added"))))
        ends = self._named(renames.unionByName(drops), "column_name", "op")
        held = written(self._next(points, ends, _NAME, ["op"]).withColumn("id", _id()), "catalog-held")
        if held.where("next.op = 'rename_column'").isEmpty():
            return held.where("added").select(F.col("id").alias("column"), *_NAME, at().alias("start"), "next")
        passed = None
        while True:
            to = held.withColumn("to", self._onward()).where("to IS NOT NULL")
            crowded = (to.groupBy(*_TABLE, "to").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                       .groupBy(*_TABLE).agg(F.min("to").alias("to")))
            reached = chains(to.where("added").select(F.col("id").alias("start"), F.col("to").alias("node")),
                             held.where("NOT added").select(F.col("id").alias("node"), self._onward().alias("next")), "catalog-chains")
            if crowded.isEmpty():
                break
            if passed is None:  # what follows a rename for those that do not get it
                passed = written(self._next(self._named(renames, "column_name"), ends, _NAME, ["op"])
                                 .select(_id().alias("to"), F.col("next").alias("later")), "catalog-passed")
            rooted = (to.join(crowded.select("to"), "to").join(reached.withColumnRenamed("node", "id"), "id", "left")
                      .select("id", "to", F.when(F.col("added"), F.col("id")).otherwise(F.col("start")).alias("root")))
            best = rooted.groupBy("to").agg(F.min("root").alias("best"))
            # a rename that moves no column has no root; it leads nowhere from now on
            lost = (rooted.join(best, "to").where("root IS NULL OR root <> best").join(passed, "to", "left")
                    .select("id", F.when(F.col("root").isNotNull(), F.col("later")).alias("later"), F.lit(True).alias("lost")))
            held = written(held.join(lost, "id", "left").withColumn("next", F.when(F.col("lost"), F.col("later")).otherwise(F.col("next")))
                           .drop("later", "lost"), "catalog-held")
        first = held.where("added").withColumn("column", F.col("id"))
        more = reached.withColumnRenamed("node", "id").join(held.where("NOT added"), "id").withColumnRenamed("start", "column")
        return written(first.unionByName(more, allowMissingColumns=True).select("column", *_NAME, at().alias("start"), "next"), "catalog-holdings")

    def _traces(self, tokens: DataFrame) -> DataFrame:
        """The holdings of names in lists and edges: ``owner, place, name,
        start, next`` for each of ``tokens`` (``owner, place`` and a name in a
        table from a time on). Unlike a column, each takes every rename."""
        renames = self._standing("rename_column")
        nodes = self._named(renames, "value")
        ends = self._named(renames.unionByName(self._standing("drop_column")), "column_name", "op")
        held = written(self._next(tokens.unionByName(nodes, allowMissingColumns=True), ends, _NAME, ["op"])
                       .withColumns({"id": _id(), "to": self._onward()}), "catalog-tokens")
        first, later = held.where("owner IS NOT NULL"), held.where("owner IS NULL")
        if first.where("to IS NOT NULL").isEmpty():
            return first.select("owner", "place", *_NAME, at().alias("since"), "next")
        reached = chains(first.where("to IS NOT NULL").select(F.struct("owner", "place").alias("start"), F.col("to").alias("node")),
                         later.select(F.col("id").alias("node"), F.col("to").alias("next")), "catalog-chains")
        more = (reached.withColumnRenamed("node", "id").join(later.drop("owner", "place"), "id")
                .withColumns({"owner": F.col("start.owner"), "place": F.col("start.place")}))
        return first.unionByName(more, allowMissingColumns=True).select("owner", "place", *_NAME, at().alias("since"), "next")

    @staticmethod
    def _lists(traces: DataFrame) -> DataFrame:
        """Per owner: its ``names`` now, in order, and when the first of them was ``killed``."""
        last = traces.where("next IS NULL OR next.op = 'drop_column'")
        return last.groupBy("owner").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"),
            F.min(_time("next")).alias("killed"))

    @staticmethod
    def _tokens(owners: DataFrame, names: str = "columns") -> DataFrame:
        return owners.select("script_id", "table_name", "seq", "sub", _id().alias("owner"), F.posexplode(names).alias("place", "name"))

    # ------------------------------------------------ lists with an owner
    @cached_property
    def indexes(self) -> DataFrame:
        made = self._standing("create_index").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
        lists = self._lists(self._traces(self._tokens(made)))
        return (made.withColumn("owner", _id()).join(lists, "owner", "left").where("killed IS NULL").select(
            "script_id", F.col("value").alias("name"), "table_name", F.coalesce("names", "columns").alias("columns"), F.coalesce("is_unique", F.lit(False)).alias("unique"),
            F.lit("BTREE").alias("index_type"), F.col("seq").alias("created_seq")))

    @cached_property
    def _constraints(self) -> DataFrame:
        """All constraints since their table's last DROP, with ``owner`` and the DROP CONSTRAINT that took them."""
        made = self._standing("add_constraint").select(*_TABLE, F.col("value").alias("name"), "seq", "sub", "at", "constraint_type", "reference_table", "reference_columns",
                                                       F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), _id().alias("owner"))
        return written(self._next(made, self._named(self._standing("drop_constraint"), "value"), _NAME, [], "dropped"), "catalog-constraints")

    @cached_property
    def _constraint_traces(self) -> DataFrame:
        return written(self._traces(self._tokens(self._constraints)), "catalog-traces")

    @cached_property
    def constraints(self) -> DataFrame:
        return (self._constraints.where("dropped IS NULL").join(self._lists(self._constraint_traces), "owner", "left").where("killed IS NULL").select(
            "script_id", "name", "table_name", "constraint_type", F.coalesce("names", "columns").alias("columns"), "reference_table", "reference_columns",
            F.col("seq").alias("created_seq"), F.col("sub").alias("created_sub")))

    @cached_property
    def relationships(self) -> DataFrame:
        keys = (self._standing("add_constraint").where(F.col("constraint_type").startswith("FOREIGN KEY"))
                .join(self.lives.select("script_id", F.col("table_name").alias("reference_table"), "wiped"), ["script_id", "reference_table"], "left")
                .where(after(F.col("at"), F.col("wiped"))))
        n = F.least(F.size(F.coalesce("columns", F.array())), F.size(F.coalesce("reference_columns", F.array())))
        near = self._tokens(keys.withColumn("names", F.slice("columns", 1, n)), "names").withColumn("place", F.col("place") * 2)
        far = (keys.select("script_id", "table_name", "reference_table", "seq", "sub", _id().alias("owner"), F.posexplode(F.slice("reference_columns", 1, n)).alias("place", "name"))
               .drop("table_name").withColumnRenamed("reference_table", "table_name").withColumn("place", F.col("place") * 2 + 1))
        last = self._traces(near.unionByName(far)).where("next IS NULL").withColumn("far", F.col("place") % 2 == 1)
        both = last.groupBy("owner", F.floor(F.col("place") / 2).alias("i")).agg(
            F.max(F.when(~F.col("far"), F.col("name"))).alias("from_column"), F.max(F.when(F.col("far"), F.col("name"))).alias("to_column"),
            F.max(F.when(F.col("far"), F.col("table_name"))).alias("to_table"))
        return both.where("from_column IS NOT NULL AND to_column IS NOT NULL").select(
            "owner.script_id", F.col("owner.table_name").alias("from_table"), "from_column", "to_table", "to_column", F.lit("FOREIGN_KEY").alias("relationship_type"),
            F.col("owner.seq").alias("created_seq"), F.col("owner.sub").alias("created_sub"), F.col("i").alias("created_i"))

    # -------------------------------------------------------------- columns
    @cached_property
    def _final(self) -> DataFrame:
        """``column, final`` (name) of the columns that stand at the end."""
        return self.holdings.where("next IS NULL").select("column", F.col("name").alias("final"))

    def _covered(self, points: DataFrame) -> DataFrame:
        """``points`` (a name in a table at a time ``at``) with each ``column`` that holds the name then."""
        h = self.holdings.select("column", *_NAME, "start", _time("next").alias("end"))
        return points.join(h, _NAME).where((F.col("start") < F.col("at")) & (F.col("end").isNull() | (F.col("at") < F.col("end"))))

    def _settings(self) -> DataFrame:
        """Last nullability and default of each column that was altered."""
        sets = self._current("set_not_null", "drop_not_null", "set_default", "drop_default").select(
            *_TABLE, F.col("column_name").alias("name"), "at", "op", "value")
        first = self._covered(sets).groupBy("script_id", "table_name", "at").agg(F.min("column").alias("column"), F.any_value("op").alias("op"), F.any_value("value").alias("value"))
        null = F.col("op").isin("set_not_null", "drop_not_null")
        return first.groupBy("column").agg(
            F.max(F.when(null, F.struct("at", (F.col("op") == "drop_not_null").alias("nullable")))).alias("null_set"),
            F.max(F.when(~null, F.struct("at", F.when(F.col("op") == "set_default", F.col("value")).alias("value")))).alias("default_set"))

    def _keys(self) -> DataFrame:
        """The last key constraints that covered each column: ``column, fk`` (time and reference), ``pk`` (time)."""
        kind = F.when(F.col("constraint_type").startswith("FOREIGN KEY"), F.lit("fk")).when(F.col("constraint_type") == "PRIMARY KEY", F.lit("pk"))
        made = self._current("add_constraint").withColumn("kind", kind).where("kind IS NOT NULL")
        reference = F.concat(F.coalesce("reference_table", F.lit("")), F.lit("."), F.coalesce(F.try_element_at("reference_columns", F.lit(1)), F.lit("")))
        points = made.select(*_TABLE, "at", "kind", reference.alias("reference"), F.explode(F.array_distinct("columns")).alias("name"))
        return self._covered(points).groupBy("column").agg(
            F.max(F.when(F.col("kind") == "fk", F.struct("at", "reference"))).alias("fk"), F.max(F.when(F.col("kind") == "pk", F.col("at"))).alias("pk"))

    def _cleared(self, since: DataFrame) -> DataFrame:
        """``column, kind`` of those flags (``column, kind, at``: set at a time)
        that a DROP CONSTRAINT clears: one that comes while no constraint of the
        kind covers the column."""
        exact = F.col("constraint_type") == "FOREIGN KEY"
        kind = (F.when(exact if self.strict else F.col("constraint_type").startswith("FOREIGN KEY"), F.lit("fk"))
                .when(F.col("constraint_type") == "PRIMARY KEY", F.lit("pk")))
        traces = self._constraint_traces
        over = (self._constraints.withColumn("kind", kind).where("kind IS NOT NULL").select("owner", "kind", _time("dropped").alias("dropped"))
                .join(self._lists(traces).select("owner", "killed"), "owner").select("owner", "kind", F.least("dropped", "killed").alias("over")))
        cover = (traces.join(over, "owner").select(*_NAME, "kind", "since", F.least(_time("next"), F.col("over")).alias("until")))
        h = self.holdings.select("column", *_NAME, "start", _time("next").alias("end"))
        spans = (cover.join(h, _NAME).select("column", "kind", F.greatest("since", "start").alias("from"), F.least("until", "end").alias("to"))
                 .where(F.col("to").isNull() | (F.col("from") < F.col("to"))))
        ever = F.struct(F.lit((1 << 63) - 1).alias("seq"), F.lit((1 << 63) - 1).alias("sub"))
        spans = (since.select("column", "kind", F.col("at").alias("from"), F.col("at").alias("to"))
                 .unionByName(spans.join(since, ["column", "kind"]).where(F.col("to").isNull() | (F.col("to") > F.col("at"))).drop("at"))
                 .withColumn("to", F.coalesce("to", ever)))
        w = Window.partitionBy("column", "kind").orderBy("from", "to")
        gaps = (spans.withColumns({"gap": F.max("to").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "again": F.lead("from").over(w)})
                .where((F.col("gap") < ever) & (F.col("again").isNull() | (F.col("gap") < F.col("again")))))
        points = gaps.select("column.script_id", "column.table_name", "gap.seq", "gap.sub", "column", "kind", "again")
        hit = self._next(points, self._current("drop_constraint").select(*_TABLE, "seq", "sub"), _TABLE, [], inclusive=True)
        return (hit.where(F.col("next").isNotNull() & (F.col("again").isNull() | (_time("next") < F.col("again"))))
                .select("column", "kind", F.lit(True).alias("cleared")).distinct())

    @cached_property
    def columns(self) -> DataFrame:
        inline = F.coalesce("is_primary_key", F.lit(False))
        c = (self._final.join(self._current("add_column").withColumn("column", _id()), "column")
             .join(self._settings(), "column", "left").join(self._keys(), "column", "left"))
        if self.strict:
            c = c.withColumn("pk", F.when(inline, F.greatest("pk", "at")).otherwise(F.col("pk")))
        c = c.withColumns({"fk_cleared": F.lit(False), "pk_cleared": F.lit(False)})
        if not self._current("drop_constraint").isEmpty():
            c = written(c, "catalog-columns")
            since = (c.select("column", F.lit("fk").alias("kind"), F.col("fk.at").alias("at")).unionByName(c.select("column", F.lit("pk").alias("kind"), F.col("pk").alias("at")))
                     .where("at IS NOT NULL"))
            out = self._cleared(since).groupBy("column").agg(F.max(F.col("kind") == "fk").alias("f"), F.max(F.col("kind") == "pk").alias("p"))
            c = c.join(out, "column", "left").withColumns({"fk_cleared": F.coalesce("f", F.lit(False)), "pk_cleared": F.coalesce("p", F.lit(False))})
        fk = F.col("fk").isNotNull() & ~F.col("fk_cleared")
        pk = F.col("pk").isNotNull() & ~F.col("pk_cleared")
        order = F.row_number().over(Window.partitionBy(*_TABLE).orderBy("seq", "sub")).cast("long")
        return c.select(
            "script_id", "table_name", order.alias("ordinal"), F.col("final").alias("name"), "data_type",
            F.coalesce("null_set.nullable", "nullable", F.lit(True)).alias("nullable"),
            F.when(F.col("default_set").isNotNull(), F.col("default_set.value")).otherwise(F.col("value")).alias("default_value"),
            (pk if self.strict else inline | pk).alias("is_primary_key"), fk.alias("is_foreign_key"), F.when(fk, F.col("fk.reference")).alias("references"))

    # ------------------------------------------------------------ inference
    @cached_property
    def inferred(self) -> DataFrame:
        """G26 on this catalog's tables (in order of creation) and columns."""
        place = at("created_seq", "created_sub")
        tables, cols = self.tables.withColumn("place", place), written(self.columns, "catalog-columns")
        first_pk = cols.where("is_primary_key").groupBy(*_TABLE).agg(F.min(F.struct("ordinal", "name")).alias("pk"))
        named = tables.select("script_id", F.col("name").alias("table_name"), "place")
        targets = named.join(first_pk, _TABLE).select("script_id", F.col("place").alias("table_pos"), "table_name", F.col("pk.name").alias("pk_column"))
        found = named.join(cols, _TABLE).select("script_id", F.col("table_name").alias("from_table"), F.col("place").alias("from_pos"), "ordinal",
                                                F.col("name").alias("column_name"), "is_foreign_key")
        return infer_foreign_keys(found, targets)


def replay(log: DataFrame, strict: bool = False) -> Catalog:
    """Change log -> {tables, columns, relationships, indexes, constraints}."""
    return Catalog(log, strict)


def catalog(log: DataFrame, strict: bool = False, infer: bool = True) -> Catalog:
    """The five catalog outputs; inferred edges are appended to
    ``relationships`` (explicit edges first, then inferred)."""
    return Catalog(log, strict, infer)


def infer_foreign_keys(candidates: DataFrame, targets: DataFrame, suffix: str = "_id",
                       drop_self: bool = False) -> DataFrame:
    """Name-based FK inference as an equi-join.

    ``candidates(script_id, from_table, from_pos, ordinal, column_name, is_foreign_key)``:
    columns to test, ``from_pos`` = position of the owning table row.
    ``targets(script_id, table_pos, table_name, pk_column)``: table rows in
    creation order with their first primary-key column (rows without a PK are
    not targets: the search goes on past them).

    A column named ``<stem>_id`` (case-sensitive suffix) that is not already a
    foreign key points to the first target whose lower-cased name is
    ``stem``, ``stem + 's'`` or ``stem + 'es'`` (lower-cased)."""
    c = (candidates.where(F.col("column_name").endswith(suffix) & ~F.col("is_foreign_key"))
         .withColumn("stem", F.lower(F.expr(f"substring(column_name, 1, length(column_name) - {len(suffix)})")))
         .select("*", F.explode(F.array(F.col("stem"), F.concat("stem", F.lit("s")),
                                        F.concat("stem", F.lit("es")))).alias("cand")))
    # Rows of one table name share its columns, so only a name's first row can
    # win: keep one target per exact name before joining (a name created a
    # million times still joins once).
    t = (targets.groupBy("script_id", "table_name")
         .agg(F.min(F.struct("table_pos", "pk_column")).alias("f"))
         .select("script_id", F.col("f.table_pos").alias("table_pos"),
                 F.col("table_name").alias("to_table"), F.col("f.pk_column").alias("pk_column"),
                 F.lower("table_name").alias("cand")))
    j = c.join(t, ["script_id", "cand"])
    if drop_self:
        j = j.where(F.col("to_table") != F.col("from_table"))
    w = Window.partitionBy("script_id", "from_pos", "ordinal").orderBy("table_pos")
    return (j.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1)
            .select("script_id", "from_table", F.col("column_name").alias("from_column"), "to_table",
                    F.col("pk_column").alias("to_column"),
                    F.lit("INFERRED_FK").alias("relationship_type"), "from_pos", "ordinal"))
