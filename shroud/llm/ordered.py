"""Positions and running sums within groups of any size.

A window over a group sorts and walks it in one task. Here the rows are dealt
by ranges of (group, order), so a large group lies in several tasks; each task
numbers and sums its own part, and what lies before a part is added from a
table of at most two rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, ship_package


def _local(group: int, sums: list[int], schema_names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen, last, held = False, None, [0] * (1 + len(sums))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = not seen or g[0].as_py() != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            columns = []
            for k, c in enumerate([None, *sums]):
                value = np.ones(n, np.int64) if c is None else batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(value)])
                before = np.where(start < 0, upto[:-1] + held[k], upto[:-1] - upto[np.maximum(start, 0)])
                held[k] = int(before[-1] + value[-1])
                columns.append(before)
            first = np.zeros(n, bool)
            first[0] = not seen
            seen, last = True, g[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns), pa.array(np.full(n, part, np.int64)), pa.array(first)],
                                             names=schema_names)

    return run


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, str], position: str, name: str) -> DataFrame:
    """``df`` with ``position`` (a row's number in its group, from 0, by
    ``order``) and, for each ``new: column`` of ``sums``, the sum of the
    (non-null, long) column over the group's rows before it.

    The group must not be null. Rows that tie in ``order`` come in any order.
    An empty table gives no rows."""
    ship_package(df.sparkSession)
    added = [position, *sums]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in [*added, "__part"]], T.StructField("__first", T.BooleanType())])
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    parts = save(ranged.mapInArrow(_local(df.columns.index(group), [df.columns.index(c) for c in sums.values()], schema.names), schema), name)
    # groups that begin a task's part, one a task, may go on from the part before
    heads = parts.where("__first").select(group).distinct()
    held = (parts.join(F.broadcast(heads), group, "left_semi").groupBy(group, "__part")
            .agg(F.count(F.lit(1)).alias(f"__{position}"), *[F.sum(c).alias(f"__{new}") for new, c in sums.items()]))
    w = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(group, "__part", *[F.coalesce(F.sum(f"__{c}").over(w), F.lit(0)).alias(f"__{c}") for c in added])
    return (parts.join(F.broadcast(offsets), [group, "__part"], "left")
            .select(*df.columns, *[(F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in added]))
