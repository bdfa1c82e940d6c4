"""Joins over ordered events: the next event of a key, and chains of events.

Times are (seq, sub) pairs. Keys may be hot (one script, one table, one column
with a third of all events), so no step sorts or walks all of a key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Statement numbers per bucket of a key.
WIDTH = 16_384


def at(seq: str = "seq", sub: str = "sub") -> Column:
    return F.struct(F.col(seq).alias("seq"), F.col(sub).alias("sub"))


def after(time: Column, border: Column) -> Column:
    """``time`` lies behind ``border``; a null border lies before everything."""
    return border.isNull() | (time > border)


def next_event(points: DataFrame, events: DataFrame, keys: list[str], payload: list[str], name: str = "next",
               inclusive: bool = False, width: int = WIDTH, last: int | None = None) -> DataFrame:
    """``points`` with ``name``: struct(seq, sub, *payload) of the first of
    ``events`` with the same ``keys`` behind (``inclusive``: or at) the point's
    ``seq, sub``; null where there is none.

    A key's statements are cut into buckets. Inside a bucket the next event is
    the last one seen in falling order; past it, the first event of the next
    bucket that has one, found among one row per bucket. So no task holds more
    of a key than a bucket, and no pair of a point and an event is formed but
    the one that is returned. Where the largest statement number (from 0 on) is
    known as ``last`` and lies in the first bucket, there is no other."""
    event = F.struct("seq", "sub", *payload)
    p = points.select(*keys, "seq", "sub", F.struct(*points.columns).alias("point"))
    e = events.select(*keys, "seq", "sub", event.alias("event"))
    both = (p.unionByName(e, allowMissingColumns=True)
            .withColumn("bucket", F.floor(F.col("seq") / width)))
    tie = F.col("event").isNull()
    falling = (Window.partitionBy(*keys, "bucket")
               .orderBy(F.desc("seq"), F.desc("sub"), tie.asc() if inclusive else tie.desc())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = both.withColumn("near", F.last("event", ignorenulls=True).over(falling)).where("point IS NOT NULL")
    if last is not None and last < width:
        return near.select("point.*", F.col("near").alias(name))
    buckets = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    later = (both.groupBy(*keys, "bucket").agg(F.min("event").alias("first"))
             .select(*keys, "bucket", F.last("first", ignorenulls=True).over(buckets).alias("later")))
    return (near.join(later, [*keys, "bucket"])
            .select("point.*", F.coalesce("near", "later").alias(name)))


def chains(starts: DataFrame, steps: DataFrame, name: str) -> DataFrame:
    """``start, node``: every node that each start reaches. ``starts`` holds
    ``start, node`` (its first node), ``steps`` holds ``node, next`` (null at an
    end). Jumps double each round, so a chain of n nodes takes log2(n) rounds."""
    jumps = steps.where("next IS NOT NULL")
    reached = starts.select("start", "node")
    if jumps.isEmpty():
        return reached
    reached, jumps = written(reached, name), written(jumps.select("node", "next"), name)
    while True:
        more = reached.join(jumps, "node").select("start", F.col("next").alias("node"))
        if more.isEmpty():
            return reached
        reached = written(reached.unionByName(more), name)
        two = jumps.join(jumps.toDF("next", "beyond"), "next").select("node", F.col("beyond").alias("next"))
        jumps = written(two, name)
