"""Streaming queries: a file source over the driver
tables is processed with ``availableNow`` into a sink under the shared
checkpoint folder; the query returns the sink as a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.timeutil import epoch_micros
from ..operators import limiter
from ..sources.tables import table
from ..streaming import streams as S
from . import oracle as O
from .q_limiter import _oracle as admission_oracle
from .registry import register


def _file_stream(spark, sf_dir, name, cols):
    """The table as a stream of files: one Parquet file or a folder of them (a
    pattern finds both; the file source takes no plain file's path)."""
    schema = table(spark, sf_dir, name).select(*cols).schema
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", 1 << 30)
            .parquet(f"{sf_dir.rstrip('/')}/{{{name}}}.parquet"))


@register("mask_stream_documents",
          f"SELECT doc_id, {O.mask_text_sql('text')} AS text FROM documents", "M14")
def mask_stream_documents(spark, sf_dir):
    src = _file_stream(spark, sf_dir, "documents", ["doc_id", "text"])
    out, ckpt = S.stream_location(spark, f"mask_documents-{uuid.uuid4().hex}")
    par = spark.sparkContext.defaultParallelism
    masked = S.mask_stream(src, "doc_id", ["text"], partitions=par)
    S.run_available_now(masked, out, ckpt)
    return spark.read.schema(masked.schema).parquet(out)


@register("admission_stream_events_7d", admission_oracle(7 * 86400, limiter.POINTS), "X7")
def admission_stream_events_7d(spark, sf_dir):
    """The events as four files in the order of time, one micro-batch each: state
    is carried from batch to batch and the query is stopped and resumed."""
    r = _admitted(spark, table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), F.lit(0))
    return r.where("NOT late").drop("late")


# every 20th event comes one file later than its time, every 3rd of those two
_DELAY = "CASE WHEN event_id % 60 = 7 THEN 2 WHEN event_id % 20 = 7 THEN 1 ELSE 0 END"
_LATE_ORACLE = f"""
WITH RECURSIVE b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
f AS (SELECT user_id, event_id, epoch_us(ts) AS t, least(3, CAST(least(3, (epoch_us(ts) - lo) * 4 // greatest(hi - lo, 1)) AS BIGINT) + {_DELAY}) AS file FROM events, b),
w AS (SELECT file, max(max(t)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {{wait}} AS border FROM f GROUP BY file),
j AS (SELECT f.*, coalesce(t <= border, false) AS late FROM f JOIN w USING (file)),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM j WHERE NOT late),
r AS (SELECT user_id, event_id, t, rn, t AS ws, CAST(1 AS BIGINT) AS n FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.t, e.rn, CASE WHEN e.t >= r.ws + {7 * 86400 * 1_000_000} THEN e.t ELSE r.ws END,
                       CASE WHEN e.t >= r.ws + {7 * 86400 * 1_000_000} THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, t AS ts_us, ws AS window_start_us, n, n <= {limiter.POINTS} AS admitted, false AS late FROM r
UNION ALL SELECT user_id, event_id, t, NULL, NULL, NULL, true FROM j WHERE late"""


@register("admission_stream_late_events_7d", _LATE_ORACLE.format(wait=2 * 86400 * 1_000_000), "X7")
def admission_stream_late_events_7d(spark, sf_dir):
    """The same with events that come out of order, some behind the watermark
    (two days): those are marked late and spend nothing."""
    return _admitted(spark, table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), F.expr(_DELAY), "2 days")


def _admitted(spark, ev, delay, watermark="1 hour"):
    """The limiter over ``ev`` dealt to four files by time, each row ``delay``
    files later, and a last request of no user far ahead, which lets the
    watermark pass all others."""
    name = f"admission_events-{uuid.uuid4().hex}"
    folder = S.stream_location(spark, name)[0] + "-in"
    t = epoch_micros(ev, "ts")
    lo, hi = ev.select(t.alias("t")).agg(F.min("t"), F.max("t")).first()
    quarter = F.least(F.lit(3), F.floor((F.col("t") - F.lit(lo or 0)) * 4 / F.lit(max((hi or 0) - (lo or 0), 1))))
    dealt = ev.withColumn("t", t).withColumn("file", F.least(F.lit(3), quarter + delay))
    for k in range(4):
        dealt.where(F.col("file") == k).select(*ev.columns).repartition(1).write.mode("append").parquet(folder)
        if k == 1:
            _admit(spark, folder, ev.schema, name, watermark)
    last = spark.range(1).select(F.lit(-1).cast(ev.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast(ev.schema["event_id"].dataType).alias("event_id"),
                                 (F.timestamp_micros(F.lit(hi or 0)) + F.expr("INTERVAL 30 DAYS")).cast(ev.schema["ts"].dataType).alias("ts"))
    last.coalesce(1).write.mode("append").parquet(folder)
    _admit(spark, folder, ev.schema, name, watermark)
    r = spark.read.schema(S.ADMISSION_OUT).parquet(S.stream_location(spark, name)[0])
    return r.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "ts_us", "window_start_us", "n", "admitted", "late")


def _admit(spark, folder, schema, name, watermark):
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    res = S.admission_stream(src, "user_id", "ts", "event_id", limiter.POINTS, 7 * 86400, watermark)
    S.run_stateful(res, *S.stream_location(spark, name))
