"""Structured Streaming jobs: stateless masking (M14) and the stateful
admission limiter (X7).

Sinks and checkpoints live under the session's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local path, so a restarted query
resumes from its offsets and state after executor or driver loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.masking import mask_text
from ..functions.timeutil import epoch_micros
from ..session import checkpoint_dir, ship_package


def stream_location(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output path, checkpoint path) for a stream, under the shared folder.
    The name is the stream's identity: started again under it, it resumes."""
    run = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    return f"{run}/out", f"{run}/checkpoint"


def mask_stream(source: DataFrame, id_col: str, text_cols: list[str],
                partitions: int | None = None) -> DataFrame:
    """The batch masking expression on an unbounded table (stateless).

    ``partitions``: spread each micro-batch round-robin before the regex work
    when the source delivers few, large files per trigger."""
    if partitions:
        source = source.repartition(partitions)
    return source.select(id_col, *[mask_text(c).alias(c) for c in text_cols])


def run_available_now(df: DataFrame, out: str, ckpt: str, fmt: str = "parquet") -> None:
    """Process everything available, in micro-batches, then stop."""
    q = (df.writeStream.format(fmt).option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


# --- X7: admission limiter as a stateful stream --------------------------------------

# times are epoch microseconds (longs): no time-zone conversion on the way out
ADMISSION_OUT = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("ts_us", T.LongType()), T.StructField("window_start_us", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("admitted", T.BooleanType()), T.StructField("late", T.BooleanType())])
BLOCK = T.StructType([T.StructField("block", T.BinaryType())])

#: State keys over which a stream's keys are dealt.
BUCKETS = 512
#: Requests in one block of the state, and in one frame of the answer.
BLOCK_ROWS = 65_536
NO_KEY, NO_ID = 1, 2


class Admission(StatefulProcessor):
    """The keys of one bucket: requests wait until the watermark has passed them,
    then spend their key's points in order of (time, id). What arrives behind the
    watermark is late: it spends nothing and comes out marked as late.

    Each call to the state is a message to Spark, so the state is a few blocks of
    64-bit numbers for all keys of a bucket and no entry per key or request:
    ``pending`` holds rows of (flags, key, time, id), ``windows`` rows of (flags,
    key, start, number). A window that the watermark has passed is forgotten, as
    the key's next request opens another."""

    def __init__(self, points: int, duration_us: int):
        self.points, self.duration = points, duration_us

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", BLOCK)
        self.windows = handle.getValueState("windows", BLOCK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, n = [], 0
        for frame in rows:
            part = frame[["flags", "key", "t", "id"]].to_numpy("int64")
            late = part[:, 2] <= border
            if late.any():
                yield _answer(part[late])
            waiting.append(part[~late])
            n += len(waiting[-1])
            if n >= BLOCK_ROWS:
                self._wait(np.concatenate(waiting))
                waiting, n = [], 0
        if n:
            self._wait(np.concatenate(waiting))

    def _wait(self, waiting: np.ndarray) -> None:
        for i in range(0, len(waiting), BLOCK_ROWS):
            self.pending.appendList([(waiting[i:i + BLOCK_ROWS].tobytes(),)])
        self.handle.registerTimer(-(-int(waiting[:, 2].min()) // 1000))  # the first watermark (in ms) that covers one

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [_rows(b) for b, in self.pending.get()]
        if not any((b[:, 2] <= border).any() for b in blocks):  # another timer of this bucket has dealt with them
            return
        waiting = np.concatenate(blocks)
        due, later = waiting[waiting[:, 2] <= border], waiting[waiting[:, 2] > border]
        self.pending.clear()
        if len(later):
            self._wait(later)
        # by key, then (time, id), a missing id first
        due = due[np.lexsort((due[:, 3], due[:, 0] & NO_ID == 0, due[:, 2], due[:, 1], due[:, 0] & NO_KEY))]
        start, number = self._spend(due, border)
        for i in range(0, len(due), BLOCK_ROWS):
            yield _answer(due[i:i + BLOCK_ROWS], start[i:i + BLOCK_ROWS], number[i:i + BLOCK_ROWS], self.points)

    def _spend(self, due: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray]:
        """Window start and number in it of each of the ordered requests; the
        open windows go back to the state."""
        old = _rows(self.windows.get()[0]).tolist() if self.windows.exists() else []
        windows = {(none, key): (ws, n) for none, key, ws, n in old}
        start, number = [], []
        owner, ws, n = None, None, 0
        for none, key, t in zip((due[:, 0] & NO_KEY).tolist(), due[:, 1].tolist(), due[:, 2].tolist(), strict=True):
            if (none, key) != owner:
                if owner is not None:
                    windows[owner] = ws, n
                owner = none, key
                ws, n = windows.get(owner, (None, 0))
            if ws is None or t >= ws + self.duration:
                ws, n = t, 0
            n += 1
            start.append(ws)
            number.append(n)
        windows[owner] = ws, n
        kept = [(*k, *w) for k, w in windows.items() if w[0] + self.duration > border]
        if kept:
            self.windows.update((np.array(kept, "int64").tobytes(),))
        else:
            self.windows.clear()
        return np.array(start, "int64"), np.array(number, "int64")

    def close(self) -> None:
        pass


def _rows(block: bytes) -> np.ndarray:
    return np.frombuffer(bytes(block), "int64").reshape(-1, 4)


def _answer(requests: np.ndarray, start: np.ndarray | None = None, number: np.ndarray | None = None, points: int = 0) -> pd.DataFrame:
    """Rows of :data:`ADMISSION_OUT`; without windows for late requests."""
    late = start is None
    none = np.full(len(requests), late)
    flags, zero = requests[:, 0], np.zeros(len(requests), "int64")
    number = zero if late else number

    def longs(values: np.ndarray, missing: np.ndarray) -> pd.arrays.IntegerArray:
        return pd.arrays.IntegerArray(values.copy(), missing)

    return pd.DataFrame({
        "key": longs(requests[:, 1], flags & NO_KEY != 0), "id": longs(requests[:, 3], flags & NO_ID != 0), "ts_us": requests[:, 2],
        "window_start_us": longs(zero if late else start, none), "n": longs(number, none),
        "admitted": pd.arrays.BooleanArray(number <= points, none), "late": none})


def admission_stream(source: DataFrame, key: str, ts: str, id_col: str, points: int,
                     duration_seconds: int, watermark: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Per-key anchored fixed windows; the rows of the batch audit (X6) over
    all requests that are not late, and the late ones with ``late`` true and no
    window.

    A request comes out once the watermark (``watermark`` behind the newest
    request) has passed it, so requests may arrive out of order within that
    time; what is still waiting when a stream stops comes out when it resumes
    and goes on. Keys are dealt over ``buckets`` by hash; a bucket's state is its
    keys' waiting requests and open windows, which its task holds in memory. A
    stream that is started again must keep the number of buckets. Needs the
    RocksDB state store (see :func:`run_stateful`)."""
    ship_package(source.sparkSession)
    # event time in epoch microseconds, independent of the session time zone; the watermark's own
    # column goes no further, or Spark would drop late requests before they are counted
    ev = source.select(F.col(key).cast("long").alias("key"), F.col(id_col).cast("long").alias("id"),
                       epoch_micros(source, ts).alias("t"))
    # a column with nulls would reach Python as floating point: flags say what is missing
    flags = F.when(F.col("key").isNull(), NO_KEY).otherwise(0) + F.when(F.col("id").isNull(), NO_ID).otherwise(0)
    ev = (ev.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", watermark)
          .select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), flags.cast("long").alias("flags"),
                  F.coalesce("key", F.lit(0)).alias("key"), "t", F.coalesce("id", F.lit(0)).alias("id")))
    return ev.groupBy("bucket").transformWithStateInPandas(
        Admission(points, int(duration_seconds) * 1_000_000), ADMISSION_OUT, "append", "eventTime")


_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_stateful(df: DataFrame, out: str, ckpt: str) -> None:
    """:func:`run_available_now` with the RocksDB state store, which list state
    and timers need; the session's own setting is put back."""
    conf = df.sparkSession.conf
    old = conf.get(_STORE)
    conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_available_now(df, out, ckpt)
    finally:
        conf.set(_STORE, old)
