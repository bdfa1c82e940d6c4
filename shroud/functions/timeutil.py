"""Time helpers independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column.

    TIMESTAMP_NTZ values are wall-clock readings: they are measured from the
    NTZ epoch, so the result does not depend on the session time zone (a cast
    to TIMESTAMP would shift it by the zone's offset). TIMESTAMP values are
    instants: ``unix_micros``."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", _epoch_ntz(), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))
