"""Admission limiter queries on the ``events`` log."""

from __future__ import annotations

from ..functions.timeutil import epoch_micros
from ..operators import limiter
from ..sources.tables import table
from .registry import register


def _oracle(duration_seconds: int, points: int) -> str:
    d = duration_seconds * 1_000_000
    return f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, ts, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events
), r AS (
  SELECT user_id, event_id, ts, rn, t AS ws, ts AS window_start, CAST(1 AS BIGINT) AS n
  FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.ts, e.rn,
         CASE WHEN e.t >= r.ws + {d} THEN e.t ELSE r.ws END,
         CASE WHEN e.t >= r.ws + {d} THEN e.ts ELSE r.window_start END,
         CASE WHEN e.t >= r.ws + {d} THEN 1 ELSE r.n + 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1
)
SELECT user_id, event_id, epoch_us(ts) AS ts_us, epoch_us(window_start) AS window_start_us, n,
       n <= {points} AS admitted FROM r
"""


def micros_output(res):
    """Timestamps as epoch microseconds (engine- and time-zone-neutral)."""
    return res.select("user_id", "event_id", epoch_micros(res, "ts").alias("ts_us"),
                      "window_start_us", "n", "admitted")


def _query(duration_seconds: int, points: int = limiter.POINTS):
    def run(spark, sf_dir):
        ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
        res = limiter.admission(ev, key="user_id", ts="ts", id_col="event_id",
                                points=points, duration_seconds=duration_seconds)
        return micros_output(res)
    return run


register("admission_events_60s", _oracle(60, 10), "X6")(_query(60))
# a budget of one request a window, so that requests are rejected
register("admission_events_60s_1point", _oracle(60, 1), "X6")(_query(60, points=1))
register("admission_events_7d", _oracle(7 * 86400, 10), "X6")(_query(7 * 86400))
