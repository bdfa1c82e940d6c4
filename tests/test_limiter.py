"""Admission limiter: distributed plan vs a brute-force sequential fold."""

import random
from datetime import datetime, timedelta

import pytest

from shroud.operators import limiter
from shroud.sources.tables import table
from shroud.streaming import streams as S

from conftest import SF_SMALL


def brute(rows, points, d_us):
    """rows: (key, id, t_us). Per key ordered by (t, id)."""
    out = {}
    by = {}
    for k, i, t in rows:
        by.setdefault(k, []).append((t, i))
    for k, evs in by.items():
        ws, n = None, 0
        for t, i in sorted(evs):
            if ws is None or t >= ws + d_us:
                ws, n = t, 0
            n += 1
            out[i] = (ws, n, n <= points)
    return out


@pytest.mark.parametrize("duration", [60, 3600, 86400 * 7])
def test_events_match_brute_force(spark, duration):
    ev = table(spark, SF_SMALL, "events").select("user_id", "event_id", "ts")
    res = limiter.admission(ev, "user_id", "ts", "event_id", points=3, duration_seconds=duration)
    got = {r.event_id: (r.window_start, r.n, r.admitted) for r in res.collect()}
    rows = [(r.user_id, r.event_id, r.ts) for r in ev.collect()]
    epoch = datetime(1970, 1, 1)
    us = [(k, i, int((t - epoch) / timedelta(microseconds=1))) for k, i, t in rows]
    want = brute(us, 3, duration * 1_000_000)
    assert len(got) == len(want)
    for i, (ws, n, adm) in want.items():
        g = got[i]
        assert (int((g[0] - epoch) / timedelta(microseconds=1)), g[1], g[2]) == (ws, n, adm)


def test_hot_key_and_ties(spark):
    random.seed(7)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):   # one key holds most rows; many equal timestamps
        k = 0 if i % 4 else i % 7
        rows.append((k, i, base + timedelta(seconds=random.randint(0, 900))))
    df = spark.createDataFrame(rows, "key long, id long, ts timestamp_ntz")
    res = limiter.admission(df, "key", "ts", "id", points=10, duration_seconds=60)
    got = {r.id: (r.n, r.admitted) for r in res.collect()}
    epoch = datetime(1970, 1, 1)
    want = brute([(k, i, int((t - epoch) / timedelta(microseconds=1))) for k, i, t in rows],
                 10, 60_000_000)
    assert {i: (v[1], v[2]) for i, v in want.items()} == got


def test_stream_equals_batch(spark, tmp_path):
    given = table(spark, SF_SMALL, "events").select("event_id", "ts", "user_id")
    # a request long after all others, for the watermark to pass them
    last = spark.createDataFrame([(-1, datetime(2030, 1, 1), -1)], "event_id long, ts timestamp_ntz, user_id long")
    for part in (given, last):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    res = S.admission_stream(src, "user_id", "ts", "event_id", 10, 7 * 86400)
    out, ckpt = S.stream_location(spark, "test_admission")
    S.run_stateful(res, out, ckpt)
    rows = spark.read.parquet(out).collect()
    assert not any(r.late for r in rows)
    stream = {(r.id, r.n) for r in rows}
    ev = table(spark, SF_SMALL, "events").select("user_id", "event_id", "ts")
    batch = {(r.event_id, r.n) for r in
             limiter.admission(ev, "user_id", "ts", "event_id", 10, 7 * 86400).collect()}
    assert stream == batch


def test_stream_state_is_of_buckets(spark, tmp_path):
    # many keys share a state row; missing keys and ids and long numbers come out as they went in
    far, base = 2 ** 53 + 1, datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(None if i % 50 == 0 else far + i % 700, None if i == 0 else far + i, base + timedelta(seconds=rng.randint(0, 600)), int(i % 9 == 4)) for i in range(3000)]
    rows += [(far, far - 1, base, 2), (-1, -1, datetime(2030, 1, 1), 3)]  # one behind the watermark; the last of all
    out, ckpt = S.stream_location(spark, "test_buckets")
    state = spark.read.format("statestore").option("path", ckpt).option("stateVarName", "pending")
    for k in range(4):
        part = spark.createDataFrame([r[:3] for r in rows if r[3] == k], "key long, id long, ts timestamp_ntz")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        S.run_stateful(S.admission_stream(src, "key", "ts", "id", 3, 60, watermark="580 seconds"), out, ckpt)
        if k == 2:  # the stream has stopped with most of its requests waiting
            assert 0 < state.load().select("key").distinct().count() <= S.BUCKETS
    got = spark.read.schema(S.ADMISSION_OUT).parquet(out).collect()
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    border = max(us(r[2]) for r in rows if r[3] < 1) // 1000 * 1000 - 580_000_000
    late = {r[1] for r in rows if r[3] in (1, 2) and us(r[2]) <= border}
    assert {r.id for r in got if r.late} == late and far - 1 in late
    # the one missing id stands for itself; a missing key is a key like any other
    want = brute([(r[0] or 0, r[1] or 0, us(r[2])) for r in rows if r[1] not in late and r[3] < 3], 3, 60_000_000)
    assert {r.id or 0: (r.window_start_us, r.n, r.admitted) for r in got if not r.late and r.key != -1} == want
    assert {r.id: r.key for r in got} == {r[1]: r[0] for r in rows if r[3] < 3 or r[0] == far}
