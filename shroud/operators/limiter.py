"""Admission limiter over a request log (batch audit, X6).

Semantics (fixed-window limiter anchored at each key's first request): a
window opens at a request time ``w`` and lasts ``duration``; every request in
``[w, w + duration)`` spends one point, rejected ones included; the request
is admitted while its position ``n`` in the window is ``<= points``. The first
request at or after ``w + duration`` opens the next window. Requests are
ordered by (ts, id).

Distributed plan (no key is ever gathered into one task):

1. ``next(i)``: the first request of the same key at or after ``t_i + D``.
   With buckets ``b = floor(t / D)`` it lies in bucket ``b_i + 1`` (found by an
   as-of lookup inside the (key, bucket) partition), or else it is the first
   request of the first non-empty bucket after ``b_i + 1``. The same pass
   finds each request's successor: a request coming ``D`` or more after its
   predecessor (a "head") always opens a window, so heads cut every key into
   independent dense segments.
2. Window starts are the chains ``head, next(head), ...`` inside each segment;
   they are found by pointer doubling: equi-joins on the request id,
   log2(windows per segment) rounds, lineage cut by ``checkpoint()``.
3. Each request joins the (at most two) starts of its own and the previous
   bucket — windows never overlap, so exactly one start covers it.
4. ``n`` is the request's rank inside its window.

Hot keys are spread over buckets in steps 1 and 3; step 2 joins on unique ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import epoch_micros
from ..session import checkpoint_dir

# The reference limiter's budget.
POINTS = 10
DURATION_SECONDS = 60


def next_pointers(ev: DataFrame, d: int) -> DataFrame:
    """ev(key, t, id, b) -> (id, nxt, head).

    ``nxt``: the first request of the key at or after ``t + D`` (NULL at the
    end). ``head``: the request's gap to its predecessor is at least ``D`` (or
    it is the key's first request) — such a request always opens a window.
    Both come from one as-of pass: probes and requests share a window
    partitioned by (key, bucket), ordered descending, where a running
    ``last(ignorenulls)`` gives each probe the nearest request after it."""
    first = F.min(F.struct("t", "id"))
    per_bucket = ev.groupBy("key", "b").agg(first.alias("f"))
    wk = Window.partitionBy("key").orderBy("b")
    per_bucket = per_bucket.select(
        "key", "b",
        F.lead("b", 1).over(wk).alias("nb1"), F.lead("f", 1).over(wk).alias("nf1"),
        F.lead("f", 2).over(wk).alias("nf2"))

    # kind 1 = request; 0 = probe at t+D in bucket b+1 (sees requests with t >= t_i + D);
    # 2 = probe at (t_i, id_i) in bucket b (sees requests strictly after i)
    no_id = F.lit(None).cast("long")
    probes_next = ev.select("key", (F.col("b") + 1).alias("b"), (F.col("t") + d).alias("t"),
                            F.lit(-(1 << 62)).cast("long").alias("o"), F.lit(0).alias("kind"),
                            no_id.alias("id"), F.col("id").alias("src"))
    probes_succ = ev.select("key", "b", "t", F.col("id").alias("o"), F.lit(2).alias("kind"),
                            no_id.alias("id"), F.col("id").alias("src"))
    events = ev.select("key", "b", "t", F.col("id").alias("o"), F.lit(1).alias("kind"), "id",
                       no_id.alias("src"))
    w = (Window.partitionBy("key", "b")
         .orderBy(F.col("t").desc(), F.col("o").desc(), F.col("kind").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cand = F.last(F.when(F.col("kind") == 1, F.struct("t", "id")), ignorenulls=True).over(w)
    asof = (probes_next.unionByName(probes_succ).unionByName(events)
            .select("kind", "src", cand.alias("c"))
            .where(F.col("kind") != 1)
            .groupBy("src").agg(F.max(F.when(F.col("kind") == 0, F.col("c"))).alias("an"),
                                F.max(F.when(F.col("kind") == 2, F.col("c"))).alias("as"))
            .withColumnRenamed("src", "id"))

    j = (ev.select("id", "key", "b", "t")
         .join(per_bucket, ["key", "b"])
         .join(asof, "id", "left"))
    nxt = F.coalesce(F.col("an.id"),
                     F.when(F.col("nb1") == F.col("b") + 1, F.col("nf2.id")).otherwise(F.col("nf1.id")))
    succ = F.coalesce(F.col("as"), F.col("nf1"))
    # i's successor opens a window when it comes D or more after i
    succ_heads = j.where(succ.isNotNull() & (succ["t"] >= F.col("t") + d)).select(succ["id"].alias("id"))
    firsts = ev.groupBy("key").agg(F.min(F.struct("t", "id")).alias("r")).select(F.col("r.id").alias("id"))
    heads = succ_heads.unionByName(firsts).withColumn("head", F.lit(True))
    return j.select("id", nxt.alias("nxt")).join(heads, "id", "left").select(
        "id", "nxt", F.coalesce("head", F.lit(False)).alias("head"))


def chain_from_roots(roots: DataFrame, jumps: DataFrame) -> DataFrame:
    """Pointer doubling: ids on the chains starting at ``roots(id)``.

    ``jumps(id, nxt)``: one successor per id. Round k adds the nodes 2^k..2^(k+1)-1
    steps from a root and squares the jump table."""
    spark = roots.sparkSession
    checkpoint_dir(spark)
    reached = roots.select("id").checkpoint()
    # Only roots and successors of some id can be on a chain, and that set is
    # closed under the successor function: restrict the jump table to it.
    cand = roots.select("id").unionByName(
        jumps.where(F.col("nxt").isNotNull()).select(F.col("nxt").alias("id"))).distinct()
    jump = jumps.where(F.col("nxt").isNotNull()).join(cand, "id", "left_semi").checkpoint()
    while True:
        # positions 2^k .. 2^(k+1)-1 of every chain (disjoint from ``reached``)
        new = reached.join(jump, "id").select(F.col("nxt").alias("id")).checkpoint()
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)  # of tables already written: one more each round
        j2 = jump.alias("a").join(jump.alias("b"), F.col("a.nxt") == F.col("b.id"))
        jump = j2.select(F.col("a.id").alias("id"), F.col("b.nxt").alias("nxt")).checkpoint()


def admission(requests: DataFrame, key: str = "key", ts: str = "ts", id_col: str = "id",
              points: int = POINTS, duration_seconds: int = DURATION_SECONDS) -> DataFrame:
    """(key, id, ts, window_start, n, admitted) for every request.

    ``id_col`` must be unique across the input."""
    d = int(duration_seconds) * 1_000_000
    checkpoint_dir(requests.sparkSession)
    ev = requests.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(ts).alias("ts"),
                         epoch_micros(requests, ts).alias("t"))
    # read by every step below: computed once. The bucket is floor(t / d) in whole numbers
    ev = ev.withColumn("b", F.expr(f"(t - pmod(t, {d}L)) div {d}L")).checkpoint()
    ptr = next_pointers(ev.select("key", "t", "id", "b"), d).checkpoint()
    # heads split each key into independent dense segments; a chain stops at
    # the next head (which is a root itself)
    heads = ptr.where("head").select("id")
    jumps = (ptr.alias("p").join(heads.withColumn("nh", F.lit(True)).alias("h"),
                                 F.col("p.nxt") == F.col("h.id"), "left")
             .select(F.col("p.id").alias("id"),
                     F.when(F.col("h.nh").isNull(), F.col("p.nxt")).alias("nxt")))
    starts_ids = chain_from_roots(heads, jumps)
    starts = ev.join(starts_ids, "id").select(
        "key", F.col("id").alias("sid"), F.col("t").alias("st"), F.col("ts").alias("sts"),
        F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    covered = ev.join(starts, ["key", "b"]).where(
        ((F.col("t") > F.col("st")) | ((F.col("t") == F.col("st")) & (F.col("id") >= F.col("sid"))))
        & (F.col("t") < F.col("st") + d))
    wn = Window.partitionBy("key", "sid").orderBy("t", "id")
    n = F.row_number().over(wn).cast("long")
    return covered.select(
        F.col("key").alias(key), F.col("id").alias(id_col), F.col("ts").alias(ts),
        F.col("sts").alias("window_start"), F.col("st").alias("window_start_us"),
        n.alias("n")).withColumn(
        "admitted", F.col("n") <= points)
