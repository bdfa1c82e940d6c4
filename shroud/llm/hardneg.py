"""Hard negatives by blocks of candidates in Hilbert order with zone maps.

1. Vectors become integers and get a key: the place of their direction, cut
   into a few steps a dimension, on a Hilbert curve.
2. Candidates are written as Parquet blocks in the order of (length, label,
   key). A block carries its zone map: smallest and largest label, and smallest
   and largest value of each dimension.
3. Interval arithmetic over the zone maps bounds the score of an anchor with
   all of a block's rows from both sides. Positives need the blocks of their
   label that may beat the scores known from the anchor's own block; negatives
   need the blocks whose bounds meet one of the anchor's windows. Only chosen
   (anchor group, block) pairs are read.
4. Chosen blocks are scored exactly, some blocks and a group of anchors at a
   time, and of each the few best rows are kept.

The result is exact. How many blocks the bounds leave out depends on the data:
on vectors without structure in many dimensions next to none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, ship_package

#: Steps of a direction's component, in units of an even spread (quartiles of the normal distribution; fixed values).
CUTS = (-0.6745, 0.0, 0.6745)
BITS = 2
#: Rows of a block and of a group of anchors (fewer where vectors are long: BLOCK_BYTES), blocks scored together, zone maps bounded together.
BLOCK, GROUP, BLOCK_BYTES, SLICE, ZONES = 256, 1024, 4 << 20, 64, 1024

_BLOCK_SCHEMA = ("block_id long, dims int, n int, low_label long, high_label long, low binary, high binary, ids binary, labels binary, data binary, "
                 "anchors array<struct<vec_id: bigint, label: bigint, data: binary, seed: bigint>>")
_GROUP_SCHEMA = "group long, dims int, n int, ids binary, labels binary, data binary, seeds binary"


# ------------------------------------------------------------ Hilbert keys
def hilbert_keys(steps, bits: int):
    """Place on the Hilbert curve of each row of ``steps`` (integers below
    ``2**bits``, a column per dimension), as bytes that sort like the places."""
    import numpy as np

    x = np.ascontiguousarray(steps.T).astype(np.uint32)  # a row per dimension
    if not len(x):
        return np.zeros((steps.shape[0], 0), np.uint8)
    # undo the turns and mirrorings of the cells, from the coarsest level down
    for level in range(bits - 1, 0, -1):
        below = np.uint32((1 << level) - 1)
        for row in x:
            set_ = (row >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(set_, np.uint32(0), (x[0] ^ row) & below)
            x[0] ^= np.where(set_, below, swap)
            row ^= swap
    # Gray code across the dimensions
    x = np.bitwise_xor.accumulate(x, axis=0)
    carry = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= carry
    planes = [((x >> np.uint32(level)) & np.uint32(1)).astype(np.uint8) for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=0).T, axis=1)


def _keys(scale: float):
    """``vec_id, label, anchor, vector`` to integer rows with keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, label, anchor, vector in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3), strict=True):
                values = vector.values
                if i is None or label is None or values is None or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64) * scale
                with np.errstate(over="ignore", invalid="ignore"):
                    if not np.isfinite(v).all() or not (v @ v) < 2.0 ** 62:
                        continue
                out.append((i, label, bool(anchor), np.floor(v).astype("<i4")))
            for dims in sorted({len(r[3]) for r in out}):
                rows = [r for r in out if len(r[3]) == dims]
                m = np.array([r[3] for r in rows], "<i4").reshape(len(rows), dims)
                length = np.sqrt((m.astype(np.float64) ** 2).sum(1, keepdims=True))
                spread = m * (np.sqrt(dims) / np.maximum(length, 1e-300))
                keys = hilbert_keys(np.digitize(spread, CUTS), BITS)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()),
                    pa.array([dims] * len(rows), pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary()),
                    pa.array([r[3].tobytes() for r in rows], pa.binary())], names=["vec_id", "label", "anchor", "dims", "key", "data"])

    return run


# ------------------------------------------------------------------ blocks
def _runs(batches: Iterator, limit, parts: int):
    """Rows of sorted batches in lists of equal ``dims`` (column 0) and up to
    ``limit(dims)`` rows, each with its number."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, []
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(parts)], strict=True):
            if held and (row[0] != held[0][0] or len(held) >= limit(row[0])):
                yield number, held
                number, held = number + 1, []
            held.append(row)
    if held:
        yield number, held


def _rows_within(most: int):
    return lambda dims: max(1, min(most, BLOCK_BYTES // (4 * max(dims, 1))))


def _matrix(data: bytes, n: int, dims: int):
    import numpy as np

    return np.frombuffer(data, "<i4").reshape(n, dims)


def _scores(a, b):
    """Integer inner products of the rows of ``a`` with those of ``b``."""
    import numpy as np

    def longest(m):
        return np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0))

    if longest(a) * longest(b) < 2.0 ** 52:  # exact in floating point
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


_NONE = -(1 << 63)


def _blocks(size: int, few: int):
    """Sorted ``dims, vec_id, label, anchor, data`` to block rows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([
            ("block_id", pa.int64()), ("dims", pa.int32()), ("n", pa.int32()), ("low_label", pa.int64()), ("high_label", pa.int64()),
            *[(c, pa.binary()) for c in ("low", "high", "ids", "labels", "data")],
            ("anchors", pa.list_(pa.struct([("vec_id", pa.int64()), ("label", pa.int64()), ("data", pa.binary()), ("seed", pa.int64())])))])
        for number, rows in _runs(batches, _rows_within(size), 5):
            dims, n = rows[0][0], len(rows)
            m = _matrix(b"".join(r[4] for r in rows), n, dims)
            ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
            at = np.array([k for k, r in enumerate(rows) if r[3]], int)
            anchors = []
            if len(at):
                s = _scores(m[at], m)
                s[(labels[at][:, None] != labels) | (ids[at][:, None] == ids)] = _NONE
                seed = np.partition(s, -few, axis=1)[:, -few] if n >= few else np.full(len(at), _NONE)
                anchors = [{"vec_id": int(ids[k]), "label": int(labels[k]), "data": rows[k][4], "seed": int(t)} for k, t in zip(at, seed, strict=True)]
            row = {"block_id": number, "dims": dims, "n": n, "low_label": int(labels.min()), "high_label": int(labels.max()),
                   "low": m.min(0).astype("<i4").tobytes(), "high": m.max(0).astype("<i4").tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(),
                   "data": m.tobytes(), "anchors": anchors}
            yield pa.RecordBatch.from_pylist([row], schema)

    return run


def candidate_blocks(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                     scale: float = 256.0, positives: int = 5, block: int = BLOCK) -> DataFrame:
    """The saved blocks of all rows that take part; ``anchor`` marks the anchors."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.coalesce(anchor, F.lit(False)),
                          F.col(vector_col).cast("array<double>")).toDF("vec_id", "label", "anchor", "vector")
    keyed = save(rows.mapInArrow(_keys(scale), "vec_id long, label long, anchor boolean, dims int, key binary, data binary"), "hardneg-rows")
    order = ["dims", "label", "key", "vec_id"]
    return save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("dims", "vec_id", "label", "anchor", "data")
                .mapInArrow(_blocks(block, positives), _BLOCK_SCHEMA), "hardneg-blocks")


def _groups(size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for number, rows in _runs(batches, _rows_within(size), 5):
            ids, labels, seeds = (np.array([r[k] for r in rows], np.int64).tobytes() for k in (1, 2, 4))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows[0][0]], pa.int32()), pa.array([len(rows)], pa.int32()),
                                              *[pa.array([x], pa.binary()) for x in (ids, labels, b"".join(r[3] for r in rows), seeds)]],
                                             names=["group", "dims", "n", "ids", "labels", "data", "seeds"])

    return run


def anchor_groups(blocks: DataFrame, size: int = GROUP) -> DataFrame:
    """The saved anchors, neighbours in the blocks' order together."""
    a = blocks.select("dims", "block_id", F.explode("anchors").alias("a")).select("dims", "a.vec_id", "a.label", "a.data", "a.seed", "block_id")
    parts = max(1, -(-a.count() // size))
    order = ["dims", "block_id", "vec_id"]
    return save(a.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("dims", "vec_id", "label", "data", "seed")
                .mapInArrow(_groups(size), _GROUP_SCHEMA), "hardneg-groups")


# ----------------------------------------------------------------- choosing
class _Group:
    """A group of anchors as arrays; ``windows`` holds (anchor's place, rank of
    the positive, its id, its score, lowest and highest score wanted)."""

    def __init__(self, row: dict, low: int, high: int):
        import numpy as np

        self.group, self.n, self.dims = row["group"], row["n"], row["dims"]
        self.ids, self.labels, self.seeds = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "seeds"))
        self.m = _matrix(row["data"], self.n, self.dims)
        self.windows = [(w["place"], w["rank"], w["vec_id"], w["score"], -(-low * w["score"] // 100), high * w["score"] // 100)
                        for w in row.get("windows") or []]
        self.windows = sorted(w for w in self.windows if w[4] <= w[5])


def bounds(m, low, high):
    """Lower and upper bound of the inner products of each row of ``m`` with
    any vector between a zone's ``low`` and ``high`` (rows)."""
    import numpy as np

    plus, minus = np.maximum(m, 0).astype(np.float64), np.minimum(m, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    slack = np.abs(m.astype(np.float64)) @ np.maximum(np.abs(low), np.abs(high)).T * 2.0 ** -40  # rounding of large numbers
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


def _choose(negative: bool, low: int, high: int):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        out = {"group": [], "block_id": [], "who": []}
        for g in (_Group(r, low, high) for r in left.to_pylist()):
            zones = [z for z in right.to_pylist() if z["dims"] == g.dims]
            if not zones:
                continue
            lo, hi = (np.frombuffer(b"".join(z[c] for z in zones), "<i4").reshape(len(zones), g.dims) for c in ("low", "high"))
            first, last = (np.array([z[c] for z in zones]) for c in ("low_label", "high_label"))
            least, most = bounds(g.m, lo, hi)
            if negative:
                who = np.zeros((g.n, len(zones)), bool)
                for place, _, _, _, a, b in g.windows:
                    who[place] |= (most[place] >= a) & (least[place] <= b)
                who &= (first != g.labels[:, None]) | (last != g.labels[:, None])
            else:
                who = (first <= g.labels[:, None]) & (last >= g.labels[:, None]) & (most >= g.seeds[:, None])
            for k in np.flatnonzero(who.any(0)):
                out["group"].append(g.group)
                out["block_id"].append(zones[k]["block_id"])
                out["who"].append(np.packbits(who[:, k]).tobytes())
        return pa.table(out, pa.schema([("group", pa.int64()), ("block_id", pa.int64()), ("who", pa.binary())]))

    return run


def _best(scores, ids, few: int):
    """Places of the ``few`` highest scores above _NONE, ties by smaller id."""
    import numpy as np

    some = np.flatnonzero(scores > _NONE)
    if len(some) > few:
        s = scores[some]
        some = some[s >= np.partition(s, -few)[-few]]
    return some[np.lexsort((ids[some], -scores[some]))][:few]


def _score(negative: bool, few: int, low: int, high: int):
    """The best rows among a slice's chosen blocks, for each anchor (or window)."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        names = ["group", "place", "rank", "anchor_id", "positive_id", "positive_score", "vec_id", "score"]
        out = []
        for g in (_Group(r, low, high) for r in left.to_pylist()):
            blocks = right.to_pylist()
            m = np.concatenate([_matrix(b["data"], b["n"], g.dims) for b in blocks])
            ids, labels = (np.concatenate([np.frombuffer(b[c], np.int64) for b in blocks]) for c in ("ids", "labels"))
            who = np.repeat(np.array([np.unpackbits(np.frombuffer(b["who"], np.uint8))[:g.n] for b in blocks], bool), [b["n"] for b in blocks], axis=0)
            windows = {}
            for w in g.windows:
                windows.setdefault(w[0], []).append(w)
            for at in range(0, g.n, 64):
                s = _scores(g.m[at:at + 64], m)
                for k in range(len(s)):
                    place = at + k
                    ok, score = who[:, place], s[k]
                    if negative:
                        ok = ok & (labels != g.labels[place])
                        for _, rank, pid, pscore, a, b in windows.get(place, []):
                            for x in _best(np.where(ok & (score >= a) & (score <= b), score, _NONE), ids, few):
                                out.append((g.group, place, rank, int(g.ids[place]), pid, pscore, int(ids[x]), int(score[x])))
                    else:
                        ok = ok & (labels == g.labels[place]) & (ids != g.ids[place])
                        for x in _best(np.where(ok, score, _NONE), ids, few):
                            out.append((g.group, place, 0, int(g.ids[place]), 0, 0, int(ids[x]), int(score[x])))
        return pa.table({c: [r[k] for r in out] for k, c in enumerate(names)}, pa.schema([(c, pa.int64()) for c in names]))

    return run


def _search(groups: DataFrame, blocks: DataFrame, zones: int, negative: bool, few: int, low: int, high: int) -> DataFrame:
    """The ``few`` best rows of each anchor (or window), with ``best`` (from 1)."""
    # zone maps against groups of anchors: a grid of cells of bounded size
    deals = -(-zones // ZONES)
    zone = F.pmod(F.xxhash64("block_id"), F.lit(deals)).alias("zone")
    maps = blocks.select("block_id", "dims", "low_label", "high_label", "low", "high", zone)
    wide = groups.withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    each = maps.join(wide.select(F.col("group").alias("to"), F.col("zone").alias("at"), F.col("dims").alias("of")),
                     (F.col("zone") == F.col("at")) & (F.col("dims") == F.col("of"))).drop("zone", "of")
    chosen = save(wide.groupBy("group", "zone").cogroup(each.groupBy("to", "at"))
                  .applyInArrow(_choose(negative, low, high), "group long, block_id long, who binary"), "hardneg-chosen")
    slices = -(-zones // SLICE)
    slice_ = F.pmod(F.xxhash64(F.col("block_id") + 1), F.lit(slices)).alias("slice")
    read = chosen.withColumnRenamed("group", "to").join(blocks.select("block_id", "n", "ids", "labels", "data", slice_), "block_id")
    here = groups.join(chosen.select("group", slice_.alias("at")).distinct(), "group")
    found = (here.groupBy("group", "at").cogroup(read.groupBy("to", "slice"))
             .applyInArrow(_score(negative, few, low, high), "group long, place long, rank long, anchor_id long, positive_id long, "
                                                            "positive_score long, vec_id long, score long"))
    best = F.expr("row_number() OVER (PARTITION BY group, place, rank ORDER BY score DESC, vec_id)")
    return found.withColumn("best", best).where(F.col("best") <= few)


def hard_negatives(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK,
                   group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each anchor (a row that ``anchor`` holds for) and each
    of its first ``positives`` other rows of its label, the first ``negatives``
    rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's. Components count as ``floor(scale * x)``, scores are inner
    products, higher ones come first, ties by smaller id.

    Defined cases: rows with a null id, label, vector or component, or with a
    component that is not finite, take no part; neither do vectors so long that
    their product with themselves passes 2**62, as their scores fit no long.
    Vectors of different lengths have no score with each other; empty ones score
    0. Repeated rows are candidates each, but a row of an anchor's own id is
    never its partner; a repeated anchor gives its rows again. A negative
    positive score has no window. An empty table gives no rows; other columns
    are not read. Equal vectors, even a third of all rows, are rows of blocks
    like any other."""
    blocks = candidate_blocks(vectors, anchor, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale, positives=positives, block=block)
    zones = max(1, blocks.count())
    groups = anchor_groups(blocks, group)
    first = save(_search(groups, blocks, zones, False, positives, low, high), "hardneg-positives")
    windows = first.groupBy("group").agg(F.collect_list(F.struct("place", F.col("best").alias("rank"), "vec_id", "score")).alias("windows"))
    found = _search(save(groups.join(windows, "group"), "hardneg-windows"), blocks, zones, True, negatives, low, high)
    return found.select("anchor_id", "positive_id", F.col("best").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))
