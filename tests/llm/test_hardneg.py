"""Hard negatives against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import hardneg, queries

from . import brute


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """Sorted result rows over (id, label, vector)."""
    good = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for i, label, v in good:
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, other, w in good if j != i and len(w) == len(v)]
        for ps, pid, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            hits = sorted((s, j) for s, j, other in scored if other != label and low * -ps <= 100 * -s <= high * -ps)
            out += [(i, pid, k, j, -ps, -s) for k, (s, j) in enumerate(hits[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(parts)


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 1), (2, 3), (3, 2), (5, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hardneg.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_all_products():
    rng = np.random.default_rng(0)
    a, m = rng.integers(-300, 300, (7, 9)), rng.integers(-300, 300, (40, 9))
    low, high = hardneg.bounds(a, m.min(0)[None], m.max(0)[None])
    s = hardneg._scores(a, m)
    assert (s == a @ m.T).all() and (low[:, 0] <= s.min(1)).all() and (s.max(1) <= high[:, 0]).all()
    low, high = hardneg.bounds(a, m[:1], m[:1])
    assert np.allclose(low, high, atol=1e-3)
    big = rng.integers(-2 ** 30, 2 ** 30, (3, 2))
    assert hardneg._scores(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in big] for p in big]


def clustered(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    at = rng.integers(0, 12, n)
    v = centres[at] + spread * rng.normal(size=(n, dims))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    labels = np.where(rng.random(n) < 0.35, 1, at % 5)  # one label holds a third, in all clusters
    v[rng.integers(0, n, n // 6)] = v[0]  # equal vectors
    return [(int(i), int(x), [float(y) for y in w]) for i, x, w in zip(rng.permutation(n), labels, v, strict=True)]


@pytest.mark.parametrize(("dims", "spread", "block", "group"), [(3, 0.1, 8, 5), (16, 0.05, 16, 1024)])
def test_equals_plain_python_and_leaves_blocks_out(spark, dims, spread, block, group):
    rows = clustered(dims, 900, dims, spread)
    df = frame(spark, rows)
    assert got(hardneg.hard_negatives(df, F.col("vec_id") % 20 == 0, block=block, group=group)) == plain(rows, lambda i: i % 20 == 0)
    blocks = hardneg.candidate_blocks(df, F.col("vec_id") % 20 == 0, block=block)
    n = blocks.count()
    groups = hardneg.anchor_groups(blocks, 1)
    chosen = hardneg._choose(False, 80, 100)
    pairs = sum(chosen(g, blocks.toArrow()).num_rows for g in [groups.where(F.col("group") == r.group).toArrow() for r in groups.select("group").collect()])
    assert 0 < pairs < 0.5 * n * 45  # the bounds choose well under half of the blocks


@pytest.mark.parametrize("limits", [{"low": 50, "high": 95}, {"positives": 2, "negatives": 1, "scale": 7.5}])
def test_parameters(spark, limits):
    rows = clustered(9, 300, 4, 0.3)
    assert got(hardneg.hard_negatives(frame(spark, rows), F.col("vec_id") < 15, **limits)) == plain(rows, lambda i: i < 15, **limits)


def test_query_equals_plain_python(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{brute.SF}/embeddings.parquet").collect()]
    assert got(queries.op13_hard_negatives(spark, brute.SF)) == plain(rows, lambda i: i % 100 == 0)


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.9, 0.5]), (2, 2, [0.9, 0.5]), (3, 2, [0.8, 0.5]),
            (4, None, [1.0, 1.0]), (5, 1, None), (6, 2, [nan, 1.0]), (8, 1, [inf, 0.0]), (9, 2, [None, 1.0]), (None, 2, [0.9, 0.5]), (10, 2, []), (100, 1, []),
            (11, 1, []), (200, 3, [1.0, 2.0, 3.0]), (201, 3, [-1.0, -2.0, -3.0]), (202, 4, [-1.0, -2.0, -3.0]), (300, 5, [0.0, 0.0]), (301, 5, [0.25, 0.0]),
            (302, 1, [1e30, 1e30]), (303, 6, [2.0 ** 18] * 2), (400, 7, [2.0 ** 18] * 2), (401, 7, [2.0 ** 18 - 1] * 2), (402, 6, [2.0 ** 18 - 2] * 2)]
    want = plain([r for r in rows if r[0] != 302], lambda i: i % 100 == 0)
    df = frame(spark, rows).withColumns({"key": F.lit("clash"), "anchor": F.lit(1), "vector": F.lit(2), "dims": F.lit(3), "score": F.lit(4)})
    assert got(hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0)) == want and {r[0] for r in want} == {0, 100, 300, 400}
    assert got(hardneg.hard_negatives(df.where("vec_id % 100 <> 0"), F.col("vec_id") % 100 == 0)) == []
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_hard_negatives(spark, str(tmp_path)).count() == 0


def test_long_vectors_and_many_equal_ones(spark):
    rng = np.random.default_rng(4)
    long = [(i, i % 3, [float(x) for x in rng.normal(size=3000)]) for i in range(40)]
    same = [(i, i % 2, [0.5, 0.25]) for i in range(1000, 2500)]
    rows = long + same
    assert got(hardneg.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0)) == plain(rows, lambda i: i % 100 == 0)
