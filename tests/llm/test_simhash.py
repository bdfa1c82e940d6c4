"""SimHash near duplicates against all pairs in plain Python."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from shroud.llm import queries, simhash

from . import brute



def plain(text, words=3):
    """Fingerprint by counting each bit."""
    w = [x.encode() for x in brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    parts = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(fps, distance=3):
    """Smallest id reachable over links, by comparing all pairs of distinct fingerprints."""
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(f, i)
    parent = {f: f for f in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(first, 2):
        if (a ^ b).bit_count() <= distance:
            x, y = sorted((root(a), root(b)), key=first.get)
            parent[y] = x
    return {i: first[root(f)] for i, f in fps.items()}


TEXTS = ["", None, " \n\t\x0b", "one", "One two", "a b c", "A  b\tc\x0cd", "ÄÖ ünï 😀 wörds", "x\x85y\xa0z w v", "tick " * 1000]


def test_fingerprints_equal_the_definition(spark):
    texts = TEXTS + [r.text for r in brute.documents(spark).collect()]
    for t in texts:
        assert int.from_bytes(simhash.fingerprint(t or "")) == plain(t)


def test_long_texts_are_read_piece_by_piece():
    text = " ".join(f"w{i * i % 977}" for i in range(3000)) + "  " + "z" * 500 + " end"
    whole = list(simhash.shingles(text, 3))
    parts = list(simhash.shingles(text, 3, 100))
    assert len(whole) == 1 and len(parts) > 50 and sum(parts, []) == whole[0]
    assert list(simhash.shingles("a" * 300 + " b", 3, 10)) == [[b"a" * 300 + b" b"]]


def test_hash_is_that_of_spark(spark):
    text = "some words of One text repeated some words of one"
    w = text.lower().split()
    h = [r[0] % (1 << 64) for r in spark.createDataFrame([(" ".join(w[i:i + 3]),) for i in range(len(w) - 2)], "s string").select(F.xxhash64("s")).collect()]
    assert int.from_bytes(simhash.fingerprint(text)) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def family(seed, n):
    """Fingerprints that differ in a few bits from one another, in both segments, and strangers."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    out = {0, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out, key=lambda x: hash((seed, x)))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 500, 2048), (2, 500, 7)])
def test_links_equal_all_pairs(spark, seed, n, block):
    fps = dict(enumerate(family(seed, n)))
    for i, y in enumerate(list(fps.values())[:60]):  # pairs at every distance in every place
        x = y
        for k in range(i % 5):
            x ^= 1 << ((7 * i + 31 * k) % 64)
        fps[n + i] = x
    nodes = spark.createDataFrame([(signed(f),) for f in set(fps.values())], "fp long")
    got = {r.node: r.root for r in simhash.link_fingerprints(nodes, block=block).collect()}
    want = reached(fps)
    groups = {}
    for i, f in fps.items():
        groups.setdefault(want[i], set()).add(got.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_cell_lets_out_fewer_links_than_rows():
    import pyarrow as pa

    rng = random.Random(5)
    fps = sorted({sum(1 << b for b in rng.sample(range(32), rng.choice([0, 1, 2]))) for _ in range(900)})
    rows = [{"bucket": 0, "bi": 0, "bj": 0, "own": 0, "node": f, "root": f} for f in fps]
    found = [tuple(r.values()) for b in simhash._compare(3)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    assert len(found) == len(fps) - 1 and all((a ^ b).bit_count() <= 3 for a, b in found)


def test_query_equals_all_pairs(spark):
    got = queries.op12_simhash(spark, brute.SF).collect()
    fps = {r.doc_id: plain(r.text) for r in brute.documents(spark).collect()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()} and len(got) == len(fps)
    assert {r.doc_id: r.component_id for r in got} == reached(fps)


def test_near_copies_link(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    texts = []
    for k in range(120):
        t = list(base)
        for _ in range(k % 4):
            t[rng.randrange(600)] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 50))) for _ in range(80)]
    docs = dict(enumerate(texts, 10))
    got = simhash.near_fingerprints(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == reached({i: plain(t) for i, t in docs.items()})


def test_odd_rows(spark):
    odd = brute.odd_documents(spark)
    got = simhash.near_fingerprints(odd.withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))).collect()
    assert len(got) == 12
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5} and {r.component_id for r in got if r.doc_id is None} == {8}
    assert [r.component_id for r in simhash.near_fingerprints(odd.where("doc_id is null")).collect()] == [None, None]
    assert simhash.near_fingerprints(brute.empty_documents(spark)).count() == 0
    with pytest.raises(ValueError, match="three"):
        simhash.link_fingerprints(odd, distance=4)
