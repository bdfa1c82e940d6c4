"""Prefix tries and ordered running sums against plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shroud.llm import convtrie, queries
from shroud.llm.ordered import running

from . import brute


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def sequences(rows):
    """conv_id -> turns, in the operator's order."""
    held = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append((turn is not None, turn or 0, role or "", text or ""))
    def order(t):
        return t[0], t[1], t[2][:64], t[3][:64], digest(t[2], t[3])

    return {c: [(r, x) for _, _, r, x in sorted(v, key=order)] for c, v in held.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def trie(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(brute.WORD.findall(p[-1][1])) if p else 0
            leaves[p[:d]] += not kids[p]
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def random_rows(seed, n):
    rng = random.Random(seed)
    texts, rows = ["a", "a b", "", None, "c d e", "A", "x\x0by"], []
    for c in rng.sample(range(4 * n), n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "user", "bot", None]), rng.choice(texts)))
    rows += [(41, t, "user", f"long {t % 3}") for t in range(700)] + [(45, t, "user", f"long {t % 3}") for t in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def table(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return put


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_plain_python(spark, table, seed):
    rows = random_rows(seed, 120)
    want = trie(rebuilt(sequences(rows)))
    assert rows_of(queries.op11_prefix_trie(spark, table(rows))) == want
    assert any(r[3] > 20 and r[1] > 0 for r in want) or seed  # shared prefixes


def test_given_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{brute.SF}/conversations.parquet").collect()]
    got = queries.op11_prefix_trie(spark, brute.SF)
    assert got.dtypes == [(c, "bigint") for c in got.columns[:-1]] + [("ends_sha256", "string")]
    assert rows_of(got) == trie(rebuilt(sequences(rows)))


def test_without_rebuilding(spark):
    rows = [(1, 0, "u", "hello you"), (1, 1, "b", "hi"), (2, 0, "u", "hello you"), (3, 0, "u", "hello you"), (3, 1, "b", "hi"), (9, 0, "u", "bye")]
    turns = convtrie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 9, 50)], "conv_id long")
    assert rows_of(convtrie.prefix_trie(turns, ids)) == trie({**sequences(rows), 50: []})


def test_many_copies(spark, table):
    rows = [(20 * i, t, "u", f"turn {t}") for i in range(3000) for t in range(2)] + [(20 * i + 7, 0, "u", "turn 0") for i in range(50)]
    assert rows_of(queries.op11_prefix_trie(spark, table(rows))) == trie(rebuilt(sequences(rows)))


def test_odd_rows(spark, table):
    rows = [(None, 1, "user", "lost"), (20, None, None, None), (20, 0, "", ""), (20, 0, "", ""), (-5, 1, "u", "x" * 200_000), (-5, 1, "u", "x" * 200_000 + "y"),
            (0, 3, "é", "ü 😀 w"), (0, 3, "a", "tie"), (0, 3, "a", "Tie"), (7, 0, "u", "alone")]
    folder = table(rows)
    df = spark.read.parquet(f"{folder}/conversations.parquet").withColumns({"pos": F.lit("clash"), "r": F.lit(1), "node_key": F.lit(2), "__part": F.lit(3)})
    convs = sequences(rows)
    turns = convtrie.ordered_turns(df)
    assert rows_of(convtrie.prefix_trie(turns, turns.select("conv_id").distinct())) == trie(convs)
    got = {c: [] for c in convs}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.pos)):
        got[r.conv_id].append(bytes(r.turn_key))
    assert got == {c: [digest(a, b) for a, b in v] for c, v in convs.items()}


def test_empty_table(spark, table):
    got = queries.op11_prefix_trie(spark, table([]))
    assert got.count() == 0 and len(got.columns) == 8


def test_running_sums_of_groups_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["big"] * 8 + ["b", "c", "z"]), i, rng.randrange(-5, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = running(df, "g", ["o"], {"s": "v", "t": "o"}, "at", "test-running").collect()
    want, n, s, t = {}, collections.Counter(), collections.Counter(), collections.Counter()
    for g, o, v in sorted(rows):
        want[g, o] = (n[g], s[g], t[g])
        n[g], s[g], t[g] = n[g] + 1, s[g] + v, t[g] + o
    assert {(r.g, r.o): (r["at"], r.s, r.t) for r in got} == want
    assert len({r["at"] for r in got}) > 2000
