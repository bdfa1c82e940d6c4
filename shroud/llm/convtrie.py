"""Prefix trie of conversations by whole-sequence collapse.

1. Turns get their position in their conversation, and each prefix of a
   conversation a key: 192 bits of sums of hashes of (position, turn), which
   running sums give for conversations of any length.
2. Identical conversations collapse into one weighted sequence, with the list
   of their ids; its rows are those of its smallest conversation.
3. Sequences that are proper prefixes of others drop out by an anti-join: the
   rest are the leaves.
4. Nodes are aggregates of the sequences' weighted prefixes.

Sums over a node's subtree need no walk. A node belongs to the sequence of its
smallest conversation, and the nodes of one sequence are the lower end of its
path. So a subtree's sum is that of all nodes of all sequences that pass, less
the nodes of its own sequence above it: one aggregate and one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, save, ship_package, text_or_empty
from .ordered import running

LANES = 6
#: Ids that stand in one row while a long list of them is put together.
LISTED = 1024


def ordered_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``conv_id, pos, turn_key`` (digest of role and text), ``n_words``: the
    turns in order, positions from 0.

    Order is by turn, null first; turns that tie come by role, then text (each
    by its first 64 characters, then by the digest). A null role or text is
    empty; rows without a conversation's id are left out; repeated rows are
    turns of their own."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    t = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    return running(t, "conv_id", ["turn", "r", "t", "turn_key"], {}, "pos", "trie-turns").select("conv_id", "pos", "turn_key", "n_words")


def rebuilt(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: the first ``taken`` (at
    most ``most``) turns of the conversation ``base``, then the own turns after
    the first ``taken``; both are expressions over ``conv_id``. Returns the
    turns (as :func:`ordered_turns`) and all ``conv_id``, turnless ones too."""
    head = (turns.where(F.col("pos") < most).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "n_words"))).alias("head")).withColumnRenamed("conv_id", "base"))
    all_ = turns.where("pos = 0").select("conv_id").withColumns({"base": base, "taken": taken})
    # written first, so that the join with the turns can be split at a long conversation
    info = save(all_.join(head, "base", "left").withColumn("got", F.least("taken", F.coalesce(F.size("head"), F.lit(0)))), "trie-heads")
    first = info.where("got > 0").select("conv_id", F.explode(F.slice("head", 1, F.col("got"))).alias("x")).select("conv_id", "x.*")
    own = (turns.join(info.select("conv_id", "taken", "got"), "conv_id").where("pos >= taken")
           .select("conv_id", (F.col("pos") - F.col("taken") + F.col("got")).alias("pos"), "turn_key", "n_words"))
    return save(first.unionByName(own), "trie-rebuilt"), info.select("conv_id")


def _prefix_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]), 256))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node_key, parent_key, n_words`` of each prefix with a
    turn; equal sequences of turns have equal keys."""
    lanes = [f"lane{k}" for k in range(LANES)]
    h = [F.xxhash64(F.lit(k), "turn_key", "pos") for k in range(LANES // 2)]
    low = F.lit((1 << 32) - 1)
    values = [x for one in h for x in (F.shiftrightunsigned(one, 32), one.bitwiseAND(low))]
    t = turns.select("conv_id", "pos", "n_words", *[v.alias(c) for v, c in zip(values, lanes, strict=True)])
    t = running(t, "conv_id", ["pos"], {f"sum_{c}": c for c in lanes}, "at", "trie-prefixes")
    depth = F.col("at") + 1
    return t.select("conv_id", depth.alias("depth"), _prefix_key(depth, [F.col(f"sum_{c}") + F.col(c) for c in lanes]).alias("node_key"),
                    _prefix_key(F.col("at"), [F.col(f"sum_{c}") for c in lanes]).alias("parent_key"), "n_words")


def _lists(batches: Iterator) -> Iterator:
    """Sorted ``node_key, conv_id`` to ``node_key, first, ids``: lists of up to LISTED ids."""
    import pyarrow as pa

    def made(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x[0] for _, x in done], pa.int64()),
                                           pa.array([",".join(map(str, x)) for _, x in done])], names=["node_key", "first", "ids"])

    key, ids = None, []
    for batch in batches:
        done = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == LISTED):
                done.append((key, ids))
                ids = []
            key = k
            ids.append(c)
        if done:
            yield made(done)
    if ids:
        yield made([(key, ids)])


def _digests(batches: Iterator) -> Iterator:
    """Sorted ``node_key, first, ids`` to ``node_key, ends_sha256``, one list at a time."""
    import hashlib

    import pyarrow as pa

    def made(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["node_key", "ends_sha256"])

    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield made(done)
    if state is not None:
        yield made([(key, state.hexdigest())])


def end_lists(ends: DataFrame) -> DataFrame:
    """``node_key, ends_sha256``: digest of the ascending, comma-joined ids
    (``conv_id``, integers) that end at each node. Lists of any length: tasks
    join ids of a range, and the digest reads the pieces one by one."""
    ship_package(ends.sparkSession)
    pieces = (ends.select("node_key", F.col("conv_id").cast("long").alias("conv_id")).repartitionByRange("node_key", "conv_id")
              .sortWithinPartitions("node_key", "conv_id").mapInArrow(_lists, "node_key binary, first long, ids string"))
    return (pieces.repartition("node_key").sortWithinPartitions("node_key", "first")
            .mapInArrow(_digests, "node_key binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node: each distinct sequence of first turns, from the
    textless root (depth 0) on.

    ``turns`` is as :func:`ordered_turns` returns it, ``ids`` holds every
    ``conv_id`` (integers) once, those without turns too. Columns: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in the
    subtree, its top included), ``saved_tokens`` (over the subtree: members but
    one, times words of the node's last turn), ``ends_sha256`` (of the ids of
    members that end at the node).

    No conversations give no rows; conversations without turns end at the root.
    Work and rows are in proportion to the turns, for long conversations and for
    many copies alike."""
    root = _prefix_key(F.lit(0), [F.lit(0)] * LANES)
    steps = save(prefixes(turns), "trie-steps")
    last = steps.groupBy("conv_id").agg(F.max_by("node_key", "depth").alias("node_key"))
    ends = save(ids.select("conv_id").join(last, "conv_id", "left").withColumn("node_key", F.coalesce("node_key", root)), "trie-ends")
    # whole sequences: weight, and the conversation that stands for it
    sequences = save(ends.groupBy("node_key").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id")), "trie-sequences")
    begun = steps.select(F.col("parent_key").alias("node_key")).distinct()
    leaves = sequences.join(begun, "node_key", "left_anti").withColumn("leaf", F.lit(1))
    inner = sequences.join(begun, "node_key", "left_semi").withColumn("leaf", F.lit(0))
    of = save(leaves.unionByName(inner), "trie-marked").select("conv_id", "weight", "leaf")
    paths = save(steps.join(of, "conv_id").unionByName(
        of.withColumns({"depth": F.lit(0).cast("long"), "node_key": root, "parent_key": F.lit(None).cast("binary"), "n_words": F.lit(0).cast("long")})), "trie-paths")

    nodes = save(paths.groupBy("node_key", "parent_key", "depth", "n_words").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"))
        .withColumn("own", (F.col("n_convs") - 1) * F.col("n_words")), "trie-nodes")
    totals = save(nodes.groupBy("conv_id").agg(F.sum("own").alias("total")), "trie-totals")
    passing = paths.select("conv_id", "node_key").join(totals, "conv_id", "left").groupBy("node_key").agg(F.sum(F.coalesce("total", F.lit(0))).alias("all_own"))
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("node_key")).agg(F.count(F.lit(1)).alias("n_children"))
    above = running(nodes.select("node_key", "parent_key", "conv_id", "depth", "n_convs", "n_leaves", "own"), "conv_id", ["depth"], {"above": "own"}, "at", "trie-above")
    parents = nodes.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (above.join(passing, "node_key").join(children, "node_key", "left").join(end_lists(ends), "node_key", "left")
            .join(parents, "parent_key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                    (F.col("all_own") - F.col("above")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
