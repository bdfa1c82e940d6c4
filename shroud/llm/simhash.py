"""Near duplicates by SimHash fingerprints and one-wildcard segment variants.

1. A document's fingerprint has a bit set where more than half of its shingles'
   hashes have it. Documents with equal fingerprints are one node.
2. A fingerprint is cut into two segments of 32 bits. Of two fingerprints that
   differ in at most three bits, one segment differs in at most one; with that
   bit struck out, the segments are equal. So each segment is indexed under its
   32 variants with one bit struck out (a wildcard), and fingerprints that link
   meet by an equality join on (segment, wildcard, rest).
3. In each variant's group every node is verified against the group's first
   node only, so a group of n nodes gives n - 1 pairs.
4. Groups that then still hold more than one component are compared again in
   tasks, block by block; a task joins components as it finds links and lets
   only links out that join two: fewer than the rows that it compares.

All links are found and each is verified on the whole fingerprints: the result
is exact, at any size of the groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_budget, save, ship_package, text_or_empty
from .neardup import cells, components, spanning

DISTANCE, SEGMENT = 3, 32
#: Seed of the shingles' XXH64 (fixed value).
SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ----------------------------------------------------------- fingerprints
def shingles(text: str, words: int, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of the shingles of ``text``, repeats included: ``words`` words each,
    A-Z as a-z, joined by a space; the whole sequence of a text with fewer
    words. Long texts come in lists of some ``piece`` bytes."""
    data = text.encode("utf-8", "surrogatepass")
    at, carry, some = 0, [], False
    while at < len(data):
        cut = _SPACE.search(data, at + piece)
        end = cut.start() if cut else len(data)
        carry += data[at:end].lower().split()
        at = end
        if len(carry) >= words:
            some = True
            yield [b" ".join(x) for x in zip(*[carry[k:] for k in range(words)], strict=False)]
            carry = carry[len(carry) - words + 1:]
    if carry and not some:
        yield [b" ".join(carry)]


def bit_counts(hashes: bytes):
    """How many of the big-endian 64-bit ``hashes`` have each bit, highest first."""
    import numpy as np

    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    if len(raw) < 256:
        return np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return np.concatenate([np.bincount(raw[:, k], minlength=256) @ bits for k in range(8)])


def fingerprint(text: str, words: int = 3) -> bytes:
    """The 8 bytes (big-endian) of a text's fingerprint."""
    import numpy as np
    from xxhash import xxh64_digest

    n, count = 0, np.zeros(64, np.int64)
    for part in shingles(text, words):
        count += bit_counts(b"".join([xxh64_digest(x, SEED) for x in part]))
        n += len(part)
    return np.packbits(2 * count > n).tobytes()


def _fingerprints(words: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in row_budget(zip(batch.column(0).to_pylist(), texts, strict=True), map(len, texts), 4 << 20):
                fp = np.frombuffer(b"".join(fingerprint(t, words) for _, t in part), ">i8").astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], batch.column(0).type), pa.array(fp)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each row."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return (docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
            .mapInArrow(_fingerprints(words), f"doc_id {kind}, fp long"))


# ------------------------------------------------------------------ links
def _compare(distance: int):
    """Links between components among the rows ``bucket, bi, bj, own, node,
    root`` of a cell; a pair that meets in several variants is left to one: the
    upper segment if that differs in a bit at most, and in it the variant that
    strikes out that bit, or the first if there is none."""

    def rows_of(rows):
        import numpy as np

        bucket, bi, bj = rows[0][:3]
        lower, wild = divmod(bucket >> SEGMENT, SEGMENT)
        block, root = (np.array([r[k] for r in rows], np.int64) for k in (3, 5))
        fp = np.array([r[4] for r in rows], np.int64).view(np.uint64)
        comp = np.unique(root, return_inverse=True)[1]
        for i in range(len(rows) - 1):
            differ = fp[i + 1:] ^ fp[i]
            upper, low = differ >> np.uint64(SEGMENT), differ & np.uint64((1 << SEGMENT) - 1)
            ok = (comp[i + 1:] != comp[i]) & (np.bitwise_count(differ) <= distance)
            ok &= (low if lower else upper) != 0 if wild else True
            if lower:
                ok &= np.bitwise_count(upper) > 1
            if bi != bj:
                ok &= block[i + 1:] != block[i]
            found = np.flatnonzero(ok) + i + 1
            if len(found):
                for k in spanning(comp, i, found):
                    yield rows[i][4], rows[k][4]

    return cells(rows_of, ["a", "b"])


def variants(fp: str = "fp"):
    """array<long>: the names of a fingerprint's variants, (segment, wildcard,
    rest) as one number."""
    return F.expr(f"""transform(sequence(0, {2 * SEGMENT - 1}), i ->
        shiftleft(CAST(i AS BIGINT), {SEGMENT})
        | ((CASE WHEN i < {SEGMENT} THEN shiftrightunsigned({fp}, {SEGMENT}) ELSE {fp} & {(1 << SEGMENT) - 1}L END)
           & ~shiftleft(1L, i % {SEGMENT})))""")


def link_fingerprints(nodes: DataFrame, *, distance: int = DISTANCE, block: int = 2048) -> DataFrame:
    """``node, root`` of the distinct fingerprints ``nodes`` (column ``fp``) that
    link with another: fingerprints link if they differ in ``distance`` bits (3
    or fewer: the index finds no more), and ``root`` names what they reach."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("two segments with a wildcard bit find up to three differing bits")
    member = nodes.select(F.col("fp").alias("node"), F.explode(variants()).alias("bucket"))
    # the struck-out bit, to leave out groups that only repeat what the first wildcard's group holds
    bit = F.expr(f"""shiftrightunsigned(node, CAST(shiftrightunsigned(bucket, {SEGMENT}) % {SEGMENT}
                     + CASE WHEN shiftrightunsigned(bucket, {SEGMENT}) < {SEGMENT} THEN {SEGMENT} ELSE 0 END AS INT)) & 1L""")
    first = F.expr(f"shiftrightunsigned(bucket, {SEGMENT}) % {SEGMENT} = 0")
    # written first: an aggregate's partitioning would serve the join too and keep a large group in one task
    centre = save(member.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size"),
                                               F.min(bit).alias("lo"), F.max(bit).alias("hi"))
                  .where((F.col("size") > 1) & (first | F.expr("lo <> hi"))).drop("lo", "hi"), "simhash-centres")
    shared = save(member.join(centre, "bucket"), "simhash-shared")
    near = F.expr(f"bit_count(node ^ centre) <= {distance}")
    star = shared.where("node <> centre").where(near).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(save(star, "simhash-links"))

    labelled = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = save(labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                 .where("lo <> hi").select("bucket"), "simhash-mixed")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    again = (labelled.join(mixed, "bucket", "left_semi")
             .withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "root"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = again.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "node")
    more = save(dealt.mapInArrow(_compare(distance), "a long, b long"), "simhash-links")
    if more.isEmpty():
        return roots
    # links between components join those; their own roots may be new
    named = [roots.toDF(x, f"r{x}") for x in "ab"]
    between = (more.join(named[0], "a", "left").join(named[1], "b", "left")
               .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    joined = save(components(between).toDF("root", "joined"), "simhash-roots")
    old = roots.join(joined, "root", "left").select("node", F.coalesce("joined", "root").alias("root"))
    new = joined.select(F.col("root").alias("node"), F.col("joined").alias("root")).join(roots, "node", "left_anti")
    return old.unionByName(new)


def near_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                      distance: int = DISTANCE, block: int = 2048) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest id
    that links reach, its own included) of each row.

    A shingle is ``words`` words joined by a space, A-Z as a-z, repeats counted;
    a text with fewer words is one shingle. Documents link if their fingerprints
    differ in ``distance`` bits or fewer.

    Defined cases: a null, empty or wordless text has fingerprint zero and links
    like any other; rows that repeat each have their row; a null id is left out
    of the smallest, and the component is null where all ids are; an empty table
    gives no rows; very long texts are read piece by piece; other columns are not
    read. A fingerprint that a third of all rows share is one node, and its rows
    get their component by an equi-join whose side Spark may split."""
    described = save(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhash-docs")
    nodes = save(described.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = link_fingerprints(nodes, distance=distance, block=block)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).hint("rebalance")
    found = save(rooted.join(least, "root").select("fp", "component_id"), "simhash-found")
    return (described.join(found, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
