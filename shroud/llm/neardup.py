"""Near duplicates: one-permutation MinHash, banded buckets, star edges.

1. Every document's distinct word shingles are hashed; documents with equal
   sets become one node (its copies keep its component).
2. One hash per shingle fills ``bins`` bins (one-permutation hashing); empty
   bins take a non-empty one's value by optimal densification. The bins of a
   band together name a bucket.
3. In each bucket every node is a candidate of the bucket's first node only: a
   star, so a bucket of n nodes gives n - 1 pairs. Candidates are confirmed on
   the full shingle sets.
4. Components of the confirmed links. A star can miss a link between two nodes
   of a bucket that are not linked to its centre, so buckets that still hold
   more than one component are compared again, block by block inside tasks:
   small sets (up to ``EXACT`` shingles) on their shingles, larger ones first
   on one-permutation sketches and, where those leave it open, on their whole
   sets in a second pass. Each task joins components as it finds links and lets
   only links out that join two: fewer than the rows that it compares.

The link relation is thereby found up to the chance that a pair of similarity
0.8 shares none of the buckets (40 bands of 5: 1 in 8 million).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, batch_slices, byte_values, fresh, mix, save, ship_package, span_hashes, text_or_empty

BANDS, ROWS = 40, 5
#: Bytes of text that a task turns into sets at once, and what a row counts besides (its bins and sketch).
PART, PER_ROW = 2 << 20, 1 << 12
SKETCH, FIRST, EXACT = 1024, 128, 128
_EMPTY = 0xFFFFFFFFFFFFFFFF


# ----------------------------------------------------------- shingle hashes
_STATE: dict = {}


def word_hashes(data: bytes):
    """Start and hash of each word of ``data`` (runs without ASCII white space,
    A-Z as a-z)."""
    import numpy as np

    if not _STATE:
        value = byte_values(20240501)
        value[65:91] = value[97:123]
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _STATE.update(value=value, space=space)
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    for at in range(0, len(raw), BLOCK):
        part = raw[at:at + BLOCK]
        gap[at + 1:at + 1 + len(part)] = _STATE["space"][part]
    edge = np.concatenate([np.flatnonzero(gap[at + 1:at + 1 + BLOCK] != gap[at:at + BLOCK][:len(gap) - 1 - at]) + at
                           for at in range(0, len(gap) - 1, BLOCK)])
    start, end = edge[0::2], edge[1::2]
    return start, span_hashes(raw, start, end, _STATE["value"]) if len(start) else np.empty(0, np.uint64)


def shingle_sets(texts: list[str], words: int) -> list:
    """Sorted distinct 64-bit shingle hashes of each text: ``words`` words each,
    or the whole sequence of a text with fewer words (none without words)."""
    import numpy as np

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) + 1 for r in raw])
    start, h = word_hashes(b"\n".join(raw))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
    key = [np.uint64(pow(0xE7037ED1A0B428DB, k + 1, 1 << 64)) for k in range(words)]
    full = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        full += h[k:k + len(full)] * key[k]
    full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= words:
            out.append(np.unique(full[a:b - words + 1]))
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for k in range(n):
                    one = one + h[a + k] * key[k]
                out.append(mix(np.array([one * np.uint64(0x8EBC6AF09C88C6E3)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _fill(sets: list, bins: int):
    """One-permutation bins of each set (rows; _EMPTY where no hash falls)."""
    import numpy as np

    out = np.full((len(sets), bins), _EMPTY, np.uint64)
    for row, s in zip(out, sets, strict=True):
        h = s[::-1]  # falling, so that the smallest of a bin is written last
        row[(h % np.uint64(bins)).astype(np.int64)] = h // np.uint64(bins)
    return out


def densified(sets: list, bins: int):
    """One-permutation MinHash values with optimal densification: an empty bin
    takes the value of the first non-empty bin in a sequence of bins that
    depends on the bin alone."""
    import numpy as np

    out = _fill(sets, bins)
    source = out.copy()
    row, col = np.nonzero(out == np.uint64(_EMPTY))
    attempt = 0
    while len(row):
        attempt += 1
        with np.errstate(over="ignore"):
            pick = (mix(col.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        got = source[row, pick]
        ok = got != np.uint64(_EMPTY)
        out[row[ok], col[ok]] = got[ok]
        row, col = row[~ok], col[~ok]
    return out


def band_hashes(sets: list, bands: int, rows: int):
    """One 64-bit bucket name per set and band."""
    import numpy as np

    sig = densified(sets, bands * rows).reshape(len(sets), bands, rows)
    key = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(rows)], np.uint64)
    return mix((sig * key).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64))


def sketches(sets: list):
    """Low bytes of the one-permutation bins; 0 where a bin is empty."""
    import numpy as np

    s = _fill(sets, SKETCH)
    return np.where(s == np.uint64(_EMPTY), 0, (s % np.uint64(255)) + np.uint64(1)).astype(np.uint8)


def summaries(sets: list) -> list[bytes]:
    """What the second pass compares: all hashes of a set of up to EXACT, the sketch of a larger one."""
    large = iter(sketches([s for s in sets if len(s) > EXACT]))
    return [(next(large) if len(s) > EXACT else s).tobytes() for s in sets]


def _describe(words: int, bands: int, rows: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for part in batch_slices(batch, "text", PART, PER_ROW):
                sets = shingle_sets(part.column(2).to_pylist(), words)
                some = [s for s in sets if len(s)]
                bucket = iter(band_hashes(some, bands, rows).view("<i8").tolist() if some else [])
                sketch = iter(summaries(some))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                    pa.array([next(bucket) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([next(sketch) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "row_key", "n_shingles", "digest", "buckets", "sketch"])

    return run


# ------------------------------------------------------------ confirmation
def _sets(words: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in batch_slices(batch, "text", PART, PER_ROW):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["node", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose full shingle sets (``node, shingles``) are
    similar enough."""
    one, two = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    return (pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(_linked(percent), "a long, b long"))


# -------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in a link of ``a, b``: the smallest node it
    reaches.

    Rounds of large-star and small-star steps (each hangs a node's neighbours
    on its smallest neighbour), saved each round, until every node hangs on one
    that hangs on none. The number of rounds grows with the logarithm of the
    longest chain."""
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    while True:
        # a node below two others, or below one that is below another
        twice = edges.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select(F.col("hi").alias("v"))
        chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("v")
        if chained.unionByName(twice).isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # rebalanced, so that the join's own shuffle can be split at a node of many links
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u <> v").distinct())
        edges = save(small, "near-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ---------------------------------------------------- buckets compared again
def spanning(comp, i, found):
    """Those of ``found`` that join ``i`` to another component, one of each;
    ``comp`` (a component's label per row) then has them joined."""
    import numpy as np

    labels, first = np.unique(comp[found], return_index=True)
    comp[np.isin(comp, labels)] = comp[i]
    return found[first]


def cells(rows_of, names: list[str]):
    """A mapInArrow function over rows sorted by their first three columns (a
    bucket and two of its blocks): ``rows_of`` turns the rows of one cell into
    result rows of long columns ``names``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(rows):
            if len(rows) > 1 and (found := list(rows_of(rows))):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], names=names)

        held, key = [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a batch's rows become Python values as they are taken
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    if row[:3] != key:
                        yield from flush(held)
                        held, key = [], row[:3]
                    held.append(row)
        yield from flush(held)

    return run


class _Cell:
    """Rows ``bucket, bi, bj, own, node, n, data, buckets, root`` of a cell."""

    def __init__(self, rows, percent: int):
        import numpy as np

        self.bucket, self.bi, self.bj = rows[0][:3]
        self.percent = percent
        self.block, self.node, self.n, root = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 8))
        self.comp = np.unique(root, return_inverse=True)[1]
        self.buckets = np.array([r[7] for r in rows], np.int64)
        self.sketch = np.zeros((len(rows), SKETCH), np.uint8)

    def partners(self, i):
        """Later rows of other components that may be similar by size, of the
        other block, and that share no bucket with ``i`` before this one."""
        import numpy as np

        n, j = self.n, np.arange(i + 1, len(self.n))
        ok = self.comp[j] != self.comp[i]
        if self.bi != self.bj:
            ok &= self.block[j] != self.block[i]
        # the most that different sets of these sizes can share
        shared = np.where(n[j] == n[i], n[i] - 1, np.minimum(n[j], n[i]))
        ok &= 100 * shared >= self.percent * (n[j] + n[i] - shared)
        j = j[ok]
        if len(j):
            j = j[self.buckets[i][(self.buckets[j] == self.buckets[i]).argmax(1)] == self.bucket]
        return j

    def likely(self, i, j):
        """Those of ``j`` whose sketches agree with i's as much as similar sets'
        do, up to five standard errors of the estimate over those columns that
        hold a shingle; first by a part of the columns, then by all."""
        import numpy as np

        for columns in (slice(0, FIRST), slice(0, SKETCH)):
            if len(j):
                a, b = self.sketch[i, columns], self.sketch[j][:, columns]
                either = ((a > 0) | (b > 0)).sum(1)
                same = ((a == b) & (a > 0)).sum(1)
                error = np.sqrt(max(self.percent * (100 - self.percent), 1600) * either)
                j = j[100 * same >= self.percent * either - 5 * error]
        return j

    def pair(self, i, k):
        a, b = int(self.node[i]), int(self.node[k])
        return min(a, b), max(a, b)


def _scan(percent: int):
    """Compares each cell by what :func:`summaries` holds. Small sets are
    compared exactly, and of their links only those that join two components
    (known ones, or joined in the cell so far) leave the task: fewer than the
    cell has rows. Rows with a likely partner that sketches cannot decide leave
    it once each, with a null ``b``."""

    def rows_of(rows):
        import numpy as np

        c = _Cell(rows, percent)
        n, small = c.n, c.n <= EXACT
        sets = [np.frombuffer(r[6], np.uint64) for r in rows if r[5] <= EXACT]
        if not small.all():
            c.sketch[small] = sketches(sets)
            c.sketch[~small] = np.frombuffer(b"".join(r[6] for r in rows if r[5] > EXACT), np.uint8).reshape(-1, SKETCH)
        # the small sets as rows of local numbers, filled up with one that nothing marks
        names, number = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0), np.empty(0, int))
        local = np.full((len(rows), max(map(len, sets), default=0)), len(names))
        local[(np.arange(local.shape[1]) < n[:, None]) & small[:, None]] = number
        marked = np.zeros(len(names) + 1, bool)
        for i in np.flatnonzero(small[:-1]):
            j = c.partners(i)
            j = j[small[j]]
            if len(j):
                marked[local[i, :n[i]]] = True
                same = marked[local[j]].sum(1)
                marked[local[i, :n[i]]] = False
                for k in spanning(c.comp, i, j[100 * same >= percent * (n[j] + n[i] - same)]):
                    yield (c.bucket, c.bi, c.bj, int(c.block[i]), *c.pair(i, k))
        unsure = np.zeros(len(rows), bool)
        if not small.all():
            for i in range(len(rows) - 1):
                j = c.partners(i)
                j = c.likely(i, j[~small[j]] if small[i] else j)
                if len(j):
                    unsure[i] = unsure[j] = True
        for i in np.flatnonzero(unsure):
            yield c.bucket, c.bi, c.bj, int(c.block[i]), int(c.node[i]), None

    return cells(rows_of, ["bucket", "bi", "bj", "own", "a", "b"])


def _settle(percent: int):
    """Compares the rows left by :func:`_scan` on their whole sets (``data``);
    again only links that join two components leave the task."""

    def rows_of(rows):
        import numpy as np

        c = _Cell(rows, percent)
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        c.sketch[:] = sketches(sets)
        names, number = np.unique(np.concatenate(sets), return_inverse=True)
        local = np.split(number, np.cumsum(c.n)[:-1])
        marked = np.zeros(len(names), bool)
        for i in range(len(rows) - 1):
            j = c.likely(i, c.partners(i))
            if not len(j):
                continue
            marked[local[i]] = True
            for k in j:
                if c.comp[k] != c.comp[i]:
                    same = int(marked[local[k]].sum())
                    if 100 * same >= percent * (c.n[i] + c.n[k] - same):
                        spanning(c.comp, i, np.array([k]))
                        yield c.pair(i, k)
            marked[local[i]] = False

    return cells(rows_of, ["a", "b"])


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of each cell together and in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "node")
            .select("bucket", "bi", "bj", "own", "node", "n", "data", "buckets", "root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS, block: int = 1024) -> DataFrame:
    """``doc_id, n_shingles`` (distinct), ``component_id`` (smallest id that
    links reach) and ``kept`` (``doc_id = component_id``) of each row, with
    ``row_key`` (a digest of id and text) to join by.

    Texts are lower-cased in A-Z; two documents are linked if 100 times the
    shingles they share is at least ``percent`` times the shingles of both.
    ``percent`` of 80 and above suits the bands.

    Defined cases: a null or empty text, or one without words, has no shingles
    and its own id as component; rows that repeat are linked like copies, and
    rows that share the smallest id of a component are all kept; a null id is
    left out of the smallest, and the component is null (and its rows kept)
    where all are null; an empty table gives no rows; other columns are not read.
    A bucket of any size is compared whole: above ``block`` nodes, or 1,024 times
    as many shingles, as pairs of blocks, each a task's work of bounded memory."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = dict(docs.dtypes)[id_col]
    d = with_row_key(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "doc_id", "text", "row_key")
    described = save(d.select("doc_id", "row_key", "text").mapInArrow(
        _describe(words, bands, rows), f"doc_id {kind}, row_key binary, n_shingles long, digest binary, buckets array<bigint>, sketch binary"), "near-docs")
    # one node per distinct set; numbered once they are written
    one = described.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"),
        F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch"))
    nodes = save(one.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    member = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    # written first, here and below: an aggregate's partitioning would serve the join too and keep a large bucket in one task
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("n") / F.lit(block * 1024))).cast("int")
    centre = save(member.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size"), blocks.alias("blocks"))
                  .where("size > 1"), "near-centres")
    shared = save(member.drop("n").join(centre, "bucket"), "near-shared")
    star = save(shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")

    # shingle sets of the nodes that share a bucket; a node's text is that of one of its rows
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("row_key", "node")
    texts = d.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key"])
    sets = save(texts.select("node", "text").mapInArrow(_sets(words), "node long, shingles binary"), "near-sets")

    links = save(confirm(star, sets, percent), "near-links")
    roots = components(links)
    labelled = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = save(labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                 .where("lo <> hi").select("bucket"), "near-mixed")
    again = (labelled.join(mixed, "bucket", "left_semi")
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "root")
             .join(nodes.select("node", "n", F.col("sketch").alias("data"), "buckets"), "node"))
    cell = "bucket long, bi long, bj long, own long, a long, b long"
    scanned = save(_dealt(again).mapInArrow(_scan(percent), cell), "near-more")
    unsure = scanned.where("b is null").select("bucket", "bi", "bj", "own", F.col("a").alias("node"))
    whole = (unsure.join(nodes.select("node", "n", "buckets"), "node").join(sets.withColumnRenamed("shingles", "data"), "node")
             .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    settled = _dealt(whole).mapInArrow(_settle(percent), "a long, b long")
    extra = save(scanned.where("b is not null").select("a", "b").unionByName(settled), "near-links")
    rooted = nodes.select("digest", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not extra.isEmpty():  # links between components: join those
        of = rooted.select("node", "root")
        between = (extra.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").where("ra <> rb")
                   .select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        rooted = (rooted.join(components(between).toDF("root", "joined"), "root", "left")
                  .withColumn("root", F.coalesce("joined", "root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component")).hint("rebalance")
    found = rooted.join(least, "root").select("digest", "component")
    return (described.select("doc_id", "row_key", "n_shingles", "digest").join(found, "digest", "left")
            .select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "row_key")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def with_row_key(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Adds ``name``: a 128-bit digest of the row's id and text."""
    return df.withColumn(name, F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text_or_empty(text_col)))))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) that :func:`near_duplicates` keeps."""
    key, other = fresh(docs, "row_key", "gone_key")
    gone = (near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, percent=percent).where("not kept")
            .select(F.col("row_key").alias(other)).distinct())
    return with_row_key(docs, id_col, text_col, key).join(gone, F.col(key) == F.col(other), "left_anti").select(*docs.columns)
