"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.session import checkpoint_dir, ship_package

#: Words of all word-based contracts: runs of anything but ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that separates them (fixed value).
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["WORD", "SPACE", "apart", "smallest_hashes", "fresh", "held", "run_folder", "save", "ship_package", "text_or_empty", "open_folder",
           "row_budget", "batch_slices", "PieceTokenizer", "tokenizer",
           "words_of", "span_hashes", "mix", "byte_values"]


def text_or_empty(col: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """array<string> of the words of ``text`` (empty array without words)."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def held(col: Column) -> Column:
    """``col``, evaluated once per row where it is defined.

    Spark pushes filters through projections by putting the columns' expressions
    in their place; an array that other expressions index would then be computed
    again for each element. The (always true) partition test is not
    deterministic to the optimizer, which therefore leaves the column alone."""
    return F.when(F.spark_partition_id() >= 0, col)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` bears (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        n = f"__{name}"
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def apart(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` and, in the struct ``row``, all of its columns:
    what an operator adds under names that the caller uses leaves those alone,
    and ``select("row.*")`` gives the caller's rows back."""
    return docs.select(*columns, F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def smallest_hashes(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``ids`` (column ``id``), those whose ids have the
    smallest hashes: a bounded, repeatable sample. Hashes above the place where
    some four times as many rows are expected are left out first, so that
    neither a task nor the driver gets ``limit`` rows of every partition."""
    n = ids.count()
    h = F.xxhash64("id")
    if n > 4 * limit:
        ids = ids.where(h < F.lit(-(1 << 63) + (1 << 64) * 4 * limit // n))
    return ids.orderBy(h, "id").limit(limit)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    lineage, computes once, and survives lost executors."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str):
    """(pyarrow file system, path) of a shared folder's URI, on any node."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9+.-]+:/", uri) else f"file://{uri}")


def row_budget(rows, sizes, budget: int):
    """Consecutive lists of ``rows`` whose ``sizes`` add up to ``budget`` at most
    (a larger single row stands alone)."""
    out, held = [], 0
    for row, size in zip(rows, sizes, strict=True):
        if out and held + size > budget:
            yield out
            out, held = [], 0
        out.append(row)
        held += size
    if out:
        yield out


def batch_slices(batch, column: str, budget: int, row: int = 0):
    """Consecutive slices of an Arrow record batch, so that no more than
    ``budget`` bytes of ``column`` become Python values at once (a larger single
    row stands alone); ``row`` bytes are added for what each row takes besides."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for part in row_budget(range(batch.num_rows), [s + row for s in size], budget):
        yield batch.slice(part[0], len(part))


# ------------------------------------------------------------ word hashes
_MULTIPLIER, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list = []
#: Bytes that :func:`span_hashes` works on at once.
BLOCK = 1 << 17


def _powers(n: int):
    """Powers 0 .. n-1 (at least) of the multiplier and of its inverse."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        block, out = 1 << 16, []
        for base in (_MULTIPLIER, _INVERSE):
            p = np.full(block, base, np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
            heads = np.array([pow(base, block * i, 1 << 64) for i in range(-(-n // block))], np.uint64)
            out.append((heads[:, None] * p[None, :]).ravel())
        _POWERS[:] = out
    return _POWERS


def span_hashes(raw, start, end, value):
    """64-bit hashes of the byte spans ``raw[start:end]`` (numpy arrays, both
    rising), as differences of one running polynomial sum; ``value`` maps bytes
    to odd random numbers. The sum runs block by block: besides arrays of one
    number a span, the memory does not grow with ``raw``."""
    import numpy as np

    up, down = _powers(min(len(raw), BLOCK))
    h, before, back = (np.zeros(len(start), np.uint64) for _ in range(3))
    total = np.uint64(0)
    for at in range(0, len(raw), BLOCK):
        n = min(BLOCK, len(raw) - at)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(value[raw[at:at + n]] * up[:n], out=run[1:])
        run *= np.uint64(pow(_MULTIPLIER, at, 1 << 64))
        run += total
        total = run[-1]
        here = slice(*np.searchsorted(start, [at, at + n]))
        before[here] = run[start[here] - at]
        back[here] = down[start[here] - at] * np.uint64(pow(_INVERSE, at, 1 << 64))
        here = slice(*np.searchsorted(end, [at, at + n], "right"))
        h[here] = run[end[here] - at]
    h = (h - before) * back
    return mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def mix(h):
    """Finaliser of a 64-bit hash (wraps)."""
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_values(seed: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


# ------------------------------------------------------------- token ids
_TWO_SPACES = re.compile(r"\s\s")
_BEFORE_WORD = re.compile(r"(?= \S)")
_ODD = re.compile(r"[\s\x00-\x1f]")


def _odd(word: str) -> bool:
    """White space or control signs anywhere but as the space before the word."""
    return _ODD.search(word, 1 if word[:1] == " " else 0) is not None


class _IdCache:
    """Piece hash -> ids, as arrays (some 40 bytes a piece): sorted hashes, with
    place and number of ids in a pool. New pieces gather in a small part that is
    merged into the large one as it grows; a full cache takes no more."""

    def __init__(self, most: int):
        import numpy as np

        self.most = most
        self.pool = np.empty(1 << 12, "<u4")
        self.used = 0
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.parts = [empty, empty]

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, keys):
        """Place and number of ids of each key; number -1 where it is unknown."""
        import numpy as np

        at, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for known, places, counts in self.parts:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                at[hit], n[hit] = places[i[hit]], counts[i[hit]]
        return at, n

    def add(self, keys, counts, data) -> None:
        import numpy as np

        room = max(0, self.most - len(self))
        keys, counts = keys[:room], counts[:room]
        if not len(keys):
            return
        data = data[:counts.sum()]
        places = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        while self.used + len(data) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used:self.used + len(data)] = data
        self.used += len(data)

        def merged(*parts):
            k, p, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(k)
            return k[order], p[order], c[order]

        large, small = self.parts
        small = merged(small, (keys, places, counts))
        if 4 * len(small[0]) > len(large[0]):
            large, small = merged(large, small), tuple(x[:0] for x in small)
        self.parts = [large, small]


class PieceTokenizer:
    """Token ids of whole texts by the ``tokenizers`` library, piece by piece.

    BPE never merges across its pre-tokenizer's borders, so a text may be cut
    at borders that every such rule has, and equal pieces need encoding only
    once. ``spaces`` names the rule of the tokenizer file:

    * ``"leading"``: byte-level BPE that keeps a single space with the word
      behind it. A cut before a single space is a border, and so is each side
      of a line end between non-spaces; texts with runs of white space are cut
      only before a space that a non-space follows.
    * ``"dropped"``: white space ends words and yields no ids.
    * ``"whole"``: any other file; texts are encoded whole.

    In both rules a full stop or comma at a word's end, behind a letter, is a
    piece of its own. Words are found by their 64-bit hashes, over blocks of
    texts in arrays; only words that are new to the cache are looked at one by
    one. The cache holds ``max_pieces`` at most (a bound on memory only: others
    are encoded each time they come).
    """

    SEGMENT = 1 << 19

    def __init__(self, path: str, spaces: str = "whole", max_pieces: int = 1_500_000):
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        if spaces not in ("leading", "dropped", "whole"):
            raise ValueError(f"unknown rule {spaces!r}")
        self.inner = Tokenizer.from_file(path)
        # the library takes these out of a text before anything else; texts are cut at them, so pieces hold none
        added = {t.content: i for i, t in self.inner.get_added_tokens_decoder().items()}
        plain = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in self.inner.get_added_tokens_decoder().values())
        self.added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        if added and not plain:  # they take in what stands around them: only whole texts will do
            spaces = "whole"
        self.spaces = spaces
        self.known = _IdCache(max_pieces)
        self.value = byte_values(20240502)
        # signs that are one id each, looked up by their byte
        self.sign = {ord(c): np.frombuffer(self._encode([c])[0], "<u4") for c in ".,\n "}
        self.tails = [b for b in b".," if len(self.sign[b]) == 1]
        # a sign between words that are encoded together; as an id it stands for itself alone
        self.between = "\n" if spaces == "leading" else " \x01 "
        self.between_id = np.frombuffer(self._encode([self.between])[0], "<u4")
        self.letter = np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True

    def _encode(self, pieces: list[str]) -> list[bytes]:
        from array import array

        out: list[bytes] = []
        for i in range(0, len(pieces), 4096):
            out += [array("I", e.ids).tobytes() for e in
                    self.inner.encode_batch_fast(pieces[i:i + 4096], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str], plain: int):
        """Number of ids of each word and all ids, in order. The first ``plain``
        words are encoded many at a time, with a sign between them whose id
        tells where each ends; the others have odd signs and stand alone."""
        import numpy as np

        counts, data = [], []
        for part in [words[i:min(i + 2000, plain)] for i in range(0, plain, 2000)] + [words[plain:]]:
            if not part:
                continue
            if len(self.between_id) == 1 and not _odd(part[0]):
                ids = np.array(self.inner.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, "<u4")
                cut = np.flatnonzero(ids == self.between_id[0])
                if len(cut) == len(part) - 1:
                    counts.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                    data.append(np.delete(ids, cut))
                    continue
            each = self._encode(part)
            counts.append(np.array([len(x) for x in each], np.int64) // 4)
            data.append(np.frombuffer(b"".join(each), "<u4"))
        return np.concatenate(counts).astype(np.int64), np.concatenate(data)

    def _block(self, segments: list[bytes]) -> list[bytes]:
        """Ids of segments without runs of white space (rule ``leading``) or of
        any segments (rule ``dropped``)."""
        import numpy as np

        leading = self.spaces == "leading"
        size = np.array([len(x) + 1 for x in segments])
        data = b"\n".join(segments)
        raw = np.frombuffer(data, np.uint8)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return [self.sign[x[0]].tobytes() if leading and x else b"" for x in segments]
        begins = np.cumsum(size) - size
        # a word's own ids, with a line end's before them and a sign's behind
        last = raw[end - 1]
        tail = (end - start > 1) & self.letter[raw[np.maximum(end - 2, 0)]] & np.isin(last, self.tails)
        core = end - tail
        key = span_hashes(raw, start, core, self.value)
        head = np.zeros(len(start), bool)
        if leading:
            before = raw[np.maximum(start - 1, 0)]
            first = np.isin(start, begins)
            spaced = (before == 32) & ~first
            head = ~spaced & ~first
            key = mix(key ^ spaced.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        unique, one, which = np.unique(key, return_index=True, return_inverse=True)
        at, count = self.known.find(unique)
        pool, more = self.known.pool, np.empty(0, "<u4")
        new = np.flatnonzero(count < 0)
        if len(new):
            pieces = [data[a:b] for a, b in zip(start[one[new]].tolist(), core[one[new]].tolist(), strict=True)]
            if leading:
                pieces = [b" " + p if x else p for p, x in zip(pieces, spaced[one[new]].tolist(), strict=True)]
            words = [p.decode("utf-8", "surrogatepass") for p in pieces]
            odd = np.array([_odd(w) for w in words])
            new = np.concatenate([new[~odd], new[odd]])
            words = [w for w, o in zip(words, odd, strict=True) if not o] + [w for w, o in zip(words, odd, strict=True) if o]
            count[new], more = self._encode_words(words, int((~odd).sum()))
            at[new] = len(pool) + np.cumsum(count[new]) - count[new]
        n = count[which]
        total = np.concatenate([[0], np.cumsum(n + head + tail)])
        out = np.empty(total[-1], "<u4")
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source = np.repeat(at[which], n) + within
        place = np.repeat(total[:-1] + head, n) + within
        old = source < len(pool)
        out[place[old]] = pool[source[old]]
        out[place[~old]] = more[source[~old] - len(pool)]
        if head.any():
            out[total[:-1][head]] = self.sign[10][0]
        for b in self.tails:
            out[total[1:][tail & (last == b)] - 1] = self.sign[b][0]
        if len(new):
            self.known.add(unique[new], count[new], more)
        words = np.searchsorted(start, np.concatenate([begins, [len(raw) + 1]]))
        bounds = total[words].tolist()
        result = [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if leading:  # white space at a segment's end stands alone
            for k, x in enumerate(segments):
                if x[-1:] in (b" ", b"\n"):
                    result[k] += self.sign[x[-1]].tobytes()
        return result

    def _segments(self, text: str) -> list[str]:
        """``text`` cut before spaces into segments of bounded length."""
        if len(text) <= self.SEGMENT:
            return [text]
        out, at = [], 0
        while len(text) - at > self.SEGMENT:
            cut = text.rfind(" ", at + 1, at + self.SEGMENT)
            if cut < 0:
                cut = text.find(" ", at + 1)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as the library's plain
        call gives them: an added token's string in a text is that token."""
        if self.spaces != "whole" and self.cut and any(map(self.cut.search, texts)):
            parts = [self.cut.split(t) for t in texts]  # odd places hold the added tokens
            between = iter(self.ids([p for x in parts for p in x[::2]]))
            return [b"".join(self.added[p] if k % 2 else next(between) for k, p in enumerate(x)) for x in parts]
        if self.spaces == "whole":
            return [self._encode([t])[0] if t else b"" for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        block: list[tuple[int, bytes]] = []
        for k, t in enumerate(texts):
            if self.spaces == "leading" and (_TWO_SPACES.search(t) or len(self.sign[10]) != 1):
                pieces = [p for p in _BEFORE_WORD.split(t) if p]
                several = dict.fromkeys(pieces)
                several.update(zip(several, self._encode(list(several)), strict=True))
                out[k] = [several[p] for p in pieces]
            elif t:
                block += [(k, x.encode("utf-8", "surrogatepass")) for x in self._segments(t)]
        for part in row_budget(block, [len(x) for _, x in block], 1 << 20):
            for (k, _), ids in zip(part, self._block([x for _, x in part]), strict=True):
                out[k].append(ids)
        return [b"".join(x) for x in out]


_TOKENIZERS: dict[tuple, PieceTokenizer] = {}


def tokenizer(path: str, spaces: str = "whole") -> PieceTokenizer:
    """One tokenizer per Python worker, path and rule."""
    key = (path, spaces)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = PieceTokenizer(path, spaces)
    return _TOKENIZERS[key]
