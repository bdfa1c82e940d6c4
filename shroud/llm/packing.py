"""Hierarchical multi-length packing of token ids.

Documents are cut into windows of the longest context tier; what remains of
each goes to the shortest tier that holds it. Tiers are packed from the longest
to the shortest: a window that its document leaves open is filled with the best
fitting remainders of shorter tiers, and the last gap with a cut of one of
them, so windows are full. Windows are then dealt to step groups of about equal
numbers of tokens.

Everything happens inside the scan's tasks, over blocks of a bounded number of
tokens: no shuffle, no global state. What a block leaves over (less than the
shortest tier) is carried into the next block of the same task, so a task ends
with one padded window at most.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_budget, ship_package, text_or_empty, tokenizer

Piece = tuple[int, int, int]  # document in the block, start, length


class _Pool:
    """Remainders of a set of tiers, ordered by (length, document, start)."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []

    def add(self, length: int, doc: int, start: int) -> None:
        bisect.insort(self.items, (length, doc, start))

    def best(self, gap: int) -> Piece | None:
        """Take the longest remainder that fits; else cut the shortest to fit."""
        if not self.items:
            return None
        i = bisect.bisect_left(self.items, (gap + 1,)) - 1
        if i >= 0:
            length, doc, start = self.items.pop(i)
            return doc, start, length
        length, doc, start = self.items.pop(0)
        self.add(length - gap, doc, start + gap)
        return doc, start, gap


def pack_block(lengths: list[tuple[int, int]], tiers: tuple[int, ...], last: bool
               ) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Pack documents, given as (first open position, end), into full windows.

    Returns the windows as (padded length, pieces) and the pieces left over,
    fewer than the shortest tier's tokens; with ``last`` these too become a
    window, padded to the longest tier.
    """
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, (start, end) in enumerate(lengths):
        while end - start >= top:
            windows.append((top, [(doc, start, top)]))
            start += top
        if end > start:
            pools[tiers[bisect.bisect_left(tiers, end - start)]].append((end - start, doc, start))
    shorter = _Pool()
    for t in tiers[:-1]:
        shorter.items += pools[t]
    shorter.items.sort()
    own = sorted(pools[top])
    left: list[Piece] = []
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        while own:
            length, doc, start = own.pop()
            pieces, gap = [(doc, start, length)], tier - length
            while gap:
                piece = shorter.best(gap)
                if piece is None and own:  # no shorter tier has anything: cut the same tier's shortest
                    n, d, s = own.pop(0)
                    piece = (d, s, min(n, gap))
                    if n > gap:
                        bisect.insort(own, (n - gap, d, s + gap))
                if piece is None:
                    break
                pieces.append(piece)
                gap -= piece[2]
            if gap:
                left += pieces
            else:
                windows.append((tier, pieces))
        if k:
            cut = bisect.bisect_right(shorter.items, (tiers[k - 2] if k > 1 else 0, float("inf")))
            own, shorter.items = shorter.items[cut:], shorter.items[:cut]
    # an open window's pieces, cut into full windows of ever shorter tiers
    for tier in reversed(tiers):
        while sum(p[2] for p in left) >= tier:
            pieces, need = [], tier
            while need:
                doc, start, length = left.pop(0)
                take = min(length, need)
                pieces.append((doc, start, take))
                need -= take
                if take < length:
                    left.insert(0, (doc, start + take, length - take))
            windows.append((tier, pieces))
    if last and left:
        windows.append((top, left))
        left = []
    return windows, left


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Group of each window: the longest first, each to the group with the
    fewest tokens, over ceil(sum / step_tokens) groups."""
    n = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (held + sizes[i], g))
    return out


#: Columns of the result and their Spark types (``doc_id`` has the input's type).
COLUMNS = (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"),
           ("offset", "long"), ("tier", "int"), ("step_group", "long"))


def _packer(path: str, spaces: str, end_id: int, tiers: tuple[int, ...], block_tokens: int, step_tokens: int):
    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tok, end = tokenizer(path, spaces), np.array([end_id], "<u4").tobytes()
        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        # ids of windows and groups: the task's number above its own count, so a repeated task gives the same
        sequence = group = TaskContext.get().partitionId() << 40
        docs: list[tuple] = []  # (doc_id, ids still to be packed, position of the first of them, tokens of the document)
        held, kind = 0, None

        def flush(last: bool) -> Iterator:
            nonlocal sequence, group, docs, held
            windows, left = pack_block([(base, base + len(ids) // 4) for _, ids, base, _ in docs], tiers, last)
            groups = step_groups([w[0] for w in windows], step_tokens)
            rows = []
            for (tier, pieces), g in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    key, ids, base, total = docs[doc]
                    at = (start - base) * 4
                    rows.append((key, start, length, ids[at:at + 4 * length], total, sequence, offset, tier, group + g))
                    offset += length
                sequence += 1
            group += max(groups, default=-1) + 1
            docs = [(docs[d][0], docs[d][1][(s - docs[d][2]) * 4:(s - docs[d][2] + n) * 4], s, docs[d][3])
                    for d, s, n in left]
            held = sum(n for _, _, n in left)
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i:i + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], kind)] + [pa.array(c, types[t]) for c, (_, t) in zip(cols[1:], COLUMNS, strict=True)],
                    names=["doc_id"] + [n for n, _ in COLUMNS])

        for batch in batches:
            kind = batch.column(0).type
            texts = batch.column(1).to_pylist()
            rows = zip(batch.column(0).to_pylist(), texts, strict=True)
            for part in row_budget(rows, map(len, texts), 4 << 20):
                for (key, _), ids in zip(part, tok.ids([t for _, t in part]), strict=True):
                    docs.append((key, ids + end, 0, len(ids) // 4 + 1))
                    held += len(ids) // 4 + 1
                if held >= block_tokens:
                    yield from flush(False)
        if docs:
            yield from flush(True)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                   spaces: str = "whole", end_id: int = 0, tiers: tuple[int, ...] = (64, 128, 256, 512, 1024),
                   block_tokens: int = 1_000_000, step_tokens: int = 64 * 1024) -> DataFrame:
    """One row per piece of a document in a packed window.

    Result: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit),
    ``doc_tokens`` (with the end id), ``sequence_id, offset`` (in the window,
    gapless from 0), ``tier`` (padded length of the window), ``step_group``.
    Windows shorter than the longest tier are full; each task's last window may
    be open and counts as padded to the longest tier.

    Defined cases: a null or empty text is the end id alone; a document longer
    than a window is cut, however long; rows that repeat are packed as often as
    they occur, null ids included; an empty table gives no rows; other columns
    of ``docs`` are not read, so their names cannot clash. A table's windows
    depend on how its scan is split, each id lies in one of them in any case.
    """
    tiers = tuple(sorted(set(tiers)))
    if tiers[0] < 1 or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, spaces, end_id, tiers, block_tokens, step_tokens),
                           f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in COLUMNS))
