"""Token-id files of independent zstandard frames with a seek table.

Layout of a file (``.ids.zst``): one zstandard frame per run of whole documents
(little-endian unsigned 32-bit ids, content size and content checksum in the
frame); a skippable frame with the document index; a skippable frame with the
seek table of the public seekable format (per frame: compressed size, size,
low 32 bits of the xxhash64 of the content; footer). Any zstandard decoder
reads the ids in order; a reader that wants some documents reads the table and
the index at the end and decompresses only the frames that hold them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_folder, row_budget, run_folder, save, ship_package, text_or_empty, tokenizer

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


class FrameWriter:
    """Writes documents' ids to an open binary file."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []  # has id, id, tokens, frame, offset in it
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.frame_bytes:
            self._close_frame()
        self.index.append((doc_id is not None, doc_id or 0, len(ids) // 4, len(self.frames), self.size))
        self.held.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        import xxhash

        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def finish(self) -> int:
        """Close the file; number of documents in it."""
        import numpy as np

        if self.held:
            self._close_frame()
        index = self.packer.compress(np.array(self.index, "<i8").reshape(-1, 5).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table) + 9) + table
                       + struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        return len(self.index)


class FrameReader:
    """Reads documents from a seekable binary file."""

    def __init__(self, src):
        import numpy as np
        import zstandard

        self.src, self.unpacker = src, zstandard.ZstdDecompressor()
        self.read_frames = 0
        end = src.seek(0, 2)
        src.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token-id file: no seek table at its end")
        src.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(src.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0].astype("i8"))])
        src.seek(int(self.at[n - 1]) + 8)
        raw = self.unpacker.decompress(src.read(int(self.table[-1, 0]) - 8))
        self.index = np.frombuffer(raw, "<i8").reshape(-1, 5)

    def frame(self, k: int) -> bytes:
        import xxhash

        self.src.seek(int(self.at[k]))
        data = self.unpacker.decompress(self.src.read(int(self.table[k, 0])))
        self.read_frames += 1
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: content does not match the seek table")
        return data

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, tokens of the file before it, ids) in file order; with
        ``wanted`` only those ids, decompressing only their frames."""
        held, data, start = -1, b"", 0
        for has, doc, n, k, offset in self.index.tolist():
            doc_id = doc if has else None
            if wanted is None or doc_id in wanted:
                if k != held:
                    held, data = k, self.frame(k)
                yield doc_id, start, data[offset:offset + 4 * n]
            start += n


def _writer(folder: str, path: str, spaces: str, end_id: int, frame_bytes: int, file_bytes: int, file_docs: int):
    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        store, at = open_folder(folder)
        tok, end = tokenizer(path, spaces), np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        # a name of its own for each attempt: only files named in manifest rows count
        attempt = uuid.uuid4().hex
        out = writer = None
        tokens = part_no = 0

        def closed():
            docs = writer.finish()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part_no], pa.int32()), pa.array([name]),
                                               pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())],
                                              names=["shard", "part", "file", "docs", "tokens"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in row_budget(zip(batch.column(0).to_pylist(), texts, strict=True), map(len, texts), 4 << 20):
                for (doc_id, _), ids in zip(part, tok.ids([t for _, t in part]), strict=True):
                    if writer is not None and (4 * tokens + len(ids) + 4 > file_bytes or len(writer.index) >= file_docs):
                        yield closed()
                        writer, tokens, part_no = None, 0, part_no + 1
                    if writer is None:
                        store.create_dir(at, recursive=True)
                        name = f"shard-{shard:06d}-{part_no:06d}-{attempt}.ids.zst"
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                        writer = FrameWriter(out, frame_bytes)
                    writer.add(doc_id, ids + end)
                    tokens += len(ids) // 4 + 1
        if writer is not None:
            yield closed()

    return write


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, *, id_col: str = "doc_id",
                      text_col: str = "text", spaces: str = "whole", end_id: int = 2, frame_bytes: int = 1 << 20,
                      file_bytes: int = 256 << 20, file_docs: int = 500_000, shards: int | None = None) -> DataFrame:
    """Write the ids of all documents to files in ``folder``, in ascending id
    order over the shards (nulls first, repeated ids by their texts' hashes).

    Returns the manifest, one row per file: ``shard, part, file, docs, tokens,
    start`` (tokens of all files before it). It is written beside the files,
    so reading it again does not write them anew. Files of failed attempts may
    stay in the folder; the manifest does not name them. A shard's next file
    begins where ids would pass ``file_bytes`` (a larger single document has a
    file of its own) or documents ``file_docs``, which bounds the index.

    Defined cases: a null or empty text is the end id alone; a document larger
    than ``frame_bytes`` has a frame of its own; repeated rows are written as
    often as they occur; an empty table gives an empty manifest; other columns
    are not read. Ids must be whole numbers or null.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    files = (rows.repartitionByRange(shards, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
             .mapInArrow(_writer(folder, tokenizer_path, spaces, end_id, frame_bytes, file_bytes, file_docs),
                         "shard int, part int, file string, docs long, tokens long"))
    manifest = save(files, "token-manifest")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, not per document
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _reader(folder: str, wanted: set | None):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, at = open_folder(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as src:
                    rows, held = [], 0
                    for doc_id, start, ids in FrameReader(src).documents(wanted):
                        rows.append((doc_id, base + start, len(ids) // 4, ids))
                        held += len(ids)
                        if held > 8 << 20:
                            yield _batch(pa, rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(pa, rows)

    return read


def _batch(pa, rows):
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def read_token_files(manifest: DataFrame, folder: str, doc_ids: set | None = None) -> DataFrame:
    """``doc_id, start`` (ids of all documents before it), ``n_tokens, ids``
    of the files a manifest names; with ``doc_ids`` (a small set) only those
    documents, decompressing only the frames that hold them."""
    spark = manifest.sparkSession
    ship_package(spark)
    files = manifest.select("file", "start", "shard", "part")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = files.repartitionByRange(n, "shard", "part").select("file", "start")  # a file or a few to each task
    return spread.mapInArrow(_reader(folder, doc_ids), "doc_id long, start long, n_tokens long, ids binary")


def token_folder(spark) -> str:
    """A new folder for token files below the shared folder."""
    return run_folder(spark, "token-ids")
