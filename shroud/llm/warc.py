"""WARC archives: a writer with revisit records and a Python data source.

The reader plans one partition per group of archive files, takes predicates on
the record type and on header columns from Spark, parses each record's header
first, and decodes a payload only if the record passed and the read schema has
the payload. In compressed archives each record is a gzip member of its own
that carries its length in the ``sl`` extra field, so an unwanted record is
skipped by a seek after its header; in plain ones Content-Length does that.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull,
                                    StringStartsWith)
from pyspark.sql.types import StructType

from .common import open_folder, run_folder, save, ship_package

# Fixed values of the WARC 1.1 format and of revisit records.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: Columns a reader can ask for -> the WARC header they come from (None: not a header).
COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "record_date": "warc-date", "page_id": "x-page-id", "refers_to": "x-refers-to-page",
           "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length",
           "content_length": "content-length", "payload": None}
SCHEMA = ("record_id string, record_type string, target_uri string, record_date string, page_id string, "
          "refers_to string, payload_digest string, payload_length long, content_length long, payload binary")


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member with its lengths in the ``sl`` extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 24 + len(body) + 8
    fits = size < 1 << 32 and len(data) < 1 << 32
    head = struct.pack("<BBBBIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8,
                       size if fits else 0, len(data) if fits else 0)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One WARC record; line ends in field values are percent-encoded."""
    lines = [VERSION]
    for k, v in [*fields.items(), ("Content-Length", len(block))]:
        if v is not None:
            lines.append(f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A").encode())
    return b"\r\n".join(lines) + END + block + END


def http_block(payload: bytes) -> bytes:
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + END + payload)


def parse_header(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """The payload in a record's block: without the HTTP head, if it has one."""
    if header.get("content-type", "").startswith("application/http"):
        return block.partition(END)[2]
    return block


def _member_size(src) -> int | None:
    """Length of the gzip member at the position from its ``sl`` field, or None."""
    head = src.read(12)
    if len(head) == 12 and head[3] & 4:
        extra = src.read(struct.unpack("<H", head[10:12])[0])
        while len(extra) >= 4:
            tag, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
            if tag == b"sl" and n == 8:
                return struct.unpack("<I", extra[4:8])[0] or None
            extra = extra[4 + n:]
    return None


def scan(src, wanted: Callable[[dict[str, str]], bool], with_payload: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload or empty) of the wanted records of an open archive."""
    src = io.BufferedReader(src, 1 << 20)
    start = src.read(2)
    src.seek(0)
    if start == b"\x1f\x8b":
        yield from _scan_gzip(src, wanted, with_payload)
        return
    while line := src.readline():
        if not line.strip():
            continue
        head = [line]
        while (line := src.readline()) not in (b"\r\n", b""):
            head.append(line)
        header = parse_header(b"".join(head))
        n = int(header.get("content-length", "0"))
        if wanted(header):
            if with_payload:
                yield header, payload_of(header, src.read(n))
            else:
                src.seek(n, 1)
                yield header, b""
        else:
            src.seek(n, 1)


def _scan_gzip(src, wanted, with_payload) -> Iterator[tuple[dict[str, str], bytes]]:
    while src.peek(1):
        at = src.tell()
        size = _member_size(src)
        src.seek(at)
        d, data = zlib.decompressobj(31), b""
        while END not in data and not d.eof and (raw := src.read(2048 if size is None else min(2048, at + size - src.tell()))):
            data += d.decompress(raw)
        head, _, block = data.partition(END)
        header = parse_header(head)
        keep = wanted(header)
        n = int(header.get("content-length", "0"))
        if keep and with_payload:
            parts = [block]
            while not d.eof and (raw := src.read(1 << 16 if size is None else min(1 << 20, at + size - src.tell()))):
                parts.append(d.decompress(raw))
            yield header, payload_of(header, b"".join(parts)[:n])
        elif keep:
            yield header, b""
        if size is not None:
            src.seek(at + size)
        else:
            while not d.eof and (raw := src.read(1 << 16)):
                d.decompress(raw)
            src.seek(-len(d.unused_data), 1)


# ------------------------------------------------------------ data source
class Archives(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.schema = schema
        if unknown := [n for n in self.names if n not in COLUMNS]:
            raise ValueError(f"unknown columns {unknown}")
        self.folder = options["path"]
        self.group_bytes = int(options.get("groupBytes", 128 << 20))
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        """Takes equality, IN and prefix predicates on header columns."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            header = COLUMNS.get(name)
            text = isinstance(getattr(f, "value", ()), (str, list, tuple)) and name not in ("payload_length", "content_length")
            if header and isinstance(f, EqualTo) and text:
                self.equal.append((header, frozenset([f.value])))
            elif header and isinstance(f, In) and text:
                self.equal.append((header, frozenset(f.value)))
            elif header and isinstance(f, StringStartsWith):
                self.prefix.append((header, f.value))
            elif header and isinstance(f, IsNotNull):
                self.prefix.append((header, ""))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        """Groups of archives of about ``groupBytes``; files named by the
        folder's manifest, else all ``.warc`` and ``.warc.gz`` files."""
        from pyarrow import fs

        store, at = open_folder(self.folder)
        if store.get_file_info(f"{at}/_archives.json").type != fs.FileType.NotFound:
            with store.open_input_stream(f"{at}/_archives.json") as f:
                files = [(x["file"], x["bytes"]) for x in json.loads(f.read())]
        else:
            found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
            files = sorted((x.base_name, x.size) for x in found if x.base_name.endswith((".warc", ".warc.gz")))
        groups: list[list[str]] = []
        held = 0
        for name, size in files:
            if not groups or held + size > self.group_bytes:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [Archives(g) for g in groups] or [Archives([])]

    def _wanted(self, header: dict[str, str]) -> bool:
        return (all(header.get(k) in v for k, v in self.equal)
                and all(k in header and header[k].startswith(v) for k, v in self.prefix))

    def read(self, partition: Archives):
        import pyarrow as pa

        store, at = open_folder(self.folder)
        kinds = {"payload": pa.binary(), "payload_length": pa.int64(), "content_length": pa.int64()}
        target = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        for name in partition.files:
            with store.open_input_file(f"{at}/{name}") as src:
                rows, held = [], 0
                for header, payload in scan(src, self._wanted, "payload" in self.names):
                    rows.append((header, payload))
                    held += len(payload) + 500
                    if held > 8 << 20:
                        yield self._batch(pa, target, rows)
                        rows, held = [], 0
                if rows:
                    yield self._batch(pa, target, rows)

    def _batch(self, pa, target, rows):
        cols = []
        for n in self.names:
            if n == "payload":
                cols.append([p for _, p in rows])
            elif n in ("payload_length", "content_length"):
                cols.append([int(h[COLUMNS[n]]) if COLUMNS[n] in h else None for h, _ in rows])
            else:
                cols.append([h.get(COLUMNS[n]) for h, _ in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(columns you need).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ----------------------------------------------------------------- writer
def _writer(folder: str, date: str, compress: bool, archive_bytes: int):
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, at = open_folder(folder)
        shard, out, name, size, done = TaskContext.get().partitionId(), None, None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                revisit = row["record_type"] == "revisit"
                fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + str(row['page_id']))}>",
                          "WARC-Date": date, "WARC-Target-URI": row["url"],
                          "WARC-Payload-Digest": "sha256:" + row["payload_digest"],
                          "X-Page-Id": row["page_id"], "X-Payload-Length": row["payload_bytes"]}
                if revisit:
                    fields |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page": row["refers_to"],
                               "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + str(row['refers_to']))}>"}
                    data = record(fields, b"")
                else:
                    data = record(fields | {"Content-Type": "application/http; msgtype=response"}, http_block(row["payload"]))
                if out is None:
                    # a name of its own for each attempt: only files in the manifest count
                    name = f"part-{shard:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    store.create_dir(at, recursive=True)
                    out, size = store.open_output_stream(f"{at}/{name}", compression=None), 0
                data = member(data) if compress else data
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        if done:
            yield pa.RecordBatch.from_pydict({"file": [x[0] for x in done], "bytes": [x[1] for x in done]})

    return write


def with_revisits(pages: DataFrame, *, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to`` of each page. Of equal payloads of ``min_bytes`` or more the one
    with the smallest page_id is a response, the others revisit it.

    The first page of a payload comes from an aggregation that combines before
    its shuffle, and goes back by an equi-join that Spark may split by rows, so
    a payload that a third of all pages share is no task's alone."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                 F.sha2("payload", 256).alias("payload_digest"))
    firsts = (p.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest"))
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    # written first, so that the join has a shuffle of its own that Spark may split
    firsts = save(firsts, "warc-firsts")
    j = p.join(firsts, p["payload_digest"] == firsts["digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
                    F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", compress: bool = True,
                   min_bytes: int = 100, archive_bytes: int = 256 << 20) -> None:
    """Write one record per page (``page_id, url, html``) into archives below
    ``folder``, and the list of the archives that count (``_archives.json``;
    one entry per archive).

    Defined cases: null html is an empty payload; payloads below ``min_bytes``
    are always responses; a null url leaves out WARC-Target-URI; rows with the
    same smallest page_id are all responses, and a group without any page_id
    has no revisits; an empty table writes an empty list; other columns are not
    read. A payload is held in memory whole, one at a time."""
    ship_package(pages.sparkSession)
    rows = with_revisits(pages, min_bytes=min_bytes).withColumn("page_id", F.col("page_id").cast("string"))
    files = save(rows.mapInArrow(_writer(folder, date, compress, archive_bytes), "file string, bytes long"), "warc-manifest")
    listed = [{"file": r["file"], "bytes": r["bytes"]} for r in files.orderBy("file").toLocalIterator()]
    store, at = open_folder(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/_archives.json") as f:
        f.write(json.dumps(listed).encode())


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all
    records: responses by their payloads, revisits by their headers alone."""
    register(spark)
    src = spark.read.format("warc")
    full = (src.schema("record_type string, page_id string, payload binary").load(folder)
            .where("record_type = 'response'")
            .select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                    F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to")))
    heads = (spark.read.format("warc").schema("record_type string, page_id string, payload_length long, payload_digest string, refers_to string")
             .load(folder).where("record_type = 'revisit'")
             .select("page_id", F.col("payload_length").alias("payload_bytes"),
                     F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", "refers_to"))
    return full.unionByName(heads)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared folder."""
    return run_folder(spark, "warc")
