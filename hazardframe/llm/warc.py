"""WARC archives as a Spark data source.

Writing gives one or more ``.warc.gz`` files per task, each record a gzip member of its own whose header also states
the member's length, so that a reader can hop from record to record. Reading plans tasks over files (small files are put
together up to a target size, so a task's share is bounded by that or by one file), parses a record's headers from the
first inflated bytes, tests the pushed predicates on them, and inflates the block only of records that pass. Archives of
other writers, compressed or not, are read as well; without the length field members are inflated to their end.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage,
)

from hazardframe.llm.storage import open_store

MANIFEST = "manifest.json"
FILE_BYTES = 256 << 20
TASK_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
MIN_REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

# Column of the reader -> header it shows.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length",
}


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_number(uri_column):
    """The page id in a record URI of this writer; NULL for other records."""
    return F.nullif(F.regexp_extract(F.coalesce(uri_column, F.lit("")), r"^<urn:x-page:(-?\d+)>$", 1), F.lit("")).cast("long")


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field WS holds its own total length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"WS", 8, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


# --- reading --------------------------------------------------------------------------------------------------------


def parse_headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Headers (lower-case names) and the length of the header part; None if it is not complete in ``raw``."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    out: dict[str, str] = {}
    name = None
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out, end + 4


class Source:
    """Buffered reading with a look ahead."""

    def __init__(self, stream):
        self.stream, self.buffer = stream, b""

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self.stream.read(max(1 << 20, n - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.buffer = self.buffer[n:]
        return out


def records(stream, wanted: Callable[[dict[str, str]], bool], with_block: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of each record that ``wanted`` accepts by its headers."""
    source = Source(stream)
    while True:
        head = source.peek(2)
        if not head:
            return
        if head == b"\x1f\x8b":
            yield from _member(source, wanted, with_block)
        elif head in (b"\r\n", b"\n\r", b"\n\n"):
            source.take(2)
        elif head[:1] == b"\n":
            source.take(1)
        else:
            yield from _plain(source, wanted, with_block)


def _member_length(source: Source) -> int | None:
    head = source.peek(12)
    if len(head) < 12 or not head[3] & 4:
        return None
    extra = source.peek(12 + struct.unpack("<H", head[10:12])[0])[12:]
    while len(extra) >= 4:
        name, size = extra[:2], struct.unpack("<H", extra[2:4])[0]
        if name == b"WS" and size == 8:
            return struct.unpack("<Q", extra[4:12])[0]
        extra = extra[4 + size :]
    return None


def _member(source: Source, wanted, with_block):
    inflate = zlib.decompressobj(31)
    size = _member_length(source)
    if size is not None:
        # The member's length is known: inflate the headers, then the rest only if it is wanted.
        raw = source.take(size)
        text = inflate.decompress(raw, 4096)
        while (parsed := parse_headers(text)) is None and inflate.unconsumed_tail:
            text += inflate.decompress(inflate.unconsumed_tail, 65536)
        if parsed is None:
            raise ValueError("a record without the end of its headers")
        headers, begin = parsed
        if wanted(headers):
            block = None
            if with_block:
                text += inflate.decompress(inflate.unconsumed_tail) + inflate.flush()
                block = text[begin : begin + int(headers["content-length"])]
            yield headers, block
        return
    text = b""
    while not inflate.eof:
        raw = source.take(1 << 16)
        if not raw:
            raise ValueError("a gzip member ends too early")
        text += inflate.decompress(raw)
    source.buffer = inflate.unused_data + source.buffer
    yield from records(io.BytesIO(text), wanted, with_block)  # members with several records also occur


def _plain(source: Source, wanted, with_block):
    size = 1 << 12
    while (parsed := parse_headers(raw := source.peek(size))) is None:
        if len(raw) < size:
            raise ValueError("a record without the end of its headers")
        size *= 2
    headers, begin = parsed
    source.take(begin)
    left = int(headers["content-length"])
    if wanted(headers) and with_block:
        yield headers, source.take(left)
        return
    while left:  # passed over in small steps
        left -= len(source.take(min(left, 1 << 20)))
    if wanted(headers):
        yield headers, None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without the HTTP headers where it is an HTTP message."""
    if headers.get("content-type", "").startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        return block[end + 4 :] if end >= 0 else b""
    return block


@dataclass
class FilesPartition(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters) -> Iterable:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column in HEADERS and column != "payload_length" and isinstance(f, (EqualTo, In, StringStartsWith)):
                kind = "starts" if isinstance(f, StringStartsWith) else "in"
                values = f.value if isinstance(f, (In, StringStartsWith)) else (f.value,)
                self.tests.append((HEADERS[column], kind, values))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            have = headers.get(name)
            if have is None or not (have.startswith(value) if kind == "starts" else have in value):
                return False
        return True

    def partitions(self) -> list[FilesPartition]:
        out, files, size = [], [], 0
        for name, n in archive_files(self.path):
            if files and size + n > TASK_BYTES:
                out.append(FilesPartition(files))
                files, size = [], 0
            files.append(name)
            size += n
        return [*out, FilesPartition(files)] if files else out or [FilesPartition([])]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for name in partition.files:
            store, path = open_store(name)
            with store.open_input_stream(path, compression=None) as stream:
                for headers, block in records(stream, self.wanted, self.with_payload):
                    payload = None if block is None else payload_of(headers, block)
                    rows.append((headers, payload))
                    size += 500 + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows) -> pa.RecordBatch:
        columns = []
        for column, header in HEADERS.items():
            values = [h.get(header) for h, _ in rows]
            columns.append(pa.array([None if v is None else int(v) for v in values], pa.int64()) if column == "payload_length" else pa.array(values, pa.string()))
        columns.append(pa.array([p for _, p in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=[*HEADERS, "payload"])


def archive_files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the archives of a folder: those of the manifest if it has one, else all ``.warc`` and
    ``.warc.gz`` files; or the one file that ``path`` names."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/{MANIFEST}") as file:
            return [(f"{path}/{f['name']}", f["bytes"]) for f in json.loads(file.read())["files"]]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f"{path}/{f.path[len(root):].lstrip('/')}", f.size) for f in found if f.path.endswith((".warc", ".warc.gz")))


# --- writing --------------------------------------------------------------------------------------------------------


@dataclass
class FilesMessage(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilesMessage:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        partition = TaskContext.get().partitionId()
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for row in zip(*(c.to_pylist() if i < 5 else c for i, c in enumerate(batch.columns))):
                if out is None:
                    name, size = f"pages-{partition:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = gzip_member(self.record(*row))
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return FilesMessage(partition, files)

    @staticmethod
    def record(page_id, url, record_type, refers_to, digest, payload) -> bytes:
        payload = payload.as_py() or b""
        headers = {
            "WARC-Type": record_type, "WARC-Record-ID": record_uri(page_id), "WARC-Date": DATE, "WARC-Target-URI": url,
            "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response",
        }
        if record_type == "revisit":
            headers |= {"WARC-Refers-To": record_uri(refers_to), "WARC-Profile": REVISIT_PROFILE}
        return record_bytes(headers, HTTP_HEAD if record_type == "revisit" else HTTP_HEAD + payload)

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for f in m.files]
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"files": [{"name": n, "bytes": b} for n, b in files]}).encode())

    def abort(self, messages) -> None:
        store, root = open_store(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                store.delete_file(f"{root}/{name}")


class Warc(DataSource):
    """``warc``: option ``path``; for reading ``payload`` (false leaves payloads NULL and never inflates them); for
    writing ``file_bytes``. Rows to write are (page_id, url, record_type, refers_to, digest, payload)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length bigint, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The rows to write. Of pages with equal payloads of at least ``least_bytes``, the one with the largest id is the
    response and the others revisit it; all else are responses.

    NULL html is an empty payload. A page without an id revisits the largest id of its payload; if none of the payload's
    pages has an id, all are responses. Rows repeated with the largest id are all responses.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")
    )
    keepers = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    keepers = keepers.where("copies > 1 AND keeper IS NOT NULL").drop("copies")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.join(keepers, ["digest", "n"], "left").select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("keeper")).alias("refers_to"), "digest", "payload",
    )


def write_warc(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    rows.sparkSession.dataSource.register(Warc)
    rows.write.format("warc").option("file_bytes", file_bytes).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive or a folder of archives. Equality, IN and prefix tests on the header columns are evaluated
    on the headers, before a block is inflated."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
