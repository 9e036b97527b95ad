"""Token ids of whole texts, and a binary file format for them.

A ``packed_ids`` folder holds one file per task and a manifest. A file is a row of blocks; a block holds BLOCK_IDS ids,
each in the fewest bits that number the vocabulary, so unpacking is a NumPy operation on a whole block. Behind the
blocks stand the byte offset of each block and, for each document, its id and its first position: any document, and any
range of ids, is read by seeking to its blocks. The manifest lists the files in order with the number of ids before
each. Only files in the manifest count, so what a failed or repeated task attempt leaves behind is never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from hazardframe.llm import textblocks as tb
from hazardframe.llm.storage import open_store

MAGIC = b"PKDID001"
BLOCK_IDS = 1 << 16
MANIFEST = "manifest.json"
TAIL = struct.Struct("<IIQQQ8s")  # bits, ids per block, ids, documents, where the index begins, magic
READ_IDS = 1 << 20


# --- encoding -------------------------------------------------------------------------------------------------------

MAX_PIECE = 64  # longer pieces are not remembered
SLOT_BITS = 20  # of the table of remembered pieces
MAX_CACHED_IDS = 6_000_000
WORDS_AT_ONCE = 32


def _byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, the same as ``Tokenizer.encode`` gives.

    With a byte-level tokenizer no token crosses a single blank or line break that stands between two visible
    characters, nor the end of a word of letters before a full stop or comma. Texts are cut there, and each distinct piece
    that a bounded table does not hold is encoded once a slice. The table has one slot for a hash: a new piece takes the
    place of the old one. Any other tokenizer gets the texts as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before, model = kind.get("pre_tokenizer") or {}, kind["model"]
        self.cuttable = (
            before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and model["type"] == "BPE"
            and not model.get("dropout") and kind.get("normalizer") is None and kind.get("post_processor") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s.,]", t["content"]) for t in kind["added_tokens"])
        )
        self.separator = self._separator(kind) if self.cuttable else None
        characters = _byte_characters()
        self.characters = np.array([ord(characters[b]) for b in range(256)], "<u4")
        self._forget()

    @staticmethod
    def _separator(kind: dict) -> tuple[int, int] | None:
        """A control character, and its id, that no rule merges with what stands beside it: words between such characters are
        merged as if each stood alone."""
        model = kind["model"]
        if any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        rules = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = {left[-1] for left, _ in rules} | {right[0] for _, right in rules}
        characters = _byte_characters()
        free = [b for b in (*range(32), 127) if characters[b] in model["vocab"] and characters[b] not in merged]
        return (ord(characters[free[0]]), model["vocab"][characters[free[0]]]) if free else None

    def _forget(self) -> None:
        """An empty table: the piece in each slot, where its ids begin, and how many there are (0: none)."""
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.begin, self.size = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.uint8)
        self.ids = np.zeros(0, np.uint32)

    def _remember(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` go on from those of the table; what they leave without a slot is dropped from time to time."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.keys[slot], self.begin[slot], self.size[slot], self.ids = keys, begin, size, ids
        if len(self.ids) > MAX_CACHED_IDS:
            live = np.flatnonzero(self.size)
            n = self.size[live].astype(np.int64)
            if n.sum() > MAX_CACHED_IDS * 3 // 4:
                self._forget()
                return
            self.ids = self.ids[np.repeat(self.begin[live], n) + tb.segment_arange(n)]
            self.begin[live] = np.cumsum(n) - n

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text. NULL is an empty text."""
        parts, counts = [], []
        for lo, hi in tb.slices(texts):
            ids, n = self._cut(texts.slice(lo, hi - lo)) if self.cuttable else self._whole(texts.slice(lo, hi - lo))
            if end_id is not None:
                at = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                out[at] = ids
                ids, n = out, n + 1
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = tb.text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = _piece_starts(data, offsets, stops=True)
        ends = np.append(starts[1:], len(data))
        key = tb.range_hash(tb.prefix_hash(data), starts, np.minimum(ends, starts + MAX_PIECE))
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        begin, n = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
        long = ends - starts > MAX_PIECE
        unknown = np.flatnonzero((self.keys[slot] != key) | (n == 0) | long)
        ids = self.ids
        if len(unknown):
            wanted = key[unknown]
            longer = np.flatnonzero(long[unknown])
            wanted[longer] = np.arange(len(longer), dtype=np.uint64)  # never taken for another piece, and never remembered
            order = np.argsort(wanted)
            new = np.ones(len(wanted), bool)
            new[1:] = wanted[order[1:]] != wanted[order[:-1]]
            one, which = unknown[order[new]], np.cumsum(new) - 1
            found, size = self._encoded(data, starts[one], ends[one])
            at = len(ids) + np.cumsum(size) - size
            ids = np.concatenate([ids, found])
            begin[unknown[order]], n[unknown[order]] = at[which], size[which]
            kept = ~long[one]
            out = ids[np.repeat(begin, n) + tb.segment_arange(n)]
            self._remember(key[one[kept]], at[kept], size[kept], ids)
        else:
            out = ids[np.repeat(begin, n) + tb.segment_arange(n)]
        upto = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(upto[np.searchsorted(starts, offsets)])

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and how many each has. A word of letters, with a blank before it or not, is a single
        unit of merges, so the model itself is asked, for many words at once."""
        size = ends - starts
        of = np.cumsum(size) - size
        data = data[np.repeat(starts, size) + tb.segment_arange(size)]
        letter = _ASCII_LETTER[data]
        pair = (data[:-1] == 0xC3) & _LETTER_BEHIND_C3[data[1:]]
        letter[:-1] |= pair
        letter[1:] |= pair
        others = np.concatenate([[0], np.cumsum(~letter)])
        inner = of + ((data[of] == 32) & (size > 1))
        plain = (others[of + size] == others[inner]) & (self.separator is not None)
        counts, parts = np.zeros(len(size), np.int64), []
        words, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        if len(words):
            ids, counts[words] = self._words(data[np.repeat(plain, size)], size[words])
            parts.append((words, ids))
        if len(rest):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(of[rest].tolist(), (of + size)[rest].tolist())]
            got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            counts[rest] = np.fromiter(map(len, got), np.int64, len(got))
            parts.append((rest, np.fromiter(chain.from_iterable(got), np.uint32)))
        begin, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.uint32)
        for numbers, ids in parts:
            n = counts[numbers]
            out[np.repeat(begin[numbers], n) + tb.segment_arange(n)] = ids
        return out, counts

    def _words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of letters that fill ``data``, in a row, and how many each has."""
        character, mark = self.separator
        spelled = np.full(len(data) + len(size), character, "<u4")  # a separator behind each word
        spelled[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = self.characters[data]
        text = spelled.tobytes().decode("utf-32-le")
        cuts = [0, *(np.cumsum(size + 1)[WORDS_AT_ONCE - 1 :: WORDS_AT_ONCE]).tolist(), len(text)]
        tokenize = self.tokenizer.model.tokenize
        ids = np.array([t.id for a, b in zip(cuts, cuts[1:]) if a < b for t in tokenize(text[a:b])], np.uint32)
        marks = np.flatnonzero(ids == mark)
        return ids[ids != mark], np.diff(marks, prepend=-1) - 1


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Second bytes of the letters from U+00C0 to U+00FF: all but the multiplication and division signs.
_LETTER_BEHIND_C3 = np.zeros(256, bool)
_LETTER_BEHIND_C3[0x80:0xC0] = True
_LETTER_BEHIND_C3[[0x97, 0xB7]] = False
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
# First bytes of characters none of which is white space.
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_LEAD_OF_TWO = np.zeros(256, bool)
_LEAD_OF_TWO[0xC3:0xE0] = True


def _piece_starts(data: np.ndarray, offsets: np.ndarray, stops: bool = False) -> np.ndarray:
    """Where pieces begin: at each text, at each single blank or line break between visible characters, and behind such
    a line break; with ``stops`` also at a full stop or comma behind a letter. Rare characters next to it only mean that no
    cut is made there."""
    before = np.zeros(len(data), bool)
    before[1:] = _VISIBLE[data[:-1]]
    if len(data) > 2:
        before[2:] |= _LEAD_OF_TWO[data[:-2]] & (data[1:-1] >= 0x80)
    after = np.zeros(len(data), bool)
    after[:-1] = _VISIBLE[data[1:]] | _LEAD[data[1:]]
    inner = np.ones(len(data), bool)  # neighbours in another text do not count
    edges = offsets[(offsets < len(data))]
    inner[edges] = False
    inner[offsets[offsets > 0] - 1] = False
    alone = before & after & inner
    begin = alone & ((data == 32) | (data == 10))
    begin[1:] |= (alone & (data == 10))[:-1]
    begin[edges] = True
    if stops:
        at = np.flatnonzero((data[1:] == 44) | (data[1:] == 46)) + 1
        last = data[at - 1]
        begin[at[_ASCII_LETTER[last] | ((data[at - 2] == 0xC3) & (at > 1) & _LETTER_BEHIND_C3[last])]] = True
    return np.flatnonzero(begin)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in tb.slices(batch.column(1), 2 << 20):
            ids, counts = encoder(tokenizer).encode(batch.column(1).slice(lo, hi - lo), end_id)
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.int32(4)
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed], names=["doc_id", "ids"])


def _in_order(df: DataFrame, id_column: str, text: str) -> DataFrame:
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    return rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")


def encode_texts(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", end_id: int | None = 0) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each text, in ascending order of the id, NULL first;
    rows of equal id are ordered by a hash of their text. NULL texts count as empty and get the end id alone."""
    return _in_order(df, id_column, text).mapInArrow(lambda batches: _encoded(batches, tokenizer, end_id), "doc_id bigint, ids binary")


# --- file format ----------------------------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits one behind the other, lowest bit first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return rows[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw[: count * bits // 8].reshape(count, -1)
    else:
        wide = np.zeros((count, 32), np.uint8)
        wide[:, :bits] = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
        out = np.packbits(wide, axis=1, bitorder="little")
    return out.view("<u4").ravel()


class PackedFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.bits, self.block_ids, self.n_ids, self.n_docs, index, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a file of packed ids")
        raw = self.file.read_at(size - TAIL.size - index, index)
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1)
        at = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, at + 8 * self.n_docs)
        self.no_id = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * (2 * self.n_docs + 1)).astype(bool)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        low, high = start // self.block_ids, -(-end // self.block_ids)
        raw = self.file.read_at(int(self.offsets[high] - self.offsets[low]), int(self.offsets[low]))
        out = []
        for b in range(low, high):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            out.append(unpack(raw[self.offsets[b] - self.offsets[low] : self.offsets[b + 1] - self.offsets[low]], self.bits, n))
        return np.concatenate(out)[start - low * self.block_ids : end - low * self.block_ids]


@dataclass
class FileMessage(WriterCommitMessage):
    partition: int
    name: str
    n_docs: int
    n_ids: int


class PackedIdsWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.bits = options["path"], bits_for(int(options["vocabulary"]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FileMessage:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        partition = TaskContext.get().partitionId()
        name = f"ids-{partition:06d}-{uuid.uuid4().hex}.bin"
        offsets, doc_ids, no_id, sizes = [len(MAGIC)], [], [], []
        rest, total = np.zeros(0, np.uint32), 0
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)

            def put(ids: np.ndarray) -> None:
                if len(ids) and int(ids.max()) >> self.bits:
                    raise ValueError(f"id {int(ids.max())} does not fit the vocabulary")
                data = pack(ids, self.bits)
                out.write(data)
                offsets.append(offsets[-1] + len(data))

            for batch in iterator:
                doc_ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                no_id.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                for lo, hi in tb.slices(batch.column(1), 4 << 20):
                    ids, counts = _binary_ids(batch.column(1).slice(lo, hi - lo))
                    sizes.append(counts)
                    total += len(ids)
                    rest = np.concatenate([rest, ids])
                    whole = len(rest) // BLOCK_IDS * BLOCK_IDS
                    for at in range(0, whole, BLOCK_IDS):
                        put(rest[at : at + BLOCK_IDS])
                    rest = rest[whole:].copy()
            if len(rest):
                put(rest)
            ends = np.cumsum(np.concatenate(sizes)) if sizes else np.zeros(0)
            starts = np.concatenate([[0], ends]).astype("<u8")
            keys = np.concatenate(doc_ids) if doc_ids else np.zeros(0, "<i8")
            flags = np.concatenate(no_id) if no_id else np.zeros(0, np.uint8)
            out.write(np.array(offsets, "<u8").tobytes() + keys.tobytes() + starts.tobytes() + flags.tobytes())
            out.write(TAIL.pack(self.bits, BLOCK_IDS, total, len(keys), offsets[-1], MAGIC))
        return FileMessage(partition, name, len(keys), total)

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            files.append({"name": m.name, "docs": m.n_docs, "ids": m.n_ids, "before": before})
            before += m.n_ids
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"bits": self.bits, "ids": before, "files": files}).encode())

    def abort(self, messages) -> None:
        store, root = open_store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


def _binary_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), "<u4"), np.diff(at) // 4


@dataclass
class FilePartition(InputPartition):
    name: str
    before: int

    def __init__(self, name: str, before: int):
        super().__init__(name)
        self.name, self.before = name, before


def read_manifest(path: str) -> dict:
    store, root = open_store(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


class PackedIdsReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(f["name"], f["before"]) for f in read_manifest(self.path)["files"]]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        file = PackedFile(f"{self.path}/{partition.name}")
        starts = file.starts.astype(np.int64)
        at = 0
        while at < file.n_docs:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_IDS, "right")) - 1)
            to = min(to, int(file.n_docs))
            ids = file.ids(int(starts[at]), int(starts[to]))
            cuts = ((starts[at : to + 1] - starts[at]) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(file.doc_ids[at:to], mask=file.no_id[at:to]),
                pa.array(starts[at:to] + partition.before),
                pa.array(np.diff(starts[at : to + 1])),
                pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype("<u4"))]),
            ], names=["doc_id", "start", "n_tokens", "ids"])
            at = to


class PackedIds(DataSource):
    """``packed_ids``: options ``path`` and, for writing, ``vocabulary`` (number of ids). Rows to write are (doc_id, ids)."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema) -> PackedIdsReader:
        return PackedIdsReader(self.options)

    def writer(self, schema, overwrite: bool) -> PackedIdsWriter:
        return PackedIdsWriter(self.options)


def write_ids(encoded: DataFrame, path: str, vocabulary: int) -> None:
    """Write (doc_id, ids) rows in the order of their partitions. The tasks write and report their files, the driver writes the
    manifest; the data source does the same for ``df.write``, at the price of Python processes beside the driver."""
    _write(encoded, path, vocabulary, lambda batches: batches)


def write_texts(
    df: DataFrame, path: str, tokenizer: str, vocabulary: int, id_column: str = "doc_id", text: str = "text", end_id: int | None = 0
) -> None:
    """``write_ids`` of ``encode_texts`` with the same files. One Python process encodes and writes, where two steps keep two
    for each core, both with a tokenizer once they have changed places, and ids do not go through Spark's memory."""
    _write(_in_order(df, id_column, text), path, vocabulary, lambda batches: _encoded(batches, tokenizer, end_id))


def _write(rows: DataFrame, path: str, vocabulary: int, ids_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> None:
    options = {"path": path, "vocabulary": str(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = PackedIdsWriter(options).write(ids_of(batches))
        yield pa.RecordBatch.from_pydict({
            "partition": pa.array([done.partition], pa.int32()), "name": [done.name], "docs": pa.array([done.n_docs], pa.int64()), "ids": pa.array([done.n_ids], pa.int64()),
        })

    # One row for each task.
    written = rows.mapInArrow(run, "partition int, name string, docs bigint, ids bigint").collect()
    PackedIdsWriter(options).commit([FileMessage(*row) for row in written])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    options = {"path": path}
    files = [(f["name"], f["before"]) for f in read_manifest(path)["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from PackedIdsReader(options).read(FilePartition(name, before))

    names = spark.createDataFrame(files, "name string, before bigint").repartition(max(1, len(files)))
    return names.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
