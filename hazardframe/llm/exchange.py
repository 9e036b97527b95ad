"""Counting hashed items over a whole corpus, and answering each batch of texts with the totals of its items.

Texts are written once, as batches of bounded size; a row of the table of batches says where its texts lie, so that steps which
shuffle batches move no texts. A batch sends every distinct item (a 64-bit hash, cut to 56 bits) with
its count to the partition of its hash, as sorted, packed arrays: one row for a batch and partition instead of one for an
item. An item of every text is one entry for each batch, so no item is hot. Partitions add up the counts and answer each
batch with the totals in the order in which it asked; the batch, computing its items again, reads them off.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.llm import textblocks as tb
from hazardframe.llm.storage import open_store, shared_folder

BATCH_BYTES = 4 << 20
PARTITION_BYTES = 24 << 20  # of text for each hash partition
TASK_BYTES = 16 << 20  # of text for each task over the batches
KEY_BITS = 56
PLACE = pa.struct([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def write_batches(df: DataFrame, id_column: str, text: str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, str]:
    """batch, ids, texts (where they lie, for ``batch_texts``), n_bytes: texts in batches of at most ``batch_bytes`` (a longer
    text is a batch of its own). A task writes the texts of its batches to one file; only files that committed rows name are
    read. Tasks over the table have about the same share of text each."""
    path = shared_folder(df.sparkSession, "batches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        store, folder = open_store(f"{path}/texts")
        store.create_dir(folder, recursive=True)
        name = f"{number >> 32:06d}-{uuid.uuid4().hex}.bin"
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        held = written = 0

        def row() -> pa.RecordBatch:
            nonlocal number, held, written
            i, data = pa.concat_arrays(ids), pack_texts(pa.concat_arrays(texts))
            file.write(data)
            ends = pa.array([0, len(i)], pa.int32())
            place = pa.array([{"file": f"{path}/texts/{name}", "at": written, "size": len(data)}], PLACE)
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(ends, i), place, pa.array([held])], names=["batch", "ids", "texts", "n_bytes"]
            )
            number += 1
            written += len(data)
            held = 0
            ids.clear()
            texts.clear()
            return out

        with store.open_output_stream(f"{folder}/{name}") as file:
            for batch in batches:
                for lo, hi in tb.slices(batch.column(1), batch_bytes // 4):
                    part = batch.column(1).slice(lo, hi - lo)
                    size = len(tb.text_bytes(part)[0])
                    if texts and held + size > batch_bytes:
                        yield row()
                    ids.append(batch.column(0).slice(lo, hi - lo))
                    texts.append(part)
                    held += size
            if texts:
                yield row()

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = rows.mapInArrow(run, "batch bigint, ids array<bigint>, texts struct<file: string, at: bigint, size: bigint>, n_bytes bigint")
    made.write.option("compression", "zstd").parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(made.schema).parquet(f"{path}/rows")
    return written.repartition(tasks_for(written), "batch"), path


def tasks_for(batches: DataFrame) -> int:
    """Tasks over the batches: the rows are small, so Spark would put those of much text into one."""
    count, total = batches.agg(F.count("*"), F.sum("n_bytes")).first()
    parallel = batches.sparkSession.sparkContext.defaultParallelism
    return max(1, min(count, max(2 * parallel, -(-(total or 0) // TASK_BYTES))))


def partitions_for(batches: DataFrame) -> int:
    """A power of two that gives each hash partition about the same share of text at any size of the corpus."""
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    return 1 << max(3, int(np.ceil(np.log2(max(1, total / PARTITION_BYTES)))))


def pack_texts(texts: pa.Array) -> bytes:
    """Lengths and bytes of the texts, compressed: half of what Spark's own codec leaves."""
    data, offsets = tb.text_bytes(texts)
    sizes = pack_numbers(np.diff(offsets))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def batch_texts(column: pa.Array) -> pa.Array:
    """The texts of a one-row slice of the ``texts`` column, read from where they lie."""
    place = column[0].as_py()
    store, path = open_store(place["file"])
    with store.open_input_file(path) as file:
        raw = file.read_at(place["size"], place["at"])
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(unpack_numbers(raw[4 : 4 + n])).astype(np.int32)
    data = zstandard.ZstdDecompressor().decompress(raw[4 + n :])
    offsets = np.concatenate([np.zeros(1, np.int32), ends])
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))


@dataclass
class Items:
    """Distinct items of a batch: sorted keys, counts, and for each occurrence the index of its key."""

    keys: np.ndarray
    counts: np.ndarray
    inverse: np.ndarray


def distinct_items(hashes: np.ndarray) -> Items:
    keys, inverse, counts = np.unique(hashes >> np.uint64(64 - KEY_BITS), return_inverse=True, return_counts=True)
    return Items(keys, counts, inverse)


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, byte planes apart, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def partition_cuts(keys: np.ndarray, partitions: int) -> np.ndarray:
    """Where each hash partition's keys begin in the sorted keys; partitions are equal ranges of the key."""
    step = (1 << KEY_BITS) // partitions
    return np.searchsorted(keys, np.arange(partitions + 1, dtype=np.uint64) * np.uint64(step))


ItemsOf = Callable[[pa.Array], list[Items]]


def totals(batches: DataFrame, items_of: ItemsOf, partitions: int) -> DataFrame:
    """batch, lane, part, totals (packed): for each batch and lane (kind of item) the corpus-wide counts of its items, in
    the order of their keys within each partition."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in rows:
            for i in range(len(chunk)):
                out: dict[str, list] = {"lane": [], "part": [], "data": []}
                for lane, items in enumerate(items_of(batch_texts(chunk.column(1).slice(i, 1)))):
                    cuts = partition_cuts(items.keys, partitions)
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        k = items.keys[cuts[p] : cuts[p + 1]]
                        keys, counts = pack_numbers(np.concatenate([k[:1], np.diff(k)])), pack_numbers(items.counts[cuts[p] : cuts[p + 1]])
                        out["lane"].append(lane)
                        out["part"].append(p)
                        out["data"].append(len(keys).to_bytes(4, "little") + keys + counts)
                batch = pa.array([chunk.column(0)[i].as_py()] * len(out["lane"]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch, pa.array(out["lane"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["data"], pa.binary())],
                    names=["batch", "lane", "part", "data"],
                )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for data in group["data"]:
            n = int.from_bytes(data[:4], "little")
            keys.append(np.cumsum(unpack_numbers(data[4 : 4 + n]), dtype=np.uint64))
            counts.append(unpack_numbers(data[4 + n :]))
        sizes = np.array([len(k) for k in keys])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts).astype(np.float64)).astype(np.uint64)[inverse]
        ends = np.cumsum(sizes)
        return pd.DataFrame({
            "batch": group["batch"], "lane": group["lane"], "part": group["part"],
            "totals": [pack_numbers(total[e - s : e]) for s, e in zip(sizes, ends)],
        })

    asked = batches.select("batch", "texts").mapInArrow(ask, "batch bigint, lane int, part int, data binary")
    return asked.groupBy("lane", "part").applyInPandas(add, "batch bigint, lane int, part int, totals binary")


def beside(batches: DataFrame, rows: DataFrame, gathered: Column, name: str) -> DataFrame:
    """The batches, each with what ``gathered`` makes of its ``rows`` (NULL without any). Both sides get the number of tasks that
    the text of the batches asks for, so neither is shuffled again and small rows do not end up in a few tasks."""
    tasks = tasks_for(batches)
    found = rows.repartition(tasks, "batch").groupBy("batch").agg(gathered.alias(name))
    return batches.repartition(tasks, "batch").join(found, "batch", "left")


def with_totals(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """The batches with their answers: array of (lane, part, totals), at most one for each lane and partition."""
    return beside(batches, answers, F.sort_array(F.collect_list(F.struct("lane", "part", "totals"))), "answers")


def lane_totals(answers: list[dict] | None, lane: int) -> np.ndarray:
    """All totals of a lane in the order of the batch's sorted keys."""
    found = [unpack_numbers(a["totals"]) for a in answers or [] if a["lane"] == lane]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)
