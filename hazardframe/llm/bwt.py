"""Removal of repeated byte strings with a sparse Burrows-Wheeler index.

Indexing every suffix of a corpus is out of reach, so suffixes are sampled at *anchors*: the smallest hash among the short
grams of each stretch of LENGTH bytes. Equal stretches pick the same anchor at the same place, so all copies of a string
meet at its anchor, and only anchors that occur twice in the corpus matter. Around such an anchor a *row* is kept: the
bytes from the anchor on (its suffix) and the bytes before it, which are the column a Burrows-Wheeler transform keeps.

A shard (rows of neighbouring batches, in the partition of an anchor's hash) holds its rows in suffix order. Shards are merged in
pairs: the interleave of two sorted shards is refined word by word, only where rows of both shards still share a block,
until blocks agree in all bytes; no suffix is sorted twice. Common prefixes of neighbours in the merged order give the
intervals of rows that agree in the first 100 - x bytes, and the ranks of the column give those that agree in the x
bytes before the anchor; both together are the repeated stretches that begin x bytes before it, for each x. The earliest
row of each keeps its stretch, all others lose theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from hazardframe.llm import exchange as ex
from hazardframe.llm import textblocks as tb
from hazardframe.llm.storage import write_table

LENGTH = 100
GRAM = 32
ROWS_PER_PARTITION = 60_000
#: An anchor with more rows is not kept together: each of its stretches is dealt out by the stretch's own hash. The rows
#: that are found are the same either way.
HOT_ROWS = 10_000
SHARD_ROWS = 8_192


# --- anchors and rows -----------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of stretch starts that share an anchor: hash, anchor position, first and last start, and the text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), none, none, none, none
    h = tb.gram_hashes(tb.prefix_hash(data), gram)
    width = length - gram + 1
    least = tb.windowed_minimum(h, width)
    # Stretches that lie inside one text.
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    p = np.repeat(offsets[:-1], counts) + tb.segment_arange(counts)
    if not len(p):
        return np.zeros(0, np.uint64), none, none, none, none
    value = least[p]
    new = np.ones(len(p), bool)
    new[1:] = value[1:] != value[:-1]
    inhabited = counts[counts > 0]
    new[np.cumsum(inhabited) - inhabited] = True
    # The same value may come from a later, equal gram: the leftmost gram of a stretch counts, so runs are cut where it drops out.
    first, at = _leftmost(h, p, value, new, width)
    last = np.append(first[1:], len(p)) - 1
    return value[first], at, p[first], p[last], np.searchsorted(offsets, p[first], "right") - 1


def _leftmost(h: np.ndarray, p: np.ndarray, value: np.ndarray, new: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of stretch starts with the same leftmost minimal gram begin, and the position of that gram."""
    todo = np.flatnonzero(new)
    end = np.append(todo[1:], len(p))
    windows = np.lib.stride_tricks.sliding_window_view(h, width)
    starts, found = [], []
    # For the first start of each run scan its stretch; a run's anchor stays until the starts pass it.
    while len(todo):
        ahead = (windows[p[todo]] == value[todo][:, None]).argmax(axis=1)
        starts.append(todo)
        found.append(p[todo] + ahead)
        # Starts of the run up to the anchor keep it; behind it the next equal gram is looked up.
        stop = todo + ahead + 1
        more = stop < end
        todo, end = stop[more], end[more]
    first = np.concatenate(starts)
    order = np.argsort(first, kind="stable")
    return first[order], np.concatenate(found)[order]


def anchor_items(texts: pa.Array, length: int, gram: int) -> list[ex.Items]:
    value, *_ = _batch_anchors(texts, length, gram)
    return [ex.distinct_items(value)]


def _batch_anchors(texts: pa.Array, length: int, gram: int):
    """Anchors of a whole batch, found slice by slice; positions count from the begin of the batch's bytes."""
    parts, base, rows = [], 0, 0
    for lo, hi in tb.slices(texts):
        data, offsets = tb.text_bytes(texts.slice(lo, hi - lo))
        value, at, first, last, text = anchors(data, offsets, length, gram)
        parts.append((value, at + base, first + base, last + base, text + rows))
        base += len(data)
        rows += hi - lo
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5)) if parts else anchors(np.zeros(0, np.uint8), np.zeros(1, np.int64), length, gram)


# --- the sparse index of one partition ------------------------------------------------------------------------------


class Shard:
    """Rows in suffix order: block (anchor), suffix as big-endian words, and the row's number."""

    def __init__(self, block: np.ndarray, words: np.ndarray, row: np.ndarray):
        self.block, self.words, self.row = block, words, row


def sorted_shard(block: np.ndarray, words: np.ndarray, row: np.ndarray) -> Shard:
    order = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)] + [block])
    return Shard(block[order], words[order], row[order])


def merge_shards(a: Shard, b: Shard) -> Shard:
    """Merge by refining the interleave. A block is a set of rows that agree so far; blocks are numbered in suffix order.
    In each round the rows of blocks that hold rows of both shards are split by their next word."""
    ka, kb = _joint_ranks([a.block], [b.block])
    for k in range(a.words.shape[1]):
        blocks = int(max(ka[-1], kb[-1])) + 1
        both = (np.bincount(ka, minlength=blocks) > 0) & (np.bincount(kb, minlength=blocks) > 0)
        if not both.any():
            break
        ia, ib = np.flatnonzero(both[ka]), np.flatnonzero(both[kb])
        # Sub-blocks of the shared blocks, numbered behind their block; other blocks only move apart to make room.
        sa, sb = _joint_ranks([ka[ia], a.words[ia, k]], [kb[ib], b.words[ib, k]])
        of = np.zeros(int(max(sa[-1], sb[-1])) + 1, np.int64)  # the block of each sub-block
        of[sa], of[sb] = ka[ia], kb[ib]
        parts = np.where(both, np.bincount(of, minlength=blocks), 1)
        begin = np.cumsum(parts) - parts
        within = np.arange(len(of)) - np.searchsorted(of, of) + begin[of]
        ka, kb = begin[ka], begin[kb]
        ka[ia], kb[ib] = within[sa], within[sb]
    order = np.argsort(np.concatenate([ka, kb]), kind="stable")
    return Shard(np.concatenate([a.block, b.block])[order], np.concatenate([a.words, b.words])[order], np.concatenate([a.row, b.row])[order])


def _joint_ranks(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the rows of two lists under a common order. Both lists come sorted, so only their runs are compared."""
    heads = []
    for rows in (x, y):
        new = np.ones(len(rows[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in rows], axis=0) if len(new) > 1 else new[1:]
        heads.append(new)
    runs = [np.concatenate([cx[heads[0]], cy[heads[1]]]) for cx, cy in zip(x, y)]
    order = np.lexsort(runs[::-1])
    new = np.zeros(len(order), np.int64)
    if len(order) > 1:
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in runs], axis=0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    n = int(heads[0].sum())
    return rank[:n][np.cumsum(heads[0]) - 1], rank[n:][np.cumsum(heads[1]) - 1]


def common_prefix(block: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Bytes each row shares with the row before it, 0 at the begin of a block."""
    out = np.zeros(len(raw), np.int64)
    if len(raw) > 1:
        differs = raw[1:] != raw[:-1]
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), raw.shape[1])
        out[1:][block[1:] != block[:-1]] = 0
    return out


def repeated_starts(
    hashes: np.ndarray, suffix: np.ndarray, before: np.ndarray, x_low: np.ndarray, x_high: np.ndarray, age: np.ndarray, shard: np.ndarray, length: int
) -> np.ndarray:
    """Rows x (x = 0 …): whether the stretch that begins x bytes before the row's anchor also begins somewhere earlier.

    ``suffix`` and ``before`` are byte matrices (``before`` backwards from the anchor, both filled with zeros), a row
    has the stretches with x_low <= x <= x_high, ``age`` orders rows by where they stand, ``shard`` tells them apart.
    """
    n, reach = len(hashes), before.shape[1]
    out = np.zeros((n, reach + 1), bool)
    if n < 2:
        return out
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = suffix
    words = wide.view(">u8").astype(np.uint64)
    queue = [sorted_shard(hashes[i], words[i], i) for i in (np.flatnonzero(shard == s) for s in np.unique(shard))]
    while len(queue) > 1:
        queue = [merge_shards(*queue[k : k + 2]) if k + 1 < len(queue) else queue[k] for k in range(0, len(queue), 2)]
    order = queue[0].row
    shared = common_prefix(queue[0].block, suffix[order])
    back_order = _byte_order(before)
    back_shared = common_prefix(np.zeros(n, np.int64), before[back_order])
    # A row meets others only as far as its neighbours in both orders do.
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    low[order] = length - np.maximum(shared, np.append(shared[1:], 0))
    high[back_order] = np.maximum(back_shared, np.append(back_shared[1:], 0))
    low, high = np.maximum(low, x_low), np.minimum(high, x_high)
    place, back_place = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order] = back_place[back_order] = np.arange(n)
    eldest = np.argsort(age, kind="stable")
    eldest = eldest[low[eldest] <= high[eldest]]
    low, high = low[eldest], high[eldest]
    bits = np.uint64(n.bit_length())
    for x in range(reach + 1):
        older = np.flatnonzero((low <= x) & (x <= high))
        if len(older) < 2:
            continue
        rows = eldest[older]
        right = np.cumsum(shared < length - x)[place[rows]]
        left = np.cumsum(back_shared < x)[back_place[rows]] if x else np.zeros(len(rows), np.int64)
        if n < 1 << 21:  # both ranks and the age in one number
            key = np.sort((((right.astype(np.uint64) << bits) | left.astype(np.uint64)) << bits) | older.astype(np.uint64))
            again = (key[1:] >> bits) == (key[:-1] >> bits)
            out[eldest[(key[1:][again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)], x] = True
        else:
            key = right * (n + 1) + left
            by = np.argsort(key, kind="stable")
            again = key[by][1:] == key[by][:-1]
            out[rows[by][1:][again], x] = True
    return out


def earlier_rows(hashes: np.ndarray, suffix: np.ndarray, before: np.ndarray, x_low: np.ndarray, x_high: np.ndarray, age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows equal to an earlier one in all their bytes, which have no stretch of their own; and the rows that are left with
    another row at their anchor. What the earliest of equal rows does to others, the rest would do too."""
    n = len(hashes)
    wide = np.zeros((n, -(-(suffix.shape[1] + before.shape[1]) // 8) * 8), np.uint8)
    wide[:, : suffix.shape[1]] = suffix
    wide[:, suffix.shape[1] : suffix.shape[1] + before.shape[1]] = before
    key = hashes + (x_low * 256 + x_high).astype(np.uint64)
    for k, word in enumerate(wide.view("<u8").T):
        key = tb.mixed(key + word * np.uint64(pow(tb.BASE, 2 * k + 3, 1 << 64)))
    eldest = np.argsort(age, kind="stable")
    _, first = np.unique(key[eldest], return_index=True)
    copy = np.ones(n, bool)
    copy[eldest[first]] = False
    _, block, rows = np.unique(hashes[~copy], return_inverse=True, return_counts=True)
    return np.flatnonzero(copy), np.flatnonzero(~copy)[rows[block] > 1]


def all_repeated_starts(
    hashes: np.ndarray, suffix: np.ndarray, before: np.ndarray, x_low: np.ndarray, x_high: np.ndarray, age: np.ndarray, length: int
) -> np.ndarray:
    """``repeated_starts`` of a whole partition. Equal rows are settled first; the rest is cut into shards of a fixed size, so that
    merges grow with the rows of a partition and not with the batches of the corpus."""
    x = np.arange(before.shape[1] + 1)
    copies, rest = earlier_rows(hashes, suffix, before, x_low, x_high, age)
    out = np.zeros((len(hashes), len(x)), bool)
    out[copies] = (x_low[copies][:, None] <= x) & (x <= x_high[copies][:, None])
    shard = np.arange(len(rest)) // SHARD_ROWS
    out[rest] = repeated_starts(hashes[rest], suffix[rest], before[rest], x_low[rest], x_high[rest], age[rest], shard, length)
    return out


def _byte_order(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])


# --- Spark jobs -----------------------------------------------------------------------------------------------------

ROW_SCHEMA = "part long, batch long, n int, data binary"


def _pack_rows(columns: dict[str, np.ndarray]) -> bytes:
    head = b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values())
    return zstandard.ZstdCompressor(level=1).compress(head)


def _unpack_rows(data: bytes, n: int, length: int, reach: int) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, {}
    for name, kind, width in (("hash", "<u8", 1), ("doc", "<i8", 1), ("has_doc", "u1", 1), ("text", "<i4", 1), ("place", "<i8", 1), ("low", "u1", 1), ("high", "u1", 1), ("suffix", "u1", length), ("before", "u1", reach)):
        size = np.dtype(kind).itemsize * width * n
        c = np.frombuffer(raw[at : at + size], kind)
        out[name] = c.reshape(n, width) if width > 1 else c
        at += size
    return out


def repeated_rows(batches: DataFrame, length: int, gram: int, hot_rows: int) -> DataFrame:
    """batch, text (number in the batch), starts (first and last start of runs of removable stretches, counted from the begin of the
    text), packed: what every partition of anchors found for each batch."""
    reach = length - gram
    partitions = ex.partitions_for(batches)
    answers = ex.totals(batches, lambda texts: anchor_items(texts, length, gram), partitions)
    asked = ex.with_totals(batches, answers)

    def rows(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            for i in range(len(chunk)):
                yield from _rows_of(chunk.column(0)[i].as_py(), chunk.column(1).slice(i, 1).flatten(), ex.batch_texts(chunk.column(2).slice(i, 1)), chunk.column(3)[i].as_py())

    def _rows_of(batch: int, ids: pa.Array, texts: pa.Array, answer) -> Iterator[pa.RecordBatch]:
        value, at, first, last, text = _batch_anchors(texts, length, gram)
        items = ex.distinct_items(value)
        total = ex.lane_totals(answer, 0)[items.inverse] if len(value) else np.zeros(0, np.uint64)
        data, offsets = tb.text_bytes(texts)
        hot = total > hot_rows
        k = np.flatnonzero((total > 1) & ~hot)
        h = np.flatnonzero(hot)
        # A hot anchor's stretches are rows of their own, under the hash of the stretch.
        n = (last - first + 1)[h]
        start = np.repeat(first[h], n) + tb.segment_arange(n)
        parts = [(value[k], at[k], first[k], last[k], text[k])]
        if len(start):
            own = tb.range_hash(tb.prefix_hash(data), start, start + length)
            parts.append((own, np.repeat(at[h], n), start, start, np.repeat(text[h], n)))
        value, at, first, last, text = (np.concatenate(c) for c in zip(*parts))
        if not len(value):
            return
        doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        has = ids.is_valid().to_numpy(zero_copy_only=False).astype("u1")
        # Rows equal in all their bytes: the batch's earliest stands for them, all others lose all their stretches. So a
        # passage of very many texts is one row for each batch.
        age = np.lexsort((at, text, doc[text], has[text]))
        same = tb.range_hash(tb.prefix_hash(data), first, last + length) + value + (at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        _, earliest = np.unique(same[age], return_index=True)
        stays = np.zeros(len(value), bool)
        stays[age[earliest]] = True
        if not stays.all():
            g = ~stays
            gone = _pack_rows({"text": text[g].astype("<i8"), "low": (first - offsets[text])[g].astype("<i8"), "high": (last - offsets[text])[g].astype("<i8")})
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(batch % partitions_of_rows)]), pa.array([batch]), pa.array([-1], pa.int32()), pa.array([gone], pa.binary())], names=["part", "batch", "n", "data"]
            )
            value, at, first, last, text = (c[stays] for c in (value, at, first, last, text))
        end = last + length
        span = np.minimum(end - at, length)
        padded = np.concatenate([data, np.zeros(length, np.uint8)])
        part = (tb.mixed(value) % np.uint64(partitions_of_rows)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=partitions_of_rows))
        for lo, hi in zip(cuts, cuts[1:]):
            i = by[lo:hi]
            suffix = padded[at[i][:, None] + np.arange(length)]
            suffix[np.arange(length) >= span[i][:, None]] = 0
            left = at[i] - first[i]
            before = padded[np.maximum(at[i][:, None] - 1 - np.arange(reach), 0)]
            before[np.arange(reach) >= left[:, None]] = 0
            packed = _pack_rows({
                "hash": value[i].astype("<u8"), "doc": doc[text[i]], "has_doc": has[text[i]], "text": text[i].astype("<i4"), "place": (at[i] - offsets[text[i]]).astype("<i8"),
                "low": (at[i] - last[i]).astype("u1"), "high": left.astype("u1"), "suffix": suffix, "before": before,
            })
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[i[0]])]), pa.array([batch]), pa.array([len(i)], pa.int32()), pa.array([packed], pa.binary())], names=["part", "batch", "n", "data"]
            )

    # As many partitions as give each about ROWS_PER_PARTITION rows if a third of all anchors were shared.
    total_bytes = batches.agg(F.sum("n_bytes")).first()[0] or 0
    partitions_of_rows = max(8, int(total_bytes / ((reach + 2) / 2) / 3 / ROWS_PER_PARTITION))
    dealt = asked.select("batch", "ids", "texts", "answers").mapInArrow(rows, ROW_SCHEMA)

    def index(group: pd.DataFrame) -> pd.DataFrame:
        settled = group[group["n"] < 0]  # found inside a batch
        out = list(zip(settled["batch"], settled["data"]))
        group = group[group["n"] >= 0].sort_values("batch")
        if not len(group):
            return pd.DataFrame(out, columns=["batch", "found"])
        parts = [_unpack_rows(d, n, length, reach) for d, n in zip(group["data"], group["n"])]
        c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        batch = np.repeat(group["batch"].to_numpy(), group["n"].to_numpy())
        age = np.empty(len(batch), np.int64)
        age[np.lexsort((c["place"], c["text"], batch, c["doc"], c["has_doc"]))] = np.arange(len(batch))
        again = all_repeated_starts(c["hash"], c["suffix"], c["before"], c["low"].astype(np.int64), c["high"].astype(np.int64), age, length)
        # Runs of removable starts: x counts back from the anchor.
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, begin = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        place = c["place"][r]
        columns = {"text": c["text"][r].astype("<i8"), "low": place - (stop - 1), "high": place - begin}
        of = batch[r]  # ascending, as rows are
        cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for lo, hi in zip(cuts, cuts[1:]):
            out.append((of[lo], _pack_rows({k: v[lo:hi] for k, v in columns.items()})))
        return pd.DataFrame(out, columns=["batch", "found"])

    return dealt.groupBy("part").applyInPandas(index, "batch long, found binary")


def _removed(n_bytes: int, low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the stretches that begin at low … high."""
    order = np.argsort(low, kind="stable")
    begin, end = low[order], np.maximum.accumulate(high[order] + length)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return list(zip(begin[first].tolist(), end[np.append(first[1:], len(begin)) - 1].tolist()))


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """id, n_bytes, n_removed, spans (array of begin and end of the maximal removed runs, in UTF-8 bytes), kept (the
    remaining bytes), one row per row of ``df``.

    A byte goes if a string of ``length`` bytes that covers it also begins earlier: in a text with a smaller id, or earlier in the same
    text. Strings never cross texts and are judged on the input. NULL counts as the empty text. A NULL id comes before all
    others; rows with equal ids are ordered by where they were read, each a text of its own. Empty tables give an empty
    result; only the named columns are read.
    """
    batches, path = ex.write_batches(df, id_column, text)
    found, found_path = write_table(repeated_rows(batches, length, gram, hot_rows), "repeats")

    def cut(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            for i in range(len(chunk)):
                texts = ex.batch_texts(chunk.column(1).slice(i, 1))
                data, offsets = tb.text_bytes(texts)
                raw = data.tobytes()
                rows = [np.frombuffer(zstandard.ZstdDecompressor().decompress(f), "<i8").reshape(3, -1) for f in chunk.column(2)[i].as_py() or []]
                of, low, high = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.int64)
                by = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[by], np.arange(len(texts) + 1))
                spans, kept, removed = [], [], []
                for t in range(len(texts)):
                    mine = by[cuts[t] : cuts[t + 1]]
                    begin = int(offsets[t])
                    runs = _removed(int(offsets[t + 1]) - begin, low[mine], high[mine], length) if len(mine) else []
                    at, left = begin, []
                    for s, e in runs:
                        left.append(raw[at : begin + s])
                        at = begin + e
                    left.append(raw[at : int(offsets[t + 1])])
                    kept.append(b"".join(left))
                    spans.append([{"begin": s, "end": e} for s, e in runs])
                    removed.append(sum(e - s for s, e in runs))
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0).slice(i, 1).flatten(), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "spans", "kept"],
                )

    joined = ex.beside(batches, found, F.collect_list("found"), "found").select("ids", "texts", "found")
    return joined.mapInArrow(cut, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary")
