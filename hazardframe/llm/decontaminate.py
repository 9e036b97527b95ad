"""Benchmark decontamination: n-gram seeds, then local alignment.

Every text is scanned once for word n-grams of the test items. Hits of one item on about the same diagonal form a
window. Every window is aligned that has enough of the item's words to reach the score, however common its seeds are.
Smith-Waterman alignment over the words of window and item then gives a score that edits lower gently, so paraphrased
and edited copies are found as well as literal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hazardframe.llm import textblocks as tb
from hazardframe.llm.storage import write_table

SEED_WORDS = 3
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Seeds up to this number travel with the scan as sorted arrays of 28 bytes each; more are joined by a shuffle.
MAX_CARRIED_SEEDS = 500_000


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (letters and digits, lower case) of the texts in a row, and each text's first word."""
    data, offsets = tb.text_bytes(pc.utf8_lower(column))
    starts, ends, first = tb.word_bounds(data, offsets, tb.NOT_ALNUM)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return tb.word_hashes(data, starts, ends), first


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (a key that is never NULL), item_id and the item's word hashes (binary, 8 bytes a word), items without words
    left out, repeated ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = word_hashes(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([words[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["item_id", "words"]
            )

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "item_id bigint, words binary").where(F.octet_length("words") > 0).dropDuplicates()
    return found.withColumn("item", F.xxhash64("item_id", "words"))


def item_seeds(words: DataFrame, n: int = SEED_WORDS) -> DataFrame:
    """seed, item, offset and length of the item: one row per n-gram of each item. Items shorter than n words are one
    seed of what they have (``size`` tells how many words the seed spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds, at, length, size = [], [], [], [], []
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.frombuffer(raw, np.uint64)
                k = min(n, len(w))
                g = tb.grams(w, k)
                ids += [item] * len(g)
                seeds += g.view(np.int64).tolist()
                at += range(len(g))
                length += [len(w)] * len(g)
                size += [k] * len(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(length, pa.int32()), pa.array(size, pa.int32())],
                names=["seed", "item", "at", "length", "size"],
            )

    return words.select("item", "words").mapInArrow(run, "seed bigint, item bigint, at int, length int, size int")


WINDOW_SCHEMA = "row long, item bigint, first_word int, words binary, seeds array<bigint>"


def _windows(words: np.ndarray, hits: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """Group one text's hits (position, item, offset, length, seed) into windows of an item."""
    hits.sort(key=lambda h: (h[1], h[0] - h[2]))
    group: list[tuple[int, int, int, int, int]] = []
    for h in [*hits, None]:
        if group and (h is None or h[1] != group[0][1] or (h[0] - h[2]) - (group[-1][0] - group[-1][2]) > max(4, group[0][3] // 2)):
            item, length = group[0][1], group[0][3]
            pad = max(4, length // 4)
            lo = max(0, min(g[0] - g[2] for g in group) - pad)
            hi = min(len(words), max(g[0] - g[2] for g in group) + length + pad)
            yield item, lo, words[lo:hi].tobytes(), sorted({g[4] for g in group})
            group = []
        if h is not None:
            group.append(h)


def _carried_hits(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Windows by a scan that carries the seeds (a checked number) with it. No shuffle of texts."""
    rows = seeds.orderBy("seed", "item", "at").toPandas()
    table = rows["seed"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(table, kind="stable")
    table = table[order]
    item, at, length, size = (rows[c].to_numpy()[order] for c in ("item", "at", "length", "size"))
    sizes = sorted(set(size.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << 22, bool)
        bitmap[(table & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            out = []
            for lo, hi in tb.slices(batch.column(1)):
                words, first = word_hashes(batch.column(1).slice(lo, hi - lo))
                found: dict[int, list] = {}
                for k in sizes:
                    g = tb.grams(words, k)
                    maybe = np.flatnonzero(bitmap[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    a, b = np.searchsorted(table, g[maybe], "left"), np.searchsorted(table, g[maybe], "right")
                    docs = np.searchsorted(first, maybe, "right") - 1
                    whole = maybe + k <= first[docs + 1]
                    for p, d, s, e in zip(maybe[whole].tolist(), docs[whole].tolist(), a[whole].tolist(), b[whole].tolist()):
                        for j in range(s, e):
                            if size[j] == k:
                                found.setdefault(d, []).append((p - int(first[d]), int(item[j]), int(at[j]), int(length[j]), int(table[j].view(np.int64))))
                for d, hits in found.items():
                    out += [(lo + d, *w) for w in _windows(words[first[d] : first[d + 1]], hits)]
            names = ["row", "item", "first_word", "words", "seeds"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            columns[0] = batch.column(0).take(columns[0])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, WINDOW_SCHEMA)


def _joined_hits(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Windows where the seeds are too many to carry: the texts' n-grams are joined to them by a shuffle, and the texts
    with a hit are read again for their windows."""

    keyed = texts.withColumn("k", F.xxhash64("row", "text"))  # rows with equal or NULL ids stay apart
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                words, first = word_hashes(batch.column(1).slice(lo, hi - lo))
                for k in sizes:
                    g = tb.grams(words, k)
                    p = np.arange(len(g))
                    d = np.searchsorted(first, p, "right") - 1
                    whole = p + k <= first[d + 1]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(d[whole] + lo)), pa.array((p - first[d])[whole].astype(np.int32)),
                        pa.array(np.full(whole.sum(), k, np.int32)), pa.array(g[whole].view(np.int64)),
                    ], names=["k", "pos", "size", "seed"])

    hits = keyed.select("k", "text").mapInArrow(grams, "k long, pos int, size int, seed bigint").join(seeds, ["seed", "size"])
    per_text = hits.groupBy("k").agg(F.collect_list(F.struct("pos", "item", "at", "length", "seed")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words, _ = word_hashes(pa.array([text.as_py()], pa.string()))
                out += [(row, *w) for w in _windows(words, [(h["pos"], h["item"], h["at"], h["length"], h["seed"]) for h in hits])]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["row", "item", "first_word", "words", "seeds"])

    return keyed.join(per_text, "k").select("row", "text", "hits").mapInArrow(run, WINDOW_SCHEMA)


def smith_waterman(window: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of the item in the window: score as a share of the item's own, and where it lies (words)."""
    n = len(window)
    column = np.arange(n + 1)
    score = np.zeros(n + 1, np.int64)
    begin = column.copy()  # where the alignment that ends here began
    best, span = 0, (0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(window == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        take = diagonal >= above
        fresh = np.maximum(np.where(take, diagonal, above), 0)
        origin = np.where(take, begin[:-1], begin[1:])
        origin = np.where(fresh > 0, origin, column[1:])
        # Gaps along the window: the best of all cells to the left, less the way from there.
        lifted = np.concatenate([[0], fresh]) - GAP * column
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, column, 0))
        new = np.maximum(top + GAP * column, 0)
        source = np.concatenate([[0], origin])[at]
        begin = np.where(new > 0, source, column)
        score = new
        k = int(score.argmax())
        if score[k] > best:
            best, span = int(score[k]), (int(begin[k]), k)
    return best / (MATCH * max(1, len(item))), span[0], span[1]


def contaminated(
    documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_score: float = MIN_SCORE, max_carried_seeds: int = MAX_CARRIED_SEEDS,
) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word (the aligned words), n_seeds: the best alignment of each document with
    each item that reaches ``min_score``.

    Every window is aligned unless it has too few of the item's words to reach ``min_score`` in any order. NULL or empty texts and items without a word match nothing;
    a NULL doc_id is reported as NULL. Rows repeated with equal id count as one document. Empty tables give an empty
    result. Only the named columns are read.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("row"), F.col(text).alias("text"))
    words, _ = write_table(item_words(items, item_id, item_text), "items")
    seeds = item_seeds(words)
    n_seeds = seeds.count()
    windows = _carried_hits(rows, seeds) if n_seeds <= max_carried_seeds else _joined_hits(rows, seeds)
    windows, _ = write_table(windows, "windows")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, got = [], []
            for k, (at, w, i) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                window, item = np.frombuffer(w, np.uint64), np.frombuffer(i, np.uint64)
                # No alignment scores above the share of the item's words that the window has at all.
                if np.isin(item, window).sum() < min_score * len(item) - 1e-9:
                    continue
                score, lo, hi = smith_waterman(window, item)
                if score >= min_score:
                    rows.append(k)
                    got.append((score, at + lo, at + hi))
            chosen = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(chosen), batch.column(1).take(chosen), *(pa.array([g[j] for g in got], t) for j, t in enumerate((pa.float64(), pa.int32(), pa.int32()))),
                batch.column(5).take(chosen),
            ], names=["doc_id", "item_id", "score", "first_word", "end_word", "n_seeds"])

    met = windows.withColumn("n_seeds", F.size("seeds").cast("long")).join(words.withColumnRenamed("words", "item_words"), "item")
    scored = met.select("row", "item_id", "first_word", "words", "item_words", "n_seeds").mapInArrow(
        align, "doc_id bigint, item_id bigint, score double, first_word int, end_word int, n_seeds bigint"
    )
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word", "n_seeds")).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.score", (-F.col("b.f")).alias("first_word"), "b.end_word", "b.n_seeds"
    )
