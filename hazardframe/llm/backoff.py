"""Language-model scores by stupid backoff, with counts of the whole corpus.

The model of a document is every other document: its own n-grams are taken off the corpus counts, so a text cannot vouch
for itself. Count tables are partitioned by the hash of the n-gram; the documents' n-grams meet them there and the
scores are summed per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardframe.llm import exchange as ex
from hazardframe.llm import textblocks as tb
from hazardframe.llm.storage import delete_table, write_table

ORDER = 3
BACKOFF = 0.4
BATCH_BYTES = 8 << 20  # n-grams repeat within a batch: a larger one sends fewer keys, and closer ones


def _gram_lanes(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1 … order the hash of the n-gram that ends at each word (0 where the text has fewer words before), the
    text of each word, and the position of each word in its text."""
    parts = [_lanes_of(texts.slice(lo, hi - lo), order, lo) for lo, hi in tb.slices(texts)]
    if not parts:
        return [np.zeros(0, np.uint64)] * order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes, text_of, at = zip(*parts)
    return [np.concatenate(h) for h in zip(*lanes)], np.concatenate(text_of), np.concatenate(at)


def _lanes_of(texts: pa.Array, order: int, first_text: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    data, offsets = tb.text_bytes(texts)
    starts, ends, first = tb.word_bounds(data, offsets)
    counts = np.diff(first)
    text_of, at = first_text + np.repeat(np.arange(len(counts)), counts), tb.segment_arange(counts)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * order, text_of, at
    words = tb.word_hashes(data, starts, ends)
    lanes = []
    for n in range(1, order + 1):
        h = np.zeros(len(words), np.uint64)
        h[n - 1 :] = tb.grams(words, n)
        h[at < n - 1] = 0
        lanes.append(h)
    return lanes, text_of, at


def _items(texts: pa.Array, order: int) -> list[ex.Items]:
    lanes, _, at = _gram_lanes(texts, order)
    return [ex.distinct_items(h[at >= n]) for n, h in enumerate(lanes)]


def _own_counts(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in its own text."""
    _, inverse, counts = np.unique(hashes ^ tb.mixed(text_of.astype(np.uint64) + np.uint64(0x51ED270B)), return_inverse=True, return_counts=True)
    return counts[inverse]


def _word_scores(texts: pa.Array, answers: list[dict] | None, order: int, corpus_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word, and the text of each word."""
    lanes, text_of, at = _gram_lanes(texts, order)
    words = np.bincount(text_of, minlength=len(texts))
    left = []  # counts of each n-gram in all other texts
    for n, h in enumerate(lanes):
        full = np.zeros(len(h), np.int64)
        has = at >= n
        if has.any():
            items = ex.distinct_items(h[has])
            full[has] = ex.lane_totals(answers, n)[items.inverse].astype(np.int64) - _own_counts(h[has], text_of[has])
        left.append(full)
    others = np.maximum(corpus_words - words[text_of], 0)
    # Unigrams; a word that no other text has counts as less than one occurrence.
    score = np.log(np.where(left[0] > 0, left[0], 1) / np.maximum(others + (left[0] == 0), 1))
    for n in range(1, order):
        context = np.zeros(len(score), np.int64)
        context[1:] = left[n - 1][:-1]
        seen = (at >= n) & (left[n] > 0)
        higher = np.log(np.where(seen, left[n], 1) / np.maximum(np.where(seen, context, 1), 1))
        score = np.where(at < n, score, np.where(seen, higher, np.log(BACKOFF) + score))
    return score, text_of


def backoff_scores(df: DataFrame, id_column: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """id, n_words, log_score (sum over the words) and mean_log_score of each text under all others.

    Texts without words, NULL among them, have log_score 0 and no mean. Repeated rows are texts like any other and vouch
    for each other. A NULL id is kept. An empty table gives an empty table; only the named columns are read.
    """
    batches, path = ex.write_batches(df, id_column, text, BATCH_BYTES)
    partitions = ex.partitions_for(batches)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in rows:
            n = [len(tb.word_bounds(*tb.text_bytes(ex.batch_texts(chunk.column(0).slice(i, 1))))[0]) for i in range(len(chunk))]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    corpus_words = batches.select("texts").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    answers = ex.totals(batches, lambda texts: _items(texts, order), partitions)

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in rows:
            for i in range(len(chunk)):
                texts = ex.batch_texts(chunk.column(1).slice(i, 1))
                per_word, text_of = _word_scores(texts, chunk.column(2)[i].as_py(), order, corpus_words)
                n = np.bincount(text_of, minlength=len(texts))
                total = np.bincount(text_of, weights=per_word, minlength=len(texts)).astype(np.float64)  # whole numbers where there are no words
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([chunk.column(0).slice(i, 1).flatten(), pa.array(n, pa.int64()), pa.array(total), mean], names=["id", "n_words", "log_score", "mean_log_score"])

    scored = ex.with_totals(batches, answers).select("ids", "texts", "answers").mapInArrow(score, "id bigint, n_words bigint, log_score double, mean_log_score double")
    out, _ = write_table(scored, "scores")
    delete_table(df.sparkSession, path)
    return out
