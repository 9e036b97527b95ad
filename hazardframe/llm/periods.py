"""Maximal periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q, at least max(MIN_LENGTH, 2q) long, that neither neighbour extends.

* Periods below 3 * SCALE are found by comparing the words with themselves q places on.
* For each dyadic scale t (SCALE, 2 SCALE, ...) the periods from 3t to 6t - 1 are found from positions that the words
  around them select: position i is in the set if the smallest hash among the t-word stretches that begin in [i, i + t]
  is that of the first or of the last of them. Equal surroundings of 2t words select alike, so a run that holds a
  selected position with its surroundings holds it again one period on: equal surroundings at a distance of 3t to
  6t - 1 propose that distance. Stretches of period t/3 or less take no part in the choice; the runs of smaller periods,
  all known by then, tell where they are. Any 3t - 1 words without a selected position have a period of t/3 or less.
* That leaves runs whose first period lies wholly in a highly periodic region. Their second lies in another one of the
  same period that begins where the first ends: for touching regions the phase between them gives the distances.

Proposals are extended to both sides by binary search over hashes and then compared word by word. Words are told apart
by 64-bit hashes of their bytes; two different words of a text are confused with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardframe.llm import textblocks as tb

MIN_LENGTH = 12
SCALE = 12  # at least MIN_LENGTH: regions that a scale leaves out must be runs by themselves
NO_HASH = np.uint64((1 << 64) - 1)


def _stretches(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the stretches of consecutive numbers."""
    if not len(hits):
        return hits, hits
    cut = np.flatnonzero(np.diff(hits) != 1)
    return hits[np.concatenate([[0], cut + 1])], hits[np.concatenate([cut, [len(hits) - 1]])] + 1


class _Words:
    """The words of several texts in a row, with hashes of any stretch. ``text``: the number of each text in the batch."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray):
        self.ids, self.sizes, self.text = ids, sizes, text
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.stop = np.repeat(self.first[1:], sizes)
        self.begin = np.repeat(self.first[:-1], sizes)
        self._sums = None

    def longer(self, least: int) -> _Words:
        """The texts of at least so many words."""
        fit = self.sizes >= least
        if fit.all():
            return self
        return _Words(self.ids[np.repeat(fit, self.sizes)], self.sizes[fit], self.text[fit])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sums is None:
            self._sums = np.zeros(len(self.ids) + 1, np.uint64)
            np.cumsum(self.ids * tb.powers(len(self.ids) + 1)[: len(self.ids)], out=self._sums[1:])
        return tb.range_hash(self._sums, start, end)

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from i and j on (or, backwards, before i and j), within the text; i < j."""
        low = np.zeros(len(i), np.int64)
        high = (self.stop[i] - j) if forward else (i - self.begin[i])
        while len(i) and (low < high).any():
            middle = (low + high + 1) // 2
            if forward:
                same = self.hashes(i, i + middle) == self.hashes(j, j + middle)
            else:
                same = self.hashes(i - middle, i) == self.hashes(j - middle, j)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _short_periods(words: _Words) -> list[np.ndarray]:
    found = []
    for q in range(1, 3 * SCALE):
        if len(words.ids) <= q:
            break
        same = words.ids[:-q] == words.ids[q:]
        same &= words.stop[:-q] == words.stop[q:]
        start, end = _stretches(np.flatnonzero(same))
        good = end - start + q >= max(MIN_LENGTH, 2 * q)
        found.append(np.stack([start[good], end[good] + q, np.full(good.sum(), q)]))
    return found


def _selected(words: _Words, t: int, regions: np.ndarray) -> np.ndarray:
    """The synchronising set of scale t; ``regions``: runs of period t/3 or less, as (start, end, period) columns."""
    count = len(words.ids) - t + 1
    at = np.arange(count)
    ids = words.hashes(at, at + t)
    marks = np.zeros(count + 1, np.int64)
    inside = regions[1] - regions[0] >= t
    np.add.at(marks, regions[0][inside], 1)
    np.add.at(marks, regions[1][inside] - t + 1, -1)
    ids[np.cumsum(marks[:-1]) > 0] = NO_HASH
    least = tb.windowed_minimum(ids, t + 1)
    n = len(least)
    chosen = ((least == ids[:n]) | (least == ids[t : t + n])) & (least != NO_HASH)
    return np.flatnonzero(chosen & (at[:n] + 2 * t <= words.stop[:n]))


def _by_context(words: _Words, t: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances from 3t to 6t - 1 to places with the same 2t words."""
    context = words.hashes(places, places + 2 * t)
    order = np.argsort(context, kind="stable")
    places, context = places[order], context[order]
    found, k = [], np.arange(len(places))
    for lag in range(1, len(places)):
        k = k[k + lag < len(places)]
        gap = places[np.minimum(k + lag, len(places) - 1)] - places[k]
        near = (context[k] == context[k + lag]) & (gap < 6 * t)  # distances in a group only grow with the lag
        k, gap = k[near], gap[near]
        if not len(k):
            break
        wide = (gap >= 3 * t) & (words.begin[places[k]] == words.begin[places[k + lag]])
        found.append(np.stack([places[k[wide]], gap[wide]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _by_phase(words: _Words, t: int, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances from 3t to 6t - 1 that carry the end of a region onto the next one of the same period."""
    start, end, period = regions[:, np.lexsort((regions[0], regions[2]))]
    pair = np.flatnonzero((period[:-1] == period[1:]) & (start[1:] <= end[:-1]) & (words.begin[start[:-1]] == words.begin[start[1:]]))
    most = np.minimum(end - start, 6 * t - 1)
    most = np.minimum(most[pair], most[pair + 1])
    pair, most = pair[most >= 3 * t], most[most >= 3 * t]
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, last, s1, s2 = period[pair], end[pair] - period[pair], start[pair], start[pair + 1]
    owner, shift = np.repeat(np.arange(len(pair)), p), tb.segment_arange(p)
    place = s2[owner] + shift
    same = words.hashes(place, place + p[owner]) == words.hashes(last, last + p)[owner]
    owner, place = owner[same], place[same]
    if not len(owner):  # regions of other words
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    phase = (place - last[owner]) % p[owner]
    least = 3 * t + (phase - 3 * t) % p[owner]
    steps = np.maximum(0, (most[owner] - least) // p[owner] + 1)
    distance = np.repeat(least, steps) + tb.segment_arange(steps) * np.repeat(p[owner], steps)
    owner = np.repeat(owner, steps)
    return np.maximum(s1[owner], s2[owner] - distance), distance


def _extended(words: _Words, place: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """(start, end, distance) of the longest stretches of that period around the places; those of two periods or more."""
    other = place + distance
    start = place - words.common(place, other, False)
    end = other + words.common(place, other, True)
    runs = np.stack([start, end, distance])
    runs = np.unique(runs[:, end - start >= np.maximum(MIN_LENGTH, 2 * distance)], axis=1)
    if not runs.shape[1]:
        return runs
    size = runs[1] - runs[0] - runs[2]
    owner, at = np.repeat(np.arange(len(size)), size), np.repeat(runs[0], size) + tb.segment_arange(size)
    wrong = np.unique(owner[words.ids[at] != words.ids[at + runs[2][owner]]])
    exact = [np.delete(runs, wrong, axis=1)]
    for q in np.unique(runs[2][wrong]):  # stretches that only their hashes took for equal
        hits = np.flatnonzero((words.ids[:-q] == words.ids[q:]) & (words.stop[:-q] == words.stop[q:]))
        a, b = _stretches(hits)
        good = b - a >= q
        exact.append(np.stack([a[good], b[good] + q, np.full(good.sum(), q)]))
    return np.concatenate(exact, axis=1)


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Of equal stretches the one with the smallest period, in order of start, end."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    return runs[:, new]


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs in texts of ``sizes`` words in a row: rows of (start, end, period), positions in ``ids``; no run crosses texts."""
    whole = _Words(ids, np.asarray(sizes, np.int64), np.arange(len(sizes)))
    runs = _least_periods(np.concatenate([np.zeros((3, 0), np.int64), *_short_periods(whole)], axis=1))
    words, t = whole, SCALE
    while True:
        words = words.longer(6 * t)  # two periods of 3t
        if not len(words.ids):
            return runs
        offset = np.full(len(whole.sizes), -1)
        offset[words.text] = words.first[:-1]
        text = np.searchsorted(whole.first, runs[0], "right") - 1
        known = runs[:, (offset[text] >= 0) & (runs[2] <= t // 3)]
        text = np.searchsorted(whole.first, known[0], "right") - 1
        shift = offset[text] - whole.first[text]
        known = np.stack([known[0] + shift, known[1] + shift, known[2]])
        proposals = [_by_context(words, t, _selected(words, t, known)), _by_phase(words, t, known)]
        found = _extended(words, *(np.concatenate(x) for x in zip(*proposals)))
        if found.shape[1]:
            home = np.searchsorted(words.first, found[0], "right") - 1
            shift = whole.first[words.text[home]] - words.first[home]
            runs = _least_periods(np.concatenate([runs, np.stack([found[0] + shift, found[1] + shift, found[2]])], axis=1))
        t *= 2


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank; ``first``: number of each text's first word."""
    before = np.concatenate([[0], np.cumsum(kept)])
    keep = np.flatnonzero(kept)
    size = ends[keep] - starts[keep] + 1
    out = np.full(size.sum(), 32, np.uint8)
    stops = np.cumsum(size)
    inner = np.ones(len(out), bool)
    inner[stops - 1] = False
    out[inner] = data[np.repeat(starts[keep], size - 1) + tb.segment_arange(size - 1)]
    # Without the blank behind the last word of a text.
    edge = np.concatenate([[0], stops])[before[first]]
    last = edge[1:][np.diff(before[first]) > 0] - 1
    out = np.delete(out, last)
    edge = edge - np.concatenate([[0], np.cumsum(np.diff(before[first]) > 0)])
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(out)])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs_and_rest(texts: pa.Array) -> list[pa.Array]:
    data, offsets = tb.text_bytes(texts)
    starts, ends, first = tb.word_bounds(data, offsets)
    ids = tb.word_hashes(data, starts, ends)
    runs = find_runs(ids, np.diff(first))
    text = np.searchsorted(first, runs[0], "right") - 1
    runs, text = runs[:, order := np.lexsort((runs[2], runs[0]))], text[order]
    drop = np.zeros(len(ids) + 1, np.int64)
    np.add.at(drop, runs[0] + runs[2], 1)
    np.add.at(drop, runs[1], -1)
    kept = np.cumsum(drop[:-1]) == 0
    columns = [pa.array(runs[0] - first[text]), pa.array(runs[1] - runs[0]), pa.array(runs[2])]
    lists = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(columns, fields=list(RUN)))
    return [pa.array(np.diff(first)), listed, _collapsed(data, starts, ends, kept, first)]


def periodic_runs(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of each whole text: id, n_words, runs (start and length in words, period; by start, then period) and collapsed, the
    words that no run holds behind its first period, joined by one blank.

    One row for each row of ``df``, in no certain order; other columns are left out, whatever their names. NULL and
    empty texts have no words, no runs and an empty ``collapsed``; repeated rows and ids, also NULL ones, give a row
    each; an empty table gives an empty one. No shuffle: a text is worked on where it is read, in memory in proportion to its length.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1), 2 << 20):
                found = _runs_and_rest(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *found], names=["id", "n_words", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def longest_run(runs: str) -> F.Column:
    """The run of greatest length; of equal ones that with the smallest start, then period. NULL without runs."""
    key = F.transform(F.col(runs), lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(key)
