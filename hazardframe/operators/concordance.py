"""Concordance index of one or many risk columns without a pair join.

A pair (i, j) counts if t_i < t_j and i had the event. Rows travel in packed blocks of one model and key, so that a task counts
one model. Such a group of at most GROUP_ROWS rows is counted in one task, by merge counting over rank bits. A larger group is
cut into time pieces and into risk pieces:

* pairs in different time pieces and different risk pieces follow from the counts of the cells, added up over tasks;
* pairs inside a time piece are a smaller group;
* pairs in different time pieces and the same risk piece are a smaller group, with the piece as time.

Smaller groups are treated alike, so no task holds more than GROUP_ROWS rows at any size of the input. A time or risk shared by very
many rows gets a piece of its own, in which nothing is left to count. Cut points come from a sample and decide balance only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardframe.operators.ordered import join_on
from hazardframe.session import cut_lineage

GROUP_ROWS = 1_000_000
PIECES = 256
SAMPLE_ROWS = 100_000  # of each group that is cut
BLOCK = "k string, k0 string, whole boolean, m0 int, m int, n bigint, t binary, d binary, s binary"
COUNTS = "k0 string, model int, comparable bigint, concordant bigint, tied bigint"


def dominance_counts(a: np.ndarray, s: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[int, int, int]:
    """Sums over i, weighted by d_i, of n_j over j with a_j > a_i: all of them, those with s_j < s_i, with s_j = s_i.

    Pairs are split by the highest bit in which their ranks of ``a`` differ; at each bit one sort and one running sum
    count all of them.
    """
    a = np.unique(a, return_inverse=True)[1].astype(np.int64)
    s = np.unique(s, return_inverse=True)[1].astype(np.int64)
    width = int(s.max()) + 1 if len(s) else 1
    every = less = equal = 0
    for bit in range(int(a.max()).bit_length() if len(a) else 0):
        block, upper = a >> (bit + 1), (a >> bit) & 1
        key = block * width + s
        order = np.argsort(key, kind="stable")
        key, block, weight = key[order], block[order], np.where(upper[order] == 1, n[order], 0)
        running = np.concatenate([[0], np.cumsum(weight)])
        start, first, last = np.searchsorted(block, block), np.searchsorted(key, key), np.searchsorted(key, key, "right")
        stop = np.searchsorted(block, block, "right")
        events = np.where(upper[order] == 0, d[order], 0)
        every += int((events * (running[stop] - running[start])).sum())
        less += int((events * (running[first] - running[start])).sum())
        equal += int((events * (running[last] - running[first])).sum())
    return every, less, equal


def _block(k: str, k0: str, whole: bool, m0: int, t: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple:
    return k, k0, whole, m0, s.shape[1], len(t), t.astype(float).tobytes(), d.astype(np.uint8).tobytes(), np.ascontiguousarray(s, float).tobytes()


_BLOCK_TYPES = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_BLOCK_NAMES = [f.split(" ")[0] for f in BLOCK.split(", ")]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_BLOCK_TYPES)], names=_BLOCK_NAMES)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["t"]), np.frombuffer(row["d"], np.uint8), np.frombuffer(row["s"]).reshape(row["n"], row["m"])


def _counts(k0: str, m0: int, found: Sequence[tuple[int, int, int]], whole: bool) -> pa.Table:
    """A row for each model; pairs that cells have counted as comparable already are not counted again."""
    return pa.table({
        "k0": pa.array([k0] * len(found), pa.string()), "model": pa.array(range(m0, m0 + len(found)), pa.int32()),
        "comparable": pa.array([c if whole else 0 for c, _, _ in found], pa.int64()), "concordant": pa.array([c for _, c, _ in found], pa.int64()),
        "tied": pa.array([c for _, _, c in found], pa.int64()),
    })


def _pieces(order: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, rows) of each run of equal keys, given the rows in order of their keys."""
    edges = np.flatnonzero(np.diff(keys[order], prepend=-1, append=-1))
    for lo, hi in zip(edges, edges[1:]):
        yield int(keys[order[lo]]), order[lo:hi]


def _packed(rows: DataFrame) -> DataFrame:
    """(k, t, d, s) rows as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy().astype(np.int64)
            t, d = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            s = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
            size = batch.column(3).value_lengths().to_numpy()
            begin, out = np.cumsum(size) - size, []
            for c, own in _pieces(np.argsort(code, kind="stable"), code):
                m = size[own].max(initial=0)  # a shorter vector lacks the models behind its end
                at = begin[own][:, None] + np.arange(m)
                risks = np.where(np.arange(m) < size[own][:, None], s[np.minimum(at, max(0, len(s) - 1))] if len(s) else np.nan, np.nan)
                name = names.dictionary[c].as_py()
                # A group for each model, so that a task counts one of them.
                out += [_block(f"{name}#{i}", name, True, i, t[own], d[own], risks[:, i : i + 1]) for i in range(m)]
            yield _blocks(out)

    return rows.mapInArrow(run, BLOCK)


def _joined(rows: Sequence[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_open(r) for r in rows]
    m = max(s.shape[1] for *_, s in parts)
    wide = [np.pad(s, ((0, 0), (0, m - s.shape[1])), constant_values=np.nan) for *_, s in parts]
    return np.concatenate([t for t, *_ in parts]), np.concatenate([d for _, d, _ in parts]), np.concatenate(wide)


def _count_group(blocks: pa.Table) -> pa.Table:
    rows = blocks.to_pylist()
    t, d, s = _joined(rows)
    found = []
    for model in range(s.shape[1]):
        known = ~np.isnan(s[:, model])
        found.append(dominance_counts(t[known], s[known, model], np.ones(known.sum(), np.int64), d[known].astype(np.int64)))
    return _counts(rows[0]["k0"], rows[0]["m0"], found, rows[0]["whole"])


def _cuts(values: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut points at quantiles, and the numbers of the pieces that hold a single, heavy value."""
    values = np.sort(values[~np.isnan(values)])
    if not len(values):
        return np.zeros(0), np.zeros(0, np.int64)
    picked = values[np.minimum(len(values) - 1, np.arange(1, pieces) * len(values) // pieces)]
    value, times = np.unique(picked, return_counts=True)
    heavy = value[(times > 1) & np.isfinite(value)]
    cuts = np.unique(np.concatenate([value, np.nextafter(heavy, math.inf)]))
    return cuts, np.searchsorted(cuts, heavy, "right")


def _split(blocks: DataFrame, sizes: dict[str, int], pieces: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the cells of large groups, and the blocks of the smaller groups that are left."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                t, d, s = _open(r)
                own = np.linspace(0, len(t) - 1, max(1, min(len(t), SAMPLE_ROWS * len(t) // sizes[r["k"]]))).astype(int)
                out.append(_block(r["k"], r["k0"], r["whole"], r["m0"], t[own], d[own], s[own]))
            yield _blocks(out)

    def cut(group: pa.Table) -> pa.Table:
        t, _, s = _joined(group.to_pylist())
        found = [_cuts(t, pieces), *(_cuts(s[:, i], pieces) for i in range(s.shape[1]))]
        raw = [[v.astype(float).tobytes() for v in column] for column in zip(*found)]
        return pa.table({"k": group["k"].slice(0, 1), "cuts": pa.array([raw[0]], pa.list_(pa.binary())), "single": pa.array([raw[1]], pa.list_(pa.binary()))})

    # One row for each group of more than GROUP_ROWS rows.
    found = blocks.mapInArrow(sample, BLOCK).groupBy("k").applyInArrow(cut, "k string, cuts array<binary>, single array<binary>").collect()
    cuts = {r["k"]: ([np.frombuffer(c) for c in r["cuts"]], [np.frombuffer(c).astype(np.int64) for c in r["single"]]) for r in found}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                t, d, s = _open(r)
                points, _ = cuts[r["k"]]
                tp, width = np.searchsorted(points[0], t, "right"), len(points[0]) + 1
                for i in range(r["m"]):
                    known = ~np.isnan(s[:, i])
                    cell = np.searchsorted(points[i + 1], s[known, i], "right") * width + tp[known]
                    shape = (2, (len(points[i + 1]) + 1) * width)
                    key = (r["k"], r["k0"], r["whole"], r["m0"] + i, i)
                    table = total.setdefault(key, np.zeros(shape, np.int64))
                    table[0] += np.bincount(cell, minlength=shape[1])
                    table[1] += np.bincount(cell[d[known] == 1], minlength=shape[1])
        columns = list(zip(*total)) or [[]] * 5
        types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(columns, types)), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["k", "k0", "whole", "model", "i", "cells"]
        )

    def across(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        points, single = cuts[rows[0]["k"]]
        i, width = rows[0]["i"], len(points[0]) + 1
        n, d = sum(np.frombuffer(r["cells"], np.int64).reshape(2, -1) for r in rows)
        held = np.flatnonzero(n)
        rp, tp = held // width, held % width
        every, less, _ = dominance_counts(tp, rp, n[held], d[held])
        equal = sum(dominance_counts(tp[rp == v], rp[rp == v], n[held][rp == v], d[held][rp == v])[2] for v in single[i + 1])
        return _counts(rows[0]["k0"], rows[0]["model"], [(every, less, equal)], rows[0]["whole"])

    def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                t, d, s = _open(r)
                points, single = cuts[r["k"]]
                tp = np.searchsorted(points[0], t, "right")
                for piece, own in _pieces(np.argsort(tp, kind="stable"), tp):
                    if piece not in single[0]:
                        out.append(_block(f"{r['k']}/t{piece}", r["k0"], r["whole"], r["m0"], t[own], d[own], s[own]))
                for i in range(r["m"]):
                    known = np.flatnonzero(~np.isnan(s[:, i]))
                    rp = np.searchsorted(points[i + 1], s[known, i], "right")
                    for piece, own in _pieces(np.argsort(rp, kind="stable"), rp):
                        if piece not in single[i + 1]:
                            at = known[own]
                            out.append(_block(f"{r['k']}/m{i}r{piece}", r["k0"], False, r["m0"] + i, tp[at], d[at], s[at, i : i + 1]))
                yield _blocks(out)

    counted = blocks.mapInArrow(cells, "k string, k0 string, whole boolean, model int, i int, cells binary").groupBy("k", "i").applyInArrow(across, COUNTS)
    return counted, blocks.mapInArrow(smaller, BLOCK)


def _large(blocks: DataFrame, most: int) -> tuple[DataFrame, dict[str, int]]:
    """The blocks, written because several jobs read them, and the groups of more than ``most`` rows."""
    blocks = cut_lineage(blocks)
    return blocks, {r["k"]: r["n"] for r in blocks.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()}


def concordances(
    df: DataFrame, risks: str, time: str = "OS_MONTHS", event: str = "OS_EVENT", keys: Iterable[str] = (), pieces: int = PIECES, group_rows: int | None = None,
) -> DataFrame:
    """For each key and each position of the array column ``risks`` (column ``model``): comparable, concordant and tied
    pairs, and the index (NULL without comparable pairs). A missing risk takes its row out for that model only.

    ``pieces`` and ``group_rows`` (GROUP_ROWS) decide how the work is cut, never what is found.
    """
    keys, most = list(keys), GROUP_ROWS if group_rows is None else group_rows
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("all")
    known = df.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(risks).isNotNull())
    rows = known.select(*keys, name.alias("_k"), F.col(time).cast("double").alias("_t"), (F.col(event) == 1).cast("int").alias("_d"), F.col(risks).cast("array<double>").alias("_s"))
    blocks = _packed(rows.select("_k", "_t", "_d", "_s"))
    counts, large = [], {}
    if not rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).isEmpty():
        blocks, large = _large(blocks, most)
    while large:
        is_large = F.col("k").isin(list(large))
        counts.append(blocks.where(~is_large).groupBy("k").applyInArrow(_count_group, COUNTS))
        found, blocks = _split(blocks.where(is_large), large, pieces)
        counts.append(found)
        blocks, large = _large(blocks, most)
    total = blocks.groupBy("k").applyInArrow(_count_group, COUNTS)
    for part in counts:
        total = total.unionByName(part)
    total = total.groupBy("k0", "model").agg(*[F.sum(c).alias(c) for c in ("comparable", "concordant", "tied")])
    index = (F.col("concordant") + F.col("tied") / 2) / F.nullif(F.col("comparable"), F.lit(0))
    total = total.withColumn("c_index", index)
    if not keys:
        return total.drop("k0")
    named = rows.select(*keys, F.col("_k").alias("k0")).distinct()
    return join_on(named, total, ["k0"]).drop("k0")


def concordance(
    df: DataFrame, time: str = "OS_MONTHS", event: str = "OS_EVENT", risk: str = "risk", keys: Iterable[str] = (),
    pieces: int = PIECES, group_rows: int | None = None,
) -> DataFrame:
    """``concordances`` of a single risk column: one row per key."""
    known = df.where(F.col(risk).isNotNull()).withColumn("_risks", F.array(F.col(risk).cast("double")))
    return concordances(known, "_risks", time, event, keys, pieces, group_rows).drop("model")
