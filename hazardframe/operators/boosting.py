"""Gradient boosting of conditional quantiles (pinball loss), which Spark's own boosting does not offer.

Trees grow level by level from histograms. Split points are fixed once: midpoints between neighbouring values at exact
quantiles of each feature (between all neighbours, where a feature has at most MAX_BINS values), and no row is sampled.
Rows are then sorted by their vectors of bin numbers and packed in blocks. Rows of one vector share their node and their
prediction, so trees are followed once for each vector of a block. For a level every task follows the tree so far to the node
of each vector and adds up, for each (node, feature, bin), the rows and those with a positive residual; the best split is
chosen from their sums. Histograms of a few tasks are added up by the driver, larger ones meet by feature after a shuffle. The pinball gradient takes two values, so these sums are whole numbers and the
trees do not depend on how rows are dealt out. A leaf is set to the exact quantile of its residuals, found by narrowing
the interval that holds it with summaries of order statistics. Several quantiles are fitted in the same passes.

Up to LOCAL_ROWS rows are boosted by the same functions inside one task, which spares a job for each level; what is fitted
is the same either way.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardframe.operators.ordered import cut_points, ordered_columns, with_piece
from hazardframe.session import cut_lineage

MAX_BINS = 256
LOCAL_ROWS = 20_000
BLOCK_ROWS = 65_536
ROWS_PER_TASK = 50_000  # up to as many tasks as a shuffle has
MOST_ROWS_PER_TASK = 1_000_000  # beyond them the number of tasks grows with the rows
DRIVER_BYTES = 32_000_000  # sums of all tasks of a pass that are joined by the driver
SUMMARY = 512  # order statistics that a task sends for each leaf
TREE_SCHEMA = "tree int, node int, feature int, threshold double, bin int, left int, value double"


@dataclass
class Tree:
    """Nodes in order of their making; the right child stands behind the left one, a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @staticmethod
    def stump() -> Tree:
        return Tree(np.array([-1]), np.array([np.nan]), np.array([-1]), np.array([-1]), np.zeros(1))

    def split(self, node: int, feature: int, bin_: int, threshold: float) -> None:
        self.feature[node], self.bin[node], self.threshold[node], self.left[node] = feature, bin_, threshold, len(self.feature)
        self.feature, self.bin, self.left = (np.append(a, [-1, -1]) for a in (self.feature, self.bin, self.left))
        self.threshold, self.value = np.append(self.threshold, [np.nan, np.nan]), np.append(self.value, [0.0, 0.0])

    def nodes(self, goes_left) -> np.ndarray:
        """The leaf of each row; ``goes_left(nodes)`` tells for rows at those nodes which go left."""
        at = goes_left.start()
        while (inner := self.feature[at] >= 0).any():
            at = np.where(inner, self.left[at] + ~goes_left(self, at), at)
        return at

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.feature < 0)


class _Binned:
    def __init__(self, bins: np.ndarray):
        self.bins, self.rows = bins, np.arange(len(bins))

    def start(self) -> np.ndarray:
        return np.zeros(len(self.bins), np.int64)

    def __call__(self, tree: Tree, at: np.ndarray) -> np.ndarray:
        return self.bins[self.rows, np.maximum(tree.feature[at], 0)] <= tree.bin[at]


class _Raw(_Binned):
    def __call__(self, tree: Tree, at: np.ndarray) -> np.ndarray:
        return self.bins[self.rows, np.maximum(tree.feature[at], 0)] <= tree.threshold[at]


@dataclass
class QuantileModel:
    """Start value and trees, whose leaf values are scaled by ``rate``."""

    quantile: float
    start: float
    rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), _Raw(x)
        for tree in self.trees:
            out += self.rate * tree.value[tree.nodes(rows)]
        return out

    def transform(self, df: DataFrame, name: str, features: str = "features") -> DataFrame:
        """Add the prediction; only features that some split uses are sent to Python."""
        used = sorted({int(f) for t in self.trees for f in t.feature if f >= 0})
        if not used:
            return df.withColumn(name, F.lit(self.start + self.rate * sum(float(t.value[0]) for t in self.trees)))
        place = np.full(used[-1] + 1, -1)
        place[used] = np.arange(len(used))
        trees = [Tree(np.where(t.feature >= 0, place[t.feature], -1), t.threshold, t.bin, t.left, t.value) for t in self.trees]
        model = QuantileModel(self.quantile, self.start, self.rate, trees)

        @F.pandas_udf("double")
        def predict(*columns: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

        return df.withColumn(name, predict(*[F.col(features)[f] for f in used]))

    def tree_rows(self) -> list[tuple]:
        return [
            (i, k, int(t.feature[k]), float(t.threshold[k]), int(t.bin[k]), int(t.left[k]), float(t.value[k]))
            for i, t in enumerate(self.trees) for k in range(len(t.feature))
        ]

    @staticmethod
    def from_rows(quantile: float, start: float, rate: float, rows: pd.DataFrame) -> QuantileModel:
        ordered = rows.sort_values(["tree", "node"])
        trees = [Tree(*(g[c].to_numpy().copy() for c in ("feature", "threshold", "bin", "left", "value"))) for _, g in ordered.groupby("tree")]
        return QuantileModel(quantile, start, rate, trees)


# --- split points ---------------------------------------------------------------------------------------------------


def split_points(rows: DataFrame, features: str = "features", bins: int = MAX_BINS) -> dict[int, np.ndarray]:
    """Thresholds of each feature: halfway from a value to the next one, at all values or at exact quantiles."""
    cells = rows.select(F.posexplode(features).alias("feature", "value")).where(~F.isnan("value"))
    counts = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    ranked = ordered_columns(
        with_piece(counts, "value", cut_points(cells, "value")), ["value"], ["feature"], sums={"upto": "n"}, totals={"size": "n", "distinct": "one"},
        following={"next": "value"},
    )
    share = lambda n: F.floor(n * F.lit(bins) / F.col("size"))
    picked = ranked.where(F.col("next").isNotNull() & ((F.col("distinct") <= bins) | (share(F.col("upto")) > share(F.col("upto") - F.col("n")))))
    out: dict[int, list[float]] = {}
    for r in picked.orderBy("feature", "value").select("feature", "value", "next").collect():  # fewer than ``bins`` a feature
        middle = r["value"] + (r["next"] - r["value"]) / 2
        out.setdefault(r["feature"], []).append(middle if middle < r["next"] else r["value"])
    return {f: np.array(v) for f, v in out.items()}


# --- sums over blocks of rows ---------------------------------------------------------------------------------------


@dataclass
class _Block:
    """Some rows by their vectors of bins: the vectors, the rows of each, the predictions (a column for each quantile) of each,
    and the targets in order of the vectors."""

    bins: np.ndarray
    times: np.ndarray
    fitted: np.ndarray
    y: np.ndarray

    def advanced(self, rounds: Sequence[tuple[Sequence[Tree], float]]) -> _Block:
        """With a round of scaled trees after the other added to the predictions."""
        fitted, vectors = self.fitted.copy(), _Binned(self.bins)
        for trees, scale in rounds:
            for m, tree in enumerate(trees):
                fitted[:, m] += scale * tree.value[tree.nodes(vectors)]
        return _Block(self.bins, self.times, fitted, self.y)

    def above(self, model: int) -> np.ndarray:
        """Rows above their prediction, of each vector."""
        higher = np.concatenate([[0], np.cumsum(self.y > np.repeat(self.fitted[:, model], self.times))])
        ends = np.cumsum(self.times)
        return higher[ends] - higher[ends - self.times]

    def histogram(self, model: int, tree: Tree, open_: Sequence[int]) -> np.ndarray:
        """(open node, feature, bin, rows and rows above their prediction)."""
        at = tree.nodes(_Binned(self.bins))
        place = np.full(len(tree.feature), -1)
        place[list(open_)] = np.arange(len(open_))
        some = place[at] >= 0
        node, rows, above = place[at][some], self.times[some], self.above(model)[some]
        p = self.bins.shape[1]
        out = np.zeros((len(open_), p, MAX_BINS, 2), np.int64)
        for f in range(p):
            cell = node * MAX_BINS + self.bins[some, f]
            for i, weights in enumerate((rows, above)):  # whole numbers below 2^53 are exact
                out[:, f, :, i] = np.bincount(cell, weights, len(open_) * MAX_BINS).reshape(-1, MAX_BINS)
        return out

    def residuals(self, model: int, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(tree.nodes(_Binned(self.bins)), self.times), self.y - np.repeat(self.fitted[:, model], self.times)


def best_split(histogram: np.ndarray, quantile: float, min_leaf: int) -> tuple[float, int]:
    """Gain and bin of the best split of a node on one feature (the first of equal ones); gain 0 if there is none.

    The gain is the fall of the squared error of the gradient, which is ``quantile`` above the prediction and
    ``quantile - 1`` at or below it.
    """
    n, above = histogram[:, 0].cumsum(), histogram[:, 1].cumsum()
    total, total_above = n[-1], above[-1]
    if total < 2 * min_leaf or total_above in (0, total):
        return 0.0, -1
    sums = above - n * (1.0 - quantile)
    whole = total_above - total * (1.0 - quantile)
    ok = (n >= min_leaf) & (total - n >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, sums**2 / n + (whole - sums) ** 2 / (total - n) - whole**2 / total, 0.0)
    gain = np.where(gain > 1e-12 * total, gain, 0.0)
    best = int(np.argmax(gain))
    return (float(gain[best]), best) if gain[best] > 0 else (0.0, -1)


@dataclass
class _Search:
    """The rank-th smallest of a leaf's residuals lies in (low, high]; a task sends about ``size`` values of it (0: all)."""

    rank: int = 0  # 0: not known yet
    low: float = -math.inf
    high: float = math.inf
    size: int = SUMMARY


@dataclass
class _Summary:
    """Of some residuals: how many there are, how many are at most ``low``, and values of the interval with the exact
    number of interval values up to each, and of each."""

    n: int
    below: int
    values: np.ndarray
    upto: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(residuals: np.ndarray, search: _Search) -> _Summary:
        """All distinct values of the interval, or some of them at even ranks, the largest included."""
        inside = residuals[(residuals > search.low) & (residuals <= search.high)]
        values, times = np.unique(inside, return_counts=True)
        upto = np.cumsum(times)
        if 0 < search.size < len(values):
            picked = np.unique(np.searchsorted(upto, np.linspace(len(inside) / search.size, len(inside), search.size)))
            values, upto, times = values[picked], upto[picked], times[picked]
        return _Summary(len(residuals), int((residuals <= search.low).sum()), values, upto, times)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At least, and at most, so many interval values up to each x; at most so many strictly below it."""
        counts = np.concatenate([[0], self.upto])
        less = np.append(self.upto - self.times, self.upto[-1] if len(self.upto) else 0)
        at, after = np.searchsorted(self.values, x, "left"), np.searchsorted(self.values, x, "right")
        return counts[after], np.where(after > at, counts[after], less[after]), less[at]


def _narrowed(parts: Sequence[_Summary], search: _Search, quantile: float) -> tuple[float | None, _Search]:
    """The wanted value, if the summaries settle it, else a smaller interval that holds it."""
    rank = search.rank or max(1, math.ceil(round(sum(p.n for p in parts) * quantile, 9)))
    left = rank - sum(p.below for p in parts)
    values = np.unique(np.concatenate([p.values for p in parts]))
    least, most, less = (sum(c) for c in zip(*(p.bounds(values) for p in parts)))
    at = int(np.searchsorted(least, left))
    if less[at] < left:
        return float(values[at]), search
    before = int(np.searchsorted(most, left)) - 1  # up to this value there are surely fewer
    low, high = float(values[before]) if before >= 0 else search.low, float(values[at])
    return None, _Search(rank, low, high, 2 * search.size)  # ends even where the interval hardly narrows


class _InTask:
    """All rows in one block."""

    def __init__(self, block: _Block):
        self.block = block

    def splits(self, wanted: list[tuple[int, Tree, list[int]]], quantiles: Sequence[float], min_leaf: int) -> dict[tuple[int, int], tuple[float, int, int]]:
        out = {}
        for m, tree, open_ in wanted:
            for k, by_feature in zip(open_, self.block.histogram(m, tree, open_)):
                found = [(g, -f, b) for f, h in enumerate(by_feature) for g, b in [best_split(h, quantiles[m], min_leaf)]]
                gain, f, b = max(found, default=(0.0, 0, -1))
                out[m, k] = (gain, -f, b)
        return out

    def leaf_values(self, trees: Sequence[Tree], quantiles: Sequence[float]) -> list[dict[int, float]]:
        out = []
        for m, tree in enumerate(trees):
            at, r = self.block.residuals(m, tree)
            out.append({int(k): _narrowed([_Summary.of(r[at == k], _Search(size=0))], _Search(), quantiles[m])[0] for k in tree.leaves()})
        return out

    def advance(self, trees: Sequence[Tree], scale: float) -> None:
        self.block = self.block.advanced([(trees, scale)])


class _OverTasks:
    """Blocks in a table; every question is a job, and predictions are written anew after ``every`` rounds."""

    def __init__(self, packed: DataFrame, width: int, models: int, every: int, driver_bytes: int | None = None):
        self.packed, self.width, self.models, self.every = packed, width, models, every
        self.driver_bytes = DRIVER_BYTES if driver_bytes is None else driver_bytes
        self.tasks = packed.rdd.getNumPartitions()
        self.recent: list[tuple[list[Tree], float]] = []

    def _blocks(self):
        width, models, recent = self.width, self.models, list(self.recent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield _open(row, width, models).advanced(recent)

        return run

    def splits(self, wanted, quantiles, min_leaf):
        blocks = self._blocks()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for block in blocks(batches):
                for m, tree, open_ in wanted:
                    total[m] = total.get(m, 0) + block.histogram(m, tree, open_)
            rows = [(m, k, f, total[m][i, f].tobytes()) for m, _, open_ in wanted if m in total for i, k in enumerate(open_) for f in range(total[m].shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), pa.int32(), pa.int32(), pa.binary()])], names=["model", "node", "feature", "h"])

        def best(part: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(h, np.int64).reshape(MAX_BINS, 2) for h in part["h"].to_pylist())
            gain, b = best_split(whole, quantiles[part["model"][0].as_py()], min_leaf)
            return part.slice(0, 1).drop_columns(["h"]).append_column("gain", pa.array([gain])).append_column("bin", pa.array([b], pa.int32()))

        parts = self.packed.mapInArrow(sums, "model int, node int, feature int, h binary")
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        cells = sum(len(open_) for _, _, open_ in wanted) * self.width
        if self.tasks * cells * MAX_BINS * 16 <= self.driver_bytes:
            whole: dict[tuple[int, int, int], np.ndarray] = {}
            for r in parts.collect():  # one row for each task, open node and feature
                key = (r["model"], r["node"], r["feature"])
                whole[key] = whole.get(key, 0) + np.frombuffer(r["h"], np.int64)
            for (m, k, f), h in whole.items():
                gain, b = best_split(h.reshape(MAX_BINS, 2), quantiles[m], min_leaf)
                found[m, k] = max(found.get((m, k), (0.0, -self.width, -1)), (gain, -f, b))
            return {k: (g, -f, b) for k, (g, f, b) in found.items()}
        parts = parts.groupBy("model", "node", "feature")
        for r in parts.applyInArrow(best, "model int, node int, feature int, gain double, bin int").collect():  # one row for each open node and feature
            key, new = (r["model"], r["node"]), (r["gain"], -r["feature"], r["bin"])
            found[key] = max(found.get(key, (0.0, -self.width, -1)), new)
        return {k: (g, -f, b) for k, (g, f, b) in found.items()}

    def leaf_values(self, trees, quantiles):
        blocks = self._blocks()
        out: list[dict[int, float]] = [{} for _ in trees]
        searches = {(m, int(k)): _Search() for m, tree in enumerate(trees) for k in tree.leaves()}
        while searches:
            asked = dict(searches)

            def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: dict[tuple[int, int], list[np.ndarray]] = {key: [] for key in asked}
                for block in blocks(batches):
                    for m, tree in enumerate(trees):
                        at, r = block.residuals(m, tree)
                        for key in asked:
                            if key[0] == m:
                                held[key].append(r[at == key[1]])
                rows = [(key, _Summary.of(np.concatenate(v), asked[key])) for key, v in held.items() if v]
                numbers = [[key[0] for key, _ in rows], [key[1] for key, _ in rows], [x.n for _, x in rows], [x.below for _, x in rows]]
                packed = [[getattr(x, name).tobytes() for _, x in rows] for name in ("values", "upto", "times")]
                columns = [*(pa.array(c, pa.int64()) for c in numbers), *(pa.array(c, pa.binary()) for c in packed)]
                yield pa.RecordBatch.from_arrays(columns, names=["model", "node", "n", "below", "values", "upto", "times"])

            def joined(key: tuple[int, int], rows: Sequence) -> tuple[float | None, _Search]:
                whole = lambda raw: np.frombuffer(raw, np.int64)
                parts = [_Summary(r["n"], r["below"], np.frombuffer(r["values"]), whole(r["upto"]), whole(r["times"])) for r in rows]
                return _narrowed(parts, asked[key], quantiles[key[0]])

            def narrow(part: pa.Table) -> pa.Table:
                key = (part["model"][0].as_py(), part["node"][0].as_py())
                value, s = joined(key, part.to_pylist())
                return pa.table({"model": [key[0]], "node": [key[1]], "value": pa.array([value], pa.float64()), "rank": [s.rank], "low": [s.low], "high": [s.high], "size": [s.size]})

            kind = "model bigint, node bigint, n bigint, below bigint, values binary, upto binary, times binary"
            sent = self.packed.mapInArrow(summaries, kind)
            if self.tasks * sum(s.size for s in asked.values()) * 24 <= self.driver_bytes:
                by_leaf: dict[tuple[int, int], list] = {}
                for r in sent.collect():  # one row for each task and leaf
                    by_leaf.setdefault((r["model"], r["node"]), []).append(r)
                found = [(key, *joined(key, rows)) for key, rows in by_leaf.items()]
            else:
                rows = sent.groupBy("model", "node").applyInArrow(
                    narrow, "model bigint, node bigint, value double, rank bigint, low double, high double, size bigint"
                ).collect()  # one row for each leaf
                found = [((r["model"], r["node"]), r["value"], _Search(r["rank"], r["low"], r["high"], r["size"])) for r in rows]
            for key, value, search in found:
                if value is not None:
                    out[key[0]][key[1]] = value
                    del searches[key]
                else:
                    searches[key] = search
        return out

    def advance(self, trees, scale):
        self.recent.append((list(trees), scale))
        if len(self.recent) >= self.every:
            blocks = self._blocks()

            def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for block in blocks(batches):
                    yield _pack(block)

            self.packed, self.recent = cut_lineage(self.packed.mapInArrow(written, _PACKED)), []


_PACKED = "bins binary, times binary, fitted binary, y binary"


def _pack(block: _Block) -> pa.RecordBatch:
    arrays = {"bins": block.bins, "times": block.times, "fitted": block.fitted, "y": block.y}
    return pa.RecordBatch.from_pydict({n: pa.array([a.tobytes()], pa.binary()) for n, a in arrays.items()})


def _open(row: dict, width: int, models: int) -> _Block:
    times = np.frombuffer(row["times"], np.int64)
    return _Block(
        np.frombuffer(row["bins"], np.uint8).reshape(len(times), width), times, np.frombuffer(row["fitted"]).reshape(len(times), models), np.frombuffer(row["y"])
    )


def _grow(
    rows: _InTask | _OverTasks, quantiles: Sequence[float], points: dict[int, np.ndarray], rounds: int, depth: int, rate: float, min_leaf: int
) -> tuple[list[float], list[list[Tree]]]:
    """Start values and trees of each quantile."""
    stumps = [Tree.stump() for _ in quantiles]
    starts = [v[0] for v in rows.leaf_values(stumps, quantiles)]
    for tree, start in zip(stumps, starts):
        tree.value[0] = start
    rows.advance(stumps, 1.0)
    grown: list[list[Tree]] = []
    for _ in range(rounds):
        trees, open_ = [Tree.stump() for _ in quantiles], [[0] for _ in quantiles]
        for _ in range(depth):
            wanted = [(m, tree, nodes) for m, (tree, nodes) in enumerate(zip(trees, open_)) if nodes]
            if not wanted:
                break
            found, open_ = rows.splits(wanted, quantiles, min_leaf), [[] for _ in quantiles]
            for m, tree, nodes in wanted:
                for k in nodes:
                    gain, feature, b = found[m, k]
                    if gain > 0:
                        tree.split(k, feature, b, points[feature][b])
                        open_[m] += [int(tree.left[k]), int(tree.left[k]) + 1]
        for tree, values in zip(trees, rows.leaf_values(trees, quantiles)):
            for k, v in values.items():
                tree.value[k] = v
        rows.advance(trees, rate)
        grown.append(trees)
    return starts, [[round_[m] for round_ in grown] for m in range(len(quantiles))]


def fit_quantiles(
    df: DataFrame, quantiles: Sequence[float], target: str = "OS_MONTHS", features: str = "features", rounds: int = 200, depth: int = 3,
    rate: float = 0.05, min_leaf: int = 9, every: int = 20, local_rows: int | None = None, driver_bytes: int | None = None,
) -> list[QuantileModel]:
    """Boost ``rounds`` trees on the pinball loss at each quantile, all in the same passes. Features must be complete.

    ``every``, ``local_rows`` and ``driver_bytes`` (DRIVER_BYTES) decide where sums meet, never what is found."""
    spark: SparkSession = df.sparkSession
    rows = cut_lineage(df.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).where("y IS NOT NULL"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).first()
    if not shape["n"]:
        raise ValueError("no rows to fit")
    width, models = shape["p"], len(quantiles)
    points = split_points(rows, "x")
    edges = [points.get(f, np.zeros(0)) for f in range(width)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            bins = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.uint8) if width else np.zeros((len(x), 0), np.uint8)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * width
            vectors = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bins))])
            yield pa.RecordBatch.from_arrays([vectors, batch.column(1)], names=["bins", "y"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            raw = b"".join(whole["bins"].to_pylist())
            bins, y = np.frombuffer(raw, np.uint8).reshape(whole.num_rows, width), whole["y"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (bins[1:] != bins[:-1]).any(axis=1)]))
            return _pack(_Block(bins[first], np.diff(np.append(first, len(y))), np.zeros((len(first), models)), y))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield block()
                held.clear()
        if any(b.num_rows for b in held):
            yield block()

    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(usual, shape["n"] // ROWS_PER_TASK), shape["n"] // MOST_ROWS_PER_TASK)
    # The row number deals a vector shared by very many rows over several tasks.
    numbered = rows.mapInArrow(binned, "bins binary, y double").withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(tasks, "bins", "row").sortWithinPartitions("bins").select("bins", "y")
    packed = cut_lineage(ordered.mapInArrow(pack, _PACKED))
    arguments = (quantiles, points, rounds, depth, rate, min_leaf)
    if shape["n"] <= (LOCAL_ROWS if local_rows is None else local_rows):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [_open(row, width, models) for batch in batches for row in batch.to_pylist()]
            if blocks:  # the one task that holds the rows
                block = _Block(*(np.concatenate([getattr(b, n) for b in blocks]) for n in ("bins", "times", "fitted", "y")))
                yield pa.RecordBatch.from_pydict({"fit": pa.array([pickle.dumps(_grow(_InTask(block), *arguments))], pa.binary())})

        starts, trees = pickle.loads(packed.coalesce(1).mapInArrow(whole, "fit binary").first()["fit"])
    else:
        starts, trees = _grow(_OverTasks(packed, width, models, every, driver_bytes), *arguments)
    return [QuantileModel(q, float(s), rate, t) for q, s, t in zip(quantiles, starts, trees)]


def fit_quantile(df: DataFrame, quantile: float, target: str = "OS_MONTHS", features: str = "features", **options) -> QuantileModel:
    """``fit_quantiles`` for a single quantile."""
    return fit_quantiles(df, [quantile], target, features, **options)[0]


def interval_columns(names: Sequence[str], lo: str, hi: str, swap: bool = True) -> dict[str, Column]:
    """Bounds in order. With ``swap`` crossed bounds change places; without, both take the old upper bound."""
    low = F.least(F.col(lo), F.col(hi))
    return {names[0]: low, names[1]: F.greatest(F.col(lo), F.col(hi)) if swap else F.greatest(low, F.col(hi))}
