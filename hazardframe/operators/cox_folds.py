"""Cox models of many training sets ("all folds but g") on one table of raw vectors.

The features of a training set are an affine map of the raw vector, so a model's linear predictor is one of the raw vector as
well: no row is copied for the sets it belongs to, and none twice for its start and its stop. Rows lie in packed blocks in any
order. What they add at risk is summed by event time, of which the table has a limited number: a first pass adds up, for each
model, the weights that enter and leave between neighbouring event times; from the sums the driver derives the cumulative
hazard at each event time, and a second pass weighs every row by the hazard between its start and its stop. Both passes are
matrix products over all models of all sets at once; their sums meet in tasks, by stretches of event times and by training set.

Blocks hold at most BLOCK_CELLS numbers and are compressed before they leave Python, so that a task holds no more of them in
memory than the file has bytes, however well they compress, and opens one at a time.

Tables with more than GRID_TIMES distinct event times go through ``cox.cox_data``, which sorts rows by time instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.session import cut_lineage

GRID_TIMES = 20_000
TIMES_PER_ROW = 256
BLOCK_CELLS = 1 << 18  # rows times features
CODEC = "lz4"
# A reader holds a row group at once. Sizes are looked at after every row, of which Parquet waits for 100 otherwise.
_WRITING = {
    "compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 22), "parquet.page.size": str(1 << 20),
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}
_BLOCK = "n int, fold binary, stop binary, start binary, event binary, x binary"
_SUMS = "fold int, gram binary, events binary"


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _compressed(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([pa.compress(np.ascontiguousarray(a), CODEC, asbytes=True) if a.size else b""], pa.binary()) for a in arrays]


def _open(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Of each block: folds, stops, starts (None without), events and raw vectors."""
    for batch in batches:
        for i, n in enumerate(batch.column(0).to_pylist()):

            def values(column: int, kind: type, count: int = n) -> np.ndarray:
                raw = batch.column(column)[i].as_buffer()
                return np.frombuffer(pa.decompress(raw, count * np.dtype(kind).itemsize, CODEC) if raw.size else b"", kind)

            start = values(3, float)
            yield values(1, np.int32), values(2, float), start if len(start) else None, values(4, np.uint8), values(5, float, n * width).reshape(width, n).T


def _added(keys: Sequence[str], sums: Sequence[str]):
    """Sums of packed arrays over the rows of a group."""

    def run(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).select(list(keys))
        for c in sums:
            total = sum(np.frombuffer(v) for v in rows[c].to_pylist())
            first = first.append_column(c, pa.array([total.tobytes()], pa.binary()))
        return first

    return run


@dataclass
class RawBlocks:
    """Raw vectors in blocks, and what was summed over them: a Gram matrix of (1, x) and sums of (1, x) over events of each
    fold; the event times with the events of each fold (None where there are too many)."""

    packed: DataFrame
    width: int
    grams: dict[int, np.ndarray]
    events: dict[int, np.ndarray]
    times: np.ndarray | None
    deaths: dict[int, np.ndarray]


def raw_blocks(df: DataFrame, columns: Sequence[Column], fold: str, folds: int, stop: str, event: str, start: str | None = None) -> RawBlocks:
    """Pack the vectors of ``columns`` (no missing values). ``df`` is read twice."""
    width = len(columns)
    most = max(1, BLOCK_CELLS // max(1, width))
    rows = df.select(
        F.col(fold).cast("int").alias("fold"), F.col(stop).cast("double").alias("stop"),
        (F.col(start).cast("double") if start else F.lit(None).cast("double")).alias("start"),
        F.coalesce((F.col(event) == 1).cast("int"), F.lit(0)).alias("event"), F.array(*columns).alias("x"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                x = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, width)
                begin = batch.column(2).to_numpy(zero_copy_only=False) if start else np.zeros(0)
                arrays = (batch.column(0).to_numpy().astype(np.int32), batch.column(1).to_numpy(zero_copy_only=False), begin,
                          batch.column(3).to_numpy().astype(np.uint8), x.T)  # a feature after the other, which compresses well
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *_compressed(*arrays)], names=["n", "fold", "stop", "start", "event", "x"])

    packed = cut_lineage(rows.mapInArrow(pack, _BLOCK), **_WRITING)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for own, _, _, e, x in _open(batches, width):
            full = np.column_stack([np.ones(len(x)), x])
            for g in np.unique(own).tolist():
                part, dead = full[own == g], e[own == g]
                total = found.setdefault(g, [np.zeros((width + 1, width + 1)), np.zeros(width + 1)])
                total[0] += part.T @ part
                total[1] += dead @ part
        for g, (gram, dead) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *_binary(gram, dead)], names=["fold", "gram", "events"])

    grams = {g: np.zeros((width + 1, width + 1)) for g in range(folds)}
    events = {g: np.zeros(width + 1) for g in range(folds)}
    for r in packed.mapInArrow(sums, _SUMS).groupBy("fold").applyInArrow(_added(["fold"], ["gram", "events"]), _SUMS).collect():  # one row for each fold
        grams[r["fold"]], events[r["fold"]] = np.frombuffer(r["gram"]).reshape(width + 1, -1), np.frombuffer(r["events"])
    at = rows.where("event = 1").groupBy("stop").agg(*[F.count_if(F.col("fold") == g).alias(f"d{g}") for g in range(folds)])
    found = at.limit(GRID_TIMES + 1).toPandas().sort_values("stop")  # one row for each event time, up to the limit
    times, deaths = None, {}
    if len(found) <= GRID_TIMES and not found["stop"].isna().any():
        times = found["stop"].to_numpy(dtype=float)
        deaths = {g: found[f"d{g}"].to_numpy(dtype=float) for g in range(folds)}
    return RawBlocks(packed, width, grams, events, times, deaths)


@dataclass
class FoldData:
    """Data of ``cox.fit_models`` whose groups are the training sets of ``spaces``, affine maps (weights, offset) by the fold
    left out; a number that is no fold leaves nothing out."""

    blocks: RawBlocks
    maps: Mapping[int, tuple[np.ndarray, np.ndarray]]

    def __post_init__(self):
        b = self.blocks
        self.event_sums, self.metrics, self.deaths = {}, {}, {}
        for g, (weights, offset) in self.maps.items():
            kept = [f for f in b.grams if f != g]
            gram, dead = sum(b.grams[f] for f in kept), sum(b.events[f] for f in kept)
            n = max(gram[0, 0], 1)
            mean = gram[0, 1:] / n
            self.event_sums[g] = dead[1:] @ weights + dead[0] * offset
            self.metrics[g] = dead[0] * (weights.T @ (gram[1:, 1:] / n - np.outer(mean, mean)) @ weights)
            self.deaths[g] = sum(b.deaths[f] for f in kept)

    def likelihood(self, betas: dict[int, np.ndarray], clip: float = 40.0, strict: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """As ``cox.partial_likelihood``. The driver sees a number for each event time and model, and a matrix for each set."""
        groups, width, times = sorted(betas), self.blocks.width, self.blocks.times
        sizes = [betas[g].shape[1] for g in groups]
        ends = np.cumsum(sizes)
        place = {g: slice(e - s, e) for g, s, e in zip(groups, sizes, ends)}
        owner, models, cells = np.repeat(groups, sizes), int(ends[-1]), len(times) + 1
        raw = np.column_stack([self.maps[g][0] @ betas[g] for g in groups])
        shift = np.concatenate([self.maps[g][1] @ betas[g] for g in groups])

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            """Of each block: event times up to the stop and up to the start, membership, predictors, weights, events, vectors."""
            for own, stop, start, e, x in _open(batches, width):
                eta = x @ raw
                eta += shift
                np.clip(eta, -clip, clip, out=eta)
                member = (own[:, None] != owner).astype(float)
                w = np.exp(eta)
                w *= member
                yield np.searchsorted(times, stop, "right"), None if start is None else np.searchsorted(times, start, "right"), member, eta, w, e, x

        def by_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((cells, models))

            def add(at: np.ndarray, w: np.ndarray, sign: float) -> None:
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[at[order[first]]] += sign * np.add.reduceat(w[order], first, axis=0)

            seen = False
            for upto, before, _, _, w, _, _ in weighed(batches):
                seen = True
                add(upto, w, 1.0)
                if before is not None:
                    add(before, w, -1.0)
            if seen:
                for k in range(0, cells, TIMES_PER_ROW):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *_binary(total[k : k + TIMES_PER_ROW])], names=["k", "w"])

        changes = np.zeros((cells, models))
        met = self.blocks.packed.mapInArrow(by_time, "k int, w binary").groupBy("k").applyInArrow(_added(["k"], ["w"]), "k int, w binary")
        for r in met.collect():  # one row for each stretch of event times
            part = np.frombuffer(r["w"]).reshape(-1, models)
            changes[r["k"] : r["k"] + len(part)] = part
        at_risk = np.cumsum(changes[::-1], axis=0)[::-1][1:]  # at an event time: rows that stop then or later and start earlier
        dead = np.column_stack([np.repeat(self.deaths[g][:, None], s, axis=1) for g, s in zip(groups, sizes)])
        with np.errstate(divide="ignore", invalid="ignore"):
            fine = np.where(at_risk > 0, at_risk, np.nan)
            share, logs = np.where(dead > 0, dead / fine, 0.0), np.where(dead > 0, dead * np.log(fine), 0.0)
        hazard = np.concatenate([np.zeros((1, models)), np.cumsum(share, axis=0)])

        def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved, whole, predicted = np.zeros((width, models)), np.zeros(models), np.zeros(models)
            for upto, before, member, eta, w, e, x in weighed(batches):
                w *= hazard[upto] if before is None else hazard[upto] - hazard[before]
                moved += x.T @ w
                whole += w.sum(axis=0)
                events = e == 1
                predicted += (eta[events] * member[events]).sum(axis=0)
            for g in groups:
                own = place[g]
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *_binary(moved[:, own], whole[own], predicted[own])], names=["g", "x", "w", "eta"])

        schema, out = "g int, x binary, w binary, eta binary", {}
        for r in self.blocks.packed.mapInArrow(slopes, schema).groupBy("g").applyInArrow(_added(["g"], ["x", "w", "eta"]), schema).collect():  # one row for each set
            g = r["g"]
            weights, offset = self.maps[g]
            taken = weights.T @ np.frombuffer(r["x"]).reshape(width, -1) + np.outer(offset, np.frombuffer(r["w"]))
            loglik = np.frombuffer(r["eta"]) - logs[:, place[g]].sum(axis=0)
            if strict and np.isnan(loglik).any():
                raise ValueError("an event time has no weight at risk")
            out[g] = (loglik, self.event_sums[g][:, None] - taken)
        return out

    def close(self) -> None:
        """Blocks are files in the checkpoint folder."""
