"""Cox proportional-hazards models by distributed partial likelihood.

Rows become signed entries at a time: +1 at the stop time and, for (start, stop] rows, -1 at the start time, so the
risk-set sum at t is the sum of sign * exp(eta) over entries at times >= t. Entries are range-partitioned once by falling
time, with the row number as a tie-breaker, so that a time shared by very many rows is dealt over several partitions, and
kept sorted. A partition is a stretch of the time axis; there are as many as the rows ask for. Each evaluation makes two passes without
a shuffle of rows: the first adds up every stretch, which gives each stretch the sum of all later times and, where its last
time goes on in the next ones, what they hold at that time. The second streams through the stretches. Its results are
summaries that two neighbouring stretches can be joined by, also in the middle of a tied time; many of them are joined by
blocks in tasks before the driver joins the blocks. Ties follow Breslow.

Several models are fitted together: ``group`` tells data sets apart (folds), and each group may carry many models
(penalties, feature subsets), whose coefficients are the columns of one matrix product per batch. The optimisers of all
models advance in step, so a whole grid costs as many passes as its slowest member.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from hazardframe.operators.cox_folds import FoldData
from hazardframe.session import cut_lineage

CELLS_PER_TASK = 500_000  # entries times features, up to as many tasks as a shuffle has
MOST_CELLS_PER_TASK = 8 * CELLS_PER_TASK  # beyond them the number of tasks grows with the rows
JOINED_BY_DRIVER = 64  # summaries of a group; more are joined in tasks first
SMOOTHING = 1e-6


@dataclass(frozen=True)
class Problem:
    """One model: a data group, its penalty, and which features it may use (all by default)."""

    group: int = 0
    alpha: float = 1.0
    l1_ratio: float = 0.0
    active: tuple[bool, ...] | None = None
    label: str = ""

    def penalty(self, beta: np.ndarray) -> tuple[float, np.ndarray]:
        root = np.sqrt(beta * beta + SMOOTHING)
        used = np.ones(len(beta), bool) if self.active is None else np.asarray(self.active)
        lasso = self.l1_ratio * root[used].sum() if self.l1_ratio else 0.0
        value = self.alpha * (lasso + (1 - self.l1_ratio) * 0.5 * beta @ beta)
        return value, self.alpha * (self.l1_ratio * beta / root + (1 - self.l1_ratio) * beta)

    def curvature(self, beta: np.ndarray) -> np.ndarray:
        return self.alpha * (self.l1_ratio * SMOOTHING / (beta * beta + SMOOTHING) ** 1.5 + 1 - self.l1_ratio)


@dataclass
class Fit:
    problem: Problem
    coef: np.ndarray
    objective: float
    n_iter: int
    converged: bool
    error: str = ""  # type of the error that ended this model, while the others went on


@dataclass
class CoxData:
    """Entries partitioned for evaluation; release with ``close``."""

    entries: DataFrame
    width: int
    stretches: int
    event_sums: dict[int, np.ndarray] = field(default_factory=dict)
    metrics: dict[int, np.ndarray] = field(default_factory=dict)

    def close(self) -> None:
        self.entries.unpersist()

    def likelihood(self, betas: dict[int, np.ndarray], clip: float = 40.0, strict: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return partial_likelihood(self, betas, clip, strict)


def cox_data(
    df: DataFrame, stop: str = "OS_MONTHS", event: str = "OS_EVENT", features: str = "features",
    start: str | None = None, group: str | None = None, width: int | None = None, stretches: int | None = None,
) -> CoxData:
    """Prepare rows with an array column of features (no missing values); ``width`` is its length, if known. ``stretches``
    sets the number of partitions, which follows from the size otherwise and never changes what is found."""
    base = df.select(
        (F.col(group).cast("int") if group else F.lit(0)).alias("g"),
        F.col(stop).cast("double").alias("t"), F.lit(1.0).alias("sign"), (F.col(event) == 1).cast("int").alias("e"),
        F.col(features).alias("x"), *([F.col(start).cast("double").alias("_start")] if start else []),
    )
    if start:
        ends = F.array(
            F.struct("t", "sign", "e"), F.struct(F.col("_start").alias("t"), F.lit(-1.0).alias("sign"), F.lit(0).alias("e"))
        )
        base = base.select("g", "x", F.explode(ends).alias("_z")).select("g", "_z.t", "_z.sign", "_z.e", "x")
    width = width or len(df.select(features).first()[0])
    if stretches is None:
        cells = base.count() * width
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stretches = max(1, min(usual, cells // CELLS_PER_TASK), cells // MOST_CELLS_PER_TASK)
    entries = (
        base.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(stretches, "g", F.desc("t"), "row")
        .sortWithinPartitions("g", F.desc("t"))
        .select("g", "t", "sign", "e", "x")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    data = CoxData(entries, width, stretches)
    schema = "part int, g int, n bigint, rows bigint, ex binary, x binary, xx binary"
    sums = _by_blocks(entries.mapInArrow(_totals, schema), schema, _added_totals, stretches)
    totals: dict[int, list] = {}
    for r in sums.collect():  # one row for each block and group
        values = _open_totals(r.asDict())
        known = totals.get(r["g"])
        totals[r["g"]] = values if known is None else [a + b for a, b in zip(known, values)]
    for g, (events, rows, ex, x, xx) in totals.items():
        xx = xx.reshape(width, width)
        mean = x / max(rows, 1)
        data.event_sums[g] = ex
        data.metrics[g] = events * (xx / max(rows, 1) - np.outer(mean, mean))
    return data


def _by_blocks(summaries: DataFrame, schema: str, join, stretches: int) -> DataFrame:
    """Summaries of neighbouring stretches joined in tasks, where there are many."""
    if stretches <= JOINED_BY_DRIVER:
        return summaries
    size = math.ceil(math.sqrt(stretches))
    return summaries.withColumn("block", F.floor(F.col("part") / size)).groupBy("g", "block").applyInArrow(lambda rows: join(rows.drop_columns(["block"])), schema)


def _open_totals(row: dict) -> list:
    return [row["n"], row["rows"], *(np.frombuffer(row[c]) for c in ("ex", "x", "xx"))]


def _added_totals(rows: pa.Table) -> pa.Table:
    n, count, ex, x, xx = (sum(c) for c in zip(*map(_open_totals, rows.to_pylist())))
    first = rows.slice(0, 1).select(["part", "g"])
    for name, value in (("n", pa.array([n], pa.int64())), ("rows", pa.array([count], pa.int64())), ("ex", _packed([ex])), ("x", _packed([x])), ("xx", _packed([xx]))):
        first = first.append_column(name, value)
    return first


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of one group within a batch: group, times, signs, events, feature matrix."""
    if batch.num_rows == 0:
        return
    g, t, sign, e = (batch.column(i).to_numpy() for i in range(4))
    x = batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)
    edges = [0, *(np.flatnonzero(np.diff(g) != 0) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        yield int(g[lo]), t[lo:hi], sign[lo:hi], e[lo:hi], x[lo:hi]


def _packed(arrays: Iterable[np.ndarray]) -> pa.Array:
    """Sums as bytes, which the driver reads without unpacking each number."""
    return pa.array([np.ascontiguousarray(a, dtype=float).tobytes() for a in arrays], pa.binary())


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group: events, rows, feature sums of the events, feature sums and cross products of the rows."""
    sums: dict[int, list] = {}
    for batch in batches:
        for g, _, sign, e, x in _segments(batch):
            rows = x[sign > 0]
            values = [int(e.sum()), len(rows), e @ x, rows.sum(axis=0), rows.T @ rows]
            sums[g] = [a + b for a, b in zip(sums[g], values)] if g in sums else values
    columns = list(zip(*sums.values())) if sums else [[]] * 5
    yield pa.RecordBatch.from_pydict(
        {"part": _part(len(sums)), "g": pa.array(list(sums), pa.int32()), "n": pa.array(columns[0], pa.int64()), "rows": pa.array(columns[1], pa.int64()),
         **{name: _packed(columns[i]) for i, name in ((2, "ex"), (3, "x"), (4, "xx"))}}
    )


def _part(count: int) -> pa.Array:
    """The number of the stretch at work: partitions of the range partitioning in order."""
    return pa.array([TaskContext.get().partitionId()] * count, pa.int32())


def _weights(x: np.ndarray, sign: np.ndarray, beta: np.ndarray, clip: float) -> tuple[np.ndarray, np.ndarray]:
    eta = np.clip(x @ beta, -clip, clip)
    return eta, sign[:, None] * np.exp(eta)


def _stretch_sums(betas: dict[int, np.ndarray], clip: float):
    """Of each stretch: its weight, its first and last time, and the weight at the first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for g, t, sign, _, x in _segments(batch):
                if g not in betas:
                    continue
                w = _weights(x, sign, betas[g], clip)[1]
                s = found.setdefault(g, [0.0, t[0], 0.0, t[-1]])
                s[0], s[2], s[3] = s[0] + w.sum(axis=0), s[2] + w[t == s[1]].sum(axis=0), t[-1]
        yield pa.RecordBatch.from_pydict(
            {"part": _part(len(found)), "g": pa.array(list(found), pa.int32()), "first": pa.array([s[1] for s in found.values()], pa.float64()),
             "last": pa.array([s[3] for s in found.values()], pa.float64()), **{n: _packed(s[i] for s in found.values()) for n, i in (("w", 0), ("at_first", 2))}}
        )

    return run


class _Stream:
    """Sums of one stretch while its rows arrive by falling time. ``later``: weight of all later times; ``beyond``: what the
    next stretches hold at this one's last time."""

    def __init__(self, later: np.ndarray, beyond: np.ndarray, width: int):
        k = len(later)
        self.s0, self.beyond = later.copy(), beyond
        self.first, self.time, self.pending = None, None, 0
        self.seen = np.zeros(k)  # sum of d / S0 over closed event times
        self.loglik, self.share = np.zeros(k), np.zeros(k)
        self.xw, self.xwg, self.xw_first = (np.zeros((width, k)) for _ in range(3))

    def _shares(self, d: np.ndarray, s0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """d / S0 and d log S0; NaN where an event time has no weight at risk."""
        with np.errstate(divide="ignore", invalid="ignore"):
            fine = np.where(s0 > 0, s0, np.nan)
            return np.where(d > 0, d / fine, 0.0), np.where(d > 0, d * np.log(fine), 0.0)

    def close_time(self, beyond: np.ndarray | float = 0.0) -> None:
        self.share, logs = self._shares(np.float64(self.pending), self.s0 + beyond)
        self.seen = self.seen + self.share
        self.loglik -= logs
        self.pending = 0

    def add(self, t: np.ndarray, e: np.ndarray, x: np.ndarray, eta: np.ndarray, w: np.ndarray) -> None:
        self.loglik += e @ eta
        self.xw += x.T @ w
        if self.first is None:
            self.first = t[0]
        if t[0] == self.first:
            same = t == self.first
            self.xw_first += x[same].T @ w[same]
        if self.time is not None and t[0] != self.time:
            self.close_time()
        first = np.flatnonzero(np.concatenate([[True], np.diff(t) != 0]))
        last = np.concatenate([first[1:], [len(t)]]) - 1
        s0 = self.s0 + np.cumsum(w, axis=0)[last]
        d = np.add.reduceat(e, first).astype(float)
        d[0] += self.pending
        share, logs = self._shares(d[:, None], s0)
        before = self.seen + np.concatenate([np.zeros((1, s0.shape[1])), np.cumsum(share, axis=0)[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(t)]])))
        self.xwg += x.T @ (w * before[group])
        # All times but the last are complete; the last may go on in the next batch.
        if len(first) > 1:
            self.seen = before[-1].copy()
            self.loglik -= logs[:-1].sum(axis=0)
        self.s0, self.pending, self.time = s0[-1], int(d[-1]), t[-1]


_SUMMARY = ("h", "loglik", "share", "xw", "xwg", "xw_first")
_SUMMARY_SCHEMA = "part int, g int, first double, last double, " + ", ".join(f"{c} binary" for c in _SUMMARY)


@dataclass
class _Stretch:
    """What a stretch adds to likelihood and gradient.

    h: sum of d / S0 over its event times; share: that of its last time; xw: sums of x * w. With H the sum of d / S0 up to
    the stretch's end and over earlier times, its rows take H * xw - xwg off the gradient. xw_first: xw at its first time.
    """

    first: float
    last: float
    h: np.ndarray
    loglik: np.ndarray
    share: np.ndarray
    xw: np.ndarray
    xwg: np.ndarray
    xw_first: np.ndarray

    def then(self, next_: _Stretch) -> _Stretch:
        """This stretch and the next one, of earlier times, as one. Where a time goes over both, rows behind the seam
        also count the events before it."""
        tied = self.last == next_.first
        xwg = self.xwg + next_.xwg + self.h * next_.xw
        return _Stretch(
            self.first, next_.last, self.h + next_.h, self.loglik + next_.loglik,
            next_.share + (self.share if tied and next_.first == next_.last else 0.0), self.xw + next_.xw,
            xwg - self.share * next_.xw_first if tied else xwg, self.xw_first + (next_.xw_first if tied and self.first == self.last else 0.0),
        )


def _open_stretch(row: dict) -> _Stretch:
    values = {c: np.frombuffer(row[c]) for c in _SUMMARY}
    k = len(values["h"])
    return _Stretch(row["first"], row["last"], **{c: v.reshape(-1, k) if c.startswith("xw") else v for c, v in values.items()})


def _joined(rows: Iterable[dict]) -> _Stretch:
    whole = None
    for row in sorted(rows, key=lambda r: r["part"]):
        whole = _open_stretch(row) if whole is None else whole.then(_open_stretch(row))
    return whole


def _stretch_columns(found: list[tuple[int, int, _Stretch]]) -> dict:
    return {
        "part": pa.array([p for p, _, _ in found], pa.int32()), "g": pa.array([g for _, g, _ in found], pa.int32()),
        "first": pa.array([s.first for *_, s in found], pa.float64()), "last": pa.array([s.last for *_, s in found], pa.float64()),
        **{c: _packed(getattr(s, c) for *_, s in found) for c in _SUMMARY},
    }


def _joined_table(rows: pa.Table) -> pa.Table:
    listed = rows.to_pylist()
    return pa.table(_stretch_columns([(min(r["part"] for r in listed), listed[0]["g"], _joined(listed))]))


def _stretch_gradients(betas: dict[int, np.ndarray], starts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], clip: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        streams: dict[int, _Stream] = {}
        for batch in batches:
            for g, t, sign, e, x in _segments(batch):
                if g in betas:
                    stream = streams.setdefault(g, _Stream(*starts[part, g], x.shape[1]))
                    stream.add(t, e, x, *_weights(x, sign, betas[g], clip))
        found = []
        for g, s in streams.items():
            s.close_time(s.beyond)
            found.append((part, g, _Stretch(s.first, s.time, s.seen, s.loglik, s.share, s.xw, s.xwg, s.xw_first)))
        yield pa.RecordBatch.from_pydict(_stretch_columns(found))

    return run


def partial_likelihood(
    data: CoxData, betas: dict[int, np.ndarray], clip: float = 40.0, strict: bool = True
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Log partial likelihood and gradient at given coefficients.

    ``betas`` maps a group to a (features x models) matrix; the result maps it to (values, features x models gradients).
    The driver sees a few numbers for each stretch and model, and matrices for each block of stretches. An event time
    whose risk set has no weight left (rows that end before they start, or sums lost to rounding at extreme coefficients)
    is an error; without ``strict`` the value is NaN.
    """
    schema = "part int, g int, first double, last double, w binary, at_first binary"
    stretches: dict[int, list] = {}
    for r in data.entries.mapInArrow(_stretch_sums(betas, clip), schema).collect():
        stretches.setdefault(r["g"], []).append((r["part"], r["first"], r["last"], np.frombuffer(r["w"]), np.frombuffer(r["at_first"])))
    starts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for g, found in stretches.items():
        found.sort(key=lambda s: s[0])
        later, beyond = [], []
        total = np.zeros(betas[g].shape[1])
        for s in found:
            later.append(total)
            total = total + s[3]
        go_on = np.zeros_like(total)
        for s, after in zip(reversed(found), [None, *reversed(found[1:])]):
            if after is None or after[1] != s[2]:
                go_on = np.zeros_like(total)
            else:
                go_on = after[4] + (go_on if after[1] == after[2] else 0.0)
            beyond.append(go_on)
        starts |= {(s[0], g): pair for s, pair in zip(found, zip(later, reversed(beyond)))}
    summaries = data.entries.mapInArrow(_stretch_gradients(betas, starts, clip), _SUMMARY_SCHEMA)
    rows: dict[int, list[dict]] = {}
    for r in _by_blocks(summaries, _SUMMARY_SCHEMA, _joined_table, data.stretches).collect():
        rows.setdefault(r["g"], []).append(r.asDict())
    out = {}
    for g, beta in betas.items():
        loglik, gradient = np.zeros(beta.shape[1]), np.repeat(np.asarray(data.event_sums[g], float).reshape(-1, 1), beta.shape[1], axis=1)
        if g in rows:
            whole = _joined(rows[g])
            loglik, gradient = whole.loglik, gradient - (whole.h * whole.xw - whole.xwg)
        if strict and np.isnan(loglik).any():
            raise ValueError("an event time has no weight at risk")
        out[g] = (loglik, gradient)
    return out


class _Optimiser:
    """Limited-memory quasi-Newton steps of one model; asks for one evaluation at a time.

    The start metric is the covariance of the features times the number of events (the curvature of the likelihood at
    zero, were all risk sets alike) plus the curvature of the penalty, which spares most iterations.
    """

    def __init__(self, problem: Problem, metric: np.ndarray, maxiter: int, ftol: float, gtol: float, memory: int = 10):
        self.problem, self.maxiter, self.ftol, self.gtol = problem, maxiter, ftol, gtol
        width = len(metric)
        self.used = np.ones(width) if problem.active is None else np.asarray(problem.active, float)
        self.metric = metric * np.outer(self.used, self.used)
        self.x, self.trial = np.zeros(width), np.zeros(width)
        self.f, self.g = None, None
        self.pairs: deque = deque(maxlen=memory)
        self.n_iter, self.tries, self.step = 0, 0, 1.0
        self.done = self.converged = False
        self.error = ""

    def _direction(self) -> np.ndarray:
        start = self.metric + np.diag(self.problem.curvature(self.x) + 1e-6 + (1 - self.used))
        q = self.g.copy()
        coefficients = []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (y @ s)
            coefficients.append(a)
            q -= a * y
        q = np.linalg.solve(start, q)
        if self.pairs and not self.problem.l1_ratio:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ np.linalg.solve(start, y))
        for (s, y), a in zip(self.pairs, reversed(coefficients)):
            q += s * (a - (y @ q) / (y @ s))
        return -q * self.used

    def _start_search(self) -> None:
        self.d = self._direction()
        if self.g @ self.d >= 0:
            self.pairs.clear()
            self.d = self._direction()
        self.step = 1.0
        self.tries = 0
        self.trial = self.x + self.step * self.d

    def tell(self, loglik: float, gradient: np.ndarray) -> None:
        value, slope = self.problem.penalty(self.trial)
        f, g = value - loglik, (slope - gradient) * self.used
        if self.f is None:
            self.f, self.g = f, g
            if np.abs(g).max(initial=0.0) <= self.gtol:
                self.done = self.converged = True
                return
            self._start_search()
            return
        if not np.isfinite(f) or f > self.f + 1e-4 * self.step * (self.g @ self.d):
            self.tries += 1
            expected = -self.step * (self.g @ self.d)
            if self.tries > 30 or expected <= self.ftol * max(1.0, abs(self.f)):
                # Nothing left to gain along this direction beyond the accuracy of the sums.
                self.done, self.converged = True, self.tries <= 30
                return
            self.step *= 0.5
            self.trial = self.x + self.step * self.d
            return
        s, y = self.trial - self.x, g - self.g
        if s @ y > 1e-12 * (y @ y):
            self.pairs.append((s, y))
        small = (self.f - f) <= self.ftol * max(abs(self.f), abs(f), 1.0)
        self.x, self.f, self.g = self.trial, f, g
        self.n_iter += 1
        if small or np.abs(g).max(initial=0.0) <= self.gtol:
            self.done = self.converged = True
        elif self.n_iter >= self.maxiter:
            self.done = True
        else:
            self._start_search()


def fit_models(
    data: CoxData | FoldData, problems: Sequence[Problem], maxiter: int = 400, clip: float = 40.0, ftol: float = 2.2e-9, gtol: float = 1e-5, strict: bool = True
) -> list[Fit]:
    """Fit all problems together; groups without rows of events shrink to zero through their penalty. Without ``strict`` a
    model that cannot be fitted carries the type of its error, and the others are fitted as if it were not there."""
    states = [_Optimiser(p, data.metrics[p.group], maxiter, ftol, gtol) for p in problems]
    while True:
        active = [s for s in states if not s.done]
        if not active:
            break
        by_group: dict[int, list[_Optimiser]] = {}
        for s in active:
            by_group.setdefault(s.problem.group, []).append(s)
        betas = {g: np.column_stack([s.trial for s in members]) for g, members in by_group.items()}
        found = data.likelihood(betas, clip, strict=strict and any(s.f is None for s in active))
        for g, members in by_group.items():
            for k, s in enumerate(members):
                try:
                    if s.f is None and np.isnan(found[g][0][k]):
                        raise ValueError("an event time has no weight at risk")
                    s.tell(float(found[g][0][k]), found[g][1][:, k])
                except (ValueError, ArithmeticError, np.linalg.LinAlgError) as error:
                    if strict:
                        raise
                    s.done, s.error = True, type(error).__name__
    return [Fit(s.problem, s.x, math.nan if s.f is None else float(s.f), s.n_iter, s.converged, s.error) for s in states]


def fit_one(
    df: DataFrame, alpha: float = 1.0, l1_ratio: float = 0.0, maxiter: int = 400, clip: float = 40.0, **columns: str | None
) -> Fit:
    """Ridge (l1_ratio 0) or elastic-net model on one data set; pass ``start=`` for (start, stop] rows."""
    named = {"stop": "OS_MONTHS", "event": "OS_EVENT", "features": "features", "start": None, **columns}
    # The design is written once: cut points and entries both read it.
    data = cox_data(cut_lineage(df.select(*[c for c in named.values() if c])), **named)
    try:
        return fit_models(data, [Problem(0, alpha, l1_ratio)], maxiter, clip)[0]
    finally:
        data.close()


def coefficient_table(df: DataFrame, fits: Sequence[Fit], names: Sequence[str]) -> DataFrame:
    rows = [
        (f.problem.label, f.problem.group, f.problem.alpha, f.problem.l1_ratio, i, names[i], float(v), f.n_iter, f.converged)
        for f in fits for i, v in enumerate(f.coef)
    ]
    schema = (
        "label string, fold int, alpha double, l1_ratio double, coef_index int, feature string, coef_value double, "
        "n_iter int, converged boolean"
    )
    return df.sparkSession.createDataFrame(rows, schema)
