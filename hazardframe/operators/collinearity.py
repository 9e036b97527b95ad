"""Pairwise correlations by tiles of the Gram matrix, and collinearity filters on the graph of strong pairs.

Emitting all feature pairs of every row would cost rows x features². Instead the columns are cut into blocks of TILE, and
each task multiplies chunks of its rows block by block: a tile holds the sums of TILE x TILE pairs. Tiles are added up by
(block, block), turned into correlations where they are added, and laid out as a table of pairs; no task and no driver
holds features x features numbers. Missing values are handled by their masks: with x0 = x or 0 and m = 1 or 0, the products of
x0, x0² and m hold every sum that a pairwise-complete correlation needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators.clean import column_quantiles
from hazardframe.session import cut_lineage

TILE = 256
CHUNK_CELLS = 4_000_000  # rows times columns that a task multiplies at once
CHUNKS_PER_TASK = 64  # tiles of so many chunks are added up in one task
LOCAL_EDGES = 1_000_000
TINY = 1e-12
DROP_SCHEMA = (
    "group string, feature_dropped string, anchor_feature string, abs_correlation double, threshold double, method string"
)


def gram_matrix(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    rows = df.select(array_to_vector(F.array(*columns)).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), numCols=len(columns))
    return matrix.computeGramianMatrix().toArray()


def column_moments(df: DataFrame, columns: Sequence[str]) -> pd.DataFrame:
    """count, mean and std of each column, plus the row count; one driver row per column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        number = S.to_number(c)
        aggs += [F.count(number).alias(f"n{i}"), F.avg(number).alias(f"m{i}"), F.stddev_samp(number).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    out = pd.DataFrame(
        {"n": [row[f"n{i}"] for i in range(len(columns))],
         "mean": [row[f"m{i}"] for i in range(len(columns))],
         "std": [row[f"s{i}"] for i in range(len(columns))]},
        index=list(columns), dtype="float64",
    )
    out.attrs["rows"] = row["rows"]
    return out


def tile_sums(x: np.ndarray, i: slice, j: slice, complete: bool) -> list[np.ndarray]:
    """n, sums of x and y, of their squares, and of their products, over the rows where both are known."""
    if complete:
        a, b = x[:, i], x[:, j]
        return [np.full((1, 1), float(len(x))), a.sum(axis=0)[:, None], b.sum(axis=0)[None, :], (a * a).sum(axis=0)[:, None], (b * b).sum(axis=0)[None, :], a.T @ b]
    known = ~np.isnan(x)
    m, n = known[:, i].astype(float), known[:, j].astype(float)
    a, b = np.where(known[:, i], x[:, i], 0.0), np.where(known[:, j], x[:, j], 0.0)
    return [m.T @ n, a.T @ n, m.T @ b, (a * a).T @ n, m.T @ (b * b), a.T @ b]


def correlations(sums: Sequence[np.ndarray]) -> np.ndarray:
    """Correlations of a tile, NaN where undefined."""
    n, x, y, xx, yy, xy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (xy - x * y / n) / (np.sqrt(np.clip(xx - x * x / n, 0, None)) * np.sqrt(np.clip(yy - y * y / n, 0, None)))
    return np.clip(np.where((n >= 2) & np.isfinite(r), r, np.nan), -1.0, 1.0)


def correlation_pairs(df: DataFrame, columns: Sequence[str], moments: pd.DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(i, j, f1, f2, r) for all i < j with a defined, pairwise-complete Pearson correlation."""
    moments = column_moments(df, columns) if moments is None else moments
    names, p = list(columns), len(columns)
    complete = bool((moments.loc[names, "n"] == moments.attrs["rows"]).all())
    # Correlation does not change with a shift; centred values keep the sums accurate.
    centred = [S.to_number(c) - F.lit(float(np.nan_to_num(moments.loc[c, "mean"]))) for c in names]
    blocks = [slice(at, min(p, at + tile)) for at in range(0, p, tile)]
    chunk = max(1, CHUNK_CELLS // max(1, p))
    chunks = math.ceil(moments.attrs["rows"] / chunk)
    salts = 1 if chunks <= CHUNKS_PER_TASK else math.ceil(math.sqrt(chunks))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, 0
        for batch in [*batches, None] if p else []:
            if batch is not None:
                held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p))
                count += batch.num_rows
            if count and (batch is None or count >= chunk):
                x = np.concatenate(held)
                held, count, number = [], 0, number + 1
                for k, i in enumerate(blocks):
                    for n, j in enumerate(blocks[k:], start=k):
                        raw = b"".join(v.tobytes() for v in tile_sums(x, i, j, complete))
                        yield pa.RecordBatch.from_pydict({"bi": pa.array([k], pa.int32()), "bj": pa.array([n], pa.int32()), "sums": pa.array([raw], pa.binary())})

    def opened(bi: int, bj: int, raw: np.ndarray) -> list[np.ndarray]:
        m, n = (blocks[b].stop - blocks[b].start for b in (bi, bj))
        shapes = [(1, 1), (m, 1), (1, n), (m, 1), (1, n), (m, n)] if complete else [(m, n)] * 6
        ends = np.cumsum([a * b for a, b in shapes])
        return [part.reshape(shape) for part, shape in zip(np.split(raw, ends[:-1]), shapes)]

    def added(tiles: pa.Table) -> np.ndarray:
        total = 0.0
        for raw in tiles["sums"]:
            total = total + np.frombuffer(raw.as_buffer())
        return total

    def add(tiles: pa.Table) -> pa.Table:
        return pa.table({"bi": tiles["bi"].slice(0, 1), "bj": tiles["bj"].slice(0, 1), "sums": pa.array([added(tiles).tobytes()], pa.binary())})

    def lay_out(tiles: pa.Table) -> pa.Table:
        bi, bj = tiles["bi"][0].as_py(), tiles["bj"][0].as_py()
        r = correlations(opened(bi, bj, added(tiles)))
        i, j = np.nonzero(np.isfinite(r))
        value = r[i, j]
        i, j = i + blocks[bi].start, j + blocks[bj].start
        ordered = i < j
        i, j, value = i[ordered], j[ordered], value[ordered]
        labels = pa.array(names, pa.string())
        return pa.table({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "f1": labels.take(pa.array(i)), "f2": labels.take(pa.array(j)), "r": pa.array(value)})

    rows = df.select(F.array(*centred).cast("array<double>").alias("x"))
    kind = "bi int, bj int, sums binary"
    tiles = rows.mapInArrow(multiply, kind)
    if salts > 1:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
        tiles = tiles.withColumn("salt", salt).groupBy("bi", "bj", "salt").applyInArrow(lambda t: add(t), kind)
    return tiles.groupBy("bi", "bj").applyInArrow(lay_out, "i int, j int, f1 string, f2 string, r double")


def strong_pairs(pairs: DataFrame, low: float = 0.5, high: float = 1.0) -> DataFrame:
    size = F.abs("r")
    return pairs.where((size > low) & (size < high)).orderBy(F.desc("r"), "f1", "f2")


def top_pairs(pairs: DataFrame, threshold: float, n: int = 20) -> DataFrame:
    """Preview of the strongest pairs above the threshold."""
    size = F.abs("r")
    return pairs.where(size > threshold).select(
        F.col("f1").alias("feature_a"), F.col("f2").alias("feature_b"), size.alias("abs_correlation")
    ).orderBy(F.desc("abs_correlation"), "feature_a", "feature_b").limit(n)


def drop_table(pairs: DataFrame, threshold: float | Column, group: str = "expression", by: Sequence[str] = ()) -> DataFrame:
    """One pass: a feature is dropped if any earlier one, itself dropped or not, correlates above the threshold.

    The anchor is the strongest earlier feature, the first of them on a tie; correlations that agree to 12 digits tie.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    size = F.abs("r")
    best = F.max(F.struct(F.round(size, 12).alias("s"), (-F.col("i")).alias("k"), F.col("f1").alias("f"))).alias("_b")
    hits = pairs.withColumn("threshold", limit).where(size > F.col("threshold"))
    return hits.groupBy(*by, "threshold", F.col("f2").alias("feature_dropped")).agg(best).select(
        *by, F.lit(group).alias("group"), "feature_dropped", F.col("_b.f").alias("anchor_feature"),
        F.col("_b.s").alias("abs_correlation"), "threshold", F.lit("full_correlation_matrix").alias("method"),
    )


def sweep(pairs: DataFrame, thresholds: Sequence[float], n_features: int) -> DataFrame:
    """Pairs above, dropped and kept features for each threshold, from one pair table."""
    size = F.abs("r")
    levels = F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    rows = pairs.withColumn("threshold", levels).withColumn("hit", size > F.col("threshold"))
    per_feature = rows.groupBy("threshold", "f2").agg(F.count_if("hit").alias("n"))
    return per_feature.groupBy("threshold").agg(
        F.sum("n").alias("n_pairs_above_threshold"), F.count_if(F.col("n") > 0).alias("n_dropped")
    ).withColumn("n_kept", F.lit(n_features) - F.col("n_dropped"))


def greedy_drops(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(j): the columns that the greedy rule drops, given strong pairs (i, j), i < j: one with a kept earlier partner.

    In each round the columns without an earlier partner left are kept, and all their partners are dropped with their own
    pairs. When few pairs are left, one task takes the columns in turn; the result is the same.
    """
    most = LOCAL_EDGES if local_edges is None else local_edges

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners: dict[int, list[int]] = {}
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                partners.setdefault(j, []).append(i)
        gone: set[int] = set()
        for j in sorted(partners):
            if any(i not in gone for i in partners[j]):
                gone.add(j)
        yield pa.RecordBatch.from_pydict({"j": pa.array(sorted(gone), pa.int32())})

    left = cut_lineage(edges.select("i", "j"))
    rounds = []
    while left.count() > most:
        heads = left.select("i").distinct().join(left.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        gone = cut_lineage(left.join(heads, "i", "left_semi").select("j").distinct())
        rounds.append(gone)
        left = left.join(gone, "j", "left_anti").join(gone.select(F.col("j").alias("i")), "i", "left_anti")
        left = cut_lineage(left.select("i", "j"))
    dropped = left.coalesce(1).mapInArrow(in_turn, "j int")
    for gone in rounds:
        dropped = dropped.unionByName(gone)
    return dropped


def _greedy_table(df: DataFrame, columns: Sequence[str], threshold: float, group: str, tile: int) -> DataFrame:
    """Greedy filter against kept columns only; missing values filled with medians."""
    medians = column_quantiles(df, columns, {"m": 0.5})
    filled = df.select(*[F.coalesce(S.to_number(c), F.lit(float(medians[c]["m"] or 0.0))).alias(c) for c in columns])
    edges = cut_lineage(correlation_pairs(filled, columns, tile=tile).where(F.abs("r") > threshold))
    dropped = cut_lineage(greedy_drops(edges))
    against_kept = edges.join(dropped, "j", "left_semi").join(dropped.select(F.col("j").alias("i")), "i", "left_anti")
    return drop_table(against_kept, threshold, group).withColumn("method", F.lit("incremental_against_kept"))


def drop_collinear(
    df: DataFrame, columns: Sequence[str], threshold: float, group: str = "expression",
    method: str = "full", tile: int = TILE,
) -> tuple[list[str], DataFrame, dict]:
    """Collinearity filter with its screens: returns kept columns, drop table and summary.

    ``method`` names the rule and holds at any width: "full" drops a column that correlates with any earlier one (missing
    values left out pair by pair), "incremental" one that correlates with an earlier column that was kept (missing
    values filled with medians). The two keep different columns. Columns with fewer than two values or hardly any spread are not evaluated and stay.
    """
    spark = df.sparkSession
    moments = column_moments(df, columns) if columns else None
    sparse = [c for c in columns if moments.loc[c, "n"] < 2]
    flat = [c for c in columns if c not in sparse and not (moments.loc[c, "std"] >= TINY)]
    evaluated = [c for c in columns if c not in sparse and c not in flat]
    summary = {
        "group": group, "threshold": float(threshold), "input_feature_count": len(columns),
        "numeric_evaluated_count": len(evaluated), "skipped_non_numeric_or_too_sparse": sparse,
        "skipped_constant_or_near_constant": flat,
    }
    pairs_above = None
    if len(evaluated) < 2:
        rows: list[tuple] = []
        name = "none" if not columns else "insufficient_numeric_features"
    elif method == "full":
        strong = cut_lineage(correlation_pairs(df, evaluated, moments, tile).where(F.abs("r") > threshold))
        rows = [tuple(r) for r in drop_table(strong, threshold, group).collect()]  # one row per dropped feature
        pairs_above = strong.count()
        name = "full_correlation_matrix"
    elif method != "incremental":
        raise ValueError(f"unknown method {method}")
    else:
        rows = [tuple(r) for r in _greedy_table(df, evaluated, threshold, group, tile).collect()]  # one row per dropped feature
        name = "incremental_against_kept"
    dropped = {r[1] for r in rows}
    kept = [c for c in columns if c not in dropped]
    summary.update(
        dropped_count=len(dropped), kept_count=len(kept), dropped_features=sorted(dropped), method=name,
        n_pairs_above_threshold=pairs_above,
    )
    table = spark.createDataFrame(rows, DROP_SCHEMA).orderBy("group", F.desc("abs_correlation"), "feature_dropped")
    return kept, table, summary


def filter_train_features(
    train: DataFrame, clinical: Sequence[str], expression: Sequence[str], threshold: float = 0.75
) -> tuple[list[str], list[str], DataFrame, dict]:
    """Fit the filter on training rows only, for expression columns and for clinical columns that hold numbers."""
    known = column_moments(train, clinical) if clinical else None
    numeric = [c for c in clinical if known.loc[c, "n"] >= 2]
    kept_expr, expr_table, expr_summary = drop_collinear(train, expression, threshold, "expression")
    kept_num, clin_table, clin_summary = drop_collinear(train, numeric, threshold, "clinical_numeric")
    gone = set(numeric) - set(kept_num)
    kept_clin = [c for c in clinical if c not in gone]
    table = expr_table.unionByName(clin_table).orderBy("group", F.desc("abs_correlation"), "feature_dropped")
    summary = {
        "threshold_abs_pearson": float(threshold), "fit_reference": "train_split_only",
        "expression": expr_summary, "clinical_numeric": clin_summary,
        "clinical_non_numeric_or_sparse_kept_as_is": [c for c in clinical if c not in numeric],
        "feature_counts": {
            "expr_before": len(expression), "expr_after": len(kept_expr),
            "clinical_before": len(clinical), "clinical_after": len(kept_clin),
        },
    }
    return kept_clin, kept_expr, table, summary
