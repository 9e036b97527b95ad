"""Feature blocks of the survival models, fitted for all folds from additive sums.

Every row becomes one raw vector: numbers (missing as 0) with missing-flags, one-hot flags with a missing-flag per
category column, and omic values (missing as 0). Median and mode imputation, scaling, PCA and the final scaling are
then one affine map per training set. Its statistics come from the Gram matrix of the raw vectors, which adds up over
folds: the matrix of "all folds but g" is a sum of per-fold matrices, so fitting k folds reads the data once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hazardframe.functions import scalars as S
from hazardframe.operators import profile
from hazardframe.operators.collinearity import gram_matrix
from hazardframe.operators.ordered import exact_medians, leave_out_medians

ALL = -1  # the training set that leaves no fold out


@dataclass
class Layout:
    """What each position of the raw vector holds."""

    numeric: list[tuple[str, str]]  # (block, column)
    categorical: list[tuple[str, list[str]]]
    omics: dict[str, list[str]]
    columns: list[Column] = field(default_factory=list)

    def __post_init__(self):
        for _, c in self.numeric:
            x = S.to_number(c) if c not in self.flags else F.col(c).cast("double")
            self.columns += [F.coalesce(x, F.lit(0.0)), F.when(x.isNull(), 1.0).otherwise(0.0)]
        for c, levels in self.categorical:
            text = F.col(c).cast("string")
            self.columns += [F.when(text == v, 1.0).otherwise(0.0) for v in levels]
            self.columns.append(F.when(text.isNull(), 1.0).otherwise(0.0))
        for names in self.omics.values():
            self.columns += [F.coalesce(S.to_number(f"`{c}`"), F.lit(0.0)) for c in names]

    flags: frozenset[str] = frozenset()

    @property
    def width(self) -> int:
        return len(self.columns)


@dataclass
class FeatureSpace:
    """The affine map raw -> features of one training set."""

    weights: np.ndarray
    offset: np.ndarray
    names: list[str]
    blocks: list[str]
    checks: dict
    sources: list[str] = field(default_factory=list)  # the column behind each feature; empty for omic components


def discover_layout(
    df: DataFrame, clinical: Sequence[str] = (), mutation: Sequence[str] = (), expression: Sequence[str] = (), cna: Sequence[str] = ()
) -> Layout:
    """Sort columns into blocks; the levels of category columns are read from the data."""
    present = [c for c in clinical if c in df.columns]
    numeric = set(profile.numeric_columns(df.select(*present))) if present else set()
    flags = frozenset(f.name for f in df.schema if isinstance(f.dataType, T.BooleanType))
    texts = [c for c in present if c not in numeric]
    levels: dict[str, list[str]] = {c: [] for c in texts}
    if texts:
        cells = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in texts]
        found = df.select(F.explode(F.array(*cells)).alias("z")).select("z.*").where("v is not null").distinct().collect()
        for r in found:  # one row per category level
            levels[r["c"]].append(r["v"])
    numbers = [("clinical", c) for c in present if c in numeric] + [("mutation", c) for c in mutation if c in df.columns]
    omics = {k: list(v) for k, v in (("expression", expression), ("cna", cna)) if v}
    return Layout(numbers, [(c, sorted(levels[c])) for c in texts], omics, flags=flags)


def _space(layout: Layout, gram: np.ndarray, medians: dict[str, float], components: int, spare_one: bool) -> FeatureSpace:
    n = gram[0, 0]
    mean, second = gram[0, 1:] / n, np.diag(gram)[1:] / n
    p = layout.width
    columns, offsets, names, blocks, sources = [], [], [], [], []

    def add(vector: np.ndarray, constant: float, m: float, sd: float, name: str, block: str, source: str = "") -> None:
        """A feature raw @ vector + constant, standardised; one without spread carries no weight."""
        scale = 1.0 / sd if sd > 1e-12 else 0.0
        columns.append(vector * scale)
        offsets.append((constant - m) * scale)
        names.append(name)
        blocks.append(block)
        sources.append(source)

    at = 0
    for block, c in layout.numeric:
        fill = medians.get(c) or 0.0
        vector = np.zeros(p)
        vector[at], vector[at + 1] = 1.0, fill
        m = mean[at] + mean[at + 1] * fill
        sd = np.sqrt(max(0.0, second[at] + mean[at + 1] * fill * fill - m * m))
        add(vector, 0.0, m, sd, c, block, c)
        at += 2
    for c, values in layout.categorical:
        missing = at + len(values)
        mode = at + int(np.argmax(mean[at:missing])) if values else missing
        for k, v in enumerate(values):
            vector = np.zeros(p)
            vector[at + k] = 1.0
            if at + k == mode:
                vector[missing] = 1.0
            m = vector @ mean
            add(vector, 0.0, m, np.sqrt(max(0.0, m - m * m)), f"{c}={v}", "clinical", c)
        at = missing + 1
    kept_components = {}
    for block, columns_of in layout.omics.items():
        q = len(columns_of)
        where = slice(at, at + q)
        m = mean[where]
        cov = gram[1:, 1:][where, where] / n - np.outer(m, m)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        scale = np.where(sd > 1e-12, 1.0 / np.where(sd > 1e-12, sd, 1.0), 0.0)
        values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
        k = int(max(0, min(components, n - 1 if spare_one else n, q)))
        kept_components[block] = k
        for i in range(k):
            vector = np.zeros(p)
            vector[where] = vectors[:, q - 1 - i] * scale
            add(vector, 0.0, float(vector[where] @ m), float(np.sqrt(max(0.0, values[q - 1 - i]))), f"{block}_pc{i + 1}", block)
        at += q
    weights = np.column_stack(columns) if columns else np.zeros((p, 0))
    if not np.isfinite(weights).all():
        raise ValueError("non-finite values after scaling")
    offset = np.asarray(offsets)
    # What scaling made of the training columns, from the same sums.
    centre = mean @ weights + offset
    spread = np.sqrt(np.clip(np.einsum("ij,ik,kj->j", weights, gram[1:, 1:] / n - np.outer(mean, mean), weights), 0, None))
    checks = {
        "final_dim": len(names),
        "final_train_mean_abs_max": float(np.abs(centre).max(initial=0.0)),
        "final_train_std_min": float(spread.min(initial=np.inf)),
        "final_train_std_max": float(spread.max(initial=0.0)),
        "final_constant_feature_count": int((spread < 1e-12).sum()),
        **{f"{b}_components": k for b, k in kept_components.items()},
    }
    return FeatureSpace(weights, offset, names, blocks, checks, sources)


def fit_spaces(
    df: DataFrame, layout: Layout, fold: str | None = None, folds: int = 1, components: int = 50, spare_one: bool = False,
    parts: dict[int, np.ndarray] | None = None,
) -> dict[int, FeatureSpace]:
    """Feature space of each "all folds but g"; without a fold column, one space under the key ``ALL``.

    Only matrices over columns reach the driver. ``parts`` are the Gram matrices of (1, raw vector) by fold, if known.
    """
    vector = [F.lit(1.0), *layout.columns]
    groups = [ALL] if fold is None else list(range(folds))
    if fold is None:
        grams = {ALL: gram_matrix(df, vector) if parts is None else sum(parts.values())}
    else:
        parts = parts or {g: gram_matrix(df.where(F.col(fold) == g), vector) for g in groups}
        whole = sum(parts.values())
        grams = {g: whole - parts[g] for g in groups}
    names = [c for _, c in layout.numeric]
    medians: dict[int, dict[str, float]] = {g: {} for g in groups}
    if names:
        typed = df.select(
            *([fold] if fold else []), *[F.col(c).cast("double").alias(c) if c in layout.flags else S.to_number(c).alias(c) for c in names]
        )
        if fold is None:
            rows = exact_medians(typed, names).withColumn("g", F.lit(ALL))
        else:
            rows = leave_out_medians(typed, names, fold, groups)
        for r in rows.collect():  # one row per training set and column
            medians[r["g"]][r["feature"]] = r["median"]
    return {g: _space(layout, grams[g], medians[g], components, spare_one) for g in groups}


def with_features(df: DataFrame, layout: Layout, spaces: dict[int, FeatureSpace], group: str | None = None, name: str = "features") -> DataFrame:
    """Add the feature array; ``group`` names the column that tells which space a row uses."""
    maps = {g: (s.weights, s.offset) for g, s in spaces.items()}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(g: pd.Series, raw: pd.Series) -> pd.Series:
        out = np.empty(len(g), dtype=object)
        values, which = np.stack(raw.to_numpy()), g.to_numpy()
        for k in np.unique(which):
            at = np.flatnonzero(which == k)
            weights, offset = maps[int(k)]
            out[at] = list(values[at] @ weights + offset)
        return pd.Series(out)

    chosen = F.col(group) if group else F.lit(next(iter(spaces)))
    return df.withColumn(name, apply(chosen, F.array(*layout.columns)))


def training_rows(df: DataFrame, layout: Layout, spaces: dict[int, FeatureSpace], fold: str = "fold") -> DataFrame:
    """Each row once for every training set it belongs to, with that set's features; the set is column ``g``."""
    groups = F.filter(F.array(*[F.lit(g) for g in sorted(spaces)]), lambda g: g != F.col(fold))
    return with_features(df.withColumn("g", F.explode(groups)), layout, spaces, "g")


def held_out_rows(df: DataFrame, layout: Layout, spaces: dict[int, FeatureSpace], fold: str = "fold") -> DataFrame:
    """Each row once, with the features of the training set that leaves it out."""
    return with_features(df.withColumn("g", F.col(fold)), layout, spaces, "g")
