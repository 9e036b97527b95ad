"""Cross-validation, feature-set ablation and scoring of Cox models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators import cox, cox_folds, features, splits
from hazardframe.operators.clean import drop_listed, prefixed_columns
from hazardframe.operators.concordance import concordances
from hazardframe.session import cut_lineage
from hazardframe.schema import (
    ALPHA_GRID, CLINICAL_COVARIATES, CNA, EXPR, FEATURE_BLOCKS, INTERVAL_COVARIATES, L1_GRID,
    LOW_VALUE_COLUMNS,
)


def score_models(
    df: DataFrame, fits: Sequence[cox.Fit], group: str = "g", spaces: dict[int, features.FeatureSpace] | None = None
) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Each row with ``risks``, the scores by all models of its group, in place of its features; and for each (group,
    position in risks) the model's place in ``fits``. With ``spaces`` the features are raw vectors."""
    by_group: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        by_group.setdefault(f.problem.group, []).append(i)
    weights = {g: np.column_stack([fits[i].coef for i in at]) for g, at in by_group.items()}
    shifts = {g: spaces[g].offset @ w if spaces else 0.0 for g, w in weights.items()}
    weights = {g: spaces[g].weights @ w if spaces else w for g, w in weights.items()}
    out = df.select(*[c for c in df.columns if c != "features"], F.lit(None).cast("array<double>").alias("risks")).schema
    at_group, at_features = df.columns.index(group), df.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(at_group).to_numpy()
            x = batch.column(at_features).flatten().to_numpy().reshape(batch.num_rows, -1)
            sizes = np.array([weights[k].shape[1] if k in weights else 0 for k in g.tolist()], np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            scores = np.empty(begin[-1])
            for k, w in weights.items():
                own = np.flatnonzero(g == k)
                scores[begin[own][:, None] + np.arange(w.shape[1])] = x[own] @ w + shifts[k]
            columns = [c for i, c in enumerate(batch.columns) if i != at_features]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(scores))], names=out.names)

    return df.mapInArrow(run, out), {(g, k): i for g, at in by_group.items() for k, i in enumerate(at)}


def _results(fits: Sequence[cox.Fit], indices: dict[int, float | None], strict: bool) -> pd.DataFrame:
    rows = []
    for i, f in enumerate(fits):
        value, note = indices.get(i), ""
        if f.error:
            value, note = None, f"fold_{f.problem.group + 1}:{f.error}"
        elif strict and not f.converged:
            value, note = None, f"fold_{f.problem.group + 1}:not_converged"
        elif value is None:
            note = f"fold_{f.problem.group + 1}:non_finite_ci"
        rows.append((f.problem.label, f.problem.alpha, f.problem.l1_ratio, f.problem.group, value, note))
    return pd.DataFrame(rows, columns=["label", "alpha", "l1_ratio", "fold", "c_index", "note"])


_FOLD_SCHEMA = "label string, alpha double, l1_ratio double, fold int, c_index double, note string"


def _fold_summary(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population std and text of the fold scores of each model (a handful of folds per model)."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "c_index", "note")))
    grouped = folds.groupBy(*keys).agg(
        F.count("c_index").cast("int").alias("n_valid_folds"), F.count_if(F.col("c_index").isNull()).cast("int").alias("n_failed_folds"),
        F.avg("c_index").alias("mean_c_index"), F.stddev_pop("c_index").alias("std_c_index"), ordered.alias("_f"),
    )
    scores = F.transform(F.filter("_f", lambda z: z["c_index"].isNotNull()), lambda z: z["c_index"])
    notes = F.transform(F.filter("_f", lambda z: z["note"] != ""), lambda z: z["note"])
    return grouped.withColumns({"fold_scores": S.join_scores(scores), "failure_notes": F.array_join(notes, "; ")}).drop("_f")


def _fold_data(
    folded: DataFrame, layout: features.Layout, k: int, components: int, spare_one: bool, columns: dict[str, str]
) -> tuple[dict[int, features.FeatureSpace], cox.CoxData | cox_folds.FoldData]:
    """Feature spaces of all training sets and the data of their models; ``folded`` is read several times."""
    blocks = cox_folds.raw_blocks(folded, layout.columns, "fold", k, **columns)
    spaces = features.fit_spaces(folded, layout, "fold", k, components, spare_one, blocks.grams)
    if blocks.times is not None:
        return spaces, cox_folds.FoldData(blocks, {g: (s.weights, s.offset) for g, s in spaces.items()})
    return spaces, cox.cox_data(features.training_rows(folded, layout, spaces), group="g", width=len(spaces[0].names), **columns)


def _held_out_scores(
    folded: DataFrame, layout: features.Layout, spaces: dict[int, features.FeatureSpace], fits: Sequence[cox.Fit], columns: Sequence[str]
) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    raw = folded.select(F.col("fold").alias("g"), *columns, F.array(*layout.columns).alias("features"))
    return score_models(raw, fits, spaces=spaces)


def cross_validate(
    df: DataFrame, clinical: Sequence[str], expression: Sequence[str], alphas: Sequence[float] = ALPHA_GRID,
    l1_ratios: Sequence[float] = L1_GRID, folds: int = 5, maxiter: int = 400, components: int = 50,
    id_column: str = "PATIENT_ID", time: str = "OS_MONTHS", event: str = "OS_EVENT",
) -> DataFrame:
    """The penalty grid under stratified folds: one row per (alpha, l1_ratio), best first.

    Features depend on the fold only and are fitted once per fold; all grid cells of all folds are optimised in step.
    """
    k = splits.fold_count(df, event, folds)
    folded = cut_lineage(splits.stratified_folds(df, id_column, [event], k))
    layout = features.discover_layout(folded, clinical, expression=expression)
    spaces, data = _fold_data(folded, layout, k, components, False, {"stop": time, "event": event})
    problems = [cox.Problem(g, a, r, label=f"{a}|{r}") for a in alphas for r in l1_ratios for g in range(k)]
    try:
        fits = cox.fit_models(data, problems, maxiter, strict=False)
    finally:
        data.close()
    scored, places = _held_out_scores(folded, layout, spaces, fits, [time, event])
    found = concordances(cut_lineage(scored), "risks", time, event, ["g"]).collect()  # one row per model and fold
    table = _results(fits, {places[r["g"], r["model"]]: r["c_index"] for r in found}, strict=True)
    summary = _fold_summary(df.sparkSession.createDataFrame(table, _FOLD_SCHEMA), ["alpha", "l1_ratio"])
    return summary.orderBy(F.desc("n_valid_folds"), F.desc_nulls_last("mean_c_index"), "std_c_index", "alpha", "l1_ratio")


def select_best(grid: DataFrame) -> DataFrame:
    """The best viable row of a grid: finite mean, at least two valid folds."""
    viable = grid.where(F.col("mean_c_index").isNotNull() & ~F.isnan("mean_c_index") & (F.col("n_valid_folds") >= 2))
    return viable.orderBy(F.desc("n_valid_folds"), F.desc("mean_c_index"), "std_c_index", "alpha", "l1_ratio").limit(1)


def _ablation_scores(folded: DataFrame, layout: features.Layout, k: int, maxiter: int, clip: float, cox_columns: dict, patient_level: bool,
                     time: str, event: str, alpha: float, components: int, without: Sequence[Sequence[str]] = ((),)) -> pd.DataFrame:
    """One row for each feature set, fold and entry of ``without``: label, fold, c_index, note, and ``variant``, the place in
    ``without``. A variant fits without the features made of the columns that it names; all of them advance together on
    one design, as every other feature depends on its own column only."""
    spaces, data = _fold_data(folded, layout, k, components, True, cox_columns)
    blocks, sources = spaces[0].blocks, spaces[0].sources
    problems, variants = [], []
    for name, wanted in FEATURE_BLOCKS.items():
        for v, gone in enumerate(without):
            active = tuple(b in wanted and s not in gone for b, s in zip(blocks, sources))
            if any(active):
                problems += [cox.Problem(g, alpha, 0.0, active, name) for g in range(k)]
                variants += [v] * k
    try:
        fits = cox.fit_models(data, problems, maxiter, clip, strict=False)
    finally:
        data.close()
    wanted = list(dict.fromkeys(["PATIENT_ID", *(["T_STOP"] if patient_level else []), time, event]))
    scored, places = _held_out_scores(folded, layout, spaces, fits, wanted)
    if patient_level:
        scored = scored.groupBy("PATIENT_ID", "g").agg(
            F.max_by("risks", "T_STOP").alias("risks"), F.max(time).alias(time), F.max(event).alias(event)
        )
    found = concordances(cut_lineage(scored), "risks", time, event, ["g"]).collect()  # one row per experiment and fold
    table = _results(fits, {places[r["g"], r["model"]]: r["c_index"] for r in found}, strict=False)
    return table.assign(variant=variants)


def _ablate(folded: DataFrame, *settings) -> DataFrame:
    table = _ablation_scores(folded, *settings).drop(columns="variant")
    summary = _fold_summary(folded.sparkSession.createDataFrame(table, _FOLD_SCHEMA), ["label"])
    return summary.select(
        F.col("label").alias("experiment"), "mean_c_index", "std_c_index", "fold_scores"
    ).orderBy(F.desc_nulls_last("mean_c_index"), "experiment")


def static_ablation(
    df: DataFrame, folds: int = 5, maxiter: int = 300, alpha: float = 1.0, components: int = 30,
    clinical: Sequence[str] = (*CLINICAL_COVARIATES, "IS_FALLBACK"),
) -> DataFrame:
    """Seven feature sets under folds stratified by cohort and event; mean and std of the concordance index."""
    folded = cut_lineage(splits.stratified_folds(df, "PATIENT_ID", ["CANCER_TYPE", "OS_EVENT"], folds))
    layout = features.discover_layout(
        folded, clinical, ["MUTATION_BURDEN"], prefixed_columns(df, EXPR), prefixed_columns(df, CNA)
    )
    return _ablate(folded, layout, folds, maxiter, 50.0, {"stop": "OS_MONTHS", "event": "OS_EVENT"}, False,
                   "OS_MONTHS", "OS_EVENT", alpha, components)


_INTERVAL_COLUMNS = {"stop": "T_STOP", "event": "EVENT", "start": "T_START"}


def _interval_layout(folded: DataFrame, covariates: Sequence[str]) -> features.Layout:
    return features.discover_layout(folded, covariates, ["MUTATION_BURDEN"], prefixed_columns(folded, EXPR), prefixed_columns(folded, CNA))


def _patient_folds(intervals: DataFrame, folds: int) -> DataFrame:
    """Intervals with the folds of their patients; both are written once, as intervals are read for the folds and again with them."""
    return cut_lineage(splits.group_folds(cut_lineage(intervals), "PATIENT_ID", ["CANCER_TYPE", "OS_EVENT"], folds))


def interval_ablation(intervals: DataFrame, folds: int = 5, maxiter: int = 250, alpha: float = 1.0, components: int = 30) -> DataFrame:
    """The same feature sets on (start, stop] rows; folds are drawn over patients, risk is that of the last interval."""
    folded = _patient_folds(intervals, folds)
    layout = _interval_layout(folded, INTERVAL_COVARIATES)
    return _ablate(folded, layout, folds, maxiter, 40.0, _INTERVAL_COLUMNS, True, "OS_DAYS", "OS_EVENT", alpha, components)


def rerun_counts(intervals: DataFrame, drop: Sequence[str] = tuple(LOW_VALUE_COLUMNS), folds: int = 5) -> DataFrame:
    """What a cleaned re-run works on, a row for each fold: rows, patients, patients with an event, columns before and after."""
    pruned, dropped, absent = drop_listed(intervals, drop)
    folded = splits.group_folds(intervals.select("PATIENT_ID", "CANCER_TYPE", "OS_EVENT"), "PATIENT_ID", ["CANCER_TYPE", "OS_EVENT"], folds)
    patients = folded.groupBy("fold", "PATIENT_ID").agg(F.count(F.lit(1)).alias("n"), F.max("OS_EVENT").alias("e"))
    counts = patients.groupBy("fold").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("patients"), F.sum(F.col("e").cast("bigint")).alias("events")
    )
    return counts.withColumns({
        "columns_before": F.lit(len(intervals.columns)), "columns_after": F.lit(len(pruned.columns)),
        "dropped": F.lit(",".join(dropped)), "absent": F.lit(",".join(absent)),
    })


def cleaned_rerun(
    intervals: DataFrame, drop: Sequence[str] = tuple(LOW_VALUE_COLUMNS), folds: int = 5, maxiter: int = 250, alpha: float = 1.0,
    components: int = 30, covariates: Sequence[str] = tuple(INTERVAL_COVARIATES),
) -> DataFrame:
    """The interval ablation with all columns and without those of ``drop``, under one set of patient folds: a row for each
    experiment and fold with both concordance indices and their difference; see ``paired_summary``.

    Without covariates the models of both runs are fitted together on one design. Where a column of the expression or
    copy-number blocks goes, their components change, so the cleaned run gets a design of its own, on the same folds. An
    experiment without a column left has no cleaned index.
    """
    pruned, dropped, _ = drop_listed(intervals, drop)
    rest = [maxiter, 40.0, _INTERVAL_COLUMNS, True, "OS_DAYS", "OS_EVENT", alpha, components]
    folded = _patient_folds(intervals, folds)
    layout = _interval_layout(folded, covariates)
    if any(c.startswith((EXPR, CNA)) for c in dropped):
        cleaned = folded.drop(*dropped)
        scores = pd.concat([
            _ablation_scores(folded, layout, folds, *rest),
            _ablation_scores(cleaned, _interval_layout(cleaned, covariates), folds, *rest).assign(variant=1),
        ])
    else:
        scores = _ablation_scores(folded, layout, folds, *rest, without=((), tuple(dropped)))
    return pair_folds(intervals.sparkSession.createDataFrame(scores, _FOLD_SCHEMA + ", variant int"))


def pair_folds(scores: DataFrame) -> DataFrame:
    """Scores of two runs on the same folds (label, fold, variant 0 or 1, c_index, note) as a row for each label and fold."""
    def of(variant: int, column: str):
        return F.max(F.when(F.col("variant") == variant, F.col(column)))

    paired = scores.groupBy(F.col("label").alias("experiment"), "fold").agg(
        of(0, "c_index").alias("c_index_old"), of(1, "c_index").alias("c_index_cleaned"),
        of(0, "note").alias("note_old"), F.coalesce(of(1, "note"), F.lit("no_columns_left")).alias("note_cleaned"),
    )
    return paired.withColumn("delta", F.col("c_index_cleaned") - F.col("c_index_old"))


def paired_summary(paired: DataFrame) -> DataFrame:
    """A row for each experiment: means of both runs over their own folds, and the differences over the folds valid in both."""
    grouped = paired.groupBy("experiment").agg(
        F.avg("c_index_old").alias("mean_c_index_old"), F.avg("c_index_cleaned").alias("mean_c_index_cleaned"),
        F.count("delta").alias("paired_folds"), F.avg("delta").alias("mean_paired_delta"), F.stddev_pop("delta").alias("std_paired_delta"),
        F.count_if(F.col("delta") > 0).alias("folds_better"), F.count_if(F.col("delta") < 0).alias("folds_worse"),
    )
    delta = F.col("mean_c_index_cleaned") - F.col("mean_c_index_old")
    return grouped.withColumn("delta_mean_c_index", delta).orderBy(F.desc_nulls_last("mean_c_index_cleaned"), "experiment")


def compare_runs(old: DataFrame, new: DataFrame, key: str = "experiment") -> DataFrame:
    """Results of two runs side by side, with the change of the mean concordance index."""
    values = [c for c in old.columns if c != key]
    left = old.withColumnsRenamed({c: f"{c}_old" for c in values})
    right = new.withColumnsRenamed({c: f"{c}_cleaned" for c in values})
    joined = left.join(right, key)
    return joined.withColumn("delta_mean_c_index", F.col("mean_c_index_cleaned") - F.col("mean_c_index_old")).orderBy(
        F.desc("mean_c_index_cleaned"), key
    )
