"""From a patient table to a tuned, calibrated model with its report tables, and the collinearity sweep over it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators import clean, cohort, collinearity, conformal, cox, cox_folds, features, splits
from hazardframe.operators.concordance import concordance
from hazardframe.plans import tuning
from hazardframe.schema import CLINICAL_COVARIATES, EXPR, SWEEP_THRESHOLDS, TARGET_COLUMNS
from hazardframe.session import cut_lineage, kept
from hazardframe.sources.readers import path_exists


@dataclass
class ModelRun:
    """Tables and numbers of one run."""

    predictions: DataFrame
    coefficients: DataFrame
    grid: DataFrame | None
    dropped: DataFrame | None
    horizon_metrics: DataFrame | None
    horizon_classification: DataFrame | None
    horizon_predictions: DataFrame | None
    fit: cox.Fit
    metrics: dict
    layout: features.Layout
    space: features.FeatureSpace
    interval: conformal.IntervalResult
    calibrators: dict


def prepare_rows(df: DataFrame, outliers: bool = True) -> tuple[DataFrame, dict]:
    """Usable rows without outliers, split in three; the table is written once because every later step reads it."""
    rows = cohort.strict_endpoint(df)
    before = rows.count()
    rules: list[dict] = []
    if outliers:
        rows, rules = clean.iqr_filter(rows)
    split = cut_lineage(splits.three_way_split(rows, "PATIENT_ID", ["OS_EVENT"]))
    report = splits.split_report(split)
    splits.require_both_classes(report)
    after = split.count()
    audit = {
        "outliers": {"initial_rows": before, "final_rows": after, "total_removed": before - after, "iqr_multiplier": 3.0, "rules": rules},
        "splits": {r["split"]: r.asDict() for r in report.collect()},  # three rows
    }
    return split, audit


def train_and_calibrate(
    rows: DataFrame, clinical: Sequence[str] = tuple(CLINICAL_COVARIATES), expression: Sequence[str] | None = None,
    threshold: float | None = 0.75, penalty: tuple[float, float] | None = None, interval: str = "isotonic",
    cqr_rounds: int = 200, maxiter: int = 400, horizon_tables: bool = True, pick: tuple[list[str], list[str], DataFrame, dict] | None = None,
) -> ModelRun:
    """Collinearity filter, leakage guard, penalty search, final fit, scores, intervals and horizons.

    ``rows`` carry a ``split`` column. ``penalty`` (alpha, l1_ratio) skips the search; ``interval`` is isotonic or cqr.
    """
    clinical = [c for c in clinical if c in rows.columns]
    expression = clean.prefixed_columns(rows, EXPR, ordered=True) if expression is None else list(expression)
    train = rows.where(F.col("split") == "train")
    dropped, summary = None, {}
    if pick is None and threshold is not None:
        pick = collinearity.filter_train_features(train, clinical, expression, threshold)
    if pick is not None:
        clinical, expression, dropped, summary = pick
    clean.check_leakage([*clinical, *expression], TARGET_COLUMNS)

    grid = None
    if penalty is None:
        grid = tuning.cross_validate(train, clinical, expression, maxiter=maxiter)
        best = tuning.select_best(grid).first()
        if best is None:
            raise ValueError("no viable penalty in the grid")
        penalty = (best["alpha"], best["l1_ratio"])
    layout = features.discover_layout(train, clinical, expression=expression)
    blocks = cox_folds.raw_blocks(train.withColumn("fold", F.lit(0)), layout.columns, "fold", 1, "OS_MONTHS", "OS_EVENT")
    spaces = features.fit_spaces(train, layout, parts=blocks.grams)
    space = spaces[features.ALL]
    with kept(features.with_features(rows, layout, spaces)) as design:
        if blocks.times is None:
            group, data = 0, cox.cox_data(design.where(F.col("split") == "train"), width=len(space.names))
        else:
            group, data = features.ALL, cox_folds.FoldData(blocks, {features.ALL: (space.weights, space.offset)})
        try:
            fit = cox.fit_models(data, [cox.Problem(group, *penalty, label="final")], maxiter)[0]
        finally:
            data.close()
        columns = ["PATIENT_ID", "OS_MONTHS", "OS_EVENT", "split", "features"]
        scored = design.select(*columns, S.dot("features", fit.coef.tolist()).alias("risk"))
        found = {r["split"]: r["c_index"] for r in concordance(scored, keys=["split"]).collect()}  # three rows
        if interval == "cqr":
            result = conformal.cqr_interval(scored, rounds=cqr_rounds)
        else:
            result = conformal.month_interval(scored)
        predictions = cut_lineage(result.predictions.select(
            "split", "PATIENT_ID", "OS_MONTHS", "OS_EVENT", F.col("risk").alias("risk_score"), "pred_survival_lo_months_90",
            "pred_survival_hi_months_90",
        ))
        horizon = None
        if horizon_tables:
            horizon = conformal.horizon_conformal(cut_lineage(scored.drop("features")), higher_rule=interval != "cqr")
    test = predictions.where(F.col("split") == "test")
    report = conformal.coverage_report(
        test, "pred_survival_lo_months_90", "pred_survival_hi_months_90", "OS_MONTHS", F.col("OS_EVENT") == 1
    ).collect()  # two rows
    covered = {r["rows_of"]: r for r in report}
    metrics = {
        "alpha": penalty[0], "l1_ratio": penalty[1], "n_iter": fit.n_iter, "converged": fit.converged,
        **{f"c_index_{s}": found.get(s) for s in ("train", "calibration", "test")},
        f"{'cqr' if interval == 'cqr' else 'conformal'}_month_interval": {
            "status": result.status, "qhat": result.qhat,
            "coverage_test_events_only": covered["events"]["coverage"] if "events" in covered else None,
            "mean_interval_width_months_test": covered["all"]["mean_width"] if "all" in covered else None,
            "median_interval_width_months_test": covered["all"]["median_width"] if "all" in covered else None, **result.details,
        },
        "feature_checks": space.checks, "collinearity": summary,
    }
    coefficients = cox.coefficient_table(rows, [fit], space.names)
    return ModelRun(
        predictions, coefficients, grid, dropped, horizon and horizon.metrics, horizon and horizon.classification,
        horizon and horizon.predictions, fit, metrics, layout, space, result, horizon.calibrators if horizon else {},
    )


SWEEP_SCHEMA = (
    "threshold double, expr_before int, expr_after int, expr_dropped int, clinical_before int, clinical_after int, clinical_dropped int, "
    "collinearity_pairs_above_threshold bigint, c_index_train double, c_index_calibration double, c_index_test double, "
    "coverage_test_events_only double, mean_interval_width_months_test double, status string, error string"
)


def _strong_pairs(train: DataFrame, columns: Sequence[str], low: float) -> DataFrame:
    """Pairs of columns that hold numbers with some spread, above the lowest threshold; written once for all of them."""
    moments = collinearity.column_moments(train, columns) if columns else None
    usable = [c for c in columns if moments.loc[c, "n"] >= 2 and moments.loc[c, "std"] >= collinearity.TINY]
    if len(usable) < 2:
        return train.sparkSession.createDataFrame([], "i int, j int, f1 string, f2 string, r double")
    return cut_lineage(collinearity.correlation_pairs(train, usable, moments).where(F.abs("r") > low))


def _dropped_above(strong: DataFrame, threshold: float) -> dict[str, int]:
    """Columns with an earlier partner above the threshold, and the number of those."""
    found = strong.where(F.abs("r") > threshold).groupBy("f2").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each dropped column
    return {r["f2"]: r["n"] for r in found}


def sweep_branches(
    spark: SparkSession, thresholds: Sequence[float], run: Callable[[float], dict], folder: str | None = None, rerun: bool = False,
) -> DataFrame:
    """One row for each threshold, whatever becomes of its run: an error is a row with status ``failed`` and its text while
    the others go on. With ``folder`` a finished row is kept there, and read back as ``skipped_existing`` on the next call
    unless ``rerun`` is set; failed ones are tried again."""
    names = [f.split(" ")[0] for f in SWEEP_SCHEMA.split(", ")]
    rows = []
    for threshold in thresholds:
        path = folder and f"{folder}/threshold-{threshold:g}"
        if path and not rerun and path_exists(spark, f"{path}/_SUCCESS"):
            rows.append(spark.read.parquet(path).first().asDict() | {"status": "skipped_existing"})
            continue
        row = dict.fromkeys(names) | {"threshold": float(threshold), "status": "completed", "error": ""}
        try:
            row |= run(threshold)
        except Exception as error:  # one branch must not take the others with it
            row |= {"status": "failed", "error": f"{type(error).__name__}: {error}"[:2_000]}
        else:
            if path:
                spark.createDataFrame([tuple(row[n] for n in names)], SWEEP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
        rows.append(row)
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SWEEP_SCHEMA)
    done = against_baseline(table)
    left = table.join(done.select("threshold"), "threshold", "left_anti")
    return done.unionByName(left, allowMissingColumns=True).orderBy(F.desc("threshold"))


def threshold_sweep(
    rows: DataFrame, clinical: Sequence[str] = tuple(CLINICAL_COVARIATES), thresholds: Sequence[float] = tuple(SWEEP_THRESHOLDS),
    penalty: tuple[float, float] | None = (3.0, 0.7), maxiter: int = 400, folder: str | None = None, rerun: bool = False,
) -> DataFrame:
    """One model run per collinearity threshold, side by side with the run at the largest threshold; see ``sweep_branches``.

    Expression columns and clinical columns that hold numbers are filtered. The correlations of the training rows are
    computed once; every threshold only filters their pairs. Thresholds that leave the same columns share a run.
    """
    clinical = [c for c in clinical if c in rows.columns]
    expression = clean.prefixed_columns(rows, EXPR, ordered=True)
    train = rows.where(F.col("split") == "train")
    strong, strong_clinical = (_strong_pairs(train, c, min(thresholds)) for c in (expression, clinical))
    done: dict[tuple[str, ...], dict] = {}  # metrics by the columns left; a failed run is tried again

    def run(threshold: float) -> dict:
        gone, gone_clinical = _dropped_above(strong, threshold), _dropped_above(strong_clinical, threshold)
        left, left_clinical = [c for c in expression if c not in gone], [c for c in clinical if c not in gone_clinical]
        columns = (*left_clinical, *left)
        if columns not in done:
            done[columns] = train_and_calibrate(rows, left_clinical, left, threshold=None, penalty=penalty, maxiter=maxiter, horizon_tables=False).metrics
        found = done[columns]
        month = found["conformal_month_interval"]
        return {
            "expr_before": len(expression), "expr_after": len(left), "expr_dropped": len(gone),
            "clinical_before": len(clinical), "clinical_after": len(left_clinical), "clinical_dropped": len(gone_clinical),
            "collinearity_pairs_above_threshold": sum(gone.values()), **{f"c_index_{s}": found[f"c_index_{s}"] for s in ("train", "calibration", "test")},
            **{k: month[k] for k in ("coverage_test_events_only", "mean_interval_width_months_test")},
        }

    return sweep_branches(rows.sparkSession, thresholds, run, folder, rerun)


def against_baseline(runs: DataFrame) -> DataFrame:
    """Changes of each completed run from the one with the largest threshold (the runs are a handful of rows)."""
    done = runs.where(F.col("status").isin("completed", "skipped_existing") & F.col("c_index_test").isNotNull())
    values = {"test_c_index": "c_index_test", "coverage": "coverage_test_events_only", "width": "mean_interval_width_months_test"}
    base = done.orderBy(F.desc("threshold")).limit(1).select(*[F.col(c).alias(f"_{k}") for k, c in values.items()])
    joined = done.withColumn("_one", F.lit(1)).join(base.withColumn("_one", F.lit(1)), "_one")
    deltas = {f"delta_{k}_vs_no_drop": F.col(c) - F.col(f"_{k}") for k, c in values.items()}
    return joined.withColumns(deltas).drop("_one", *[f"_{k}" for k in values])


def best_runs(runs: DataFrame) -> DataFrame:
    """The run with the best test concordance and the one with the narrowest intervals."""
    best = runs.orderBy(F.desc_nulls_last("c_index_test"), F.desc("threshold")).limit(1).withColumn("best_by", F.lit("c_index_test"))
    tight = runs.orderBy(F.asc_nulls_last("mean_interval_width_months_test"), F.desc("threshold")).limit(1)
    return best.unionByName(tight.withColumn("best_by", F.lit("mean_interval_width_months_test")))
