"""Conformal calibration: quantiles of scores, survival-time intervals, probability intervals at horizons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.operators import boosting, horizons
from hazardframe.operators.ordered import exact_quantiles, join_on, order_statistics
from hazardframe.schema import HORIZONS_MONTHS
from hazardframe.session import cut_lineage

ALPHA = 0.10
MIN_TRAIN_EVENTS, MIN_CALIBRATION_EVENTS = 20, 10


def _level(alpha: float) -> Column:
    n = F.col("_size").cast("double")
    return F.ceil((n + 1) * F.lit(1.0 - alpha)) / n


def higher_quantile(df: DataFrame, score: str = "score", alpha: float = ALPHA, keys: Sequence[str] = ()) -> DataFrame:
    """(n, qhat): the score at or above the corrected level, which is limited to 1."""
    level = F.least(_level(alpha), F.lit(1.0))
    # A position that is whole but for rounding noise must not move up one place.
    position = F.ceil(F.round(level * (F.col("_size") - 1), 9)).cast("double")
    return order_statistics(df, score, {"qhat": position}, keys).withColumnRenamed("_size", "n")


def interpolated_quantile(df: DataFrame, score: str = "score", alpha: float = ALPHA, keys: Sequence[str] = ()) -> DataFrame:
    """(n, qhat): linear between scores; +inf where the corrected level exceeds 1."""
    level = _level(alpha)
    position = F.when(level <= 1.0, level * (F.col("_size") - 1))
    found = order_statistics(df, score, {"qhat": position}, keys).withColumnRenamed("_size", "n")
    return found.withColumn("qhat", F.coalesce("qhat", F.lit(float("inf"))))


def score_audit(df: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    basic = df.groupBy(*keys).agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg(score).alias("score_mean"))
    spread = exact_quantiles(df, score, {"score_median": 0.5, "score_p90": 0.9}, keys)
    if keys:
        return join_on(basic, spread, keys)
    quantiles = spread.first()
    return basic.withColumns({c: F.lit(quantiles[c]) for c in ("score_median", "score_p90")})


def coverage_report(df: DataFrame, lo: str, hi: str, value: str, group: Column | None = None) -> DataFrame:
    """Coverage and width (mean, median), for all rows and for a subset of them (``group``), one row each."""
    width = F.col(hi) - F.col(lo)
    both = F.array(F.lit("all"), F.lit("events")) if group is None else F.when(group, F.array(F.lit("all"), F.lit("events"))).otherwise(F.array(F.lit("all")))
    rows = df.where(F.col(lo).isNotNull()).select(
        F.explode(both).alias("rows_of"), width.alias("width"), F.col(value).between(F.col(lo), F.col(hi)).cast("int").alias("inside")
    )
    basic = rows.groupBy("rows_of").agg(
        F.count(F.lit(1)).alias("n"), F.avg("inside").alias("coverage"), F.avg("width").alias("mean_width")
    )
    return basic.join(exact_quantiles(rows, "width", {"median_width": 0.5}, ["rows_of"]), "rows_of")


def fit_isotonic(df: DataFrame, x: str, y: str, increasing: bool, name: str) -> IsotonicRegressionModel:
    """Monotone calibration; rows that share a score are merged before the fit."""
    merged = df.groupBy(F.col(x).cast("double").alias("_x")).agg(F.avg(y).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", isotonic=increasing, predictionCol=name).fit(merged)


def apply_isotonic(model: IsotonicRegressionModel, df: DataFrame, x: str) -> DataFrame:
    """Linear between the steps, constant beyond the ends."""
    return model.transform(df.withColumn("_x", F.col(x).cast("double"))).drop("_x")


@dataclass
class IntervalResult:
    """Predictions with the two bound columns, the fitted quantile, a status, the fitted models, and the figures of a quantile
    run (see ``interval_details``)."""

    predictions: DataFrame
    qhat: float | None
    status: str
    models: list
    details: dict = field(default_factory=dict)


def _without_bounds(df: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("double")
    return df.withColumns({"pred_survival_lo_months_90": empty, "pred_survival_hi_months_90": empty})


def month_interval(
    scored: DataFrame, alpha: float = ALPHA, time: str = "OS_MONTHS", event: str = "OS_EVENT", risk: str = "risk",
    split: str = "split", split_calibration: bool = False, id_column: str = "PATIENT_ID",
) -> IntervalResult:
    """Survival-time interval from the risk score, calibrated on events in log months.

    By default the monotone map is fitted and scored on the same calibration rows; ``split_calibration`` uses half of
    them (by id hash) for each, which the coverage guarantee needs.
    """
    calibration = scored.where((F.col(split) == "calibration") & (F.col(event) == 1)).withColumn("_y", F.log1p(time))
    half = F.pmod(F.xxhash64(id_column), F.lit(2)) == 0
    fit_rows = calibration.where(half) if split_calibration else calibration
    score_rows = calibration.where(~half) if split_calibration else calibration
    if fit_rows.limit(2).count() < 2:
        return IntervalResult(_without_bounds(scored), None, "skipped_insufficient_calibration_events", [])
    model = fit_isotonic(fit_rows, risk, "_y", False, "_fit")
    residuals = apply_isotonic(model, score_rows, risk).select(F.abs(F.col("_y") - F.col("_fit")).alias("score"))
    qhat = higher_quantile(residuals, alpha=alpha).first()["qhat"]
    test = F.col(split) == "test"
    fitted = apply_isotonic(model, scored, risk)
    lo = F.greatest(F.expm1(F.col("_fit") - qhat), F.lit(0.0))
    hi = F.greatest(F.expm1(F.col("_fit") + qhat), F.lit(0.0))
    out = fitted.withColumns(
        {"pred_survival_lo_months_90": F.when(test, lo), "pred_survival_hi_months_90": F.when(test, hi)}
    ).drop("_fit")
    return IntervalResult(out, qhat, "ok", [model])


def cqr_interval(
    rows: DataFrame, alpha: float = ALPHA, time: str = "OS_MONTHS", event: str = "OS_EVENT", features: str = "features",
    split: str = "split", rounds: int = 200, swap_crossed: bool = True, min_train: int = MIN_TRAIN_EVENTS,
    min_calibration: int = MIN_CALIBRATION_EVENTS, **tree: float,
) -> IntervalResult:
    """Conformalised quantile regression on events in months; bounds for all test rows."""
    events = rows.where(F.col(event) == 1)
    counts = events.agg(
        F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "calibration").alias("cal")
    ).first()
    if counts["train"] < min_train:
        return IntervalResult(_without_bounds(rows), None, f"skipped: only {counts['train']} training events (need >= {min_train})", [])
    if counts["cal"] < min_calibration:
        return IntervalResult(_without_bounds(rows), None, f"skipped: only {counts['cal']} calibration events (need >= {min_calibration})", [])
    train = events.where(F.col(split) == "train")
    models = boosting.fit_quantiles(train, [alpha / 2, 1 - alpha / 2], time, features, rounds, **tree)
    predicted = models[1].transform(models[0].transform(rows, "_lo", features), "_hi", features)
    # Written once: the bounds are read for the calibration scores and again for the result.
    predicted = cut_lineage(predicted)
    predicted = predicted.withColumns(boosting.interval_columns(("_l", "_h"), "_lo", "_hi", swap_crossed)).drop("_lo", "_hi")
    bounded, details = conformal_bounds(predicted, "_l", "_h", alpha, time, event, split)
    details = {"n_train_events": counts["train"], **details}
    if details["qhat_months"] == float("inf"):
        status = f"skipped: qhat is +inf (n_cal_events={counts['cal']})"
        return IntervalResult(_without_bounds(rows), None, status, models, {**details, "status": status})
    return IntervalResult(bounded.drop("_l", "_h"), details["qhat_months"], "ok", models, {**details, "status": "ok"})


def conformal_bounds(
    rows: DataFrame, low: str, high: str, alpha: float = ALPHA, time: str = "OS_MONTHS", event: str = "OS_EVENT", split: str = "split",
) -> tuple[DataFrame, dict]:
    """Raw quantile bounds widened by the conformal quantile of their scores on calibration events, for test rows; and the
    details: events, score figures (least, median, 90 %, largest, mean), mean raw width, the quantile, and width and coverage on
    all test rows and on test events."""
    calibration = rows.where((F.col(split) == "calibration") & (F.col(event) == 1)).select(
        F.greatest(F.col(low) - F.col(time), F.col(time) - F.col(high)).alias("score"), (F.col(high) - F.col(low)).alias("raw")
    )
    audit = score_audit(calibration).withColumnsRenamed({f"score_{k}": f"calibration_score_{k}" for k in ("min", "max", "mean", "median", "p90")}).first().asDict()
    raw = calibration.agg(F.count(F.lit(1)).alias("n_cal_events"), F.avg("raw").alias("raw_qr_interval_width_mean_cal")).first().asDict()
    qhat = interpolated_quantile(calibration, alpha=alpha).first()["qhat"]
    details = {**raw, **audit, "qhat_months": qhat}
    lo = F.greatest(F.col(low) - qhat, F.lit(0.0))
    hi = F.greatest(lo, F.col(high) + qhat)
    test = F.col(split) == "test"
    out = rows.withColumns({"pred_survival_lo_months_90": F.when(test, lo), "pred_survival_hi_months_90": F.when(test, hi)})
    if qhat == float("inf"):
        return out, details
    report = coverage_report(out.where(test), "pred_survival_lo_months_90", "pred_survival_hi_months_90", time, F.col(event) == 1).collect()  # two rows
    covered = {r["rows_of"]: r for r in report}
    for part, name in (("all", "all_test"), ("events", "test_events")):
        found = covered.get(part)
        details |= {f"{k}_interval_width_months_{name}": found and found[f"{k}_width"] for k in ("mean", "median")}
    events = covered.get("events")
    return out, {**details, "n_test_events": events["n"] if events else 0, "coverage_test_events_only": events and events["coverage"]}


@dataclass
class HorizonResult:
    metrics: DataFrame
    predictions: DataFrame | None
    classification: DataFrame | None
    calibrators: dict


def _union(frames: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def horizon_conformal(
    scored: DataFrame, alpha: float = ALPHA, horizon_list: Sequence[int] = tuple(HORIZONS_MONTHS), risk: str = "risk",
    split: str = "split", id_column: str = "PATIENT_ID", higher_rule: bool = False,
) -> HorizonResult:
    """Per horizon: calibrated event probability, its conformal interval, and test metrics; or why it was skipped.

    The loop runs over the few horizons; each of its steps is a distributed job.
    """
    labelled = horizons.horizon_labels(scored, horizon_list)
    found = labelled.groupBy("horizon_months", split).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true_by_horizon").alias("events")
    ).collect()  # horizons x splits
    known = {(r["horizon_months"], r[split]): (r["n"], r["events"]) for r in found}
    metrics, predicted, calibrators = [], [], {}
    for h in horizon_list:
        (n_cal, e_cal), (n_test, e_test) = known.get((h, "calibration"), (0, 0)), known.get((h, "test"), (0, 0))
        note = None
        if not n_cal or not n_test:
            note = "no_known_labels"
        elif e_cal in (0, n_cal):
            note = "insufficient_cal_class_variation"
        elif e_test in (0, n_test):
            note = "insufficient_test_class_variation"
        if note:
            metrics.append((h, n_cal, n_test, None, note))
            continue
        rows = labelled.where(F.col("horizon_months") == h)
        calibration = rows.where(F.col(split) == "calibration")
        model = fit_isotonic(calibration, risk, "y_true_by_horizon", True, "p_event_hat")
        fitted = apply_isotonic(model, calibration, risk)
        scores = fitted.select(F.abs(F.col("y_true_by_horizon") - F.col("p_event_hat")).alias("score"))
        rule = higher_quantile if higher_rule else interpolated_quantile
        qhat = rule(scores, alpha=alpha).first()["qhat"]
        if qhat == float("inf"):
            metrics.append((h, n_cal, n_test, None, "non_finite_conformal_quantile"))
            continue
        threshold = horizons.youden_thresholds(fitted).first()["threshold"]
        metrics.append((h, n_cal, n_test, qhat, "ok"))
        calibrators[h] = {"isotonic": model, "qhat": qhat, "threshold": threshold}
        test = apply_isotonic(model, rows.where(F.col(split) == "test"), risk)
        p = F.col("p_event_hat")
        predicted.append(test.select(
            "horizon_months", id_column, F.col(risk).alias("risk_score"), "y_true_by_horizon", "p_event_hat",
            F.greatest(p - qhat, F.lit(0.0)).alias("p_event_lo"), F.least(p + qhat, F.lit(1.0)).alias("p_event_hi"),
            F.lit(threshold).alias("threshold"),
        ))
    schema = "horizon_months int, n_cal_known bigint, n_test_known bigint, qhat double, note string"
    base = scored.sparkSession.createDataFrame(metrics, schema)
    predictions = _union(predicted)
    if predictions is None:
        empty = F.lit(None).cast("double")
        return HorizonResult(base.withColumns({"coverage_known_test": empty, "mean_interval_width": empty}), None, None, {})
    covered = predictions.groupBy("horizon_months").agg(
        F.avg(F.col("y_true_by_horizon").between(F.col("p_event_lo"), F.col("p_event_hi")).cast("int")).alias("coverage_known_test"),
        F.avg(F.col("p_event_hi") - F.col("p_event_lo")).alias("mean_interval_width"),
    )
    report = horizons.classification_report(predictions)
    return HorizonResult(base.join(covered, "horizon_months", "left"), predictions.drop("threshold"), report, calibrators)
