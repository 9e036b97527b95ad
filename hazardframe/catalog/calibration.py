"""Conformal quantiles, intervals, horizon labels and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog import views as V
from hazardframe.catalog.clinical import rounded_all
from hazardframe.catalog.registry import Tables, query
from hazardframe.operators import conformal, horizons, ordered

_SCORES = """scores AS (SELECT "CANCER_TYPE", abs(ln(1 + "OS_MONTHS") - (4 - risk)) AS score FROM scored WHERE split = 'calibration' AND "OS_EVENT" = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY "CANCER_TYPE" ORDER BY score) - 1 AS k, count(*) OVER (PARTITION BY "CANCER_TYPE") AS n FROM scores)"""


def _calibration_scores(t: Tables) -> DataFrame:
    rows = V.scored(t).where("split = 'calibration' AND OS_EVENT = 1")
    return rows.select("CANCER_TYPE", F.abs(F.log1p("OS_MONTHS") - (4 - F.col("risk"))).alias("score"))


@query(V.sql("scored", f"""with {_SCORES}
SELECT "CANCER_TYPE", n, r6(score;) AS qhat FROM numbered
WHERE k = ceil(round(least(ceil((n + 1) * CAST(0.9 AS DOUBLE)) / n, 1.0) * (n - 1), 9))"""))
def conformal_higher(t: Tables) -> DataFrame:
    return rounded_all(conformal.higher_quantile(_calibration_scores(t), keys=["CANCER_TYPE"]))


@query(V.sql("scored", f"""with {_SCORES},
levels AS (SELECT DISTINCT "CANCER_TYPE", n, ceil((n + 1) * CAST(0.9 AS DOUBLE)) / n AS level FROM numbered)
SELECT l."CANCER_TYPE", l.n, CASE WHEN max(level) > 1 THEN CAST('inf' AS DOUBLE) ELSE
  r6(max(score) FILTER (WHERE k = floor(level * (l.n - 1))) + (max(score) FILTER (WHERE k = ceil(level * (l.n - 1))) - max(score) FILTER (WHERE k = floor(level * (l.n - 1))))
     * (max(level) * (l.n - 1) - floor(max(level) * (l.n - 1)));) END AS qhat
FROM levels l JOIN numbered s ON l."CANCER_TYPE" = s."CANCER_TYPE" GROUP BY 1, 2"""))
def conformal_interp(t: Tables) -> DataFrame:
    return rounded_all(conformal.interpolated_quantile(_calibration_scores(t), keys=["CANCER_TYPE"]))


@query(V.sql("scored", f"""with {_SCORES}
SELECT "CANCER_TYPE", r6(min(score);) AS score_min, r6(max(score);) AS score_max, r6(avg(score);) AS score_mean,
       r6(quantile_cont(score, 0.5);) AS score_median, r6(quantile_cont(score, 0.9);) AS score_p90 FROM scores GROUP BY 1"""))
def score_audit(t: Tables) -> DataFrame:
    return rounded_all(conformal.score_audit(_calibration_scores(t), keys=["CANCER_TYPE"]))


@query(V.sql("scored", """with bounds AS (SELECT "OS_MONTHS", "OS_EVENT", greatest(60 - 10 * risk, 0) AS lo, greatest(70 - 10 * risk + "AGE" / 10, 0) AS hi FROM scored WHERE split = 'test'),
twice AS (SELECT 'all' AS rows_of, * FROM bounds UNION ALL SELECT 'events', * FROM bounds WHERE "OS_EVENT" = 1)
SELECT rows_of, count(*) AS n, r6(avg(CASE WHEN "OS_MONTHS" BETWEEN lo AND hi THEN 1 ELSE 0 END);) AS coverage, r6(avg(hi - lo);) AS mean_width,
       r6(quantile_cont(hi - lo, 0.5);) AS median_width FROM twice GROUP BY 1"""))
def interval_coverage(t: Tables) -> DataFrame:
    rows = V.scored(t).where("split = 'test'").withColumns({
        "lo": F.greatest(60 - 10 * F.col("risk"), F.lit(0.0)), "hi": F.greatest(70 - 10 * F.col("risk") + F.col("AGE") / 10, F.lit(0.0)),
    })
    return rounded_all(conformal.coverage_report(rows, "lo", "hi", "OS_MONTHS", F.col("OS_EVENT") == 1))


@query(V.sql("event_probability", """SELECT "PATIENT_ID", horizon_months, y_true_by_horizon FROM event_probability"""))
def horizon_labels(t: Tables) -> DataFrame:
    return horizons.horizon_labels(V.scored(t)).select("PATIENT_ID", "horizon_months", "y_true_by_horizon")


_FLAGS = """flags AS (SELECT horizon_months, p_event_hat AS p, y_true_by_horizon AS y, p_event_hat >= 0.6 AS hit FROM event_probability)"""


@query(V.sql("event_probability", f"""with {_FLAGS}
SELECT horizon_months, count(*) FILTER (WHERE hit AND y = 1) AS tp, count(*) FILTER (WHERE hit AND y = 0) AS fp,
       count(*) FILTER (WHERE NOT hit AND y = 0) AS tn, count(*) FILTER (WHERE NOT hit AND y = 1) AS fn FROM flags GROUP BY 1"""))
def confusion_by_horizon(t: Tables) -> DataFrame:
    rows = V.event_probability(t).withColumn("threshold", F.lit(0.6))
    return horizons.confusion(rows).select("horizon_months", "tp", "fp", "tn", "fn")


@query(V.sql("event_probability", f"""with {_FLAGS},
c AS (SELECT horizon_months, count(*) FILTER (WHERE hit AND y = 1) AS tp, count(*) FILTER (WHERE hit AND y = 0) AS fp,
       count(*) FILTER (WHERE NOT hit AND y = 0) AS tn, count(*) FILTER (WHERE NOT hit AND y = 1) AS fn, avg(y) AS rate, avg((p - y) * (p - y)) AS brier FROM flags GROUP BY 1)
SELECT horizon_months, r6(rate;) AS event_rate, r6(brier;) AS brier, r6((tp + tn) / (tp + fp + tn + fn);) AS accuracy,
       r6(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END;) AS "precision", r6(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END;) AS recall_sensitivity,
       r6(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END;) AS specificity, r6(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END;) AS f1 FROM c"""))
def brier_f1(t: Tables) -> DataFrame:
    rows = V.event_probability(t).withColumn("threshold", F.lit(0.6))
    return rounded_all(horizons.confusion(rows).drop("tp", "fp", "tn", "fn"))


@query(V.sql("event_probability", """with grid AS (SELECT unnest(range(0, 201)) AS k),
c AS (SELECT horizon_months, k, count(*) FILTER (WHERE p_event_hat >= k * (1.0::DOUBLE / 200) AND y_true_by_horizon = 1) AS tp,
             count(*) FILTER (WHERE p_event_hat < k * (1.0::DOUBLE / 200) AND y_true_by_horizon = 0) AS tn,
             count(*) FILTER (WHERE y_true_by_horizon = 1) AS p, count(*) FILTER (WHERE y_true_by_horizon = 0) AS n
      FROM event_probability CROSS JOIN grid GROUP BY 1, 2),
j AS (SELECT horizon_months, k, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END + CASE WHEN n > 0 THEN tn / n ELSE 0 END - 1.0, 12) AS j FROM c)
SELECT horizon_months, r6(k * (1.0::DOUBLE / 200);) AS threshold, r6(j;) AS youden_j FROM (SELECT *, row_number() OVER (PARTITION BY horizon_months ORDER BY j DESC, k) AS rn FROM j) z WHERE rn = 1"""))
def youden_threshold(t: Tables) -> DataFrame:
    return rounded_all(horizons.youden_thresholds(V.event_probability(t)))


@query(V.sql("event_probability", """with r AS (SELECT horizon_months, y_true_by_horizon AS y, rank() OVER (PARTITION BY horizon_months ORDER BY p_event_hat)
  + (count(*) OVER (PARTITION BY horizon_months, p_event_hat) - 1) / 2.0 AS rk FROM event_probability),
a AS (SELECT horizon_months, sum(rk) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM r GROUP BY 1)
SELECT horizon_months, r6(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2) / (p * n) END;) AS roc_auc FROM a"""))
def roc_auc(t: Tables) -> DataFrame:
    return rounded_all(horizons.ranking_metrics(V.event_probability(t)).select("horizon_months", "roc_auc"))


@query(V.sql("event_probability", """with s AS (SELECT horizon_months, p_event_hat AS p, count(*) FILTER (WHERE y_true_by_horizon = 1) AS pos, count(*) AS n FROM event_probability GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY horizon_months) AS p_all FROM s WINDOW w AS (PARTITION BY horizon_months ORDER BY p DESC))
SELECT horizon_months, r6(CASE WHEN max(p_all) > 0 THEN sum(pos * tp / k) / max(p_all) END;) AS pr_auc FROM c GROUP BY 1"""))
def average_precision(t: Tables) -> DataFrame:
    return rounded_all(horizons.ranking_metrics(V.event_probability(t)).select("horizon_months", "pr_auc"))


@query()
def isotonic_calibration(t: Tables) -> DataFrame:
    """Months fitted as a falling step function of risk on calibration events."""
    rows = V.scored(t).where("split = 'calibration' AND OS_EVENT = 1").withColumn("y", F.log1p("OS_MONTHS"))
    model = conformal.fit_isotonic(rows, "risk", "y", False, "fitted")
    return rounded_all(conformal.apply_isotonic(model, rows, "risk").select("PATIENT_ID", "risk", "y", "fitted"))


@query()
def month_interval(t: Tables) -> DataFrame:
    return rounded_all(conformal.month_interval(V.scored(t)).predictions)


@query()
def cqr_interval(t: Tables) -> DataFrame:
    """Conformalised quantile regression, 200 rounds of boosting at a rate of 0.05."""
    x = F.array("AGE", F.col("SEX").cast("double"), "risk")
    rows = V.scored(t).withColumn("features", x)
    return rounded_all(conformal.cqr_interval(rows).predictions.drop("features"))


@query(V.sql("scored", """with b AS (SELECT *, greatest(60 - 10 * risk, 0) AS l, greatest(60 - 10 * risk, 0) + 5 + "AGE" / 10 AS h FROM scored),
c AS (SELECT greatest(l - "OS_MONTHS", "OS_MONTHS" - h) AS s, h - l AS w FROM b WHERE split = 'calibration' AND "OS_EVENT" = 1),
z AS (SELECT count(*) AS n, ceil((count(*) + 1) * CAST(0.9 AS DOUBLE)) / count(*) AS level FROM c),
q AS (SELECT max(s) FILTER (WHERE k = floor(pos)) + (max(s) FILTER (WHERE k = ceil(pos)) - max(s) FILTER (WHERE k = floor(pos))) * (max(pos) - floor(max(pos))) AS qhat
      FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k FROM c) r, (SELECT level * (n - 1) AS pos FROM z) p),
f AS (SELECT b.*, greatest(l - qhat, 0) AS lo, greatest(greatest(l - qhat, 0), h + qhat) AS hi FROM b, q WHERE split = 'test')
SELECT (SELECT count(*) FROM c) AS n_cal_events, r6((SELECT min(s) FROM c);) AS calibration_score_min, r6((SELECT quantile_cont(s, 0.5) FROM c);) AS calibration_score_median,
       r6((SELECT quantile_cont(s, 0.9) FROM c);) AS calibration_score_p90, r6((SELECT max(s) FROM c);) AS calibration_score_max, r6((SELECT avg(s) FROM c);) AS calibration_score_mean,
       r6((SELECT avg(w) FROM c);) AS raw_qr_interval_width_mean_cal, r6((SELECT qhat FROM q);) AS qhat_months,
       r6(avg(hi - lo);) AS mean_interval_width_months_all_test, r6(quantile_cont(hi - lo, 0.5);) AS median_interval_width_months_all_test,
       r6(avg(hi - lo) FILTER (WHERE "OS_EVENT" = 1);) AS mean_interval_width_months_test_events,
       r6(quantile_cont(hi - lo, 0.5) FILTER (WHERE "OS_EVENT" = 1);) AS median_interval_width_months_test_events,
       count(*) FILTER (WHERE "OS_EVENT" = 1) AS n_test_events,
       r6(avg(CASE WHEN "OS_MONTHS" BETWEEN lo AND hi THEN 1 ELSE 0 END) FILTER (WHERE "OS_EVENT" = 1);) AS coverage_test_events_only FROM f"""))
def cqr_details(t: Tables) -> DataFrame:
    """The calibration of given quantile bounds and every figure that a quantile run reports."""
    low = F.greatest(60 - 10 * F.col("risk"), F.lit(0.0))
    rows = V.scored(t).withColumns({"l": low, "h": low + 5 + F.col("AGE") / 10})
    _, details = conformal.conformal_bounds(rows, "l", "h")
    return rounded_all(t.spark.createDataFrame([tuple(details.values())], ", ".join(f"{k} {'bigint' if k.startswith('n_') else 'double'}" for k in details)))


@query()
def horizon_conformal(t: Tables) -> DataFrame:
    return rounded_all(conformal.horizon_conformal(V.scored(t), horizon_list=[24, 48, 60, 72]).metrics)


@query()
def horizon_classification(t: Tables) -> DataFrame:
    return rounded_all(conformal.horizon_conformal(V.scored(t), horizon_list=[48, 60, 72]).classification)


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS "year", round(quantile_cont(o_totalprice, 0.05), 6) AS p05, round(quantile_cont(o_totalprice, 0.5), 6) AS p50,
       round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1""")
def exact_quantiles(t: Tables) -> DataFrame:
    """Exact quantiles of order prices by year."""
    rows = t("orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return rounded_all(ordered.exact_quantiles(rows, "o_totalprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, ["year"]))
