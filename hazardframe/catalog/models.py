"""Risk sets, partial likelihood, concordance, fitted models, cross-validation and ablation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog import samples as SM
from hazardframe.catalog import views as V
from hazardframe.catalog.clinical import rounded_all
from hazardframe.catalog.registry import Tables, query
from hazardframe.operators import cohort, concordance, cox, intervals, ordered
from hazardframe.plans import tuning
from hazardframe.schema import INTERVAL_COVARIATES
from hazardframe.session import cut_lineage


@query(V.sql("scored", """
SELECT count(*) AS comparable, count(*) FILTER (WHERE a.risk > b.risk) AS concordant, count(*) FILTER (WHERE a.risk = b.risk) AS tied,
       r6((count(*) FILTER (WHERE a.risk > b.risk) + 0.5 * count(*) FILTER (WHERE a.risk = b.risk)) / count(*);) AS c_index
FROM scored a JOIN scored b ON a."OS_MONTHS" < b."OS_MONTHS" AND a."OS_EVENT" = 1"""))
def c_index(t: Tables) -> DataFrame:
    return rounded_all(concordance.concordance(V.scored(t)))


@query(V.sql("scored", """with coarse AS (SELECT *, round(risk, 1) AS rr FROM scored)
SELECT a.split, count(*) AS comparable, count(*) FILTER (WHERE a.rr > b.rr) AS concordant, count(*) FILTER (WHERE a.rr = b.rr) AS tied,
       r6((count(*) FILTER (WHERE a.rr > b.rr) + 0.5 * count(*) FILTER (WHERE a.rr = b.rr)) / count(*);) AS c_index
FROM coarse a JOIN coarse b ON a.split = b.split AND a."OS_MONTHS" < b."OS_MONTHS" AND a."OS_EVENT" = 1 GROUP BY 1"""))
def c_index_by_split(t: Tables) -> DataFrame:
    """Rounded scores give many tied pairs."""
    coarse = V.scored(t).withColumn("rr", F.round("risk", 1))
    return rounded_all(concordance.concordance(coarse, risk="rr", keys=["split"]))


def _risk_sets(t: Tables) -> DataFrame:
    """Per distinct time: rows, events, weights, and their sums over all rows at that time or later."""
    weight = F.exp(F.col("risk"))
    rows = V.scored(t).withColumn("w", weight)
    times = rows.groupBy("OS_MONTHS").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("OS_EVENT").cast("bigint")).alias("d"), F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("AGE")).alias("wx"),
    )
    pieced = ordered.with_piece(times, "OS_MONTHS", ordered.cut_points(rows, "OS_MONTHS"))
    sums = {"at_risk": "n", "s0": "w", "s1": "wx"}
    return ordered.ordered_columns(pieced, ["OS_MONTHS"], sums=sums, descending=True).where(F.col("d") > 0)


@query(V.sql("scored", """with times AS (SELECT DISTINCT "OS_MONTHS" AS u FROM scored WHERE "OS_EVENT" = 1)
SELECT r6(u;) AS "OS_MONTHS", count(*) AS at_risk, CAST(sum(CASE WHEN "OS_MONTHS" = u THEN "OS_EVENT" ELSE 0 END) AS BIGINT) AS d
FROM times JOIN scored ON "OS_MONTHS" >= u GROUP BY u"""))
def risk_set_sizes(t: Tables) -> DataFrame:
    return rounded_all(_risk_sets(t).select("OS_MONTHS", "at_risk", "d"))


@query(V.sql("scored", """with times AS (SELECT DISTINCT "OS_MONTHS" AS u FROM scored WHERE "OS_EVENT" = 1)
SELECT r6(u;) AS "OS_MONTHS", r6(sum(exp(risk));) AS s0, r6(sum(exp(risk) * "AGE");) AS s1
FROM times JOIN scored ON "OS_MONTHS" >= u GROUP BY u"""))
def risk_set_sums(t: Tables) -> DataFrame:
    return rounded_all(_risk_sets(t).select("OS_MONTHS", "s0", "s1"))


def _numeric_design(t: Tables) -> DataFrame:
    x = F.array(F.col("AGE") / 100, F.col("SEX").cast("double"), F.col("risk"))
    return V.scored(t).withColumn("features", x)


_BETA = [0.4, -0.2, 0.3]


def _likelihood_row(t: Tables, data: cox.CoxData) -> DataFrame:
    try:
        loglik, gradient = cox.partial_likelihood(data, {0: np.asarray(_BETA).reshape(-1, 1)})[0]
    finally:
        data.close()
    values = [float(loglik[0]), *map(float, gradient[:, 0])]
    return rounded_all(t.spark.createDataFrame([tuple(values)], "loglik double, g_age double, g_sex double, g_risk double"))


@query(V.sql("scored", """with x AS (SELECT "OS_MONTHS" AS tm, "OS_EVENT" AS e, "AGE" / 100 AS a, CAST("SEX" AS DOUBLE) AS s, risk AS r FROM scored),
w AS (SELECT *, 0.4 * a - 0.2 * s + 0.3 * r AS eta, exp(0.4 * a - 0.2 * s + 0.3 * r) AS w FROM x),
sets AS (SELECT u, sum(w) AS s0, sum(w * a) AS sa, sum(w * s) AS ss, sum(w * r) AS sr FROM (SELECT DISTINCT tm AS u FROM w WHERE e = 1) z JOIN w ON tm >= u GROUP BY 1)
SELECT r6(sum(eta - ln(s0));) AS loglik, r6(sum(a - sa / s0);) AS g_age, r6(sum(s - ss / s0);) AS g_sex, r6(sum(r - sr / s0);) AS g_risk
FROM w JOIN sets ON tm = u WHERE e = 1"""))
def cox_loglik_gradient(t: Tables) -> DataFrame:
    """Log partial likelihood and gradient at fixed coefficients."""
    return _likelihood_row(t, cox.cox_data(_numeric_design(t), width=3))


def _interval_design(t: Tables) -> DataFrame:
    x = F.array(F.col("AGE") / 100, F.col("SEX").cast("double"), F.log1p("MUTATION_BURDEN"))
    return SM.interval_table(t).withColumn("features", x)


@query(V.sql("sample endpoint", f"""with {SM._PATIENT_SQL},
x AS (SELECT d AS t0, coalesce(nxt, "OS_DAYS") AS t1, CASE WHEN nxt IS NULL THEN "OS_EVENT" ELSE 0 END AS e, "AGE" / 100 AS a, CAST("SEX" AS DOUBLE) AS s,
             ln(1 + "MUTATION_BURDEN") AS r FROM spans WHERE coalesce(nxt, "OS_DAYS") > d),
w AS (SELECT *, 0.4 * a - 0.2 * s + 0.3 * r AS eta, exp(0.4 * a - 0.2 * s + 0.3 * r) AS w FROM x),
sets AS (SELECT u, sum(w) AS s0, sum(w * a) AS sa, sum(w * s) AS ss, sum(w * r) AS sr FROM (SELECT DISTINCT t1 AS u FROM w WHERE e = 1) z JOIN w ON t0 < u AND t1 >= u GROUP BY 1)
SELECT r6(sum(eta - ln(s0));) AS loglik, r6(sum(a - sa / s0);) AS g_age, r6(sum(s - ss / s0);) AS g_sex, r6(sum(r - sr / s0);) AS g_risk
FROM w JOIN sets ON t1 = u WHERE e = 1"""))
def interval_loglik_gradient(t: Tables) -> DataFrame:
    """The same on (start, stop] rows."""
    design = cut_lineage(_interval_design(t).select("T_START", "T_STOP", "EVENT", "features"))
    return _likelihood_row(t, cox.cox_data(design, "T_STOP", "EVENT", start="T_START", width=3))


_NAMES = ["AGE/100", "SEX", "risk"]


@query()
def cox_ridge_fit(t: Tables) -> DataFrame:
    fit = cox.fit_one(_numeric_design(t), alpha=1.0, clip=50.0, maxiter=300)
    return rounded_all(cox.coefficient_table(V.scored(t), [fit], _NAMES))


@query()
def cox_enet_fit(t: Tables) -> DataFrame:
    fit = cox.fit_one(_numeric_design(t), alpha=0.8, l1_ratio=0.3)
    table = cox.coefficient_table(V.scored(t), [fit], _NAMES)
    return rounded_all(table.orderBy(F.abs("coef_value").desc(), "coef_index"))


@query()
def tv_cox_fit(t: Tables) -> DataFrame:
    fit = cox.fit_one(_interval_design(t), alpha=1.0, maxiter=250, stop="T_STOP", event="EVENT", start="T_START")
    return rounded_all(cox.coefficient_table(V.scored(t), [fit], ["AGE/100", "SEX", "log1p_burden"]))


def model_rows(t: Tables) -> DataFrame:
    """Patients with an endpoint and their omic blocks, written once for the model queries."""
    return cut_lineage(cohort.survival_endpoint(SM.multiomic_table(t, top_n=20)))


@query()
def cv_grid(t: Tables) -> DataFrame:
    """The full penalty grid under five folds on clinical and expression features."""
    rows = model_rows(t)
    expression = [c for c in rows.columns if c.startswith("EXPR_")]
    return rounded_all(tuning.cross_validate(rows, ["AGE", "SEX", "CANCER_TYPE"], expression))


@query()
def ablation(t: Tables) -> DataFrame:
    """Seven feature sets on patients."""
    return rounded_all(tuning.static_ablation(model_rows(t)))


def _omic_intervals(t: Tables, site: bool = False) -> DataFrame:
    """Intervals with the omic blocks; ``site`` adds a covariate that the cleaned re-run leaves out."""
    patients, _ = SM.interval_inputs(t)
    covariates = ["AGE", "SEX"]
    if site:
        patients, covariates = _with_site(patients), [*covariates, "TUMOR_SITE"]
    long = SM.sample_omics(t, top_n=10)
    payload = [c for c in long.columns if c.startswith(("EXPR_", "CNA_"))]
    return intervals.survival_intervals(patients, cohort.drop_post_outcome(long.drop("OS_DAYS").join(
        patients.select("PATIENT_ID", "OS_DAYS"), "PATIENT_ID")), covariates, payload)


def _with_site(patients: DataFrame) -> DataFrame:
    return patients.withColumn("TUMOR_SITE", F.concat(F.lit("site-"), (F.col("PATIENT_ID") % 4).cast("string")))


@query()
def interval_ablation(t: Tables) -> DataFrame:
    """Seven feature sets on survival intervals."""
    return rounded_all(tuning.interval_ablation(_omic_intervals(t)))


@query()
def cleaned_rerun(t: Tables) -> DataFrame:
    """Seven feature sets with and without the low-value columns on the same patient folds."""
    covariates = [*INTERVAL_COVARIATES, "TUMOR_SITE"]
    return rounded_all(tuning.paired_summary(tuning.cleaned_rerun(_omic_intervals(t, site=True), covariates=covariates)))


@query(V.sql("sample endpoint", f"""with {SM._PATIENT_SQL},
people AS (SELECT "PATIENT_ID", min("CANCER_TYPE") AS c, min("OS_EVENT") AS e, count(*) AS n FROM spans WHERE coalesce(nxt, "OS_DAYS") > d GROUP BY 1),
folded AS (SELECT *, (row_number() OVER (PARTITION BY c, e ORDER BY md5('42|' || CAST("PATIENT_ID" AS VARCHAR)), "PATIENT_ID") - 1) % 5 AS f FROM people)
SELECT CAST(f AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS patients, CAST(sum(e) AS BIGINT) AS events,
       CAST(17 AS INTEGER) AS columns_before, CAST(16 AS INTEGER) AS columns_after, 'TUMOR_SITE' AS dropped FROM folded GROUP BY 1"""))
def cleaned_rerun_counts(t: Tables) -> DataFrame:
    """What the re-run works on, by fold."""
    patients, samples = SM.interval_inputs(t)
    table = intervals.survival_intervals(_with_site(patients), samples, covariates=["AGE", "SEX", "TUMOR_SITE"])
    return tuning.rerun_counts(table).drop("absent")


@query(V.sql("scored", """with x AS (SELECT fold, "OS_MONTHS" AS tm, "OS_EVENT" AS e, risk - CAST(0.5 AS DOUBLE) * CAST("SEX" AS DOUBLE) AS r_old, risk AS r_new FROM scored),
found AS (SELECT a.fold, (count(*) FILTER (WHERE a.r_old > b.r_old) + 0.5 * count(*) FILTER (WHERE a.r_old = b.r_old)) / count(*) AS o,
                 (count(*) FILTER (WHERE a.r_new > b.r_new) + 0.5 * count(*) FILTER (WHERE a.r_new = b.r_new)) / count(*) AS c
          FROM x a JOIN x b ON a.fold = b.fold AND a.tm < b.tm AND a.e = 1 GROUP BY 1)
SELECT 'fixed coefficients' AS experiment, r6(avg(o);) AS mean_c_index_old, r6(avg(c);) AS mean_c_index_cleaned, count(*) AS paired_folds,
       r6(avg(c - o);) AS mean_paired_delta, r6(stddev_pop(c - o);) AS std_paired_delta, count(*) FILTER (WHERE c > o) AS folds_better,
       count(*) FILTER (WHERE c < o) AS folds_worse, r6(avg(c) - avg(o);) AS delta_mean_c_index FROM found"""))
def cleaned_rerun_deltas(t: Tables) -> DataFrame:
    """The paired comparison on folds of scored patients, at fixed coefficients with and without SEX."""
    risks = F.array(F.col("risk") - F.lit(0.5) * F.col("SEX").cast("double"), F.col("risk"))
    found = concordance.concordances(V.scored_folds(t).withColumn("risks", risks), "risks", keys=["fold"])
    scores = found.select(F.lit("fixed coefficients").alias("label"), "fold", F.col("model").alias("variant"), "c_index", F.lit("").alias("note"))
    return rounded_all(tuning.paired_summary(tuning.pair_folds(scores)))


@query(V.sql("scored", """with folds AS (SELECT DISTINCT fold AS g FROM scored),
cells AS (SELECT fold, 'AGE' AS feature, CAST("AGE" AS DOUBLE) AS v FROM scored UNION ALL SELECT fold, 'OS_MONTHS', "OS_MONTHS" FROM scored
          UNION ALL SELECT fold, 'risk', CASE WHEN "SEX" = 0 OR "PATIENT_ID" % 3 = 0 THEN risk END FROM scored)
SELECT g, feature, r6(quantile_cont(v, 0.5);) AS median FROM folds JOIN cells ON fold <> g GROUP BY g, feature"""))
def training_medians(t: Tables) -> DataFrame:
    """Medians of every training set of five folds, a column with gaps among them."""
    known = (F.col("SEX") == 0) | (F.col("PATIENT_ID") % 3 == 0)
    rows = V.scored_folds(t).withColumn("risk", F.when(known, F.col("risk")))
    return rounded_all(ordered.leave_out_medians(rows, ["AGE", "OS_MONTHS", "risk"], "fold", range(5)))
