"""Endpoints, cleaning, status and barcode queries. In the SQL texts ``r6(x;)`` stands for x rounded to 6 digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog import views as V
from hazardframe.catalog.registry import Tables, query
from hazardframe.functions import scalars as S
from hazardframe.operators import clean, cohort, ordered, profile, splits


def rounded_all(df: DataFrame) -> DataFrame:
    return df.select(*[S.rounded(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(V.sql("endpoint", """
SELECT "PATIENT_ID", "CANCER_TYPE", r6("OS_MONTHS";) AS "OS_MONTHS", "OS_EVENT" FROM endpoint"""))
def endpoint_filter(t: Tables) -> DataFrame:
    return rounded_all(V.endpoint(t).select("PATIENT_ID", "CANCER_TYPE", "OS_MONTHS", "OS_EVENT"))


@query(V.sql("patient", """
SELECT CAST("PATIENT_ID" AS VARCHAR) AS "PATIENT_ID", r6("OS_MONTHS";) AS "OS_MONTHS",
       CASE WHEN "OS_EVENT" * 2 > 0 THEN 1 ELSE 0 END AS "OS_EVENT"
FROM patient WHERE "OS_MONTHS" > 0"""))
def strict_endpoint_filter(t: Tables) -> DataFrame:
    doubled = V.patient(t).withColumn("OS_EVENT", F.col("OS_EVENT") * 2)
    return rounded_all(cohort.strict_endpoint(doubled).select("PATIENT_ID", "OS_MONTHS", "OS_EVENT"))


@query(V.sql("endpoint", """
SELECT "CANCER_TYPE", count("PATIENT_ID") AS n, CAST(sum("OS_EVENT") AS BIGINT) AS events,
       r6(avg("OS_EVENT");) AS event_rate, r6(quantile_cont("OS_MONTHS", 0.5);) AS median_os_months
FROM endpoint GROUP BY 1"""))
def outcome_by_cohort(t: Tables) -> DataFrame:
    return rounded_all(cohort.outcome_by_group(V.endpoint(t)))


@query(V.sql("patient endpoint", """
SELECT (SELECT count(*) FROM patient) AS rows_total, CAST(10 AS BIGINT) AS cols_total,
       count(*) AS rows_analyzed, CAST(sum("OS_EVENT") AS BIGINT) AS events,
       CAST(sum(1 - "OS_EVENT") AS BIGINT) AS censored, r6(avg("OS_EVENT");) AS event_rate FROM endpoint"""))
def dataset_summary(t: Tables) -> DataFrame:
    return rounded_all(profile.dataset_summary(V.patient(t)))


@query("""
SELECT o_orderkey,
       CASE WHEN status LIKE '%1:%' OR upper(status) LIKE '%DECEASED%' THEN 1 ELSE 0 END AS os_event,
       CASE WHEN recur LIKE '%1:%' OR upper(recur) LIKE '%RECURRED%' OR upper(recur) LIKE '%PROGRESSED%' THEN 1 ELSE 0 END AS dfs_event,
       CASE WHEN regexp_matches(upper(status), '1:|DECEASED') THEN 1 ELSE 0 END AS os_event_regex
FROM (SELECT o_orderkey,
             CASE o_orderstatus WHEN 'F' THEN '1:DECEASED' WHEN 'O' THEN '0:LIVING' ELSE NULL END AS status,
             CASE WHEN o_orderpriority LIKE '1%' THEN '1:Recurred/Progressed' WHEN o_orderpriority LIKE '2%' THEN 'progressed'
                  WHEN o_orderpriority LIKE '3%' THEN NULL ELSE '0:DiseaseFree' END AS recur FROM orders) z""")
def status_parse(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "1:DECEASED").when(F.col("o_orderstatus") == "O", "0:LIVING")
    level = F.substring("o_orderpriority", 1, 1)
    recur = F.when(level == "1", "1:Recurred/Progressed").when(level == "2", "progressed").when(level != "3", "0:DiseaseFree")
    return t("orders").select(
        "o_orderkey", S.status_flag(status).alias("os_event"), S.recurrence_flag(recur).alias("dfs_event"),
        S.status_matches(status).alias("os_event_regex"),
    )


@query(V.sql("sample", """
SELECT "SAMPLE_ID", TRY_CAST("DAYS_TO_COLLECTION" AS DOUBLE) AS d1, TRY_CAST("DAYS_TO_SPECIMEN_COLLECTION" AS DOUBLE) AS d2,
       CASE WHEN "DAYS_TO_COLLECTION" <> '[Not Available]' THEN "DAYS_TO_COLLECTION" END AS d1_text FROM sample"""))
def numeric_coerce(t: Tables) -> DataFrame:
    return V.sample(t).select(
        "SAMPLE_ID", S.to_number("DAYS_TO_COLLECTION").alias("d1"), S.to_number("DAYS_TO_SPECIMEN_COLLECTION").alias("d2"),
        S.blank_tokens("DAYS_TO_COLLECTION").alias("d1_text"),
    )


@query(V.sql("patient", """
SELECT "PATIENT_ID", CASE "OS_EVENT" WHEN 0 THEN 'Living' WHEN 1 THEN 'Deceased' END AS "Status" FROM patient"""))
def recode_label(t: Tables) -> DataFrame:
    return V.patient(t).select("PATIENT_ID", S.label_codes("OS_EVENT", {0: "Living", 1: "Deceased"}).alias("Status"))


@query(V.sql("sample", """SELECT "SAMPLE_ID", "SAMPLE_ID_NORM" FROM sample_metadata"""))
def barcode_norm(t: Tables) -> DataFrame:
    return V.sample_metadata(t).select("SAMPLE_ID", "SAMPLE_ID_NORM")


@query(V.sql("sample", """SELECT "SAMPLE_ID", "SAMPLE_TYPE_CODE", "IS_PRIMARY" FROM sample_metadata"""))
def sample_type(t: Tables) -> DataFrame:
    return V.sample_metadata(t).select("SAMPLE_ID", "SAMPLE_TYPE_CODE", "IS_PRIMARY")


@query(V.sql("sample", """SELECT "SAMPLE_ID", "SAMPLE_DAY" FROM sample_metadata"""))
def coalesce_day(t: Tables) -> DataFrame:
    return V.sample_metadata(t).select("SAMPLE_ID", "SAMPLE_DAY")


@query(V.sql("patient", """
SELECT "PATIENT_ID", CASE WHEN a > 0 AND a <= 40 THEN '≤40' WHEN a > 40 AND a <= 55 THEN '41-55' WHEN a > 55 AND a <= 65 THEN '56-65'
       WHEN a > 65 AND a <= 75 THEN '66-75' WHEN a > 75 AND a <= 120 THEN '>75' END AS "AGE_GROUP",
       CASE WHEN a > 0 AND a <= 40 THEN 0 WHEN a > 40 AND a <= 55 THEN 1 WHEN a > 55 AND a <= 65 THEN 2
       WHEN a > 65 AND a <= 75 THEN 3 WHEN a > 75 AND a <= 120 THEN 4 END AS age_order
FROM (SELECT "PATIENT_ID", "AGE" + "PATIENT_ID" % 50 AS a FROM patient) z"""))
def age_group(t: Tables) -> DataFrame:
    rows = V.patient(t).withColumn("a", F.col("AGE") + F.col("PATIENT_ID") % 50)
    return rows.select("PATIENT_ID", S.age_group("a").alias("AGE_GROUP"), S.age_group_order("a").alias("age_order"))


@query(V.sql("patient", """
SELECT "PATIENT_ID", r6(log2("OS_MONTHS" + 1);) AS log2_months, r6(log10("OS_MONTHS" + 1);) AS log10_months,
       r6(ln(1 + "OS_MONTHS");) AS log1p_months, r6(exp("AGE" / 20) - 1;) AS expm1_age, r6(sqrt("AGE");) AS sqrt_age,
       r6(exp(-"AGE" / 10);) AS exp_age, r6(abs("ACCTBAL");) AS abs_bal, ceil("OS_MONTHS") AS ceil_months
FROM patient"""))
def log_transforms(t: Tables) -> DataFrame:
    return rounded_all(V.patient(t).select(
        "PATIENT_ID", S.log2_plus_one("OS_MONTHS").alias("log2_months"), S.log10_plus_one("OS_MONTHS").alias("log10_months"),
        F.log1p("OS_MONTHS").alias("log1p_months"), F.expm1(F.col("AGE") / 20).alias("expm1_age"),
        F.sqrt("AGE").alias("sqrt_age"), F.exp(-F.col("AGE") / 10).alias("exp_age"), F.abs("ACCTBAL").alias("abs_bal"),
        F.ceil("OS_MONTHS").cast("double").alias("ceil_months"),
    ))


@query(V.sql("patient", """
SELECT "PATIENT_ID", r6("OS_MONTHS" * CAST(30.4375 AS DOUBLE);) AS "OS_DAYS" FROM patient"""))
def days_from_months(t: Tables) -> DataFrame:
    return rounded_all(V.patient(t).select("PATIENT_ID", S.months_to_days("OS_MONTHS").alias("OS_DAYS")))


@query(V.sql("patient", """
SELECT "PATIENT_ID", r6(greatest("ACCTBAL", 0.0);) AS floor_zero, r6(least(greatest("ACCTBAL" / 5000, 0.0), 1.0);) AS unit_range,
       r6(least(greatest("AGE" * 12, 0.0), greatest("OS_DAYS" - 1e-6, 1e-6));) AS within_follow_up,
       r6(least(greatest("ACCTBAL" / 100, -40.0), 40.0);) AS predictor, r6(least("AGE", "OS_MONTHS");) AS pair_min,
       r6(greatest("AGE", "OS_MONTHS");) AS pair_max
FROM patient"""))
def clip_bounds(t: Tables) -> DataFrame:
    upper = F.greatest(F.col("OS_DAYS") - 1e-6, F.lit(1e-6))
    return rounded_all(V.patient(t).select(
        "PATIENT_ID", S.clip("ACCTBAL", 0.0).alias("floor_zero"), S.clip(F.col("ACCTBAL") / 5000, 0.0, 1.0).alias("unit_range"),
        S.clip(F.col("AGE") * 12, 0.0, upper).alias("within_follow_up"),
        S.clip(F.col("ACCTBAL") / 100, -40.0, 40.0).alias("predictor"),
        F.least("AGE", "OS_MONTHS").alias("pair_min"), F.greatest("AGE", "OS_MONTHS").alias("pair_max"),
    ))


@query(V.sql("scored", """
SELECT "PATIENT_ID", "CANCER_TYPE" || '_' || "OS_EVENT" AS strata, printf('ROW_%07d', "PATIENT_ID") AS row_id,
       printf('%03d', CAST(round_even("AGE" / 89 * 100, 0) AS INTEGER)) AS label,
       printf('%.4f', round("AGE" / 64, 6)) || ', ' || printf('%.4f', round("OS_DAYS" / 64, 6)) AS scores
FROM scored"""))
def text_formats(t: Tables) -> DataFrame:
    scores = F.array(F.round(F.col("AGE") / 64, 6), F.round(F.col("OS_DAYS") / 64, 6))
    return V.scored(t).select(
        "PATIENT_ID", S.strata_key("CANCER_TYPE", "OS_EVENT").alias("strata"), S.synthetic_id("PATIENT_ID").alias("row_id"),
        S.threshold_label(F.col("AGE") / 89).alias("label"), S.join_scores(scores).alias("scores"),
    )


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, {V.r(f'(count(*) - count({c})) / count(*)::DOUBLE')} AS missing_frac FROM clinical_raw"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")
)


@query(V.sql("clinical_raw", _MISSING))
def missingness(t: Tables) -> DataFrame:
    return rounded_all(profile.missingness(V.clinical_raw(t)))


@query(V.sql("clinical_raw", """
SELECT doc_id, n_chars, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM clinical_raw)) AS quality,
       coalesce(n_even, (SELECT quantile_cont(n_even, 0.5) FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_even FROM clinical_raw) a)) AS n_even
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_even FROM clinical_raw) z"""))
def median_impute(t: Tables) -> DataFrame:
    rows = V.clinical_raw(t).withColumn("n_even", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    return clean.impute_medians(rows, ["n_chars", "quality", "n_even"]).select("doc_id", "n_chars", "quality", "n_even")


@query(V.sql("clinical_raw", """
SELECT doc_id, coalesce(lang_part, 'Unknown') AS lang_part, coalesce(toxic, 0.0) AS toxic
FROM (SELECT doc_id, CASE WHEN lang <> 'en' THEN lang END AS lang_part, toxic FROM clinical_raw) z"""))
def constant_impute(t: Tables) -> DataFrame:
    rows = V.clinical_raw(t).select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang_part"), "toxic")
    return clean.impute_constant(clean.impute_constant(rows, ["lang_part"]), ["toxic"], 0.0)


@query(V.sql("clinical_raw", """SELECT doc_id, lang, source, n_chars, quality, toxic FROM clinical_raw"""))
def drop_sparse_columns(t: Tables) -> DataFrame:
    """The column that is filled for one document in ten is dropped, those with fewer gaps are kept."""
    rows = V.clinical_raw(t).withColumn("rare", F.when(F.col("doc_id") % 10 == 0, F.col("n_chars")))
    return rows.drop(*profile.sparse_columns(rows))


@query(V.sql("patient", """SELECT "PATIENT_ID", "AGE", "OS_DAYS" FROM patient"""))
def drop_constant_columns(t: Tables) -> DataFrame:
    rows = V.patient(t).select("PATIENT_ID", "AGE", "OS_DAYS").withColumn("flat", F.lit(3.0))
    return rows.drop(*profile.zero_variance_columns(rows, ["AGE", "OS_DAYS", "flat"]))


_LONG = """long AS (SELECT 'AGE' AS feature, "AGE" AS value FROM patient UNION ALL SELECT 'OS_MONTHS', "OS_MONTHS" FROM patient
UNION ALL SELECT 'ACCTBAL', "ACCTBAL" FROM patient)"""


@query(V.sql("patient", f"""with {_LONG},
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1)
SELECT q.feature, r6(max(q1 - 1.5 * (q3 - q1));) AS lower_bound, r6(max(q3 + 1.5 * (q3 - q1));) AS upper_bound,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM long JOIN q ON long.feature = q.feature GROUP BY 1"""))
def iqr_outlier_count(t: Tables) -> DataFrame:
    return rounded_all(clean.iqr_outlier_counts(V.patient(t), ["AGE", "OS_MONTHS", "ACCTBAL"]))


@query(V.sql("endpoint", """with a AS (SELECT quantile_cont("OS_MONTHS", 0.25) AS q1, quantile_cont("OS_MONTHS", 0.75) AS q3 FROM endpoint),
first_pass AS (SELECT e.* FROM endpoint e, a WHERE "OS_MONTHS" BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)),
b AS (SELECT quantile_cont("AGE", 0.25) AS q1, quantile_cont("AGE", 0.75) AS q3 FROM first_pass)
SELECT "PATIENT_ID", r6("OS_MONTHS";) AS "OS_MONTHS", "AGE" FROM first_pass, b
WHERE "AGE" BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)"""))
def iqr_fence_filter(t: Tables) -> DataFrame:
    rows, _ = clean.iqr_filter(V.endpoint(t).select("PATIENT_ID", "OS_MONTHS", "AGE"), k=0.5)
    return rounded_all(rows)


@query(V.sql("patient", """
SELECT "PATIENT_ID", r6(least("OS_MONTHS", (SELECT quantile_cont("OS_MONTHS", 0.99) FROM patient));) AS "OS_MONTHS" FROM patient"""))
def winsor_p99(t: Tables) -> DataFrame:
    return rounded_all(clean.winsorise(V.patient(t).select("PATIENT_ID", "OS_MONTHS")))


@query(V.sql("patient", """
SELECT "CANCER_TYPE", r6(quantile_cont("OS_MONTHS", 0.1);) AS p10, r6(quantile_cont("OS_MONTHS", 0.9);) AS p90 FROM patient GROUP BY 1"""))
def quantiles_by_cohort(t: Tables) -> DataFrame:
    return rounded_all(ordered.exact_quantiles(V.patient(t), "OS_MONTHS", {"p10": 0.1, "p90": 0.9}, ["CANCER_TYPE"]))


@query(V.sql("patient", """
SELECT "CANCER_TYPE", count(*) FILTER (WHERE "SEX" = '0') AS sex_0, count(*) FILTER (WHERE "SEX" = '1') AS sex_1 FROM patient GROUP BY 1"""))
def crosstab_pivot(t: Tables) -> DataFrame:
    return profile.crosstab(V.patient(t), "CANCER_TYPE", "SEX", ["0", "1"], ["sex_0", "sex_1"])


@query(V.sql("patient", f"""with {_LONG}
SELECT feature, count(value) AS "count", r6(avg(value);) AS mean, r6(stddev_samp(value);) AS std, r6(min(value);) AS "min", r6(max(value);) AS "max",
       r6(quantile_cont(value, 0.25);) AS q25, r6(quantile_cont(value, 0.5);) AS q50, r6(quantile_cont(value, 0.75);) AS q75
FROM long GROUP BY 1"""))
def numeric_describe(t: Tables) -> DataFrame:
    return rounded_all(profile.numeric_describe(V.patient(t), ["AGE", "OS_MONTHS", "ACCTBAL"]))


@query(V.sql("clinical_raw", f"""with cells AS (SELECT 'lang' AS "column", lang AS value FROM clinical_raw UNION ALL SELECT 'source', source FROM clinical_raw
UNION ALL SELECT 'quality', CAST(CAST(quality AS INTEGER) AS VARCHAR) FROM clinical_raw),
counts AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, coalesce(value, '<NA>')) AS rn,
                  count(value) OVER (PARTITION BY "column") AS n_unique, sum(n) OVER (PARTITION BY "column") AS total FROM counts)
SELECT "column", n_unique, coalesce(value, '<NA>') AS top_value, n AS top_count, r6(n / total;) AS top_frac FROM ranked WHERE rn = 1"""))
def categorical_overview(t: Tables) -> DataFrame:
    rows = V.clinical_raw(t).withColumn("quality", F.col("quality").cast("int"))
    return rounded_all(profile.categorical_overview(rows, ["lang", "source", "quality"]))


@query(V.sql("patient", """with b AS (SELECT "CANCER_TYPE", min("AGE") AS lo, max("AGE") AS hi FROM patient GROUP BY 1),
frame AS (SELECT *, CAST(unnest(range(1, 21)) AS INTEGER) AS bin FROM b),
counts AS (SELECT p."CANCER_TYPE", CAST(least(20, 1 + floor(("AGE" - lo) * 20 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n
           FROM patient p JOIN b ON p."CANCER_TYPE" = b."CANCER_TYPE" GROUP BY 1, 2)
SELECT f."CANCER_TYPE", f.bin, r6(lo + (f.bin - 1) * ((hi - lo) / 20);) AS left_edge, coalesce(n, 0) AS n
FROM frame f LEFT JOIN counts c ON f."CANCER_TYPE" = c."CANCER_TYPE" AND f.bin = c.bin"""))
def histogram(t: Tables) -> DataFrame:
    return rounded_all(profile.histogram(V.patient(t), "AGE", 20, ["CANCER_TYPE"]))


@query(V.sql("mutation", """with burden AS (SELECT "Tumor_Sample_Barcode", log10(count(*) + 1) AS lb FROM mutation GROUP BY 1),
b AS (SELECT min(lb) AS lo, max(lb) AS hi FROM burden),
counts AS (SELECT CAST(least(30, 1 + floor((lb - lo) * 30 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM burden, b GROUP BY 1)
SELECT f.bin, r6(lo + (f.bin - 1) * ((hi - lo) / 30);) AS left_edge, coalesce(n, 0) AS n
FROM (SELECT *, CAST(unnest(range(1, 31)) AS INTEGER) AS bin FROM b) f LEFT JOIN counts c ON f.bin = c.bin"""))
def burden_histogram(t: Tables) -> DataFrame:
    burden = cohort.mutation_burden(V.mutation(t), ["Tumor_Sample_Barcode"])
    return rounded_all(profile.histogram(burden.withColumn("lb", S.log10_plus_one("MUTATION_COUNT")), "lb", 30))


@query(V.sql("patient", """with q AS (SELECT "CANCER_TYPE", "OS_EVENT", quantile_cont("OS_MONTHS", 0.25) AS q25, quantile_cont("OS_MONTHS", 0.5) AS q50,
  quantile_cont("OS_MONTHS", 0.75) AS q75 FROM patient GROUP BY 1, 2),
f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q)
SELECT f."CANCER_TYPE", f."OS_EVENT", r6(q25;) AS q25, r6(q50;) AS q50, r6(q75;) AS q75,
       r6(min("OS_MONTHS") FILTER (WHERE "OS_MONTHS" BETWEEN lo AND hi);) AS whisker_low,
       r6(max("OS_MONTHS") FILTER (WHERE "OS_MONTHS" BETWEEN lo AND hi);) AS whisker_high,
       count(*) FILTER (WHERE NOT ("OS_MONTHS" BETWEEN lo AND hi)) AS outliers
FROM patient p JOIN f ON p."CANCER_TYPE" = f."CANCER_TYPE" AND p."OS_EVENT" = f."OS_EVENT" GROUP BY 1, 2, q25, q50, q75"""))
def box_stats(t: Tables) -> DataFrame:
    return rounded_all(profile.box_stats(V.patient(t), "OS_MONTHS", ["CANCER_TYPE", "OS_EVENT"]))


@query(V.sql("patient", """with s AS (SELECT "CANCER_TYPE", count(*) AS n, stddev_samp("OS_MONTHS") * pow(count(*), -0.2) AS h, min("OS_MONTHS") AS lo, max("OS_MONTHS") AS hi
  FROM patient GROUP BY 1),
grid AS (SELECT *, CAST(unnest(range(0, 64)) AS INTEGER) AS point FROM s),
xs AS (SELECT *, (lo - 3 * h) + point * ((hi + 3 * h) - (lo - 3 * h)) / 63 AS x FROM grid)
SELECT xs."CANCER_TYPE", point, r6(max(x);) AS x,
       r6(sum(exp(-0.5 * ((x - "OS_MONTHS") / h) * ((x - "OS_MONTHS") / h)) / (n * h * sqrt(2 * pi())));) AS density
FROM xs JOIN patient p ON p."CANCER_TYPE" = xs."CANCER_TYPE" GROUP BY 1, 2"""))
def kde_grid(t: Tables) -> DataFrame:
    return rounded_all(profile.density_grid(V.patient(t), "OS_MONTHS", ["CANCER_TYPE"]))


@query(V.sql("scored", """SELECT "PATIENT_ID", fold FROM scored"""))
def strat_kfold(t: Tables) -> DataFrame:
    return splits.stratified_folds(V.endpoint(t), "PATIENT_ID", ["CANCER_TYPE", "OS_EVENT"]).select("PATIENT_ID", "fold")


@query(V.sql("scored", """SELECT "PATIENT_ID", split FROM scored"""))
def three_way_split(t: Tables) -> DataFrame:
    return V.scored(t).select("PATIENT_ID", "split")


@query(V.sql("scored", """
SELECT split, count(*) AS rows, CAST(sum("OS_EVENT") AS BIGINT) AS events, CAST(sum(1 - "OS_EVENT") AS BIGINT) AS censored,
       r6(avg("OS_EVENT");) AS event_rate FROM scored GROUP BY 1"""))
def split_report(t: Tables) -> DataFrame:
    report = splits.split_report(V.scored(t))
    splits.require_both_classes(report)
    return rounded_all(report)


@query(V.sql("scored", """
SELECT "OS_EVENT", count(*) AS n, least(5, (SELECT min(c) FROM (SELECT count(*) AS c FROM scored GROUP BY "OS_EVENT") z)) AS folds
FROM scored GROUP BY 1"""))
def class_balance(t: Tables) -> DataFrame:
    rows = V.scored(t)
    folds = splits.fold_count(rows)
    return rows.groupBy("OS_EVENT").agg(F.count(F.lit(1)).alias("n")).withColumn("folds", F.lit(folds).cast("bigint"))
