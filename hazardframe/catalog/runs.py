"""Whole runs and comparisons between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog import models as MD
from hazardframe.catalog import samples as SM
from hazardframe.catalog import views as V
from hazardframe.catalog.clinical import rounded_all
from hazardframe.catalog.registry import Tables, query
from hazardframe.operators import clean, profile
from hazardframe.plans import feature_tables, modelling, tuning
from hazardframe.schema import ID_COLUMNS, TARGET_COLUMNS
from hazardframe.sources import writers

# Two result tables derived from the orders: priorities play the part of experiments, discounted prices of scores.
_RUNS_SQL = """old_run AS (SELECT o_orderpriority AS experiment, avg(o_totalprice) / 500000 AS mean_c_index FROM orders GROUP BY 1),
new_run AS (SELECT o_orderpriority AS experiment, avg(o_totalprice) / 500000 AS mean_c_index FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""


def _run(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderpriority").alias("experiment")).agg((F.avg("o_totalprice") / 500000).alias("mean_c_index"))


@query(V.sql("patient", f"""with {_RUNS_SQL}
SELECT o.experiment, r6(o.mean_c_index;) AS mean_c_index_old, r6(n.mean_c_index;) AS mean_c_index_cleaned, r6(n.mean_c_index - o.mean_c_index;) AS delta_mean_c_index
FROM old_run o JOIN new_run n ON o.experiment = n.experiment"""))
def run_comparison(t: Tables) -> DataFrame:
    orders = t("orders")
    return rounded_all(tuning.compare_runs(_run(orders), _run(orders.where("o_orderstatus <> 'P'"))))


_SWEEP_SQL = """runs AS (SELECT CAST(l_linenumber AS DOUBLE) / 10 AS threshold, avg(l_discount) AS c_index_test, avg(l_tax) AS coverage_test_events_only,
  avg(l_quantity) AS mean_interval_width_months_test, CASE WHEN l_linenumber = 2 THEN 'failed' ELSE 'completed' END AS status FROM lineitem GROUP BY l_linenumber),
done AS (SELECT * FROM runs WHERE status = 'completed'),
base AS (SELECT * FROM done ORDER BY threshold DESC LIMIT 1)"""


def _runs(t: Tables) -> DataFrame:
    status = F.when(F.col("l_linenumber") == 2, "failed").otherwise("completed")
    return t("lineitem").groupBy((F.col("l_linenumber").cast("double") / 10).alias("threshold"), status.alias("status")).agg(
        F.avg("l_discount").alias("c_index_test"), F.avg("l_tax").alias("coverage_test_events_only"),
        F.avg("l_quantity").alias("mean_interval_width_months_test"),
    )


@query(V.sql("patient", f"""with {_SWEEP_SQL}
SELECT d.threshold, d.status, r6(d.c_index_test;) AS c_index_test, r6(d.coverage_test_events_only;) AS coverage_test_events_only,
       r6(d.mean_interval_width_months_test;) AS mean_interval_width_months_test, r6(d.c_index_test - b.c_index_test;) AS delta_test_c_index_vs_no_drop,
       r6(d.coverage_test_events_only - b.coverage_test_events_only;) AS delta_coverage_vs_no_drop,
       r6(d.mean_interval_width_months_test - b.mean_interval_width_months_test;) AS delta_width_vs_no_drop FROM done d CROSS JOIN base b"""))
def baseline_delta(t: Tables) -> DataFrame:
    return rounded_all(modelling.against_baseline(_runs(t)))


@query(V.sql("patient", f"""with {_SWEEP_SQL},
picks AS (SELECT *, 'c_index_test' AS best_by, row_number() OVER (ORDER BY c_index_test DESC, threshold DESC) AS rn FROM done
UNION ALL SELECT *, 'mean_interval_width_months_test', row_number() OVER (ORDER BY mean_interval_width_months_test, threshold DESC) FROM done)
SELECT best_by, threshold, r6(c_index_test;) AS c_index_test FROM picks WHERE rn = 1"""))
def best_run(t: Tables) -> DataFrame:
    done = _runs(t).where("status = 'completed'")
    return rounded_all(modelling.best_runs(done).select("best_by", "threshold", "c_index_test"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders""")
def column_pruning(t: Tables) -> DataFrame:
    kept, _, _ = clean.drop_listed(t("orders"), ["o_totalprice", "o_orderdate", "o_orderpriority", "TUMOR_SITE"])
    return kept


@query("""SELECT 'orders.parquet' AS source_file, count(*) AS "rows", CAST(6 AS BIGINT) AS before_columns, CAST(3 AS BIGINT) AS after_columns,
CAST(3 AS BIGINT) AS dropped_count, 'o_totalprice,o_orderdate,o_orderpriority' AS dropped, 'TUMOR_SITE' AS absent FROM orders""")
def cleaning_manifest(t: Tables) -> DataFrame:
    orders = t("orders")
    pruned, dropped, absent = clean.drop_listed(orders, ["o_totalprice", "o_orderdate", "o_orderpriority", "TUMOR_SITE"])
    record = writers.manifest_record(orders, pruned, "orders.parquet", "orders_cleaned.parquet", dropped, absent)
    files = writers.manifest(t.spark, "in", "out", [record]).select(F.explode("files").alias("f")).select("f.*")
    return files.select(
        "source_file", "rows", "before_columns", "after_columns", "dropped_count",
        F.array_join("dropped_columns", ",").alias("dropped"), F.array_join("declared_but_missing_columns", ",").alias("absent"),
    )


@query()
def column_manifest(t: Tables) -> DataFrame:
    """Columns of the patient table by role."""
    return profile.column_groups(SM.multiomic_table(t), ID_COLUMNS, TARGET_COLUMNS)


@query(V.sql("patient", """
WITH capped AS (SELECT *, quantile_cont("OS_MONTHS", 0.99) OVER () AS cap FROM patient)
SELECT "PATIENT_ID", r6(least("OS_MONTHS", cap);) AS "OS_MONTHS", "OS_EVENT", CASE WHEN "OS_EVENT" = 1 THEN 'Deceased' ELSE 'Living' END AS "Status",
       CASE WHEN "AGE" <= 40 THEN '≤40' WHEN "AGE" <= 55 THEN '41-55' WHEN "AGE" <= 65 THEN '56-65' WHEN "AGE" <= 75 THEN '66-75' ELSE '>75' END AS "AGE_GROUP",
       CASE WHEN "PATIENT_ID" % 5 = 0 THEN 'Unknown' ELSE "SEX" END AS "SEX", r6(coalesce(CASE WHEN "PATIENT_ID" % 4 <> 0 THEN "ACCTBAL" END,
         (SELECT quantile_cont("ACCTBAL", 0.5) FROM patient WHERE "PATIENT_ID" % 4 <> 0));) AS "ACCTBAL"
FROM capped"""))
def clinical_cleaning(t: Tables) -> DataFrame:
    """The cleaning chain on raw patients with gaps and a sparse column."""
    number = F.col("PATIENT_ID")
    raw = V.patient(t).select(
        "PATIENT_ID", "CANCER_TYPE", "AGE", F.when(number % 5 != 0, F.col("SEX")).alias("SEX"), "OS_STATUS", "OS_MONTHS",
        F.when(number % 4 != 0, F.col("ACCTBAL")).alias("ACCTBAL"), F.when(number % 10 == 0, F.col("AGE")).alias("RARE"),
    )
    out = feature_tables.clean_clinical(raw, ["AGE", "OS_MONTHS", "ACCTBAL"])
    return rounded_all(out.select("PATIENT_ID", "OS_MONTHS", "OS_EVENT", "Status", "AGE_GROUP", "SEX", "ACCTBAL"))


@query()
def model_run(t: Tables) -> DataFrame:
    """Endpoint, outlier fences, split, collinearity filter, fit at a fixed penalty, intervals: predictions of all rows."""
    rows, _ = modelling.prepare_rows(MD.model_rows(t))
    run = modelling.train_and_calibrate(rows, ["AGE", "SEX", "CANCER_TYPE"], penalty=(3.0, 0.7), horizon_tables=False)
    return rounded_all(run.predictions)


@query()
def threshold_sweep(t: Tables) -> DataFrame:
    """Model runs at all five collinearity thresholds, after the outlier fences."""
    rows, _ = modelling.prepare_rows(MD.model_rows(t))
    return rounded_all(modelling.threshold_sweep(rows, ["AGE", "SEX", "CANCER_TYPE"]))

