"""Queries over patients of whom some have no cohort: they form a group of their own, as GROUP BY has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog import views as V
from hazardframe.catalog.clinical import rounded_all
from hazardframe.catalog.registry import Tables, query
from hazardframe.functions import scalars as S
from hazardframe.operators import cohort, genes, ordered, profile, splits

# Patients whose age is a multiple of five lose their cohort.
_M = """m AS (SELECT * REPLACE (CASE WHEN CAST("AGE" AS INTEGER) % 5 = 0 THEN NULL ELSE "CANCER_TYPE" END AS "CANCER_TYPE") FROM patient)"""


def _patients(t: Tables) -> DataFrame:
    cohort_known = F.when(F.col("AGE").cast("int") % 5 != 0, F.col("CANCER_TYPE"))
    return V.patient(t).withColumn("CANCER_TYPE", cohort_known)


@query(V.sql("patient", f"""with {_M}
SELECT "CANCER_TYPE", r6(quantile_cont("OS_MONTHS", 0.1);) AS p10, r6(quantile_cont("OS_MONTHS", 0.9);) AS p90 FROM m GROUP BY 1"""))
def quantiles_missing_cohort(t: Tables) -> DataFrame:
    return rounded_all(ordered.exact_quantiles(_patients(t), "OS_MONTHS", {"p10": 0.1, "p90": 0.9}, ["CANCER_TYPE"]))


@query(V.sql("patient", f"""with {_M},
b AS (SELECT "CANCER_TYPE", min("OS_MONTHS") AS lo, max("OS_MONTHS") AS hi FROM m GROUP BY 1),
frame AS (SELECT *, CAST(unnest(range(1, 11)) AS INTEGER) AS bin FROM b),
counts AS (SELECT m."CANCER_TYPE", CAST(least(10, 1 + floor(("OS_MONTHS" - lo) * 10 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n
           FROM m JOIN b ON m."CANCER_TYPE" IS NOT DISTINCT FROM b."CANCER_TYPE" GROUP BY 1, 2)
SELECT f."CANCER_TYPE", f.bin, r6(lo + (f.bin - 1) * ((hi - lo) / 10);) AS left_edge, coalesce(n, 0) AS n
FROM frame f LEFT JOIN counts c ON f."CANCER_TYPE" IS NOT DISTINCT FROM c."CANCER_TYPE" AND f.bin = c.bin"""))
def histogram_missing_cohort(t: Tables) -> DataFrame:
    return rounded_all(profile.histogram(_patients(t), "OS_MONTHS", 10, ["CANCER_TYPE"]))


@query(V.sql("patient", f"""with {_M},
q AS (SELECT "CANCER_TYPE", quantile_cont("OS_MONTHS", 0.25) AS q25, quantile_cont("OS_MONTHS", 0.5) AS q50,
      quantile_cont("OS_MONTHS", 0.75) AS q75 FROM m GROUP BY 1),
f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q)
SELECT f."CANCER_TYPE", r6(q25;) AS q25, r6(q50;) AS q50, r6(q75;) AS q75,
       r6(min("OS_MONTHS") FILTER (WHERE "OS_MONTHS" BETWEEN lo AND hi);) AS whisker_low,
       r6(max("OS_MONTHS") FILTER (WHERE "OS_MONTHS" BETWEEN lo AND hi);) AS whisker_high,
       count(*) FILTER (WHERE NOT ("OS_MONTHS" BETWEEN lo AND hi)) AS outliers
FROM m JOIN f ON m."CANCER_TYPE" IS NOT DISTINCT FROM f."CANCER_TYPE" GROUP BY 1, q25, q50, q75"""))
def box_stats_missing_cohort(t: Tables) -> DataFrame:
    return rounded_all(profile.box_stats(_patients(t), "OS_MONTHS", ["CANCER_TYPE"]))


@query(V.sql("patient", f"""with {_M}
SELECT "CANCER_TYPE", count(*) AS n, CAST(sum("OS_EVENT") AS BIGINT) AS events, r6(avg("OS_EVENT");) AS event_rate,
       r6(median("OS_MONTHS");) AS median_os_months FROM m GROUP BY 1"""))
def outcome_missing_cohort(t: Tables) -> DataFrame:
    return rounded_all(cohort.outcome_by_group(_patients(t)))


@query(V.sql("patient", f"""with {_M},
n AS (SELECT "PATIENT_ID", "CANCER_TYPE",
        row_number() OVER (PARTITION BY "CANCER_TYPE" ORDER BY md5('42|' || CAST("PATIENT_ID" AS VARCHAR)), "PATIENT_ID") - 1 AS pos,
        count(*) OVER (PARTITION BY "CANCER_TYPE") AS total FROM m)
SELECT "PATIENT_ID", CAST(pos % 5 AS INTEGER) AS fold,
       CASE WHEN pos < round(total * 0.6) THEN 'train' WHEN pos < round(total * (0.6 + 0.2)) THEN 'calibration' ELSE 'test' END AS split FROM n"""))
def folds_missing_cohort(t: Tables) -> DataFrame:
    folded = splits.stratified_folds(_patients(t), "PATIENT_ID", ["CANCER_TYPE"])
    return splits.three_way_split(folded, "PATIENT_ID", ["CANCER_TYPE"]).select("PATIENT_ID", "fold", "split")


# Calls whose sample number is a multiple of seven, and vectors of cohort 3, have no cohort.
_CALLS = """m AS (SELECT * REPLACE (CASE WHEN CAST("Tumor_Sample_Barcode" AS BIGINT) % 7 <> 0 THEN "CANCER_TYPE" END AS "CANCER_TYPE") FROM mutation)"""
_VECTORS = """m AS (SELECT sample_id, CASE WHEN cohort <> 3 THEN cohort END AS cohort, gene, log2(value + 1) AS value FROM expression_long)"""


def _calls(t: Tables) -> DataFrame:
    known = F.col("Tumor_Sample_Barcode").cast("bigint") % 7 != 0
    return V.mutation(t).withColumn("CANCER_TYPE", F.when(known, F.col("CANCER_TYPE")))


def _vectors(t: Tables) -> DataFrame:
    return V.expression_long(t).withColumns({"cohort": F.when(F.col("cohort") != 3, F.col("cohort")), "value": S.log2_plus_one("value")})


@query(V.sql("mutation", f"""with {_CALLS}
SELECT "CANCER_TYPE", r6(quantile_cont(c, 0.5);) AS median_burden, r6(avg(c);) AS mean_burden, max(c) AS max_burden
FROM (SELECT "Tumor_Sample_Barcode", "CANCER_TYPE", count(*) AS c FROM m GROUP BY 1, 2) z GROUP BY 1"""))
def burden_missing_cohort(t: Tables) -> DataFrame:
    return rounded_all(cohort.burden_summary(_calls(t)))


@query(V.sql("mutation", f"""with {_CALLS},
top AS (SELECT "Hugo_Symbol" FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
n AS (SELECT "CANCER_TYPE", count(DISTINCT "Tumor_Sample_Barcode") AS n FROM m GROUP BY 1)
SELECT "Hugo_Symbol", m."CANCER_TYPE", r6(count(DISTINCT "Tumor_Sample_Barcode") / max(n.n) * 100;) AS frequency_pct
FROM m JOIN n ON m."CANCER_TYPE" IS NOT DISTINCT FROM n."CANCER_TYPE" WHERE "Hugo_Symbol" IN (SELECT "Hugo_Symbol" FROM top) GROUP BY 1, 2"""))
def mutation_frequency_missing_cohort(t: Tables) -> DataFrame:
    return rounded_all(genes.mutation_frequency(_calls(t)))


@query(V.sql("expression_long", f"""with {_VECTORS},
s AS (SELECT sample_id, cohort, quantile_cont(value, 0.5) AS median_value FROM m GROUP BY 1, 2)
SELECT s.sample_id, s.cohort, r6(median_value;) AS median_value, r6(o.overall;) AS overall_median
FROM s JOIN (SELECT cohort, quantile_cont(median_value, 0.5) AS overall FROM s GROUP BY 1) o ON s.cohort IS NOT DISTINCT FROM o.cohort"""))
def sample_median_missing_cohort(t: Tables) -> DataFrame:
    rows = _vectors(t)
    return rounded_all(ordered.join_on(genes.sample_medians(rows), genes.median_of_medians(rows), ["cohort"]))


@query(V.sql("expression_long", f"""with {_VECTORS},
top AS (SELECT cohort, gene FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY var_samp(value) DESC, gene) <= 12),
listed AS (SELECT m.* FROM m JOIN top ON m.cohort IS NOT DISTINCT FROM top.cohort AND m.gene = top.gene WHERE NOT (m.gene = 'G05' AND sample_id % 3 = 0))
SELECT a.cohort, a.gene AS gene_a, b.gene AS gene_b, r6(corr(a.value, b.value);) AS r
FROM listed a JOIN listed b ON a.sample_id = b.sample_id AND a.gene < b.gene GROUP BY 1, 2, 3"""))
def cohort_corr_missing_cohort(t: Tables) -> DataFrame:
    """A cohort without a name; in each cohort the variances come from all values, pairs from those known on both sides."""
    rows = _vectors(t)
    top = genes.top_variable_genes_by_cohort(rows, 12).select("cohort", "gene")
    listed = ordered.join_on(rows, top, ["cohort", "gene"])
    gap = (F.col("gene") == "G05") & (F.col("sample_id") % 3 == 0)
    return rounded_all(genes.cohort_correlations(listed.withColumn("value", F.when(~gap, F.col("value"))), 12))
