"""Association tests, false-discovery control, correlation and collinearity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog import views as V
from hazardframe.catalog.clinical import rounded_all
from hazardframe.catalog.registry import Tables, query
from hazardframe.operators import association, collinearity, ordered

_LONG = """long AS (SELECT 'AGE' AS feature, "AGE" AS value, "OS_EVENT" AS event FROM endpoint
UNION ALL SELECT 'OS_MONTHS', "OS_MONTHS", "OS_EVENT" FROM endpoint
UNION ALL SELECT 'ACCTBAL', CASE WHEN "PATIENT_ID" % 9 <> 0 THEN round("ACCTBAL" / 500) END, "OS_EVENT" FROM endpoint)"""


def _audit_rows(t: Tables) -> DataFrame:
    balance = F.when(F.col("PATIENT_ID") % 9 != 0, F.round(F.col("ACCTBAL") / 500))
    region = F.when(F.col("PATIENT_ID") % 11 != 0, (F.col("PATIENT_ID") % 7).cast("string"))
    return V.endpoint(t).select("AGE", "OS_MONTHS", balance.alias("ACCTBAL"), "SEX", "CANCER_TYPE", region.alias("region"), "OS_EVENT")


@query(V.sql("endpoint", f"""with {_LONG},
known AS (SELECT * FROM long WHERE value IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM known)
SELECT feature, count(*) FILTER (WHERE event = 0) AS n0, count(*) FILTER (WHERE event = 1) AS n1,
       r6(sum(r) FILTER (WHERE event = 0) - count(*) FILTER (WHERE event = 0) * (count(*) FILTER (WHERE event = 0) + 1) / 2;) AS statistic,
       r6(2 * (sum(r) FILTER (WHERE event = 0) - count(*) FILTER (WHERE event = 0) * (count(*) FILTER (WHERE event = 0) + 1) / 2)
             / (count(*) FILTER (WHERE event = 0) * count(*) FILTER (WHERE event = 1)) - 1;) AS effect_size,
       r6(quantile_cont(value, 0.5) FILTER (WHERE event = 0);) AS median_event0, r6(quantile_cont(value, 0.5) FILTER (WHERE event = 1);) AS median_event1
FROM ranked GROUP BY 1"""))
def mann_whitney(t: Tables) -> DataFrame:
    long = ordered.unpivot_numbers(_audit_rows(t), ["AGE", "OS_MONTHS", "ACCTBAL"], ["OS_EVENT"])
    tests = association.mann_whitney(long, "OS_EVENT")
    return rounded_all(tests.drop("type", "p_value"))


_CELLS = """cells AS (SELECT 'SEX' AS feature, "SEX" AS value, "OS_EVENT" AS e FROM endpoint
UNION ALL SELECT 'CANCER_TYPE', "CANCER_TYPE", "OS_EVENT" FROM endpoint
UNION ALL SELECT 'region', CASE WHEN "PATIENT_ID" % 11 <> 0 THEN CAST("PATIENT_ID" % 7 AS VARCHAR) ELSE 'NA' END, "OS_EVENT" FROM endpoint),
obs AS (SELECT feature, value, e, count(*) AS o FROM cells GROUP BY 1, 2, 3),
full_grid AS (SELECT v.feature, v.value, g.e, coalesce(o.o, 0) AS o FROM (SELECT DISTINCT feature, value FROM cells) v CROSS JOIN (VALUES (0), (1)) g(e)
         LEFT JOIN obs o ON o.feature = v.feature AND o.value = v.value AND o.e = g.e),
ex AS (SELECT *, CAST(sum(o) OVER (PARTITION BY feature, value) AS DOUBLE) * sum(o) OVER (PARTITION BY feature, e) / sum(o) OVER (PARTITION BY feature) AS x,
              sum(o) OVER (PARTITION BY feature) AS n, count(*) OVER (PARTITION BY feature) / 2 AS k FROM full_grid)"""


@query(V.sql("endpoint", f"""with {_CELLS}
SELECT feature, CAST(sum(o) FILTER (WHERE e = 0) AS BIGINT) AS n0, CAST(sum(o) FILTER (WHERE e = 1) AS BIGINT) AS n1,
       r6(sum(pow(abs(o - x) - CASE WHEN k = 2 THEN least(0.5, abs(o - x)) ELSE 0 END, 2) / x);) AS statistic FROM ex GROUP BY 1"""))
def chi_square(t: Tables) -> DataFrame:
    counts = association.category_counts(_audit_rows(t), ["SEX", "CANCER_TYPE", "region"])
    return rounded_all(association.chi_square(counts).select("feature", "n0", "n1", "statistic"))


@query(V.sql("endpoint", f"""with {_CELLS}
SELECT feature, r6(sqrt(sum(pow(o - x, 2) / x) / max(n));) AS cramers_v FROM ex GROUP BY 1"""))
def cramers_v(t: Tables) -> DataFrame:
    counts = association.category_counts(_audit_rows(t), ["SEX", "CANCER_TYPE", "region"])
    return rounded_all(association.chi_square(counts).select("feature", F.col("effect_size").alias("cramers_v")))


def omic_scan_rows(t: Tables) -> DataFrame:
    """Expression values with the follow-up of the patient of the same number; a few values are missing."""
    months = V.endpoint(t).select(F.col("PATIENT_ID").alias("sample_id"), F.col("OS_MONTHS").alias("time"))
    # Joined while a sample is one row, before its genes become rows.
    vectors = t("embeddings").select(F.col("vec_id").alias("sample_id"), "embedding").join(months, "sample_id")
    long = vectors.select("sample_id", "time", F.posexplode("embedding").alias("pos", "x"))
    gap = (F.col("pos") == 3) & (F.col("sample_id") % 7 == 0)
    return long.select(
        "sample_id", "time", F.format_string("EXPR_G%02d", "pos").alias("feature"),
        F.when(~gap, F.round(F.abs(F.col("x").cast("double")) * 100, 1)).alias("value"),
    )


@query(V.sql("endpoint expression_long", """with rows AS (
  SELECT 'EXPR_' || gene AS feature, round(value, 1) AS value, "OS_MONTHS" AS time FROM expression_long JOIN endpoint ON sample_id = "PATIENT_ID"
  WHERE NOT (gene = 'G03' AND sample_id % 7 = 0)),
ranked AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY feature ORDER BY time) + (count(*) OVER (PARTITION BY feature, time) - 1) / 2.0 AS ry FROM rows)
SELECT feature, count(*) AS n, r6(corr(rx, ry);) AS spearman_rho FROM ranked GROUP BY 1"""))
def spearman(t: Tables) -> DataFrame:
    return rounded_all(association.spearman(omic_scan_rows(t)).drop("p_value"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_discount * l_tax * 10 + l_quantity / 1000, 4) END AS p_value FROM lineitem),
ranked AS (SELECT *, coalesce(p_value, 1.0) AS pf, row_number() OVER (ORDER BY coalesce(p_value, 1.0)) AS rk, count(*) OVER () AS m FROM p),
adj AS (SELECT *, min(pf * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM ranked)
SELECT round(pf, 6) AS p_filled, count(*) AS n, round(least(max(q), 1.0), 6) AS q_max, round(least(min(q), 1.0), 6) AS q_min FROM adj GROUP BY 1""")
def bh_adjust(t: Tables) -> DataFrame:
    """False-discovery adjustment over one p-value per line item."""
    raw = F.round(F.col("l_discount") * F.col("l_tax") * 10 + F.col("l_quantity") / 1000, 4)
    tests = t("lineitem").select(F.when(F.col("l_linenumber") != 7, raw).alias("p_value"))
    adjusted = association.adjust_false_discovery(tests)
    return rounded_all(adjusted.groupBy(F.coalesce("p_value", F.lit(1.0)).alias("p_filled")).agg(
        F.count(F.lit(1)).alias("n"), F.max("q_value_bh").alias("q_max"), F.min("q_value_bh").alias("q_min")
    ))


@query()
def univariate_audit(t: Tables) -> DataFrame:
    """All columns against the outcome, with p and q values."""
    rows = _audit_rows(t)
    return rounded_all(association.univariate_tests(rows, ["AGE", "OS_MONTHS", "ACCTBAL"], ["SEX", "CANCER_TYPE", "region"]))


@query()
def omics_scan(t: Tables) -> DataFrame:
    """Rank correlation of every gene with follow-up, with p and q values."""
    return rounded_all(association.omics_spearman(omic_scan_rows(t)))


def feature_matrix(t: Tables) -> tuple[DataFrame, list[str]]:
    """The 64 genes with a few missing values and two derived, nearly collinear features."""
    wide = V.expression_matrix(t)
    gap = F.col("sample_id") % 7 == 0
    wide = wide.withColumns(
        {"G03": F.when(~gap, F.col("G03")), "H0": 2 * F.col("G00") + 1, "H1": F.col("G00") + 0.1 * F.col("G01")}
    )
    return wide, [c for c in wide.columns if c[0] in "GH"]


_FEATURES = """feats AS (SELECT sample_id, gene AS f, value FROM expression_long WHERE NOT (gene = 'G03' AND sample_id % 7 = 0)
UNION ALL SELECT sample_id, 'H0', 2 * value + 1 FROM expression_long WHERE gene = 'G00'
UNION ALL SELECT a.sample_id, 'H1', a.value + CAST(0.1 AS DOUBLE) * b.value FROM expression_long a JOIN expression_long b ON a.sample_id = b.sample_id AND b.gene = 'G01' WHERE a.gene = 'G00'),
pairs AS (SELECT a.f AS f1, b.f AS f2, corr(a.value, b.value) AS r FROM feats a JOIN feats b ON a.sample_id = b.sample_id AND a.f < b.f GROUP BY 1, 2)"""


@query(V.sql("expression_long", f"""with {_FEATURES} SELECT f1, f2, r6(r;) AS r FROM pairs"""))
def corr_pairs(t: Tables) -> DataFrame:
    return rounded_all(collinearity.correlation_pairs(*feature_matrix(t)).select("f1", "f2", "r"))


@query(V.sql("expression_long", f"""with {_FEATURES} SELECT f1, f2, r6(r;) AS r FROM pairs WHERE abs(r) > 0.12 AND abs(r) < 0.9999999"""))
def strong_corr(t: Tables) -> DataFrame:
    pairs = collinearity.correlation_pairs(*feature_matrix(t))
    return rounded_all(collinearity.strong_pairs(pairs, 0.12, 0.9999999).select("f1", "f2", "r"))


@query(V.sql("expression_long", f"""with {_FEATURES} SELECT f1 AS feature_a, f2 AS feature_b, r6(abs(r);) AS abs_correlation FROM pairs
WHERE abs(r) > 0.1 ORDER BY abs(r) DESC, f1, f2 LIMIT 20"""))
def top_corr_preview(t: Tables) -> DataFrame:
    return rounded_all(collinearity.top_pairs(collinearity.correlation_pairs(*feature_matrix(t)), 0.1))


@query(V.sql("expression_long", f"""with {_FEATURES},
best AS (SELECT *, row_number() OVER (PARTITION BY f2 ORDER BY round(abs(r), 12) DESC, f1) AS rn FROM pairs WHERE abs(r) > 0.1)
SELECT 'expression' AS "group", f2 AS feature_dropped, f1 AS anchor_feature, r6(abs(r);) AS abs_correlation, CAST(0.1 AS DOUBLE) AS threshold,
       'full_correlation_matrix' AS method FROM best WHERE rn = 1"""))
def collinear_drop(t: Tables) -> DataFrame:
    _, table, _ = collinearity.drop_collinear(*feature_matrix(t), 0.1)
    return rounded_all(table)


_LEVELS = [0.05, 0.10, 0.15, 0.75, 0.95, 1.0]


@query(V.sql("expression_long", f"""with {_FEATURES},
levels AS (SELECT CAST(unnest([0.05, 0.10, 0.15, 0.75, 0.95, 1.0]) AS DOUBLE) AS threshold),
hits AS (SELECT l.threshold, f2, count(*) FILTER (WHERE least(abs(r), 1.0) > l.threshold) AS n FROM pairs, levels l GROUP BY 1, 2)
SELECT threshold, CAST(sum(n) AS BIGINT) AS n_pairs_above_threshold, count(*) FILTER (WHERE n > 0) AS n_dropped, 66 - count(*) FILTER (WHERE n > 0) AS n_kept
FROM hits GROUP BY 1"""))
def collinear_sweep(t: Tables) -> DataFrame:
    frame, columns = feature_matrix(t)
    return collinearity.sweep(collinearity.correlation_pairs(frame, columns), _LEVELS, len(columns))


@query(V.sql("expression_long", """with known AS (SELECT sample_id, gene AS f, value FROM expression_long WHERE NOT (gene = 'G03' AND sample_id % 7 = 0)),
filled AS (SELECT * FROM known UNION ALL SELECT sample_id, gene, (SELECT quantile_cont(value, 0.5) FROM known WHERE f = 'G03') FROM expression_long WHERE gene = 'G03' AND sample_id % 7 = 0
UNION ALL SELECT sample_id, 'H0', 2 * value + 1 FROM expression_long WHERE gene = 'G00'
UNION ALL SELECT a.sample_id, 'H1', a.value + CAST(0.1 AS DOUBLE) * b.value FROM expression_long a JOIN expression_long b ON a.sample_id = b.sample_id AND b.gene = 'G01' WHERE a.gene = 'G00'),
numbered AS (SELECT f, row_number() OVER (ORDER BY f) AS k FROM (SELECT DISTINCT f FROM filled) z),
cells AS (SELECT n.k, x.sample_id, x.f, x.value FROM filled x JOIN numbered n ON x.f = n.f),
pairs AS (SELECT a.k AS i, b.k AS j, any_value(a.f) AS f1, any_value(b.f) AS f2, abs(corr(a.value, b.value)) AS r FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.k < b.k GROUP BY 1, 2),
lines AS (SELECT j, list(r ORDER BY i) AS r FROM pairs GROUP BY 1),
turns AS (SELECT CAST(1 AS BIGINT) AS k, [CAST(1 AS BIGINT)] AS kept
  UNION ALL SELECT t.k + 1, CASE WHEN len(list_filter(t.kept, lambda x: l.r[x] > 0.1)) > 0 THEN t.kept ELSE list_append(t.kept, t.k + 1) END FROM turns t JOIN lines l ON l.j = t.k + 1),
final AS (SELECT kept FROM turns ORDER BY k DESC LIMIT 1),
best AS (SELECT p.*, row_number() OVER (PARTITION BY j ORDER BY round(r, 12) DESC, i) AS rn FROM pairs p, final WHERE NOT list_contains(kept, j) AND list_contains(kept, i))
SELECT 'expression' AS "group", f2 AS feature_dropped, f1 AS anchor_feature, r6(r;) AS abs_correlation, CAST(0.1 AS DOUBLE) AS threshold,
       'incremental_against_kept' AS method FROM best WHERE rn = 1""").replace("WITH", "WITH RECURSIVE", 1))
def collinear_greedy(t: Tables) -> DataFrame:
    """Greedy filter against kept features, by tiles of 24 columns."""
    _, table, _ = collinearity.drop_collinear(*feature_matrix(t), 0.1, method="incremental", tile=24)
    return rounded_all(table)
