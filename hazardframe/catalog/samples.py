"""Sample choice, survival intervals, mutation, expression and copy-number queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog import views as V
from hazardframe.catalog.clinical import rounded_all
from hazardframe.catalog.registry import Tables, query
from hazardframe.functions import scalars as S
from hazardframe.operators import clean, cohort, genes, intervals, profile
from hazardframe.operators.ordered import join_on
from hazardframe.plans import feature_tables
from hazardframe.schema import CNA, EXPR
from hazardframe.session import cut_lineage


@query(V.sql("sample", """
SELECT "PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE" FROM (
  SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID" ORDER BY "SAMPLE_ID") AS rn FROM sample_metadata WHERE "IS_PRIMARY") z
WHERE rn = 1"""))
def primary_sample(t: Tables) -> DataFrame:
    return cohort.primary_samples(V.sample_metadata(t))


@query(V.sql("sample", """
SELECT "PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE" FROM (
  SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID" ORDER BY "SAMPLE_ID") AS rn FROM sample_metadata
  WHERE "PATIENT_ID" NOT IN (SELECT "PATIENT_ID" FROM sample_metadata WHERE "IS_PRIMARY")) z
WHERE rn = 1"""))
def fallback_sample(t: Tables) -> DataFrame:
    return cohort.fallback_samples(V.sample_metadata(t), V.patient(t))


@query(V.sql("sample", """
SELECT "PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE", NOT "IS_PRIMARY" AS "IS_FALLBACK" FROM (
  SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID" ORDER BY "IS_PRIMARY" DESC, "SAMPLE_ID") AS rn FROM sample_metadata) z
WHERE rn = 1"""))
def selected_sample(t: Tables) -> DataFrame:
    return cohort.selected_samples(V.sample_metadata(t), V.patient(t))


@query(V.sql("sample", """
WITH chosen AS (SELECT "CANCER_TYPE", "IS_PRIMARY" FROM (
  SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID" ORDER BY "IS_PRIMARY" DESC, "SAMPLE_ID") AS rn FROM sample_metadata) z WHERE rn = 1)
SELECT "CANCER_TYPE", count(*) FILTER (WHERE "IS_PRIMARY") AS "primary", count(*) FILTER (WHERE NOT "IS_PRIMARY") AS fallback
FROM chosen GROUP BY 1"""))
def selection_by_cohort(t: Tables) -> DataFrame:
    chosen = cohort.selected_samples(V.sample_metadata(t), V.patient(t))
    return profile.crosstab(chosen, "CANCER_TYPE", "IS_FALLBACK", [False, True], ["primary", "fallback"])


@query(V.sql("sample", """
SELECT "PATIENT_ID", "SAMPLE_ID_NORM", "CANCER_TYPE", "SAMPLE_DAY", "SAMPLE_ID" FROM (
  SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID", "SAMPLE_TYPE_CODE", "CANCER_TYPE" ORDER BY "SAMPLE_DAY", "SAMPLE_ID") AS rn
  FROM sample_metadata) z WHERE rn = 1"""))
def dedupe_keep_first(t: Tables) -> DataFrame:
    kept = cohort.first_row(V.sample_metadata(t), ["PATIENT_ID", "SAMPLE_TYPE_CODE", "CANCER_TYPE"], ["SAMPLE_DAY", "SAMPLE_ID"])
    return kept.select("PATIENT_ID", "SAMPLE_ID_NORM", "CANCER_TYPE", "SAMPLE_DAY", "SAMPLE_ID")


@query("""
SELECT count(*) AS "rows", count(DISTINCT (l_orderkey, l_suppkey)) AS distinct_keys,
       count(*) - count(DISTINCT (l_orderkey, l_suppkey)) AS duplicates FROM lineitem""")
def duplicate_counts(t: Tables) -> DataFrame:
    return cohort.duplicate_counts(t("lineitem"), ["l_orderkey", "l_suppkey"])


@query(V.sql("sample endpoint", """
SELECT s."PATIENT_ID", s."SAMPLE_ID", s."CANCER_TYPE", "SAMPLE_DAY", "OS_DAYS", "OS_EVENT"
FROM sample_metadata s JOIN endpoint e ON s."PATIENT_ID" = e."PATIENT_ID" AND s."CANCER_TYPE" = e."CANCER_TYPE" """))
def sample_patient_join(t: Tables) -> DataFrame:
    patients = V.endpoint(t).select("PATIENT_ID", "CANCER_TYPE", "OS_DAYS", "OS_EVENT")
    joined = V.sample_metadata(t).join(patients, ["PATIENT_ID", "CANCER_TYPE"])
    return joined.select("PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE", "SAMPLE_DAY", "OS_DAYS", "OS_EVENT")


@query(V.sql("sample endpoint", """
SELECT s."SAMPLE_ID", "SAMPLE_DAY", r6("OS_DAYS" * 0.8;) AS "OS_DAYS"
FROM sample_metadata s JOIN endpoint e ON s."PATIENT_ID" = e."PATIENT_ID"
WHERE "SAMPLE_DAY" <= "OS_DAYS" * CAST(0.8 AS DOUBLE) + 1e-6"""))
def post_outcome_filter(t: Tables) -> DataFrame:
    patients = V.endpoint(t).select("PATIENT_ID", (F.col("OS_DAYS") * 0.8).alias("OS_DAYS"))
    kept = cohort.drop_post_outcome(V.sample_metadata(t).join(patients, "PATIENT_ID"))
    return rounded_all(kept.select("SAMPLE_ID", "SAMPLE_DAY", "OS_DAYS"))


# Follow-up is shortened and the samples of two patients in three are moved later, so that samples after the outcome,
# patients without a usable sample, and patients whose first sample is late all occur.
_PATIENT_SQL = """patients AS (SELECT "PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", "OS_DAYS" * CAST(0.8 AS DOUBLE) AS "OS_DAYS", "OS_EVENT" FROM endpoint),
samples AS (SELECT s."PATIENT_ID", s."CANCER_TYPE", s.o_orderkey, s."SAMPLE_ID", s."SAMPLE_ID_NORM", s."SAMPLE_TYPE_CODE", s."IS_PRIMARY",
                   s."SAMPLE_DAY" + 400 * (s."PATIENT_ID" % 3) AS "SAMPLE_DAY"
            FROM sample_metadata s),
burden AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1),
kept AS (SELECT s.*, coalesce(b.c, 0) AS "MUTATION_BURDEN" FROM samples s JOIN patients p ON s."PATIENT_ID" = p."PATIENT_ID"
         LEFT JOIN burden b ON b.l_orderkey = s.o_orderkey WHERE "SAMPLE_DAY" <= "OS_DAYS" + 1e-6),
filled AS (SELECT p."PATIENT_ID", p."CANCER_TYPE", p."OS_DAYS", k."SAMPLE_ID", k."SAMPLE_ID_NORM", coalesce("SAMPLE_TYPE_CODE", '00') AS "SAMPLE_TYPE_CODE",
                  coalesce("IS_PRIMARY", false) AS "IS_PRIMARY", coalesce("SAMPLE_DAY", 0) AS "SAMPLE_DAY", coalesce("MUTATION_BURDEN", 0) AS "MUTATION_BURDEN"
           FROM patients p LEFT JOIN kept k ON p."PATIENT_ID" = k."PATIENT_ID"),
daily AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID", "SAMPLE_DAY" ORDER BY "SAMPLE_ID_NORM" NULLS LAST, "SAMPLE_ID") AS rn FROM filled) z WHERE rn = 1),
anchors AS (SELECT "PATIENT_ID", "CANCER_TYPE", "OS_DAYS", CAST(NULL AS VARCHAR) AS "SAMPLE_ID", CAST(NULL AS VARCHAR) AS "SAMPLE_ID_NORM", '00' AS "SAMPLE_TYPE_CODE", false AS "IS_PRIMARY",
                   CAST(0 AS DOUBLE) AS "SAMPLE_DAY", "MUTATION_BURDEN"
            FROM (SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID" ORDER BY "SAMPLE_DAY") AS rn FROM daily) z WHERE rn = 1 AND "SAMPLE_DAY" > 0),
anchored AS (SELECT * FROM daily UNION ALL SELECT * FROM anchors),
clipped AS (SELECT *, least(greatest("SAMPLE_DAY", 0), greatest("OS_DAYS" - 1e-6, 1e-6)) AS d FROM anchored),
spans AS (SELECT c.*, row_number() OVER w - 1 AS idx, lead(d) OVER w AS nxt, p."OS_EVENT", p."AGE", p."SEX"
          FROM clipped c JOIN patients p ON c."PATIENT_ID" = p."PATIENT_ID"
          WINDOW w AS (PARTITION BY c."PATIENT_ID" ORDER BY d, "SAMPLE_DAY"))"""


def interval_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    patients = V.endpoint(t).select(
        "PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", (F.col("OS_DAYS") * 0.8).alias("OS_DAYS"), "OS_EVENT"
    )
    burden = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("MUTATION_BURDEN"))
    samples = V.sample_metadata(t).withColumn("SAMPLE_DAY", F.col("SAMPLE_DAY") + 400 * (F.col("PATIENT_ID") % 3))
    kept = cohort.drop_post_outcome(samples.join(patients.select("PATIENT_ID", "OS_DAYS"), "PATIENT_ID"))
    kept = kept.join(burden, "o_orderkey", "left").withColumn("MUTATION_BURDEN", F.coalesce("MUTATION_BURDEN", F.lit(0)))
    return patients, kept.drop("OS_DAYS")


def interval_table(t: Tables) -> DataFrame:
    return intervals.survival_intervals(*interval_inputs(t), covariates=["AGE", "SEX"])


@query(V.sql("sample endpoint", f"""with {_PATIENT_SQL}
SELECT "PATIENT_ID", "CANCER_TYPE", CAST(idx AS INTEGER) AS "INTERVAL_INDEX", r6(d;) AS "T_START", r6(coalesce(nxt, "OS_DAYS");) AS "T_STOP",
       CASE WHEN nxt IS NULL THEN "OS_EVENT" ELSE 0 END AS "EVENT", r6("OS_DAYS";) AS "OS_DAYS", "OS_EVENT", "SAMPLE_ID", "SAMPLE_ID_NORM",
       r6(d;) AS "SAMPLE_DAY", "SAMPLE_TYPE_CODE", "IS_PRIMARY", "MUTATION_BURDEN", "AGE", "SEX"
FROM spans WHERE coalesce(nxt, "OS_DAYS") > d"""))
def survival_intervals(t: Tables) -> DataFrame:
    return rounded_all(interval_table(t))


@query(V.sql("sample endpoint", f"""with {_PATIENT_SQL}
SELECT "INTERVAL_INDEX", count(*) AS n FROM (
  SELECT CAST(idx AS INTEGER) AS "INTERVAL_INDEX" FROM spans WHERE coalesce(nxt, "OS_DAYS") > d) z GROUP BY 1"""))
def interval_index(t: Tables) -> DataFrame:
    return interval_table(t).groupBy("INTERVAL_INDEX").agg(F.count(F.lit(1)).alias("n"))


@query(V.sql("sample endpoint", f"""with {_PATIENT_SQL}
SELECT "PATIENT_ID", "SAMPLE_DAY", "SAMPLE_ID", "SAMPLE_TYPE_CODE", "IS_PRIMARY", "MUTATION_BURDEN" FROM anchored WHERE "SAMPLE_ID" IS NULL"""))
def day0_anchor(t: Tables) -> DataFrame:
    patients, samples = interval_inputs(t)
    rows = intervals.one_per_day(intervals.samples_or_baseline(patients, samples))
    without_id = rows.where(F.col("SAMPLE_ID").isNull()).unionByName(intervals.day0_anchors(rows))
    return without_id.select(
        "PATIENT_ID", "SAMPLE_DAY", "SAMPLE_ID", "SAMPLE_TYPE_CODE", "IS_PRIMARY", "MUTATION_BURDEN"
    )


@query(V.sql("sample endpoint", f"""with {_PATIENT_SQL}
SELECT "PATIENT_ID", r6(arg_max(d, coalesce(nxt, "OS_DAYS"));) AS "T_START", r6(max(coalesce(nxt, "OS_DAYS"));) AS "T_STOP"
FROM spans WHERE coalesce(nxt, "OS_DAYS") > d GROUP BY 1"""))
def last_interval(t: Tables) -> DataFrame:
    return rounded_all(cohort.last_interval(interval_table(t), "T_START"))


@query(V.sql("sample endpoint", f"""with {_PATIENT_SQL}
SELECT count(*) AS intervals, count(DISTINCT "PATIENT_ID") AS patients, CAST(sum(CASE WHEN nxt IS NULL THEN "OS_EVENT" ELSE 0 END) AS BIGINT) AS events
FROM spans WHERE coalesce(nxt, "OS_DAYS") > d"""))
def interval_summary(t: Tables) -> DataFrame:
    per_patient = interval_table(t).groupBy("PATIENT_ID").agg(F.count(F.lit(1)).alias("n"), F.sum("EVENT").alias("e"))
    return per_patient.agg(F.sum("n").alias("intervals"), F.count(F.lit(1)).alias("patients"), F.sum("e").alias("events"))


@query(V.sql("mutation", """
SELECT "Tumor_Sample_Barcode", "CANCER_TYPE", count(*) AS "MUTATION_COUNT" FROM mutation GROUP BY 1, 2"""))
def mutation_burden(t: Tables) -> DataFrame:
    return cohort.mutation_burden(V.mutation(t))


_BARCODES = """coded AS (SELECT 'tc-' || (CAST("Tumor_Sample_Barcode" AS BIGINT) % 500) || '-' || (CAST("Tumor_Sample_Barcode" AS BIGINT) % 7) || '-01-' || ("Tumor_Sample_Barcode") AS b, "CANCER_TYPE" FROM mutation)"""


@query(V.sql("mutation", f"""with {_BARCODES}
SELECT array_to_string(list_slice(string_split(upper(b), '-'), 1, 4), '-') AS "SAMPLE_ID_NORM", "CANCER_TYPE", count(*) AS "MUTATION_BURDEN" FROM coded GROUP BY 1, 2"""))
def burden_two_level(t: Tables) -> DataFrame:
    """Long barcodes that share their first four parts are summed."""
    number = F.col("Tumor_Sample_Barcode").cast("bigint")
    coded = F.concat_ws("-", F.lit("tc"), number % 500, number % 7, F.lit("01"), "Tumor_Sample_Barcode")
    return cohort.burden_by_normalised_sample(V.mutation(t).withColumn("Tumor_Sample_Barcode", coded))


@query(V.sql("mutation", """
SELECT "CANCER_TYPE", r6(quantile_cont(c, 0.5);) AS median_burden, r6(avg(c);) AS mean_burden, max(c) AS max_burden
FROM (SELECT "Tumor_Sample_Barcode", "CANCER_TYPE", count(*) AS c FROM mutation GROUP BY 1, 2) z GROUP BY 1"""))
def burden_stats(t: Tables) -> DataFrame:
    return rounded_all(cohort.burden_summary(V.mutation(t)))


@query(V.sql("mutation", """
SELECT "CANCER_TYPE", "Hugo_Symbol", n, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY "CANCER_TYPE" ORDER BY n DESC, "Hugo_Symbol") AS pos FROM (
    SELECT "CANCER_TYPE", "Hugo_Symbol", count(*) AS n FROM mutation GROUP BY 1, 2) a) b WHERE pos <= 10"""))
def top_genes_per_cohort(t: Tables) -> DataFrame:
    return genes.top_values(V.mutation(t), "Hugo_Symbol", 10)


@query(V.sql("mutation", """
SELECT "CANCER_TYPE", "Variant_Classification", n, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY "CANCER_TYPE" ORDER BY n DESC, "Variant_Classification") AS pos FROM (
    SELECT "CANCER_TYPE", "Variant_Classification", count(*) AS n FROM mutation GROUP BY 1, 2) a) b WHERE pos <= 10"""))
def variant_classes(t: Tables) -> DataFrame:
    return genes.top_values(V.mutation(t), "Variant_Classification", 10)


@query(V.sql("mutation", """with top AS (SELECT "Hugo_Symbol" FROM mutation GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
n AS (SELECT "CANCER_TYPE", count(DISTINCT "Tumor_Sample_Barcode") AS n FROM mutation GROUP BY 1),
hits AS (SELECT "Hugo_Symbol", m."CANCER_TYPE", count(DISTINCT "Tumor_Sample_Barcode") / max(n.n) * 100 AS pct
         FROM mutation m JOIN n ON m."CANCER_TYPE" = n."CANCER_TYPE" WHERE "Hugo_Symbol" IN (SELECT "Hugo_Symbol" FROM top) GROUP BY 1, 2)
SELECT "Hugo_Symbol", r6(coalesce(max(pct) FILTER (WHERE "CANCER_TYPE" = 'A'), 0);) AS "A", r6(coalesce(max(pct) FILTER (WHERE "CANCER_TYPE" = 'N'), 0);) AS "N",
       r6(coalesce(max(pct) FILTER (WHERE "CANCER_TYPE" = 'R'), 0);) AS "R" FROM hits GROUP BY 1"""))
def mutation_frequency(t: Tables) -> DataFrame:
    return rounded_all(genes.frequency_matrix(genes.mutation_frequency(V.mutation(t)), ["A", "N", "R"]))


@query(V.sql("mutation", """with pairs AS (SELECT DISTINCT "Hugo_Symbol" || '/' || CAST("Tumor_Sample_Barcode" AS BIGINT) % 97 AS gene, "CANCER_TYPE" FROM mutation)
SELECT gene FROM pairs GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT "CANCER_TYPE") FROM pairs)"""))
def gene_intersection(t: Tables) -> DataFrame:
    gene = F.concat_ws("/", "Hugo_Symbol", F.col("Tumor_Sample_Barcode").cast("bigint") % 97)
    return genes.genes_in_all_cohorts(V.mutation(t).select(gene.alias("gene"), F.col("CANCER_TYPE").alias("cohort")))


@query(V.sql("mutation", """with pairs AS (SELECT DISTINCT "Hugo_Symbol" || '/' || CAST("Tumor_Sample_Barcode" AS BIGINT) % 397 AS gene, "CANCER_TYPE" FROM mutation)
SELECT gene FROM pairs WHERE "CANCER_TYPE" = 'N' EXCEPT SELECT gene FROM pairs WHERE "CANCER_TYPE" = 'A'"""))
def gene_difference(t: Tables) -> DataFrame:
    gene = F.concat_ws("/", "Hugo_Symbol", F.col("Tumor_Sample_Barcode").cast("bigint") % 397)
    pairs = V.mutation(t).select(gene.alias("gene"), "CANCER_TYPE")
    return pairs.where("CANCER_TYPE = 'N'").select("gene").subtract(pairs.where("CANCER_TYPE = 'A'").select("gene"))


@query(V.sql("mutation", """
SELECT "Hugo_Symbol" AS feature FROM mutation UNION SELECT "Variant_Classification" FROM mutation"""))
def feature_union(t: Tables) -> DataFrame:
    calls = V.mutation(t)
    return calls.select(F.col("Hugo_Symbol").alias("feature")).union(calls.select("Variant_Classification")).distinct()


@query(V.sql("expression_long", """SELECT sample_id, cohort, gene, r6(value;) AS value FROM expression_long"""))
def matrix_unpivot(t: Tables) -> DataFrame:
    matrix = V.expression_matrix(t)
    return rounded_all(matrix.unpivot(["sample_id", "cohort"], [c for c in matrix.columns if c.startswith("G")], "gene", "value"))


@query(V.sql("expression_long", """
SELECT sample_id, cohort, r6(max(value) FILTER (WHERE gene = 'G00');) AS "EXPR_G00", r6(max(value) FILTER (WHERE gene = 'G17');) AS "EXPR_G17",
       CAST(0 AS DOUBLE) AS "EXPR_G99" FROM expression_long GROUP BY 1, 2"""))
def matrix_pivot_aligned(t: Tables) -> DataFrame:
    return rounded_all(genes.align_genes(V.expression_long(t), ["G00", "G17", "G99"], EXPR))


@query(V.sql("expression_long", """
SELECT cohort, r6(min(value);) AS min_value, r6(max(value);) AS max_value, r6(count(*) FILTER (WHERE value = 0) / count(*) * 100;) AS zero_pct,
       count(*) FILTER (WHERE value IS NULL) AS missing FROM expression_long GROUP BY 1"""))
def matrix_summary(t: Tables) -> DataFrame:
    return rounded_all(genes.matrix_summary(V.expression_long(t)))


@query(V.sql("expression_long", """
SELECT gene, r6(var_samp(value);) AS variance FROM expression_long GROUP BY 1 ORDER BY var_samp(value) DESC, 1 LIMIT 20"""))
def gene_variance_topk(t: Tables) -> DataFrame:
    return rounded_all(genes.top_variable_genes(V.expression_long(t), 20))


@query(V.sql("expression_long", """with m AS (SELECT sample_id, cohort, quantile_cont(log2(value + 1), 0.5) AS median_value FROM expression_long GROUP BY 1, 2)
SELECT m.sample_id, m.cohort, r6(median_value;) AS median_value, r6(o.overall;) AS overall_median
FROM m JOIN (SELECT cohort, quantile_cont(median_value, 0.5) AS overall FROM m GROUP BY 1) o ON m.cohort = o.cohort"""))
def sample_median_expr(t: Tables) -> DataFrame:
    logged = V.expression_long(t).withColumn("value", S.log2_plus_one("value"))
    return rounded_all(join_on(genes.sample_medians(logged), genes.median_of_medians(logged), ["cohort"]))


@query(V.sql("expression_long", """with logged AS (SELECT sample_id, cohort, gene, log2(value + 1) AS v FROM expression_long),
top AS (SELECT cohort, gene FROM logged GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY var_samp(v) DESC, gene) <= 50),
listed AS (SELECT l.* FROM logged l JOIN top ON l.cohort = top.cohort AND l.gene = top.gene)
SELECT a.cohort, a.gene AS gene_a, b.gene AS gene_b, r6(corr(a.v, b.v);) AS r
FROM listed a JOIN listed b ON a.sample_id = b.sample_id AND a.cohort = b.cohort AND a.gene < b.gene GROUP BY 1, 2, 3"""))
def cohort_gene_corr(t: Tables) -> DataFrame:
    """Correlations within each cohort of its own 50 most variable genes."""
    logged = V.expression_long(t).withColumn("value", S.log2_plus_one("value"))
    return rounded_all(genes.cohort_correlations(logged))


@query(V.sql("expression_long", """with logged AS (SELECT cohort, gene, log2(value + 1) AS v FROM expression_long)
SELECT cohort, gene, r6(var_samp(v);) AS variance, CAST(row_number() OVER (PARTITION BY cohort ORDER BY var_samp(v) DESC, gene) AS INTEGER) AS gene_rank
FROM logged GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY var_samp(v) DESC, gene) <= 10"""))
def cohort_variable_genes(t: Tables) -> DataFrame:
    logged = V.expression_long(t).withColumn("value", S.log2_plus_one("value"))
    return rounded_all(genes.top_variable_genes_by_cohort(logged, 10).drop("mean"))


@query(V.sql("expression_long", """
SELECT gene, r6(v;) AS variance, row_number() OVER (ORDER BY v DESC, gene) AS gene_rank FROM (SELECT gene, var_samp(value) AS v FROM expression_long GROUP BY 1) z"""))
def variance_rank(t: Tables) -> DataFrame:
    return rounded_all(genes.variance_profile(V.expression_long(t)).withColumn("gene_rank", F.col("gene_rank").cast("bigint")))


_CNA_FREQ = """freq AS (SELECT cohort, gene, CAST(count(*) FILTER (WHERE value = 2) AS DOUBLE) / count(*) * 100 AS amp_pct, CAST(count(*) FILTER (WHERE value = -2) AS DOUBLE) / count(*) * 100 AS del_pct FROM cna_long GROUP BY 1, 2)"""


@query(V.sql("expression_long", f"""with {_CNA_FREQ} SELECT cohort, gene, r6(amp_pct;) AS amp_pct, r6(del_pct;) AS del_pct FROM freq"""))
def cna_frequency(t: Tables) -> DataFrame:
    return rounded_all(genes.cna_frequency(V.cna_long(t)))


@query(V.sql("expression_long", f"""with {_CNA_FREQ},
ranked AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY amp_pct DESC, gene) AS ap, row_number() OVER (PARTITION BY cohort ORDER BY del_pct DESC, gene) AS dp FROM freq),
extra AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY dp) AS ep FROM ranked WHERE dp <= 15 AND ap > 15)
SELECT cohort, gene, CAST(ap AS BIGINT) AS pos, r6(amp_pct;) AS amp_pct, r6(-del_pct;) AS neg_del_pct FROM ranked WHERE ap <= 15
UNION ALL SELECT cohort, gene, CAST(15 + ep AS BIGINT), r6(amp_pct;), r6(-del_pct;) FROM extra WHERE ep <= 5"""))
def cna_top_amp_del(t: Tables) -> DataFrame:
    picked = genes.top_amplified_and_deleted(genes.cna_frequency(V.cna_long(t)))
    return rounded_all(picked.withColumn("pos", F.col("pos").cast("bigint")))


def _vectors_by_sample(t: Tables, samples: DataFrame, column: str) -> DataFrame:
    """Vector i belongs to the sample of order i; joined before genes become rows, and written once for both omic layers."""
    named = samples.select("o_orderkey", F.col(column).alias("sample_id"), F.col("CANCER_TYPE").alias("cohort"))
    vectors = t("embeddings").select("vec_id", "embedding")
    return cut_lineage(vectors.join(named, F.col("vec_id") == F.col("o_orderkey")).select("sample_id", "cohort", "embedding"))


def _calls_by_sample(t: Tables, samples: DataFrame) -> DataFrame:
    """Calls are counted by order before they meet the samples."""
    named = samples.select("o_orderkey", "SAMPLE_ID", "CANCER_TYPE")
    calls = V.mutation(t).groupBy(F.col("Tumor_Sample_Barcode").cast("bigint").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("N_CALLS"))
    return calls.join(named, "o_orderkey").select(F.col("SAMPLE_ID").alias("Tumor_Sample_Barcode"), "CANCER_TYPE", "N_CALLS")


def _patient_omics(t: Tables, clinical: DataFrame, top_n: int) -> DataFrame:
    samples = cut_lineage(V.sample_metadata(t))
    vectors = _vectors_by_sample(t, samples, "SAMPLE_ID")
    return feature_tables.patient_multiomic(
        clinical, samples, _calls_by_sample(t, samples), V.expression_long(t, vectors), V.cna_long(t, vectors), top_n
    )


def multiomic_table(t: Tables, top_n: int = 5) -> DataFrame:
    clinical = V.patient(t).select("PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", "OS_MONTHS", "OS_EVENT")
    return _patient_omics(t, clinical, top_n)


_OMICS = """chosen AS (SELECT "PATIENT_ID", "SAMPLE_ID", o_orderkey, "CANCER_TYPE", NOT "IS_PRIMARY" AS "IS_FALLBACK" FROM (
  SELECT *, row_number() OVER (PARTITION BY "PATIENT_ID" ORDER BY "IS_PRIMARY" DESC, "SAMPLE_ID") AS rn FROM sample_metadata) z WHERE rn = 1),
picked AS (SELECT c."SAMPLE_ID", e.gene, log2(e.value + 1) AS v FROM expression_long e JOIN chosen c ON e.sample_id = c.o_orderkey),
top AS (SELECT gene, row_number() OVER (ORDER BY var_samp(v) DESC, gene) AS pos FROM picked GROUP BY 1 QUALIFY pos <= 5),
burden AS (SELECT l_orderkey, count(*) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


@query(V.sql("sample expression_long", f"""with {_OMICS}
SELECT p."PATIENT_ID", p."CANCER_TYPE", c."SAMPLE_ID", c."IS_FALLBACK", CAST(b.b AS BIGINT) AS "MUTATION_BURDEN",
       (SELECT count(*) FROM picked k JOIN top ON k.gene = top.gene WHERE k."SAMPLE_ID" = c."SAMPLE_ID") AS n_expr,
       r6((SELECT sum(v) FROM picked k JOIN top ON k.gene = top.gene WHERE k."SAMPLE_ID" = c."SAMPLE_ID");) AS sum_expr,
       r6((SELECT sum(n.value) FROM cna_long n JOIN top ON n.gene = top.gene WHERE n.sample_id = c.o_orderkey);) AS sum_cna
FROM patient p LEFT JOIN chosen c ON p."PATIENT_ID" = c."PATIENT_ID" LEFT JOIN burden b ON b.l_orderkey = c.o_orderkey"""))
def multiomic_join(t: Tables) -> DataFrame:
    """The patient table with its omic blocks, the blocks summed up per patient."""
    clinical = V.patient(t).select("PATIENT_ID", "CANCER_TYPE")
    table = _patient_omics(t, clinical, 5)
    expr, cna = clean.prefixed_columns(table, EXPR), clean.prefixed_columns(table, CNA)
    known = sum((F.col(c).isNotNull().cast("int") for c in expr), F.lit(0)).cast("bigint")
    total = lambda names: sum((F.col(c) for c in names), F.lit(0.0))
    return rounded_all(table.select(
        "PATIENT_ID", "CANCER_TYPE", "SAMPLE_ID", "IS_FALLBACK", "MUTATION_BURDEN", known.alias("n_expr"),
        total(expr).alias("sum_expr"), total(cna).alias("sum_cna"),
    ))


@query(V.sql("sample expression_long", f"""with {_OMICS},
layers AS (SELECT p."CANCER_TYPE", b.b AS burden, (c.o_orderkey IN (SELECT vec_id FROM embeddings)) AS omic FROM patient p LEFT JOIN chosen c ON p."PATIENT_ID" = c."PATIENT_ID"
           LEFT JOIN burden b ON b.l_orderkey = c.o_orderkey)
SELECT "CANCER_TYPE", count(*) AS "rows", count(burden) AS has_burden, count(*) FILTER (WHERE omic) AS has_expression, count(*) FILTER (WHERE omic) AS has_cna,
       count(*) FILTER (WHERE omic AND burden IS NOT NULL) AS has_all, r6(count(burden) / count(*) * 100;) AS burden_pct,
       r6(count(*) FILTER (WHERE omic) / count(*) * 100;) AS expression_pct, r6(count(*) FILTER (WHERE omic) / count(*) * 100;) AS cna_pct
FROM layers GROUP BY 1"""))
def omic_coverage(t: Tables) -> DataFrame:
    clinical = V.patient(t).select("PATIENT_ID", "CANCER_TYPE")
    table = _patient_omics(t, clinical, 5)
    expr, cna = clean.prefixed_columns(table, EXPR)[0], clean.prefixed_columns(table, CNA)[0]
    layers = {"burden": "MUTATION_BURDEN", "expression": expr, "cna": cna}
    return rounded_all(profile.layer_coverage(table, layers, ["CANCER_TYPE"]))


def sample_omics(t: Tables, top_n: int = 5) -> DataFrame:
    patients = V.endpoint(t).select("PATIENT_ID", "CANCER_TYPE", "OS_DAYS", "OS_EVENT")
    samples = cut_lineage(V.sample_metadata(t))
    vectors = _vectors_by_sample(t, samples, "SAMPLE_ID_NORM")
    return feature_tables.sample_omic_long(
        patients, samples, _calls_by_sample(t, samples), V.expression_long(t, vectors), V.cna_long(t, vectors), top_n
    )


@query(V.sql("sample endpoint expression_long", """with kept AS (
  SELECT s.*, e."OS_DAYS" FROM sample_metadata s JOIN endpoint e ON s."PATIENT_ID" = e."PATIENT_ID" WHERE s."SAMPLE_DAY" <= e."OS_DAYS" + 1e-6),
picked AS (SELECT k.o_orderkey, x.gene, x.value FROM expression_long x JOIN kept k ON x.sample_id = k.o_orderkey),
top AS (SELECT gene, row_number() OVER (ORDER BY var_samp(value) DESC, gene) AS pos FROM picked GROUP BY 1 QUALIFY pos <= 5),
expr AS (SELECT o_orderkey, sum(log2(value + 1)) AS s FROM picked JOIN top ON picked.gene = top.gene GROUP BY 1),
cna AS (SELECT sample_id, sum(value) AS s FROM cna_long JOIN top ON cna_long.gene = top.gene GROUP BY 1),
burden AS (SELECT l_orderkey, count(*) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT k."PATIENT_ID", k."SAMPLE_ID_NORM", k."SAMPLE_DAY", CAST(coalesce(b, 0) AS DOUBLE) AS "MUTATION_BURDEN", r6(expr.s;) AS sum_expr,
       r6(CASE WHEN expr.s IS NOT NULL THEN cna.s END;) AS sum_cna
FROM kept k LEFT JOIN burden ON l_orderkey = k.o_orderkey LEFT JOIN expr ON expr.o_orderkey = k.o_orderkey LEFT JOIN cna ON cna.sample_id = k.o_orderkey"""))
def sample_omic_table(t: Tables) -> DataFrame:
    table = sample_omics(t)
    total = lambda prefix: sum((F.col(c) for c in clean.prefixed_columns(table, prefix)), F.lit(0.0))
    return rounded_all(table.select(
        "PATIENT_ID", "SAMPLE_ID_NORM", "SAMPLE_DAY", "MUTATION_BURDEN", total(EXPR).alias("sum_expr"), total(CNA).alias("sum_cna")
    ))


@query("""
SELECT 'early' AS "CANCER_TYPE", o_orderkey, o_totalprice AS price, CAST(NULL AS VARCHAR) AS "SEX" FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
UNION ALL SELECT 'late', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def cohort_union(t: Tables) -> DataFrame:
    orders = t("orders")
    limit = F.lit("1997-01-01").cast("timestamp")
    early = orders.where(F.col("o_orderdate") < limit).select("o_orderkey", F.col("o_totalprice").alias("price"))
    late = orders.where(F.col("o_orderdate") >= limit).select("o_orderkey", F.col("o_orderstatus").alias("SEX"))
    return clean.union_cohorts({"early": early, "late": late}).select("CANCER_TYPE", "o_orderkey", "price", "SEX")
