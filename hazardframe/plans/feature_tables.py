"""Plans that build the cleaned clinical table, the patient table and the sample table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators import clean, cohort, genes, profile
from hazardframe.operators.cohort import first_row
from hazardframe.schema import CNA, EXPR
from hazardframe.session import cut_lineage


def clean_clinical(raw: DataFrame, impute_columns: Sequence[str] | None = None, ordinal: str = "_ordinal") -> DataFrame:
    """The clinical cleaning chain.

    Columns with more than 80 % missing go; numbers are filled with their median (by default all of them, the
    survival times included, see README), texts with ``Unknown``; the first row of a patient in file order stays;
    status texts become 0/1; times are limited to their 99th percentile; ages are grouped.
    """
    kept = raw.drop(*[c for c in profile.sparse_columns(raw) if c != ordinal])
    numeric = [c for c in profile.numeric_columns(kept) if c != ordinal]
    wanted = numeric if impute_columns is None else [c for c in impute_columns if c in kept.columns]
    filled = clean.impute_constant(clean.impute_medians(kept, wanted), profile.text_columns(kept))
    unique = cohort.first_in_file_order(filled, ["PATIENT_ID"], ordinal) if ordinal in filled.columns else filled
    out = unique.drop(ordinal)
    if "OS_STATUS" in out.columns:
        out = out.withColumn("OS_EVENT", S.status_flag("OS_STATUS"))
        out = out.withColumn("Status", S.label_codes("OS_EVENT", {0: "Living", 1: "Deceased"}))
    if "DFS_STATUS" in out.columns:
        out = out.withColumn("DFS_EVENT", S.recurrence_flag("DFS_STATUS"))
    out = out.withColumns({c: S.to_number(c) for c in ("OS_MONTHS", "DFS_MONTHS", "AGE") if c in out.columns})
    out = clean.winsorise(out)
    return out.withColumn("AGE_GROUP", S.age_group("AGE")) if "AGE" in out.columns else out


def patient_table(clinical: DataFrame) -> DataFrame:
    """Patients with a usable endpoint, follow-up in days, one row per patient and cohort."""
    rows = clinical
    if "OS_EVENT" not in rows.columns:
        rows = rows.withColumn("OS_EVENT", S.status_matches("OS_STATUS"))
    rows = cohort.survival_endpoint(rows).where(F.col("PATIENT_ID").isNotNull())
    rows = rows.withColumn("OS_DAYS", S.months_to_days("OS_MONTHS"))
    wanted = ["PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", "RACE", "ETHNICITY", "AGE_GROUP", "OS_MONTHS", "OS_DAYS", "OS_EVENT"]
    order = ["_ordinal"] if "_ordinal" in rows.columns else ["OS_DAYS"]
    return clean.select_present(first_row(rows, ["PATIENT_ID", "CANCER_TYPE"], order), wanted)


def sample_omic_long(
    patients: DataFrame, samples: DataFrame, calls: DataFrame, expression: DataFrame, cna: DataFrame, top_n: int = 300
) -> DataFrame:
    """Samples of patients with an endpoint, with mutation burden and the omics of the most variable genes.

    ``expression`` and ``cna`` are long with a normalised ``sample_id``; genes are ranked by the variance of the raw
    values over the kept samples, and only then are missing values set to 0 and logs taken.
    """
    outcome = patients.select("PATIENT_ID", "CANCER_TYPE", "OS_DAYS", "OS_EVENT")
    kept = cohort.drop_post_outcome(samples.join(outcome, ["PATIENT_ID", "CANCER_TYPE"]))
    kept = cut_lineage(kept)  # read for both omic layers, for the choice of genes and for the result
    on = ["SAMPLE_ID_NORM", "CANCER_TYPE"]
    wanted = kept.select(*on).distinct()

    def of_kept(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"sample_id": "SAMPLE_ID_NORM", "cohort": "CANCER_TYPE"}).join(wanted, on, "left_semi")

    expr, copies = of_kept(expression), of_kept(cna)
    top = [r["gene"] for r in genes.top_variable_genes(expr, top_n).collect()]  # top_n names
    expr_wide = genes.long_to_wide(expr, top, EXPR, on)
    expr_wide = expr_wide.select(*on, *[S.log2_plus_one(F.coalesce(EXPR + g, F.lit(0.0))).alias(EXPR + g) for g in top])
    cna_wide = genes.align_genes(copies, top, CNA, on)
    joined = (
        kept.join(cohort.burden_by_normalised_sample(calls), on, "left")
        .join(expr_wide, on, "left")
        .join(cna_wide, on, "left")
        .withColumn("MUTATION_BURDEN", F.coalesce(F.col("MUTATION_BURDEN"), F.lit(0)).cast("double"))
    )
    return first_row(joined, ["PATIENT_ID", "SAMPLE_ID_NORM", "CANCER_TYPE"], ["SAMPLE_DAY", "SAMPLE_ID"])


def patient_multiomic(
    clinical: DataFrame, samples: DataFrame, calls: DataFrame, expression: DataFrame, cna: DataFrame, top_n: int = 500
) -> DataFrame:
    """One row per patient: clinical columns, the selected sample, its burden, expression and copy numbers.

    Genes are ranked by the variance of log2 values (missing as 0) over the selected samples.
    """
    chosen = cohort.selected_samples(samples, clinical)
    ids = chosen.select(F.col("SAMPLE_ID").alias("sample_id"), F.col("CANCER_TYPE").alias("cohort"))
    on = ["sample_id", "cohort"]
    logged = expression.join(ids, on, "left_semi").withColumn("value", S.log2_plus_one(F.coalesce("value", F.lit(0.0))))
    top = [r["gene"] for r in genes.top_variable_genes(logged, top_n).collect()]  # top_n names
    burden = cohort.mutation_burden(calls, ["Tumor_Sample_Barcode"]).select(
        F.col("Tumor_Sample_Barcode").alias("sample_id"), F.col("MUTATION_COUNT").alias("MUTATION_BURDEN")
    )
    expr_wide = genes.long_to_wide(logged, top, EXPR, ["sample_id"])
    cna_wide = genes.align_genes(cna.join(ids, on, "left_semi"), top, CNA, ["sample_id"])
    # Patients without a sample get a key of their own: NULL keys would all meet in one task.
    key = F.coalesce("SAMPLE_ID", F.concat(F.lit("none|"), F.col("PATIENT_ID").cast("string")))
    return (
        clinical.join(chosen.select("PATIENT_ID", "SAMPLE_ID", "IS_FALLBACK"), "PATIENT_ID", "left")
        .withColumn("sample_id_key", key)
        .join(burden.withColumnRenamed("sample_id", "sample_id_key"), "sample_id_key", "left")
        .join(expr_wide.withColumnRenamed("sample_id", "sample_id_key"), "sample_id_key", "left")
        .join(cna_wide.withColumnRenamed("sample_id", "sample_id_key"), "sample_id_key", "left")
        .drop("sample_id_key")
    )
