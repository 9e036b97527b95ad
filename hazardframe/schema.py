"""Column names, code lists and source schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# They must equal the published data conventions for results to be comparable.
NA_TOKENS = ["[Not Available]", "[Not Applicable]", "[Not Evaluated]", "[Pending]"]
DAYS_PER_MONTH = 30.4375
PRIMARY_CODE = "01"
DEFAULT_SAMPLE_CODE = "00"
AGE_EDGES = [0.0, 40.0, 55.0, 65.0, 75.0, 120.0]
AGE_LABELS = ["≤40", "41-55", "56-65", "66-75", ">75"]
CLINICAL_COVARIATES = ["AGE", "SEX", "RACE", "ETHNICITY", "CANCER_TYPE", "AGE_GROUP"]
INTERVAL_COVARIATES = [
    "AGE", "SEX", "RACE", "ETHNICITY", "AGE_GROUP", "CANCER_TYPE", "IS_PRIMARY", "SAMPLE_TYPE_CODE", "SAMPLE_DAY",
]
TARGET_COLUMNS = ["OS_STATUS", "OS_MONTHS", "OS_EVENT", "DFS_STATUS", "DFS_MONTHS", "DFS_EVENT"]
ID_COLUMNS = ["PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE", "IS_FALLBACK"]
HORIZONS_MONTHS = [12, 24, 36, 60]
ALPHA_GRID = [0.1, 0.3, 0.8, 1.5, 3.0]
L1_GRID = [0.0, 0.1, 0.3, 0.5, 0.7]
SWEEP_THRESHOLDS = [1.0, 0.95, 0.90, 0.85, 0.75]
FEATURE_BLOCKS = {
    "Clinical only": ["clinical"],
    "Clinical + Mutation": ["clinical", "mutation"],
    "Clinical + Expression(PCA)": ["clinical", "expression"],
    "Clinical + CNA(PCA)": ["clinical", "cna"],
    "Clinical + Expr + CNA": ["clinical", "expression", "cna"],
    "All (Clinical + Mutation + Expr + CNA)": ["clinical", "mutation", "expression", "cna"],
    "Omics only (Mutation + Expr + CNA)": ["mutation", "expression", "cna"],
}
EXPR, CNA = "EXPR_", "CNA_"
# Columns that the cleaned re-run leaves out.
LOW_VALUE_COLUMNS = [
    "HISTORY_LGG_DX_OF_BRAIN_TISSUE", "PERFORMANCE_STATUS_TIMING", "PHARMACEUTICAL_TX_ADJUVANT", "FAMILY_HISTORY_OF_CANCER",
    "HISTORY_HEPATO_CARCINOMA_RISK_FACTORS", "DEFINITIVE_SURGICAL_PROCEDURE", "PRIMARY_MELANOMA_KNOWN_DX", "PRIMARY_MULTIPLE_AT_DX",
    "SUBMITTED_TUMOR_DX_DAYS_TO", "TUMOR_SITE", "PRIMARY_MELANOMA_SKIN_TYPE", "DAYS_TO_SPECIMEN_COLLECTION",
]

# Texts that tabular readers treat as missing by default.
DEFAULT_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]
