"""The clinical, sample and omic inputs, mapped from the driver's tables. Each has a Spark and a SQL form."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from hazardframe.catalog.registry import Tables
from hazardframe.functions import scalars as S
from hazardframe.operators import cohort, splits
from hazardframe.schema import DAYS_PER_MONTH
from hazardframe.session import cut_lineage


def patient(t: Tables) -> DataFrame:
    """One row per customer with orders: follow-up from the first to the last order, event by the last status."""
    ends = (
        t("orders")
        .groupBy(F.col("o_custkey").alias("PATIENT_ID"))
        .agg(
            F.min("o_orderdate").alias("first_day"),
            F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("last"),
        )
    )
    days = F.datediff(F.col("last.o_orderdate"), F.col("first_day")).cast("double")
    event = (F.col("last.o_orderstatus") == "F").cast("int")
    return (
        t("customer")
        .select(
            F.col("c_custkey").alias("PATIENT_ID"),
            F.col("c_mktsegment").alias("CANCER_TYPE"),
            (20 + F.col("c_custkey") % 70).cast("double").alias("AGE"),
            (F.col("c_custkey") % 2).cast("string").alias("SEX"),
            F.col("c_acctbal").alias("ACCTBAL"),
        )
        .join(ends, "PATIENT_ID")
        .select(
            "PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", "ACCTBAL", "first_day",
            days.alias("OS_DAYS"), (days / DAYS_PER_MONTH).alias("OS_MONTHS"), event.alias("OS_EVENT"),
            F.when(event == 1, "1:DECEASED").otherwise("0:LIVING").alias("OS_STATUS"),
        )
    )


def sample(t: Tables) -> DataFrame:
    """One row per order: raw sample id and two raw day texts with missing-value tokens."""
    code = F.when(F.col("o_orderstatus") == "F", "01").when(F.col("o_orderstatus") == "O", "06").otherwise("11")
    day = F.datediff("o_orderdate", "first_day").cast("string")
    absent = F.lit("[Not Available]")
    orders = t("orders").select(F.col("o_custkey").alias("PATIENT_ID"), "o_orderkey", "o_orderstatus", "o_orderdate")
    return orders.join(patient(t).select("PATIENT_ID", "CANCER_TYPE", "first_day"), "PATIENT_ID").select(
        "PATIENT_ID", "CANCER_TYPE", "o_orderkey",
        F.concat_ws("-", F.lit("tc"), "PATIENT_ID", "o_orderkey", code, F.lit("x")).alias("SAMPLE_ID"),
        F.when(F.col("o_orderkey") % 7 == 0, absent).otherwise(day).alias("DAYS_TO_COLLECTION"),
        F.when(F.col("o_orderkey") % 5 == 0, absent).otherwise(day).alias("DAYS_TO_SPECIMEN_COLLECTION"),
    )


def sample_metadata(t: Tables) -> DataFrame:
    return cohort.sample_metadata(sample(t))


def mutation(t: Tables) -> DataFrame:
    """Mutation calls: one row per line item, gene and class from the part."""
    part = t("part").select("p_partkey", "p_brand", "p_type")
    return t("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("Tumor_Sample_Barcode"),
        F.col("p_brand").alias("Hugo_Symbol"),
        F.col("p_type").alias("Variant_Classification"),
        F.col("l_returnflag").alias("CANCER_TYPE"),
    )


def _gene(position):
    return F.format_string("G%02d", position)


def _cells(t: Tables, vectors: DataFrame | None) -> DataFrame:
    """A row for each vector and gene; ``vectors`` (sample_id, cohort, embedding) are all of the table unless given."""
    if vectors is None:
        vectors = t("embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("cohort"), "embedding")
    return vectors.select("sample_id", "cohort", F.posexplode("embedding").alias("pos", "x"))


def expression_long(t: Tables, vectors: DataFrame | None = None) -> DataFrame:
    """Expression in long form: 64 genes per vector, non-negative values."""
    return _cells(t, vectors).select("sample_id", "cohort", _gene(F.col("pos")).alias("gene"), (F.abs(F.col("x").cast("double")) * 100).alias("value"))


def cna_long(t: Tables, vectors: DataFrame | None = None) -> DataFrame:
    """Copy-number states -2..2 in long form."""
    state = F.least(F.greatest(F.round(F.col("x").cast("double") * 8), F.lit(-2.0)), F.lit(2.0))
    return _cells(t, vectors).select("sample_id", "cohort", _gene(F.col("pos")).alias("gene"), state.cast("int").alias("value"))


def expression_matrix(t: Tables) -> DataFrame:
    """Expression in wide form, one double column per gene."""
    value = F.col("embedding")
    genes = [(F.abs(value[i].cast("double")) * 100).alias(f"G{i:02d}") for i in range(64)]
    return t("embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("cohort"), *genes)


def clinical_raw(t: Tables) -> DataFrame:
    """A table with missing values: documents with their partly missing labels."""
    return t("documents").join(t("labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"),
    )


def endpoint(t: Tables) -> DataFrame:
    return cohort.survival_endpoint(patient(t))


def scored(t: Tables) -> DataFrame:
    """Patients with a fixed risk score and a three-way split, written once because every use reads it several times."""
    rows = endpoint(t).select(
        "PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", "OS_DAYS", "OS_MONTHS", "OS_EVENT",
        (0.02 * F.col("AGE") - 0.0001 * F.col("ACCTBAL")).alias("risk"),
    )
    return cut_lineage(splits.three_way_split(rows, "PATIENT_ID", ["OS_EVENT"]))


def scored_folds(t: Tables) -> DataFrame:
    return splits.stratified_folds(scored(t), "PATIENT_ID", ["CANCER_TYPE", "OS_EVENT"])


def event_probability(t: Tables) -> DataFrame:
    """Scored rows at each horizon with the known label and a fixed probability from the risk."""
    from hazardframe.operators import horizons

    labelled = horizons.horizon_labels(scored(t))
    return labelled.withColumn("p_event_hat", S.clip(F.round(0.5 + 0.4 * F.col("risk"), 2), 0.0, 1.0))


SQL: dict[str, str] = {
    "patient": """
ends AS (
  SELECT o_custkey, min(o_orderdate) AS first_day,
         max(o_orderdate) AS last_day FROM orders GROUP BY o_custkey),
last_order AS (
  SELECT o_custkey, o_orderstatus FROM (
    SELECT o_custkey, o_orderstatus,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) z WHERE rn = 1),
patient AS (
  SELECT c.c_custkey AS "PATIENT_ID", c.c_mktsegment AS "CANCER_TYPE",
         CAST(20 + c.c_custkey % 70 AS DOUBLE) AS "AGE", CAST(c.c_custkey % 2 AS VARCHAR) AS "SEX",
         c.c_acctbal AS "ACCTBAL", e.first_day,
         CAST(date_diff('day', CAST(e.first_day AS DATE), CAST(e.last_day AS DATE)) AS DOUBLE) AS "OS_DAYS",
         CAST(date_diff('day', CAST(e.first_day AS DATE), CAST(e.last_day AS DATE)) AS DOUBLE)
           / CAST(30.4375 AS DOUBLE) AS "OS_MONTHS",
         CASE WHEN l.o_orderstatus = 'F' THEN 1 ELSE 0 END AS "OS_EVENT",
         CASE WHEN l.o_orderstatus = 'F' THEN '1:DECEASED' ELSE '0:LIVING' END AS "OS_STATUS"
  FROM customer c JOIN ends e ON c.c_custkey = e.o_custkey JOIN last_order l ON c.c_custkey = l.o_custkey)""",
    "sample": """
sample AS (
  SELECT o.o_custkey AS "PATIENT_ID", p."CANCER_TYPE", o.o_orderkey,
         'tc-' || o.o_custkey || '-' || o.o_orderkey || '-'
           || CASE o.o_orderstatus WHEN 'F' THEN '01' WHEN 'O' THEN '06' ELSE '11' END || '-x' AS "SAMPLE_ID",
         CASE WHEN o.o_orderkey % 7 = 0 THEN '[Not Available]'
              ELSE CAST(date_diff('day', CAST(p.first_day AS DATE), CAST(o.o_orderdate AS DATE)) AS VARCHAR) END
           AS "DAYS_TO_COLLECTION",
         CASE WHEN o.o_orderkey % 5 = 0 THEN '[Not Available]'
              ELSE CAST(date_diff('day', CAST(p.first_day AS DATE), CAST(o.o_orderdate AS DATE)) AS VARCHAR) END
           AS "DAYS_TO_SPECIMEN_COLLECTION"
  FROM orders o JOIN patient p ON o.o_custkey = p."PATIENT_ID"),
sample_metadata AS (
  SELECT "PATIENT_ID", "CANCER_TYPE", o_orderkey, "SAMPLE_ID",
         array_to_string(list_slice(string_split(upper("SAMPLE_ID"), '-'), 1, 4), '-') AS "SAMPLE_ID_NORM",
         greatest(coalesce(TRY_CAST("DAYS_TO_COLLECTION" AS DOUBLE),
                           TRY_CAST("DAYS_TO_SPECIMEN_COLLECTION" AS DOUBLE), 0.0), 0.0) AS "SAMPLE_DAY",
         coalesce(string_split("SAMPLE_ID", '-')[4], '00') AS "SAMPLE_TYPE_CODE",
         coalesce(string_split("SAMPLE_ID", '-')[4], '00') = '01' AS "IS_PRIMARY"
  FROM sample)""",
    "mutation": """
mutation AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS "Tumor_Sample_Barcode", p_brand AS "Hugo_Symbol",
         p_type AS "Variant_Classification", l_returnflag AS "CANCER_TYPE"
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "expression_long": """
exploded AS (
  SELECT vec_id AS sample_id, label AS cohort, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x
  FROM embeddings),
expression_long AS (
  SELECT sample_id, cohort, 'G' || lpad(CAST(pos AS VARCHAR), 2, '0') AS gene,
         abs(CAST(x AS DOUBLE)) * 100 AS value FROM exploded),
cna_long AS (
  SELECT sample_id, cohort, 'G' || lpad(CAST(pos AS VARCHAR), 2, '0') AS gene,
         CAST(least(greatest(round(CAST(x AS DOUBLE) * 8), -2.0), 2.0) AS INTEGER) AS value FROM exploded)""",
    "clinical_raw": """
clinical_raw AS (
  SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "endpoint": """
endpoint AS (
  SELECT * FROM patient WHERE "OS_MONTHS" IS NOT NULL AND "OS_EVENT" IS NOT NULL AND "OS_MONTHS" > 0)""",
    "scored": """
ordered_rows AS (
  SELECT "PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", "OS_DAYS", "OS_MONTHS", "OS_EVENT",
         CAST(0.02 AS DOUBLE) * "AGE" - CAST(0.0001 AS DOUBLE) * "ACCTBAL" AS risk,
         row_number() OVER (PARTITION BY "OS_EVENT" ORDER BY md5('42|' || "PATIENT_ID"), "PATIENT_ID") - 1 AS pos,
         count(*) OVER (PARTITION BY "OS_EVENT") AS n,
         row_number() OVER (PARTITION BY "CANCER_TYPE", "OS_EVENT"
                            ORDER BY md5('42|' || "PATIENT_ID"), "PATIENT_ID") - 1 AS fold_pos
  FROM endpoint),
scored AS (
  SELECT "PATIENT_ID", "CANCER_TYPE", "AGE", "SEX", "OS_DAYS", "OS_MONTHS", "OS_EVENT", risk,
         CASE WHEN pos < round(n * CAST(0.6 AS DOUBLE)) THEN 'train'
              WHEN pos < round(n * CAST(0.8 AS DOUBLE)) THEN 'calibration' ELSE 'test' END AS split,
         CAST(fold_pos % 5 AS INTEGER) AS fold
  FROM ordered_rows)""",
    "event_probability": """
labelled AS (
  SELECT s.*, CAST(h.horizon_months AS INTEGER) AS horizon_months,
         CASE WHEN "OS_EVENT" = 1 AND "OS_MONTHS" <= h.horizon_months THEN 1
              WHEN "OS_MONTHS" > h.horizon_months THEN 0 END AS y_true_by_horizon
  FROM scored s CROSS JOIN (VALUES (12), (24), (36), (60)) AS h(horizon_months)),
event_probability AS (
  SELECT *, least(greatest(round(CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) * risk, 2), 0.0), 1.0) AS p_event_hat
  FROM labelled WHERE y_true_by_horizon IS NOT NULL)""",
}
_NEEDS = {
    "patient": [], "sample": ["patient"], "mutation": [], "expression_long": [], "clinical_raw": [],
    "endpoint": ["patient"], "scored": ["patient", "endpoint"],
    "event_probability": ["patient", "endpoint", "scored"],
}


def r(expression: str, digits: int = 6) -> str:
    """Rounded double without a negative zero, as SQL."""
    value = f"round(CAST({expression} AS DOUBLE), {digits})"
    return f"CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END"


def sql(views: str, body: str) -> str:
    """``body`` preceded by the definitions of the named views and of what they need."""
    names: list[str] = []
    for view in views.split():
        for name in [*_NEEDS[view], view]:
            if name not in names:
                names.append(name)
    ctes = ",".join(SQL[name] for name in names)
    body = re.sub(r"\br6\(([^;]*?);\)", lambda m: r(m.group(1)), body.strip())
    if body[:5].lower() == "with ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
