import pytest
from pyspark.sql import functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators import clean, cohort, genes, intervals, profile
from hazardframe.plans import feature_tables


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text,flag", [("1:DECEASED", 1), ("Deceased", 1), ("0:LIVING", 0), ("Unknown", 0), (None, 0), ("x1:", 1)]
)
def test_status(spark, text, flag):
    assert one(spark, S.status_flag("v"), text) == flag
    assert one(spark, S.status_matches("v"), text) == flag


@pytest.mark.parametrize("text,number", [("12.5", 12.5), ("[Not Available]", None), ("NaN", None), (None, None), ("-3", -3.0), ("x", None)])
def test_to_number(spark, text, number):
    assert one(spark, S.to_number("v"), text) == number


@pytest.mark.parametrize(
    "raw,norm,code", [("st-02-0001-01-a", "ST-02-0001-01", "01"), ("ab-c", "AB-C", "00"), ("a-b-c-06", "A-B-C-06", "06")]
)
def test_barcodes(spark, raw, norm, code):
    assert one(spark, S.normalise_barcode("v"), raw) == norm
    assert one(spark, S.sample_type_code("v"), raw) == code


@pytest.mark.parametrize("age,label", [(0.0, None), (40.0, "≤40"), (40.5, "41-55"), (75.0, "66-75"), (120.0, ">75"), (121.0, None), (None, None)])
def test_age_groups(spark, age, label):
    assert one(spark, S.age_group("v"), age, "double") == label


def test_clip_keeps_null(spark):
    assert one(spark, S.clip("v", 0.0, 1.0), None, "double") is None
    assert one(spark, S.clip("v", 0.0, 1.0), 4.0, "double") == 1.0


def test_endpoints(spark):
    rows = [("a", "5", "1"), ("b", "0", "1"), ("c", "-2", "0"), ("d", None, "1"), ("e", "3", None), ("f", "7", "2"), ("g", "x", "1")]
    df = spark.createDataFrame(rows, "PATIENT_ID string, OS_MONTHS string, OS_EVENT string")
    assert {r["PATIENT_ID"]: r["OS_EVENT"] for r in cohort.survival_endpoint(df).collect()} == {"a": 1, "f": 2}
    more = df.unionByName(spark.createDataFrame([(f"z{i}", "4", "0") for i in range(20)], df.schema))
    strict = {r["PATIENT_ID"]: r["OS_EVENT"] for r in cohort.strict_endpoint(more).collect()}
    assert strict["f"] == 1 and len(strict) == 22
    with pytest.raises(ValueError):
        cohort.strict_endpoint(df)


def test_first_row_prefers_order_then_content(spark):
    df = spark.createDataFrame([("p", 2, "x"), ("p", 1, "z"), ("p", 1, "y"), ("q", 9, None)], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in cohort.first_row(df, ["k"], ["o"]).collect()} == {"p": "y", "q": None}
    assert {r["k"]: r["v"] for r in cohort.first_row(df, ["k"], ["o"], last=True).collect()} == {"p": "x", "q": None}


def test_fence_is_sequential_and_keeps_missing(spark):
    rows = [(float(i), float(i % 7)) for i in range(40)] + [(1000.0, 500.0), (5.0, 400.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "OS_MONTHS double, AGE double")
    left, rules = clean.iqr_filter(df, ("OS_MONTHS", "AGE", "ABSENT"), 3.0)
    assert [r["removed_rows"] for r in rules] == [1, 1, 0] and rules[2]["reason"] == "column_not_found"
    assert left.count() == 41 and left.where("OS_MONTHS IS NULL").count() == 1
    flat, rules = clean.iqr_filter(spark.createDataFrame([(1.0,)] * 5, "AGE double"), ("AGE",))
    assert rules[0]["skipped"] and flat.count() == 5


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 5.0)], "c string, x double")
    assert {r["column"]: r["missing_count"] for r in profile.missingness(df).collect()} == {"c": 1, "x": 1}
    d = profile.numeric_describe(df, ["x"]).first()
    assert (d["count"], d["mean"], d["std"], d["q50"]) == (3, 3.0, 2.0, 3.0)
    top = profile.categorical_overview(df, ["c"]).first()
    assert (top["n_unique"], top["top_value"], top["top_count"]) == (2, "a", 2)
    bins = profile.histogram(df, "x", 4).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [1, 0, 1, 1]


def test_leakage_guard():
    clean.check_leakage(["AGE", "EXPR_A"], ["OS_MONTHS"])
    for bad in ("OS_DAYS", "DFS_MONTHS"):
        with pytest.raises(ValueError):
            clean.check_leakage(["AGE", bad], ["OS_MONTHS"])


def interval_rows(spark, patients, samples):
    p = spark.createDataFrame(patients, "PATIENT_ID string, CANCER_TYPE string, OS_DAYS double, OS_EVENT int")
    s = spark.createDataFrame(
        samples, "PATIENT_ID string, CANCER_TYPE string, SAMPLE_ID string, SAMPLE_DAY double, MUTATION_BURDEN long"
    ).withColumn("SAMPLE_ID_NORM", S.normalise_barcode("SAMPLE_ID")).withColumn("SAMPLE_TYPE_CODE", F.lit("01")).withColumn(
        "IS_PRIMARY", F.lit(True)
    )
    out = intervals.survival_intervals(p, s).orderBy("PATIENT_ID", "INTERVAL_INDEX").collect()
    return {k: [r for r in out if r["PATIENT_ID"] == k] for k, *_ in patients}


def test_intervals_by_hand(spark):
    patients = [("none", "C", 10.0, 1), ("late", "C", 2000.0, 1), ("same", "C", 50.0, 0), ("end", "C", 30.0, 1)]
    samples = [
        ("late", "C", "l-1", 800.0, 5), ("late", "C", "l-0", 100.0, 4), ("same", "C", "s-b", 0.0, 2), ("same", "C", "s-a", 0.0, 1),
        ("end", "C", "e-1", 0.0, 1), ("end", "C", "e-2", 30.0, 9),
    ]
    got = interval_rows(spark, patients, samples)
    assert [(r["T_START"], r["T_STOP"], r["EVENT"], r["SAMPLE_TYPE_CODE"]) for r in got["none"]] == [(0.0, 10.0, 1, "00")]
    assert [(r["T_START"], r["T_STOP"], r["EVENT"], r["SAMPLE_ID"]) for r in got["late"]] == [
        (0.0, 100.0, 0, None), (100.0, 800.0, 0, "l-0"), (800.0, 2000.0, 1, "l-1")]
    assert [(r["SAMPLE_ID"], r["MUTATION_BURDEN"]) for r in got["same"]] == [("s-a", 1)]
    # The sample on the last day is moved to just before the end and carries the event.
    assert [(r["T_START"], r["EVENT"]) for r in got["end"]] == [(0.0, 0), (30.0 - 1e-6, 1)]


def test_intervals_abut_and_keep_events(spark):
    patients = [(f"p{i}", "C", 100.0 + 400 * i, i % 2) for i in range(8)]
    samples = [(f"p{i}", "C", f"s-{i}-{j}", float((j * 61) % (100 + 400 * i)), j) for i in range(8) for j in range(i * 6)]
    got = interval_rows(spark, patients, samples)
    for pid, _, days, event in patients:
        rows = got[pid]
        assert rows[0]["T_START"] == 0.0 and rows[-1]["T_STOP"] == days
        assert all(a["T_STOP"] == b["T_START"] for a, b in zip(rows, rows[1:]))
        assert sum(r["EVENT"] for r in rows) == event


def test_gene_tables(spark):
    rows = [("s1", "A", "g1", 1.0), ("s2", "A", "g1", 9.0), ("s1", "A", "g2", 2.0), ("s2", "A", "g2", None), ("s3", "B", "g1", 5.0)]
    df = spark.createDataFrame(rows, "sample_id string, cohort string, gene string, value double")
    assert [r["gene"] for r in genes.top_variable_genes(df, 1).collect()] == ["g1"]
    wide = {r["sample_id"]: r for r in genes.align_genes(df, ["g2", "g9"], "CNA_").collect()}
    assert wide["s2"]["CNA_g2"] is None and wide["s3"]["CNA_g2"] is None and wide["s1"]["CNA_g9"] == 0.0
    assert [r["gene"] for r in genes.genes_in_all_cohorts(df).collect()] == ["g1"]


def test_cleaning_chain(spark):
    rows = [(str(i), "C", float(30 + i), "M" if i % 3 else None, "1:DECEASED" if i % 2 else "0:LIVING", float(i + 1), None) for i in range(10)]
    rows.append(("0", "C", 99.0, "F", None, None, "x"))
    raw = spark.createDataFrame(
        rows, "PATIENT_ID string, CANCER_TYPE string, AGE double, SEX string, OS_STATUS string, OS_MONTHS double, NOTE string"
    ).coalesce(1).withColumn("_ordinal", F.monotonically_increasing_id())
    out = feature_tables.clean_clinical(raw)
    assert "NOTE" not in out.columns and out.count() == 10
    first = out.where("PATIENT_ID = '0'").first()
    assert (first["AGE"], first["SEX"], first["OS_EVENT"], first["Status"]) == (30.0, "Unknown", 0, "Living")


def test_constant_columns_over_many_partitions(spark):
    """The standard deviation of 0.1 over 200 partitions is 7e-19, not 0."""
    rows = spark.range(0, 15_000, 1, 200).select(
        F.lit(0.1).alias("flat"), F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") == 7, float("nan")).otherwise(2.0).alias("gaps"), (F.col("id") == 14_999).alias("flag").cast("int"),
    )
    assert profile.zero_variance_columns(rows, ["flat", "x", "none", "gaps", "flag"]) == ["flat", "none", "gaps"]
    assert profile.density_grid(rows, "flat", []).count() == 0


def test_counted_calls_give_the_burden_of_single_ones(spark):
    """Calls counted by order before they meet the samples."""
    calls = spark.createDataFrame([("tc-1-2-01-a", "A"), ("tc-1-2-01-a", "A"), ("tc-1-2-01-b", "A"), ("tc-1-3-01-a", None)], "Tumor_Sample_Barcode string, CANCER_TYPE string")
    counted = calls.groupBy(*calls.columns).agg(F.count(F.lit(1)).alias("N_CALLS"))
    for found in (cohort.mutation_burden, cohort.burden_by_normalised_sample):
        rows = [sorted(map(str, found(df).collect())) for df in (calls, counted)]
        assert rows[0] == rows[1] and len(rows[0]) == (3 if found is cohort.mutation_burden else 2)
