import json

import pytest
from pyspark.sql import functions as F

from hazardframe.operators import boosting, cox
from hazardframe.sources import readers, writers


def test_clinical_scan(spark, tmp_path):
    path = tmp_path / "patients.txt"
    path.write_text("#a\tb\n#c\nPATIENT_ID\tAGE\tNOTE\np1\t50\t[Not Available]\n#p2\t[Pending]\tx\np1\t60\tNA\n")
    rows = readers.read_clinical(spark, str(path)).orderBy("_ordinal").collect()
    assert [(r["PATIENT_ID"], r["AGE"], r["NOTE"]) for r in rows] == [("p1", "50", None), ("#p2", None, "x"), ("p1", "60", None)]
    typed = readers.infer_numbers(readers.read_clinical(spark, str(path)))
    assert dict(typed.dtypes)["AGE"] == "double" and dict(typed.dtypes)["PATIENT_ID"] == "string"


def test_matrix_scan_keeps_first_gene_line(spark, tmp_path):
    path = tmp_path / "expr.txt"
    path.write_text("Hugo_Symbol\tEntrez_Gene_Id\tab-1-x-01-z\tab-2-x-01\nG1\t7\t1.5\t2\nG2\t8\tNA\t4\nG1\t7\t9\t9\n")
    got = {(r["sample_id"], r["gene"]): r["value"] for r in readers.read_matrix(spark, str(path), "A", normalise=True).collect()}
    assert got == {("AB-1-X-01", "G1"): 1.5, ("AB-2-X-01", "G1"): 2.0, ("AB-1-X-01", "G2"): None, ("AB-2-X-01", "G2"): 4.0}


def test_cohorts_and_mutations(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Tumor_Sample_Barcode\tHugo_Symbol\ns1\tG\n")
    (tmp_path / "b.txt").write_text("Tumor_Sample_Barcode\tOther\ns2\tx\n")
    paths = {"A": str(tmp_path / "a.txt"), "B": str(tmp_path / "b.txt")}
    rows = {r["CANCER_TYPE"]: r for r in readers.read_cohort_mutations(spark, paths).collect()}
    assert rows["A"]["Hugo_Symbol"] == "G" and rows["B"]["Hugo_Symbol"] is None
    one = readers.read_cohort_mutations(spark, paths, ["Tumor_Sample_Barcode"])
    assert one.columns == ["Tumor_Sample_Barcode", "CANCER_TYPE"]


def test_fallbacks_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    writers.write_csv(df, str(tmp_path / "only.csv"))
    assert readers.read_parquet_or_csv(spark, str(tmp_path / "only")).count() == 2
    writers.write_parquet(df.withColumn("a", F.array("i")), str(tmp_path / "both.parquet"))
    back = readers.read_parquet_or_csv(spark, str(tmp_path / "both"))
    assert dict(back.dtypes)["a"] == "string" and back.where("s IS NULL").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_parquet_or_csv(spark, str(tmp_path / "none"))
    assert readers.read_or_build(spark, str(tmp_path / "none.parquet"), lambda: df).count() == 2
    assert writers.convert_folder(spark, [str(tmp_path / "only.csv")]) and readers.read_table(spark, str(tmp_path / "only.parquet")).count() == 2
    writers.preview(df, str(tmp_path / "head.csv"), 1)
    assert readers.read_table(spark, str(tmp_path / "head.csv")).count() == 1


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    writers.write_parquet(df, str(tmp_path / "t.parquet"))
    row = writers.prune_tables(spark, str(tmp_path), str(tmp_path / "out"), {"t": ["b", "z"], "absent": ["x"]}).first()
    record = row["files"][0]
    assert (record["before_columns"], record["after_columns"], record["dropped_columns"]) == (3, 2, ["b"])
    assert record["declared_but_missing_columns"] == ["z"] and len(row["files"]) == 1


@pytest.mark.parametrize("key", ["conformal_month_interval", "cqr_month_interval"])
def test_run_metrics(spark, tmp_path, key):
    metrics = tmp_path / f"{key}.json"
    metrics.write_text(json.dumps({"c_index_test": 0.7, "n_test": 5, key: {"coverage_test_events_only": 0.8}}))
    summary = tmp_path / f"{key}_c.json"
    summary.write_text(json.dumps({"feature_counts": {"expr_before": 9}, "expression": {"method_details": {"n_pairs_above_threshold": 4}}}))
    r = readers.read_run_metrics(spark, str(metrics), str(summary)).first()
    assert (r["c_index_test"], r["n_test"], r["coverage_test_events_only"], r["c_index_train"]) == (0.7, 5, 0.8, None)
    assert (r["expr_before"], r["expr_after"], r["collinearity_pairs_above_threshold"]) == (9, None, 4)
    assert readers.read_run_metrics(spark, str(metrics)).count() == 1


def test_models_survive_a_round_trip(spark, tmp_path):
    rows = [(float(i % 7), [float(i % 5), float(i)], float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "OS_MONTHS double, features array<double>, x double").withColumn("OS_EVENT", F.lit(1))
    model = boosting.fit_quantile(df, 0.5, rounds=2)
    writers.save_quantile_model(model, spark, str(tmp_path / "m"))
    again = writers.load_quantile_model(spark, str(tmp_path / "m"))
    a = [r["q"] for r in model.transform(df, "q").orderBy("x").collect()]
    assert [r["q"] for r in again.transform(df, "q").orderBy("x").collect()] == a
    fit = cox.Fit(cox.Problem(label="final"), __import__("numpy").array([0.5, -1.0]), 1.0, 3, True)
    writers.save_fits(df, [fit], ["a", "b"], str(tmp_path / "coef"))
    assert writers.load_coefficients(spark, str(tmp_path / "coef")) == {("final", 0): [0.5, -1.0]}
    writers.write_report(spark, {"a": {"b": [1, 2]}, "c": None}, str(tmp_path / "report.json"))
    assert spark.read.json(str(tmp_path / "report.json")).first()["a"]["b"] == [1, 2]
