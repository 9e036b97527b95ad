import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import ordered, splits


def heavy_values(n=400, seed=1):
    """A third of all rows share one value, and one key holds most rows."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=n), 1)
    v[: n // 3] = 0.5
    k = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    return list(zip(k.tolist(), v.tolist(), range(n)))


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_quantiles_match_numpy(spark, pieces):
    rows = heavy_values()
    df = spark.createDataFrame([*rows, ("hot", None, -1)], "k string, v double, i int")
    cuts = ordered.cut_points(df, "v", pieces)
    got = {r["k"]: r for r in ordered.exact_quantiles(df, "v", {"q25": 0.25, "q50": 0.5, "q99": 0.99}, ["k"], cuts).collect()}
    for k in ("hot", "a", "b"):
        v = [x[1] for x in rows if x[0] == k]
        assert [got[k]["q25"], got[k]["q50"], got[k]["q99"]] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.99]).tolist())


@pytest.mark.parametrize("descending", [False, True])
def test_running_columns_match_one_sorted_pass(spark, descending):
    rows = [(k, float(i % 97) + i / 1000, i) for k, _, i in heavy_values()]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    pieced = ordered.with_piece(df, "v", ordered.cut_points(df, "v", 12))
    out = ordered.ordered_columns(
        pieced, ["v"], ["k"], sums={"s": "i"}, mins={"m": "i"}, totals={"t": "i"}, index="pos", size="n", following={"nx": "v"},
        descending=descending,
    ).collect()
    assert len(out) == len(rows)
    for k in ("hot", "a", "b"):
        mine = sorted((r for r in out if r["k"] == k), key=lambda r: r["v"], reverse=descending)
        i = np.array([r["i"] for r in mine])
        assert [r["s"] for r in mine] == np.cumsum(i).tolist()
        assert [r["m"] for r in mine] == np.minimum.accumulate(i).tolist()
        assert {r["t"] for r in mine} == {int(i.sum())}
        assert [r["pos"] for r in mine] == list(range(len(mine)))
        assert {r["n"] for r in mine} == {len(mine)}
        assert [r["nx"] for r in mine] == [r["v"] for r in mine[1:]] + [None]


def test_average_ranks(spark):
    df = spark.createDataFrame([("f", x) for x in (3.0, 1.0, 3.0, 2.0, 3.0)], "k string, v double")
    got = {r["v"]: r["rank"] for r in ordered.average_ranks(df, "v", ["k"]).collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_cut_points_isolate_heavy_values(spark):
    df = spark.createDataFrame([(0.5,)] * 300 + [(float(i),) for i in range(300)], "v double")
    cuts = ordered.cut_points_of(df, ["v"], 16, isolate=True)["v"]
    pieces = ordered.with_piece(df, "v", cuts.cuts, "p").groupBy("p").agg(F.count_distinct("v").alias("d"), F.count("*").alias("n"))
    found = {r["p"]: r for r in pieces.collect()}
    assert any(found[p]["d"] == 1 and found[p]["n"] == 300 for p in cuts.isolated)


def test_folds_and_splits_are_balanced(spark):
    df = spark.range(1000).select(F.col("id").alias("PATIENT_ID"), (F.col("id") % 10 == 0).cast("int").alias("OS_EVENT"))
    folded = splits.stratified_folds(df, "PATIENT_ID", ["OS_EVENT"], 3)
    sizes = folded.groupBy("OS_EVENT", "fold").count().collect()
    for e in (0, 1):
        n = [r["count"] for r in sizes if r["OS_EVENT"] == e]
        assert len(n) == 3 and max(n) - min(n) <= 1
    report = {r["split"]: r for r in splits.split_report(splits.three_way_split(df, "PATIENT_ID", ["OS_EVENT"])).collect()}
    assert {k: (r["rows"], r["events"]) for k, r in report.items()} == {"train": (600, 60), "calibration": (200, 20), "test": (200, 20)}


def test_single_class_is_refused(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "PATIENT_ID int, OS_EVENT int")
    with pytest.raises(ValueError):
        splits.fold_count(df)
    with pytest.raises(ValueError):
        splits.require_both_classes(splits.split_report(df.withColumn("split", F.lit("train"))))


def test_patient_folds_keep_rows_together(spark):
    df = spark.range(90).select((F.col("id") % 30).alias("PATIENT_ID"), F.lit("c").alias("CANCER_TYPE"), (F.col("id") % 2).alias("OS_EVENT"))
    out = splits.group_folds(df, "PATIENT_ID", ["CANCER_TYPE", "OS_EVENT"], 5)
    assert out.count() == 90
    assert out.groupBy("PATIENT_ID").agg(F.count_distinct("fold").alias("d")).where("d > 1").count() == 0


@pytest.mark.parametrize("limit", [0, 64])
def test_look_up_by_literals_and_by_join(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "LITERAL_KEYS", limit)
    rows = spark.createDataFrame([("a", 1, 5), ("a", None, 6), (None, 1, 7), ("b", 2, 8), ("c", 1, 9)], "g string, h int, v int")
    table = spark.createDataFrame([("a", 1, 0.5, None), ("a", None, 1.5, "x"), (None, 1, 2.5, "y"), ("b", 2, float("inf"), "z")], "g string, h int, w double, s string")
    found, small = ordered.look_up(rows, table, ["g", "h"])
    assert sorted((r["v"], r["w"], r["s"]) for r in found.collect()) == [(5, 0.5, None), (6, 1.5, "x"), (7, 2.5, "y"), (8, float("inf"), "z")]
    assert small.count() == 4 and found.columns == ["g", "h", "v", "w", "s"]
    empty, _ = ordered.look_up(rows, table.where("g = 'none'"), ["g", "h"])
    assert empty.count() == 0 and empty.columns == found.columns


@pytest.mark.parametrize("cuts", [None, [], [-1.0, 0.0, 0.5, 2.0, 3.0]])
def test_medians_of_all_but_one_group(spark, cuts):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"fold": rng.integers(0, 4, 301), "a": rng.normal(size=301), "b": rng.integers(0, 4, 301).astype(float)})
    pdf.loc[::5, "a"], pdf.loc[pdf.fold != 2, "c"] = np.nan, np.nan
    pdf.loc[pdf.fold == 2, "c"] = 7.5
    cells = [(int(r.fold), *[None if np.isnan(v) else float(v) for v in (r.a, r.b, r.c)], None) for r in pdf.itertuples()]
    df = spark.createDataFrame(cells, "fold int, a double, b double, c double, d double")
    found = {(r["g"], r["feature"]): r["median"] for r in ordered.leave_out_medians(df, ["a", "b", "c", "d"], "fold", [0, 1, 2, 3, 9], cuts).collect()}
    for g in (0, 1, 2, 3, 9):
        for c in "abc":
            want = pdf.loc[pdf.fold != g, c].median()
            assert found[g, c] == (pytest.approx(want) if want == want else None)
        assert (g, "d") not in found  # a column without any value has no row
    assert ordered.leave_out_medians(df.limit(0), ["a"], "fold", [0, 1]).count() == 0
