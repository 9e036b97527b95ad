"""All folds on one table of raw vectors against designs of their own."""

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import concordance, cox, cox_folds, features
from hazardframe.plans import modelling, tuning


def rows(spark, n=400, seed=5):
    g = np.random.default_rng(seed)
    a, b = g.normal(50, 9, n), np.where(g.random(n) < 0.1, np.nan, g.normal(size=n))
    stop = np.round(g.exponential(12 * np.exp(-(a - 50) / 20))) + 1
    table = pd.DataFrame({
        "a": a, "b": b, "c": g.choice(list("xyz"), n), "stop": stop, "start": np.maximum(stop - g.integers(1, 9, n), 0.0),
        "e": (g.random(n) < 0.6).astype(int), "fold": np.arange(n) % 3, "PATIENT_ID": np.arange(n),
    })
    return spark.createDataFrame(table).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(5)


@pytest.mark.parametrize("start", [None, "start"])
def test_likelihood_equals_that_of_copied_rows(spark, start):
    df = rows(spark)
    layout = features.discover_layout(df, ["a", "b", "c"])
    columns = {"stop": "stop", "event": "e", "start": start}
    spaces, data = tuning._fold_data(df, layout, 3, 5, False, columns)
    assert isinstance(data, cox_folds.FoldData)
    plain = features.fit_spaces(df, layout, "fold", 3, 5)
    copied = cox.cox_data(features.training_rows(df, layout, plain), group="g", width=5, **columns)
    betas = {g: np.random.default_rng(g).normal(size=(5, 2 + g)) / 3 for g in (0, 2)}
    found, want = data.likelihood(betas), cox.partial_likelihood(copied, betas)
    assert set(found) == set(want) == {0, 2}
    for g in betas:
        assert spaces[g].weights == pytest.approx(plain[g].weights, abs=1e-9)
        assert found[g][0] == pytest.approx(want[g][0], abs=1e-8) and found[g][1] == pytest.approx(want[g][1], abs=1e-8)
    for g in range(3):
        assert data.metrics[g] == pytest.approx(copied.metrics[g], abs=1e-8)
    copied.close()


def test_rows_are_written_once(spark, monkeypatch):
    """Neither for each training set nor for start and stop."""
    df = rows(spark)
    layout = features.discover_layout(df, ["a", "c"])
    _, data = tuning._fold_data(df, layout, 3, 5, False, {"stop": "stop", "event": "e", "start": "start"})
    assert data.blocks.packed.agg(F.sum("n")).first()[0] == 400
    # With more event times than the grid takes, rows are sorted by time; the models are the same.
    problems = [cox.Problem(g, 1.0, 0.3) for g in range(3)]
    fits = cox.fit_models(data, problems)
    monkeypatch.setattr(cox_folds, "GRID_TIMES", 10)
    spaces, sorted_ = tuning._fold_data(df, layout, 3, 5, False, {"stop": "stop", "event": "e", "start": "start"})
    assert isinstance(sorted_, cox.CoxData)
    for one, other in zip(fits, cox.fit_models(sorted_, problems)):
        assert one.coef == pytest.approx(other.coef, abs=1e-5) and one.objective == pytest.approx(other.objective, rel=1e-9)
    sorted_.close()


def test_event_time_without_weight_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 5.0, 3.0, 1, 0)], "a double, start double, stop double, e int, fold int")
    blocks = cox_folds.raw_blocks(df, [F.col("a")], "fold", 1, "stop", "e", "start")
    data, zero = cox_folds.FoldData(blocks, {features.ALL: (np.eye(1), np.zeros(1))}), {features.ALL: np.zeros((1, 1))}
    assert np.isnan(data.likelihood(zero, strict=False)[features.ALL][0]).all()
    with pytest.raises(ValueError):
        data.likelihood(zero)


def test_a_group_of_the_concordance_has_one_model(spark):
    df = spark.createDataFrame([(float(i % 7), i % 2, [float(i % 5), float(i % 3), None if i % 4 else 1.0]) for i in range(60)], "t double, e int, r array<double>")
    blocks = concordance._packed(df.select(F.lit("all"), F.col("t"), F.col("e"), F.col("r")))
    assert blocks.groupBy("k").agg(F.max("m").alias("m"), F.countDistinct("m0").alias("models")).select("m", "models").distinct().collect() == [(1, 1)]


def test_thresholds_that_leave_the_same_columns_share_a_run(spark, monkeypatch):
    g = np.random.default_rng(1)
    a = g.normal(size=300)
    table = pd.DataFrame({"AGE": g.normal(size=300), "EXPR_a": a, "EXPR_b": a + 0.5 * g.normal(size=300), "EXPR_c": g.normal(size=300), "split": "train"})
    runs = []

    def run(rows, clinical, expression, **_):
        runs.append(expression)
        month = {"coverage_test_events_only": 0.9, "mean_interval_width_months_test": 1.0}
        return type("Run", (), {"metrics": {"conformal_month_interval": month, **{f"c_index_{s}": 0.5 for s in ("train", "calibration", "test")}}})

    monkeypatch.setattr(modelling, "train_and_calibrate", run)
    found = modelling.threshold_sweep(spark.createDataFrame(table), ["AGE"], [1.0, 0.95, 0.75]).collect()
    assert [r["expr_after"] for r in found] == [3, 3, 2] and {r["status"] for r in found} == {"completed"}
    assert runs == [["EXPR_a", "EXPR_b", "EXPR_c"], ["EXPR_a", "EXPR_c"]]


@pytest.mark.parametrize("compressible", [True, False])
def test_a_task_holds_few_blocks_at_once(spark, compressible):
    """A reader opens a row group at once: its bytes in memory are limited, and those of the file however well rows compress."""
    n, width = 40_000, 40
    value = (F.lit(1.5) if compressible else F.rand(3)).alias("a")
    df = spark.range(0, n, 1, 1).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") % 50 + 1.0).alias("stop"), F.lit(1).alias("e"), value)
    blocks = cox_folds.raw_blocks(df, [F.col("a") + i for i in range(width)], "fold", 3, "stop", "e")
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in blocks.packed.inputFiles()]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert len(files) == 1 and max(g.total_byte_size for g in groups) < 8_000_000
    assert blocks.packed.agg(F.sum("n"), F.max("n")).first()[:] == (n, cox_folds.BLOCK_CELLS // width)
    if compressible:
        assert blocks.packed.agg(F.sum(F.length("x"))).first()[0] < n * width * 8 // 20
    gram = sum(blocks.grams.values())
    sums = df.agg(F.sum("a"), F.sum(F.col("a") * F.col("a"))).first()
    assert gram[0, 0] == n and gram[0, 1] == pytest.approx(sums[0]) and gram[1, 1] == pytest.approx(sums[1])
    assert gram[0, width] == pytest.approx(sums[0] + n * (width - 1))
