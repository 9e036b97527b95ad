"""A saved run scores rows like the run itself did."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardframe.plans import modelling
from hazardframe.sources.bundles import Bundle
from tests.test_models import survival_rows


def patients(spark, n=300):
    x, t, e, _ = survival_rows(n, seed=11, ties=False)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "PATIENT_ID": np.arange(n), "OS_MONTHS": t * 4, "OS_EVENT": e, "AGE": 60 + 9 * x[:, 0], "CANCER_TYPE": rng.choice(["A", "B", "C"], n),
        "EXPR_a": x[:, 1], "EXPR_b": x[:, 1] + x[:, 2], "SMOKER": rng.random(n) < 0.4,
    })
    pdf.loc[::11, "AGE"] = np.nan
    pdf.loc[::13, "CANCER_TYPE"] = None
    return spark.createDataFrame(pdf).withColumn("AGE", F.when(~F.isnan("AGE"), F.col("AGE")))


@pytest.mark.parametrize("interval", ["isotonic", "cqr"])
def test_scores_survive_a_round_trip(spark, tmp_path, interval):
    rows, _ = modelling.prepare_rows(patients(spark), outliers=False)
    run = modelling.train_and_calibrate(rows, ["AGE", "CANCER_TYPE", "SMOKER"], penalty=(0.8, 0.3), interval=interval, cqr_rounds=3)
    Bundle.of(run).save(spark, str(tmp_path / "model"))
    bundle = Bundle.load(spark, str(tmp_path / "model"))
    assert (len(bundle.quantiles), "months" in bundle.steps) == ((2, False) if interval == "cqr" else (0, True))
    # Only what a new patient has: no outcome, no split, one column more.
    new = rows.select("PATIENT_ID", "AGE", "CANCER_TYPE", "SMOKER", "EXPR_a", "EXPR_b", F.lit(1).alias("other"))
    scored = bundle.score(new)
    want = {r["PATIENT_ID"]: r for r in run.predictions.collect()}
    got = {r["PATIENT_ID"]: r for r in scored.collect()}
    assert len(got) == 300
    bounds = ("pred_survival_lo_months_90", "pred_survival_hi_months_90")
    for i, r in want.items():
        assert got[i]["risk_score"] == pytest.approx(r["risk_score"], abs=1e-12)
        if r["split"] == "test":
            assert [got[i][b] for b in bounds] == pytest.approx([r[b] for b in bounds], abs=1e-9)
    if run.horizon_predictions is not None:
        for r in run.horizon_predictions.collect():
            h, g = r["horizon_months"], got[r["PATIENT_ID"]]
            assert [g[f"p_event_{h}"], g[f"p_event_lo_{h}"], g[f"p_event_hi_{h}"]] == pytest.approx([r["p_event_hat"], r["p_event_lo"], r["p_event_hi"]], abs=1e-9)
    odd = spark.createDataFrame([(1, None, "never seen", None, 0.5, None)], "PATIENT_ID int, AGE double, CANCER_TYPE string, SMOKER boolean, EXPR_a double, EXPR_b double")
    assert np.isfinite(bundle.score(odd).first()["risk_score"])
    with pytest.raises(ValueError, match="AGE"):
        bundle.score(new.drop("AGE"))


def test_no_model_and_another_version(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Bundle.load(spark, str(tmp_path / "none"))
