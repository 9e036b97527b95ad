"""The re-run on cleaned columns: one set of folds, one design, paired differences."""

import random

import pytest

from hazardframe.operators import splits
from hazardframe.plans import tuning


@pytest.fixture(scope="module")
def intervals(spark):
    r = random.Random(3)
    rows = []
    for p in range(60):
        age, event, days = 40.0 + r.random() * 40, p % 2, 200.0 + r.random() * 900
        cuts = [0.0, days / 2, days] if p % 3 == 0 else [0.0, days]
        for k, (start, stop) in enumerate(zip(cuts, cuts[1:])):
            last = stop == days
            rows.append((f"p{p}", "ab"[p % 2], start, stop, event if last else 0, days, event, age if p % 7 else None, f"s{r.randrange(3)}",
                         p % 5, r.random() + k, r.random(), r.random()))
    names = "PATIENT_ID string, CANCER_TYPE string, T_START double, T_STOP double, EVENT int, OS_DAYS double, OS_EVENT int, AGE double, TUMOR_SITE string"
    return spark.createDataFrame(rows, names + ", MUTATION_BURDEN int, EXPR_a double, EXPR_b double, CNA_c double").cache()


SETTINGS = {"folds": 3, "maxiter": 60, "components": 2}


def _alone(df, covariates):
    """Indices of a run of its own on the same folds."""
    folded = splits.group_folds(df, "PATIENT_ID", ["CANCER_TYPE", "OS_EVENT"], 3)
    rest = [3, 60, 40.0, tuning._INTERVAL_COLUMNS, True, "OS_DAYS", "OS_EVENT", 1.0, 2]
    table = tuning._ablation_scores(folded, tuning._interval_layout(folded, covariates), *rest)
    return {(r.label, r.fold): r.c_index for r in table.itertuples()}


def test_both_runs_on_one_design_equal_runs_of_their_own(intervals):
    found = tuning.cleaned_rerun(intervals, ["TUMOR_SITE", "NOT_THERE"], covariates=["AGE", "TUMOR_SITE"], **SETTINGS).collect()
    assert len(found) == 21 and all(not r["note_old"] and not r["note_cleaned"] for r in found)
    old, cleaned = _alone(intervals, ["AGE", "TUMOR_SITE"]), _alone(intervals.drop("TUMOR_SITE"), ["AGE"])
    for r in found:
        key = r["experiment"], r["fold"]
        assert r["c_index_old"] == pytest.approx(old[key], abs=0.01) and r["c_index_cleaned"] == pytest.approx(cleaned[key], abs=0.01)
        assert r["delta"] == pytest.approx(r["c_index_cleaned"] - r["c_index_old"], abs=1e-12)
    assert any(r["delta"] for r in found if r["experiment"] == "Clinical only")
    assert all(r["delta"] == pytest.approx(0, abs=0.01) for r in found if r["experiment"].startswith("Omics only"))


def test_an_omic_column_gives_the_cleaned_run_its_own_components(intervals):
    found = tuning.cleaned_rerun(intervals, ["EXPR_b", "AGE"], covariates=["AGE"], **SETTINGS).collect()
    cleaned = _alone(intervals.drop("EXPR_b", "AGE"), [])
    for r in found:
        if r["experiment"] == "Clinical only":
            assert r["c_index_cleaned"] is None and r["delta"] is None and r["note_cleaned"] == "no_columns_left"
        else:
            assert r["c_index_cleaned"] == pytest.approx(cleaned[r["experiment"], r["fold"]], abs=1e-9)


def test_counts_and_summary(spark, intervals):
    counts = tuning.rerun_counts(intervals, ["TUMOR_SITE", "NOT_THERE"], 3).orderBy("fold").collect()
    assert [r["patients"] for r in counts] == [20, 20, 20] and sum(r["rows"] for r in counts) == 80 and sum(r["events"] for r in counts) == 30
    assert {(r["columns_before"], r["columns_after"], r["dropped"], r["absent"]) for r in counts} == {(13, 12, "TUMOR_SITE", "NOT_THERE")}
    scores = [("x", 0, 0, 0.5, ""), ("x", 0, 1, 0.7, ""), ("x", 1, 0, 0.6, ""), ("x", 1, 1, None, "fold_2:LinAlgError"), ("x", 2, 0, 0.8, ""), ("x", 2, 1, 0.7, "")]
    paired = tuning.pair_folds(spark.createDataFrame(scores, "label string, fold int, variant int, c_index double, note string"))
    row = tuning.paired_summary(paired).first()
    assert (row["paired_folds"], row["folds_better"], row["folds_worse"]) == (2, 1, 1)
    assert row["mean_paired_delta"] == pytest.approx(0.05) and row["std_paired_delta"] == pytest.approx(0.15)
    assert row["delta_mean_c_index"] == pytest.approx(0.7 - 1.9 / 3)
