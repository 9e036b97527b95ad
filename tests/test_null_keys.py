"""Rows without a key form a group of their own, as in SQL GROUP BY; none may disappear."""

import numpy as np
import pandas as pd
import pytest

from hazardframe.operators import cohort, collinearity, conformal, intervals, ordered, profile, splits


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    frame = pd.DataFrame({"id": np.arange(1000), "x": np.round(r.normal(size=1000), 2), "y": r.integers(0, 2, 1000)})
    frame["g"] = [None if i % 4 == 0 else "abc"[i % 3] for i in range(1000)]
    return spark.createDataFrame([tuple(v) for v in frame.itertuples(index=False)], "id bigint, x double, y int, g string"), frame


def by_group(frame):
    return {None if isinstance(g, float) else g: part for g, part in frame.groupby("g", dropna=False)}


def test_quantiles_and_box(rows):
    df, frame = rows
    want = by_group(frame)
    got = {r.g: r.m for r in ordered.exact_quantiles(df, "x", {"m": 0.3}, ["g"]).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(np.quantile(p.x, 0.3)) for g, p in want.items())
    box = {r.g: r for r in profile.box_stats(df, "x", ["g"]).collect()}
    assert set(box) == set(want) and all(box[g].q50 == pytest.approx(p.x.median()) for g, p in want.items())
    audit = {r.g: r.score_median for r in conformal.score_audit(df, "x", ["g"]).collect()}
    assert all(audit[g] == pytest.approx(p.x.median()) for g, p in want.items())


def test_histogram_and_density(rows):
    df, frame = rows
    counts = {}
    for r in profile.histogram(df, "x", 7, ["g"]).collect():
        counts[r.g] = counts.get(r.g, 0) + r.n
    assert counts == {g: len(p) for g, p in by_group(frame).items()}
    assert {r.g for r in profile.density_grid(df, "x", ["g"]).collect()} == set(counts)


def test_splits_keep_every_row(rows):
    df, frame = rows
    assert splits.stratified_folds(df, "id", ["g", "y"]).count() == 1000
    parts = splits.three_way_split(df, "id", ["g"]).groupBy("g", "split").count().collect()
    assert sum(r["count"] for r in parts) == 1000 and len(parts) == 12


def test_outcome_of_rows_without_a_group(rows):
    df, frame = rows
    got = {r.g: r.median_os_months for r in cohort.outcome_by_group(df, "g", "id", "x", "y").collect()}
    assert all(got[g] == pytest.approx(p.x.median()) for g, p in by_group(frame).items())


def test_intervals_of_a_patient_without_a_cohort(spark):
    patients = spark.createDataFrame([(1, None, 100.0, 1), (2, "a", 50.0, 0)], "PATIENT_ID bigint, CANCER_TYPE string, OS_DAYS double, OS_EVENT int")
    samples = spark.createDataFrame([(1, None, 0.0, "s1", "s1"), (1, None, 40.0, "s2", "s2")], "PATIENT_ID bigint, CANCER_TYPE string, SAMPLE_DAY double, SAMPLE_ID string, SAMPLE_ID_NORM string")
    got = [(r.PATIENT_ID, r.T_START, r.T_STOP, r.EVENT) for r in intervals.survival_intervals(patients, samples).collect()]
    assert sorted(got) == [(1, 0.0, 40.0, 0), (1, 40.0, 100.0, 1), (2, 0.0, 50.0, 0)]


def test_the_collinearity_rule_is_named_not_guessed(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=300)
    b = a + 0.6 * r.normal(size=300)
    c = b + 0.6 * r.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(a, b, c)], "a double, b double, c double")
    assert collinearity.drop_collinear(df, ["a", "b", "c"], 0.75)[0] == ["a"]
    assert collinearity.drop_collinear(df, ["a", "b", "c"], 0.75, method="incremental")[0] == ["a", "c"]
    with pytest.raises(ValueError):
        collinearity.drop_collinear(df, ["a", "b", "c"], 0.75, method="auto")
