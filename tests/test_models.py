import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardframe.functions import tails
from hazardframe.operators import association, boosting, collinearity, concordance, conformal, cox, features, horizons
from hazardframe.plans import modelling, tuning


def survival_rows(n=240, p=3, seed=0, ties=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    t = rng.exponential(10 * np.exp(-x[:, 0])) + 0.5
    if ties:
        t = np.round(t) + 1
        t[: n // 3] = 4.0
    e = (rng.random(n) < 0.6).astype(int)
    start = np.maximum(t - rng.integers(1, 9, n), 0.0)
    return x, t, e, start


def frame(spark, x, t, e, start):
    return spark.createDataFrame(pd.DataFrame({"OS_MONTHS": t, "OS_EVENT": e, "st": start, "features": list(x)}))


def likelihood(x, t, e, beta, start=None):
    w, eta = np.exp(x @ beta), x @ beta
    value, gradient = 0.0, np.zeros(x.shape[1])
    for i in np.flatnonzero(e):
        at_risk = (t >= t[i]) & ((start < t[i]) if start is not None else True)
        s0 = w[at_risk].sum()
        value += eta[i] - np.log(s0)
        gradient += x[i] - (w[at_risk][:, None] * x[at_risk]).sum(axis=0) / s0
    return value, gradient


@pytest.mark.parametrize("start", [None, "st"])
@pytest.mark.parametrize("stretches", [None, 5, 90])  # 90: a third of the rows share a time that goes over thirty stretches
def test_partial_likelihood_matches_brute_force(spark, start, stretches):
    x, t, e, st = survival_rows()
    data = cox.cox_data(frame(spark, x, t, e, st), start=start, stretches=stretches)
    try:
        betas = np.column_stack([np.zeros(3), [0.3, -0.2, 0.1], [1.0, 0.5, -1.0]])
        values, gradients = cox.partial_likelihood(data, {0: betas})[0]
        for k in range(3):
            value, gradient = likelihood(x, t, e, betas[:, k], st if start else None)
            assert values[k] == pytest.approx(value)
            assert gradients[:, k] == pytest.approx(gradient, abs=1e-8)
    finally:
        data.close()


def test_fits_reach_their_optimum_together(spark):
    x, t, e, st = survival_rows()
    df = frame(spark, x, t, e, st).withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).where("g = 0 OR OS_MONTHS > 2")
    data = cox.cox_data(df, group="g")
    problems = [cox.Problem(0, 1.0), cox.Problem(1, 0.5, 0.3), cox.Problem(0, 1.0, 0.0, (True, False, True))]
    try:
        fits = cox.fit_models(data, problems)
    finally:
        data.close()
    keep = t > 2
    for f, rows in zip(fits, (slice(None), keep, slice(None))):
        assert f.converged
        _, gradient = likelihood(x[rows], t[rows], e[rows], f.coef)
        _, slope = f.problem.penalty(f.coef)
        used = np.ones(3, bool) if f.problem.active is None else np.asarray(f.problem.active)
        assert np.abs((slope - gradient)[used]).max() < 2e-2
    assert fits[2].coef[1] == 0.0


def test_stretches_join_in_any_order():
    """Joining neighbours is associative, also where one time goes over all of them."""
    rng = np.random.default_rng(4)
    times = [(9.0, 9.0), (9.0, 7.0), (7.0, 7.0), (7.0, 7.0), (7.0, 2.0), (1.0, 1.0)]
    some = [cox._Stretch(a, b, *(rng.random(2) for _ in range(3)), *(rng.random((3, 2)) for _ in range(3))) for a, b in times]
    left = some[0]
    for s in some[1:]:
        left = left.then(s)
    for cut in range(1, 6):
        a, b = some[0], some[cut]
        for s in some[1:cut]:
            a = a.then(s)
        for s in some[cut + 1 :]:
            b = b.then(s)
        for name in ("h", "loglik", "share", "xw", "xwg", "xw_first"):
            assert getattr(a.then(b), name) == pytest.approx(getattr(left, name))


def test_an_event_without_weight_at_risk_is_an_error(spark):
    df = spark.createDataFrame([(5.0, 1, 7.0, [0.1]), (6.0, 0, 1.0, [0.2])], "OS_MONTHS double, OS_EVENT int, st double, features array<double>")
    data = cox.cox_data(df.where("OS_EVENT = 1"), start="st")
    try:
        with pytest.raises(ValueError, match="at risk"):
            cox.partial_likelihood(data, {0: np.zeros((1, 1))})
        assert np.isnan(cox.partial_likelihood(data, {0: np.zeros((1, 1))}, strict=False)[0][0]).all()
        with pytest.raises(ValueError, match="at risk"):
            cox.fit_models(data, [cox.Problem()])
    finally:
        data.close()


def test_a_model_that_fails_leaves_the_others(spark):
    """Group 1 holds a row that ends before it starts; its models carry the error, group 0 is fitted as alone."""
    x, t, e, st = survival_rows(80)
    good = frame(spark, x, t, e, st).withColumn("g", F.lit(0))
    bad = spark.createDataFrame([(5.0, 1, 7.0, [0.1, 0.2, 0.3], 1)], "OS_MONTHS double, OS_EVENT int, st double, features array<double>, g int")
    data = cox.cox_data(good.select("OS_MONTHS", "OS_EVENT", "st", "features", "g").unionByName(bad), start="st", group="g")
    try:
        fits = cox.fit_models(data, [cox.Problem(0), cox.Problem(1)], strict=False)
    finally:
        data.close()
    assert (fits[0].error, fits[1].error) == ("", "ValueError") and fits[0].converged and not fits[1].converged
    assert fits[0].coef == pytest.approx(cox.fit_one(good, start="st").coef, abs=1e-4)
    notes = tuning._results(fits, {0: 0.7, 1: 0.5}, strict=True)
    assert notes["note"].tolist() == ["", "fold_2:ValueError"] and notes["c_index"].isna().tolist() == [False, True]


def test_sweep_goes_on_after_a_failed_threshold(spark, tmp_path):
    calls = []

    def run(threshold):
        calls.append(threshold)
        if threshold == 0.9:
            raise ValueError("no viable penalty")
        return {"c_index_test": threshold, "coverage_test_events_only": 0.9, "mean_interval_width_months_test": 10 * threshold}

    levels = [1.0, 0.95, 0.9, 0.85, 0.75]
    rows = modelling.sweep_branches(spark, levels, run, str(tmp_path / "sweep")).collect()
    assert [r["status"] for r in rows] == ["completed", "completed", "failed", "completed", "completed"]
    assert rows[2]["error"] == "ValueError: no viable penalty" and rows[2]["delta_test_c_index_vs_no_drop"] is None
    assert rows[4]["delta_width_vs_no_drop"] == pytest.approx(-2.5)
    again = modelling.sweep_branches(spark, levels, run, str(tmp_path / "sweep")).collect()
    assert [r["status"] for r in again] == ["skipped_existing", "skipped_existing", "failed", "skipped_existing", "skipped_existing"]
    assert calls == [*levels, 0.9] and again[1]["c_index_test"] == 0.95
    assert all(r["status"] == "failed" for r in modelling.sweep_branches(spark, [0.9], run).collect())


def test_no_events_shrinks_to_zero(spark):
    x, t, _, st = survival_rows(60)
    fit = cox.fit_one(frame(spark, x, t, np.zeros(60, int), st))
    assert np.abs(fit.coef).max() == 0.0


def pairs(t, e, s):
    comparable = (t[:, None] < t[None, :]) & (e[:, None] == 1)
    return comparable.sum(), ((s[:, None] > s[None, :]) & comparable).sum(), ((s[:, None] == s[None, :]) & comparable).sum()


@pytest.mark.parametrize("pieces, rows", [(8, None), (4, 200), (16, 60), (3, 25)])  # the last: groups are cut several times
def test_concordance_counts_all_pairs(spark, pieces, rows):
    x, t, e, _ = survival_rows(500)
    s = np.round(x[:, 0], 1)
    s[100:250] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"OS_MONTHS": t, "OS_EVENT": e, "risk": s, "k": np.arange(500) % 2}))
    r = concordance.concordance(df, pieces=pieces, group_rows=rows).first()
    assert (r["comparable"], r["concordant"], r["tied"]) == pairs(t, e, s)
    for r in concordance.concordance(df, keys=["k"], pieces=pieces, group_rows=rows).collect():
        m = np.arange(500) % 2 == r["k"]
        assert (r["comparable"], r["concordant"], r["tied"]) == pairs(t[m], e[m], s[m])
    back = concordance.concordance(df.withColumn("risk", -F.col("risk"))).first()["c_index"]
    forth = concordance.concordance(df).first()["c_index"]
    assert back == pytest.approx(1 - forth)
    assert concordance.concordance(df.withColumn("OS_EVENT", F.lit(0))).first()["c_index"] is None


def test_many_models_count_like_single_ones(spark):
    """25 risk columns in one pass, some values missing, a NULL key, groups that are cut and ones that are not."""
    x, t, e, _ = survival_rows(420)
    rng = np.random.default_rng(3)
    s = np.round(x[:, :1] + rng.normal(size=(420, 25)), 1)
    s[:, 7] = 1.0
    s[::9, 3] = np.nan
    rows = [(float(a), int(b), [None if np.isnan(v) else float(v) for v in r], None if k < 90 else f"k{k % 2}") for k, (a, b, r) in enumerate(zip(t, e, s))]
    df = spark.createDataFrame(rows, "OS_MONTHS double, OS_EVENT int, risks array<double>, k string").repartition(4)
    found = {(r["k"], r["model"]): r for r in concordance.concordances(df, "risks", keys=["k"], pieces=5, group_rows=100).collect()}
    assert len(found) == 75
    key = np.array([r[3] or "" for r in rows])
    for (k, m), r in found.items():
        own = (key == (k or "")) & ~np.isnan(s[:, m])
        assert (r["comparable"], r["concordant"], r["tied"]) == pairs(t[own], e[own], s[own, m])


def test_tails_against_known_values():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert tails.upper_gamma(5.0, 18.307038053275146 / 2) == pytest.approx(0.05)
    assert tails.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert tails.student_two_sided(1.0, 1) == pytest.approx(0.5)


def test_rank_tests(spark):
    rng = np.random.default_rng(3)
    value, event = np.round(rng.normal(size=200), 1), rng.integers(0, 2, 200)
    value[event == 1] += 0.3
    df = spark.createDataFrame([("f", float(v), int(e)) for v, e in zip(value, event)], "feature string, value double, event int")
    r = association.mann_whitney(df).first()
    a, b = value[event == 0], value[event == 1]
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert r["statistic"] == u and r["effect_size"] == pytest.approx(2 * u / (len(a) * len(b)) - 1)
    assert (r["median_event0"], r["median_event1"]) == (np.median(a), np.median(b)) and 0 < r["p_value"] < 0.2
    small = association.mann_whitney(df.limit(30))
    assert small.count() == 0


def test_false_discovery_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.03, None, 1.0, 0.005]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    got = {r["i"]: r["q_value_bh"] for r in association.adjust_false_discovery(df).collect()}
    filled = np.array([1.0 if x is None else x for x in p])
    order = np.argsort(filled)
    want = np.minimum.accumulate((filled[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert [got[i] for i in order] == pytest.approx(np.minimum(want, 1.0).tolist())
    assert all(got[i] >= filled[i] for i in got)


def collinear_frame(spark, n=60, p=8, seed=5, gaps=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 3] = x[:, 0] + 0.2 * rng.normal(size=n)
    x[:, 5] = x[:, 3] + 0.4 * rng.normal(size=n)
    x[:, 6] = 2.5
    pdf = pd.DataFrame(x, columns=[f"EXPR_{i}" for i in range(p)])
    if gaps:
        pdf.loc[rng.random(n) < 0.2, "EXPR_3"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    return df, pdf


def test_pairwise_complete_correlation(spark):
    df, pdf = collinear_frame(spark)
    columns = [c for c in pdf.columns if c != "EXPR_6"]
    want = pdf[columns].corr().to_numpy()
    for tile in (2, 3, 50):
        found = collinearity.correlation_pairs(df.repartition(3), columns, tile=tile).collect()
        assert len(found) == 21 and all(r["r"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9) for r in found)
    whole = [c for c in columns if c != "EXPR_3"]
    assert {(r["f1"], r["f2"]): r["r"] for r in collinearity.correlation_pairs(df, whole, tile=4).collect()} == pytest.approx(
        {(a, b): pdf[a].corr(pdf[b]) for k, a in enumerate(whole) for b in whole[k + 1 :]}, abs=1e-9
    )


def test_many_chunks_are_added_in_steps(spark, monkeypatch):
    monkeypatch.setattr(collinearity, "CHUNK_CELLS", 14)  # two rows
    monkeypatch.setattr(collinearity, "CHUNKS_PER_TASK", 4)
    df, pdf = collinear_frame(spark)
    columns = [c for c in pdf.columns if c != "EXPR_6"]
    want = pdf[columns].corr().to_numpy()
    assert all(r["r"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9) for r in collinearity.correlation_pairs(df, columns, tile=3).collect())


def test_greedy_rounds_drop_what_turns_drop(spark):
    rng = np.random.default_rng(12)
    for n, m in ((40, 60), (30, 200), (12, 0)):
        edges = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(m)} | {(k, k + 1) for k in range(0, n - 1, 2) if m}
        gone = set()
        for j in range(n):
            if any((i, j) in edges and i not in gone for i in range(j)):
                gone.add(j)
        df = spark.createDataFrame(sorted(edges), "i int, j int")
        for local in (0, 10**6):
            assert {r["j"] for r in collinearity.greedy_drops(df, local).collect()} == gone


def test_collinearity_rules(spark):
    df, pdf = collinear_frame(spark)
    columns = list(pdf.columns)
    kept, table, summary = collinearity.drop_collinear(df, columns, 0.8)
    corr = pdf.drop(columns="EXPR_6").corr().abs()
    want = {}
    for j, c in enumerate(corr.columns):
        earlier = corr[c].iloc[:j]
        if (earlier > 0.8).any():
            want[c] = earlier.idxmax()
    assert {r["feature_dropped"]: r["anchor_feature"] for r in table.collect()} == want
    assert summary["skipped_constant_or_near_constant"] == ["EXPR_6"] and "EXPR_6" in kept
    assert collinearity.drop_collinear(df, columns, 1.0)[0] == columns
    for tile in (2, 3, 50):
        kept, table, _ = collinearity.drop_collinear(df, columns, 0.8, method="incremental", tile=tile)
        filled = pdf.fillna(pdf.median())
        mine = []
        for c in columns:
            if not any(abs(np.corrcoef(filled[c], filled[k])[0, 1]) > 0.8 for k in mine if k != "EXPR_6" and c != "EXPR_6"):
                mine.append(c)
        assert kept == mine


def test_feature_space_matches_direct_preprocessing(spark):
    rng = np.random.default_rng(2)
    n = 80
    pdf = pd.DataFrame({
        "AGE": rng.normal(60, 9, n), "SEX": rng.choice(["F", "M"], n), "EXPR_a": rng.normal(5, 2, n), "EXPR_b": rng.normal(0, 1, n),
        "fold": np.arange(n) % 4,
    })
    pdf.loc[::9, "AGE"] = np.nan
    pdf.loc[::7, "SEX"] = None
    df = spark.createDataFrame(pdf).withColumn("AGE", F.when(~F.isnan("AGE"), F.col("AGE"))).withColumn("i", F.monotonically_increasing_id())
    layout = features.discover_layout(df, ["AGE", "SEX"], expression=["EXPR_a", "EXPR_b"])
    spaces = features.fit_spaces(df, layout, "fold", 4)
    train = pdf[pdf.fold != 1].reset_index(drop=True)
    got = features.with_features(df.where("fold <> 1"), layout, {1: spaces[1]}).orderBy("i").toPandas()
    x = np.stack(got["features"])
    age = train.AGE.fillna(train.AGE.median())
    sex = train.SEX.fillna(train.SEX.mode()[0])
    z = lambda v: (v - v.mean()) / v.std(ddof=0)
    assert x[:, 0] == pytest.approx(z(age).to_numpy())
    assert x[:, 2] == pytest.approx(z((sex == "M").astype(float)).to_numpy())
    scaled = np.column_stack([z(train.EXPR_a), z(train.EXPR_b)])
    values, vectors = np.linalg.eigh(np.cov(scaled.T, ddof=0))
    first = z(pd.Series(scaled @ vectors[:, -1])).to_numpy()
    assert np.abs(x[:, 3]) == pytest.approx(np.abs(first))
    assert x.mean(axis=0) == pytest.approx(np.zeros(5), abs=1e-9) and x.std(axis=0) == pytest.approx(np.ones(5))


@pytest.mark.parametrize("n", [3, 9, 19, 40])
def test_conformal_quantile_rules(spark, n):
    s = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(float(v),) for v in s], "score double")
    level = np.ceil((n + 1) * 0.9) / n
    higher = np.quantile(s, min(1.0, level), method="higher")
    assert conformal.higher_quantile(df).first()["qhat"] == pytest.approx(higher)
    want = np.inf if level > 1 else np.quantile(s, level)
    assert conformal.interpolated_quantile(df).first()["qhat"] == pytest.approx(want)


def scored_frame(spark, n=400, seed=11):
    x, t, e, _ = survival_rows(n, seed=seed, ties=False)
    split = np.where(np.arange(n) % 5 < 3, "train", np.where(np.arange(n) % 5 == 3, "calibration", "test"))
    pdf = pd.DataFrame({"PATIENT_ID": np.arange(n), "OS_MONTHS": t, "OS_EVENT": e, "risk": x[:, 0], "split": split, "features": list(x)})
    return spark.createDataFrame(pdf), pdf


def test_month_interval(spark):
    df, pdf = scored_frame(spark)
    result = conformal.month_interval(df)
    test = result.predictions.where("split = 'test'").toPandas()
    assert result.status == "ok" and (test.pred_survival_lo_months_90 <= test.pred_survival_hi_months_90).all()
    assert result.predictions.where("split <> 'test' AND pred_survival_lo_months_90 IS NOT NULL").count() == 0
    assert result.predictions.count() == len(pdf)
    few = conformal.month_interval(df.where("split <> 'calibration'"))
    assert few.status == "skipped_insufficient_calibration_events"
    assert conformal.month_interval(df, split_calibration=True).status == "ok"


def test_quantile_boosting_and_cqr(spark):
    df, pdf = scored_frame(spark)
    events = df.where("OS_EVENT = 1 AND split = 'train'")
    model = boosting.fit_quantile(events, 0.9, rounds=6, rate=0.3, every=4)
    fitted = model.transform(events, "q").toPandas()
    assert 0.8 <= (fitted.OS_MONTHS <= fitted.q).mean() <= 0.98
    result = conformal.cqr_interval(df, rounds=3, rate=0.3)
    assert result.details["status"] == "ok" and result.details["qhat_months"] == result.qhat and result.details["n_test_events"] > 0
    assert result.status == "ok" and result.predictions.where("split = 'test' AND pred_survival_hi_months_90 IS NULL").count() == 0
    assert "training events" in conformal.cqr_interval(df.limit(10), rounds=1).status


def test_horizons(spark):
    df, pdf = scored_frame(spark)
    result = conformal.horizon_conformal(df, horizon_list=[2, 8, 100000])
    notes = {r["horizon_months"]: r["note"] for r in result.metrics.collect()}
    assert notes[2] == "ok" and notes[8] == "ok" and notes[100000] in ("insufficient_cal_class_variation", "insufficient_test_class_variation")
    row = result.classification.where("horizon_months = 8").first()
    p = result.predictions.where("horizon_months = 8").toPandas()
    pos, neg = p[p.y_true_by_horizon == 1].p_event_hat.to_numpy(), p[p.y_true_by_horizon == 0].p_event_hat.to_numpy()
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert row["roc_auc"] == pytest.approx(auc)
    assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == len(p)
    grid = horizons.youden_thresholds(result.predictions).count()
    assert grid == 2


def test_cross_validation_and_selection(spark):
    df, _ = scored_frame(spark, 200)
    df = df.select("PATIENT_ID", "OS_MONTHS", "OS_EVENT", F.col("features")[0].alias("AGE"), F.col("features")[1].alias("EXPR_a"))
    grid = tuning.cross_validate(df, ["AGE"], ["EXPR_a"], [0.1, 3.0], [0.0, 0.7], folds=3)
    rows = grid.collect()
    assert len(rows) == 4 and all(r["n_valid_folds"] == 3 and r["mean_c_index"] > 0.6 for r in rows)
    assert len(rows[0]["fold_scores"].split(", ")) == 3
    best = tuning.select_best(grid).first()
    assert best["mean_c_index"] == max(r["mean_c_index"] for r in rows)


def test_full_run(spark):
    df, _ = scored_frame(spark, 300)
    table = df.select(
        "PATIENT_ID", "OS_MONTHS", "OS_EVENT", F.col("features")[0].alias("AGE"), F.col("features")[1].alias("EXPR_a"),
        (F.col("features")[1] * 2 + 0.01 * F.col("features")[2]).alias("EXPR_b"), F.lit("C").alias("CANCER_TYPE"),
    )
    rows, audit = modelling.prepare_rows(table, outliers=False)
    run = modelling.train_and_calibrate(rows, ["AGE", "CANCER_TYPE"], penalty=(0.8, 0.3))
    assert [r["feature_dropped"] for r in run.dropped.collect()] == ["EXPR_b"]
    assert run.metrics["c_index_test"] > 0.6 and run.predictions.count() == 300
    assert sum(s["rows"] for s in audit["splits"].values()) == 300
    sweep = modelling.threshold_sweep(rows, ["AGE", "CANCER_TYPE"], [1.0, 0.75], penalty=(0.8, 0.3)).collect()
    assert [r["expr_after"] for r in sweep] == [2, 1] and sweep[0]["delta_test_c_index_vs_no_drop"] == 0.0
