"""Boosted quantiles against a boosting that tries every split point on every row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import boosting

OPTIONS = dict(rounds=6, depth=3, rate=0.3, min_leaf=9)


def midpoints(column, bins=boosting.MAX_BINS):
    values, counts = np.unique(column, return_counts=True)
    upto, n = np.cumsum(counts), len(column)
    here = np.ones(len(values), bool) if len(values) <= bins else (upto * bins // n) > ((upto - counts) * bins // n)
    return [values[i] + (values[i + 1] - values[i]) / 2 for i in range(len(values) - 1) if here[i]]


def plain_boosting(x, y, quantile, rounds, depth, rate, min_leaf):
    """Predictions on the training rows, by trying all split points of each node; squared errors from the rows themselves."""
    points = [midpoints(x[:, f]) for f in range(x.shape[1])]
    rank = lambda r: np.sort(r)[max(1, int(np.ceil(round(len(r) * quantile, 9)))) - 1]
    fitted = np.full(len(y), rank(y))
    for _ in range(rounds):
        gradient = np.where(y > fitted, quantile, quantile - 1.0)
        nodes, step = [np.arange(len(y))], np.zeros(len(y))
        for _ in range(depth):
            after = []
            for rows in nodes:
                g = gradient[rows]
                best, chosen = 1e-9 * len(rows), None
                for f, tried in enumerate(points):
                    order = np.argsort(x[rows, f], kind="stable")
                    sums, sorted_x = np.concatenate([[0.0], np.cumsum(g[order])]), x[rows, f][order]
                    n = np.searchsorted(sorted_x, tried, "right")
                    ok = (n >= min_leaf) & (len(rows) - n >= min_leaf)
                    gain = np.where(ok, sums[n] ** 2 / np.maximum(n, 1) + (sums[-1] - sums[n]) ** 2 / np.maximum(len(rows) - n, 1) - sums[-1] ** 2 / len(rows), 0.0)
                    if len(tried) and gain.max() > best * (1 + 1e-9):
                        best, chosen = gain.max(), (f, tried[int(np.argmax(gain > gain.max() * (1 - 1e-12)))])
                if chosen is None or g.min() == g.max():
                    step[rows] = rank(y[rows] - fitted[rows])
                else:
                    left = x[rows, chosen[0]] <= chosen[1]
                    after += [rows[left], rows[~left]]
            nodes = after
        for rows in nodes:
            step[rows] = rank(y[rows] - fitted[rows])
        fitted = fitted + rate * step
    return fitted


def table(seed, n):
    g = np.random.default_rng(seed)
    x = np.column_stack([g.normal(size=n), g.integers(0, 9, n).astype(float), np.round(g.exponential(size=n), 2), np.ones(n)])
    y = np.round(np.exp(0.4 * x[:, 0] + 0.1 * x[:, 1]) * (0.5 + g.random(n)) * 10, 1)
    y[: n // 3] = 7.0  # one residual in a third of the rows
    return x, y


def frame(spark, x, y, partitions=5):
    return spark.createDataFrame(pd.DataFrame({"OS_MONTHS": y, "features": list(x), "i": np.arange(len(y))})).repartition(partitions)


@pytest.mark.parametrize("quantile", [0.05, 0.5, 0.95])
@pytest.mark.parametrize("local_rows", [0, 10_000])
def test_trees_are_those_of_every_split_point(spark, quantile, local_rows):
    x, y = table(1, 1_200)
    df = frame(spark, x, y)
    model = boosting.fit_quantile(df, quantile, local_rows=local_rows, every=4, **{**OPTIONS, "rounds": 6 if local_rows else 3})
    want = plain_boosting(x, y, quantile, **{**OPTIONS, "rounds": 6 if local_rows else 3})
    got = model.transform(df, "q").orderBy("i").toPandas()["q"].to_numpy()
    assert got == pytest.approx(want, abs=1e-9)


def test_many_rows_in_tasks(spark):
    """150,000 rows, more than 256 values of a feature, two quantiles in the same passes, written anew in between."""
    x, y = table(2, 150_000)
    df = frame(spark, x, y, 7)
    options = {**OPTIONS, "rounds": 2}
    models = boosting.fit_quantiles(df, [0.1, 0.9], every=1, **options)
    for model in models:
        want = plain_boosting(x, y, model.quantile, **options)
        assert model.predict(x) == pytest.approx(want, abs=1e-9)


def test_both_ways_fit_the_same(spark):
    x, y = table(3, 900)
    df = frame(spark, x, y)
    a, b = (boosting.fit_quantiles(df, [0.2, 0.7], local_rows=n, every=2, **{**OPTIONS, "rounds": 3}) for n in (0, 900))
    assert [m.tree_rows() for m in a] != [] and str([m.tree_rows() for m in a]) == str([m.tree_rows() for m in b])


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_narrowing_finds_the_exact_value(size):
    g = np.random.default_rng(size)
    for _ in range(60):
        parts = [np.round(g.normal(size=g.integers(0, 200)), g.integers(0, 4)) for _ in range(g.integers(1, 6))]
        parts[0] = np.append(parts[0], np.full(g.integers(1, 150), 0.5))
        q = g.random()
        search, value, steps = boosting._Search(size=size), None, 0
        while value is None:
            value, search = boosting._narrowed([boosting._Summary.of(p, search) for p in parts], search, q)
            steps += 1
            assert steps < 60
        every = np.sort(np.concatenate(parts))
        assert value == every[max(1, int(np.ceil(round(len(every) * q, 9)))) - 1]


def test_odd_tables(spark):
    one = spark.createDataFrame([(4.0, [1.0, 2.0])], "OS_MONTHS double, features array<double>")
    model = boosting.fit_quantile(one, 0.5, rounds=2)
    assert model.start == 4.0 and [r["q"] for r in model.transform(one, "q").collect()] == [4.0]
    with pytest.raises(ValueError):
        boosting.fit_quantile(one.where(F.lit(False)), 0.5)
    same = spark.createDataFrame([(float(i % 5), [3.0]) for i in range(40)], "OS_MONTHS double, features array<double>")
    assert {len(t.feature) for t in boosting.fit_quantile(same, 0.5, rounds=2).trees} == {1}


def test_rows_of_one_vector_are_followed_once(spark):
    """Trees are followed for the vectors of a block, and the sums of a few tasks need no shuffle; with one the trees are the same."""
    x, y = table(5, 3_000)
    x[:, 0], x[:, 2] = np.round(x[:, 0]), 0.0
    df = frame(spark, x, y)
    options = {**OPTIONS, "rounds": 2, "local_rows": 0}
    a, b = (boosting.fit_quantiles(df, [0.2, 0.7], driver_bytes=n, **options) for n in (None, 0))
    assert str([m.tree_rows() for m in a]) == str([m.tree_rows() for m in b]) and [m.start for m in a] == [m.start for m in b]
    block = boosting._Block(np.array([[0], [2]], np.uint8), np.array([3, 1]), np.array([[1.0], [5.0]]), np.array([0.0, 1.0, 2.0, 9.0]))
    assert block.above(0).tolist() == [1, 1] and block.histogram(0, boosting.Tree.stump(), [0])[0, 0, :3].tolist() == [[3, 1], [0, 0], [1, 1]]
