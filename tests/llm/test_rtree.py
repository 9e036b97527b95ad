import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.llm import rtree

SCHEMA = "vec_id bigint, label int, vector array<bigint>, block string, tile string, copies string"


def by_comparison(rows, positives=5, negatives=3):
    rows = [(i, label, v) for i, label, v, *_ in rows if label is not None and v is not None and None not in v]
    dims = max([len(v) for _, _, v in rows], default=0)
    held = np.array([[max(-rtree.LIMIT, min(rtree.LIMIT, c)) for c in [*v, *[0] * (dims - len(v))]] for _, _, v in rows], object)
    out = Counter()
    for a, (anchor, label, _) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        score = (held @ held[a]).tolist() if dims else [0] * len(rows)
        order = sorted(range(len(rows)), key=lambda r: (-score[r], rows[r][0] is None, rows[r][0] or 0))
        for p in [r for r in order if r != a and rows[r][1] == label][:positives]:
            fit = [r for r in order if rows[r][1] != label and 50 * score[p] <= 100 * score[r] <= 95 * score[p]]
            for rank, r in enumerate(fit[:negatives], 1):
                out[anchor, rows[p][0], rank, rows[r][0], score[p], score[r]] += 1
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    found = rtree.hard_negatives(df, F.col("vec_id") % 50 == 0, **options)
    return Counter(tuple(r)[:6] for r in found.collect())


def clustered(seed, n, dims, centres, spread, hot=0):
    g = np.random.default_rng(seed)
    middle = g.integers(-200, 200, (centres, dims))
    home = g.integers(0, centres, n)
    x = middle[home] + g.integers(-spread, spread + 1, (n, dims))
    x[:hot] = x[0]
    labels = (home + (g.random(n) < 0.3)) % 4
    return [(int(i), int(c), v.tolist()) for i, c, v in zip(g.permutation(n), labels, x)]


@pytest.mark.parametrize("case", ["clusters", "one vector in a third of the rows", "noise"])
def test_many_tiles_against_comparison(spark, monkeypatch, case):
    """Several parts, tiles, leaves and salts."""
    for name, value in (("TILE_ROWS", 300), ("PART_TILES", 3), ("BLOCKS_PER_TASK", 2)):
        monkeypatch.setattr(rtree, name, value)
    rows = {
        "clusters": lambda: clustered(1, 2_400, 6, 30, 12),
        "one vector in a third of the rows": lambda: clustered(2, 2_400, 4, 12, 30, hot=800),
        "noise": lambda: clustered(3, 1_500, 12, 1, 60),
    }[case]()
    assert mined(spark, rows) == by_comparison(rows)


def test_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(3), [r.randrange(-9, 10) for _ in range(5)]) for i in range(120)]
    rows += [(50, 1, [3, 1, 2, 0, 5])] * 7 + [(100, 0, [1, 2])] * 2 + [(100, 2, []), (50, 0, [9, 9, 9, 9, 9, 9])]
    rows += [(None, k % 3, [4, 1, 0, 2, 2]) for k in range(9)] + [(150, None, [1, 2, 3]), (151, 1, None), (152, 1, [1, None, 2])]
    rows += [(200, 1, [10**15, 1, 1]), (201, 1, [10**15, 0, 0]), (202, 2, [3 * 10**6, 5, 5]), (203, 0, [3 * 10**6 + 1, 5, 5])]
    want = by_comparison(rows)
    assert mined(spark, rows) == want and max(want.values()) > 1
    assert mined(spark, rows, positives=2, negatives=1) == by_comparison(rows, 2, 1)


def test_nothing_to_mine(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, 1, [1, 2]), (2, 2, [1, 2])])  # no anchor
    assert not mined(spark, [(50, 1, [1, 2])])  # alone
    assert not mined(spark, [(50, 1, [5, 2]), (51, 1, [-5, 0]), (52, 2, [-3, 0])])  # a negative score has no window


def test_boxes_bound_every_score():
    g = np.random.default_rng(6)
    x, q = g.integers(-50, 50, (64, 7)), g.integers(-50, 50, (9, 7))
    low, high = rtree._boxes(x, np.arange(0, 64, 16))
    lower, upper = rtree._bounds(q, low, high)
    score = (q @ x.T).reshape(9, 4, 16)
    assert (lower[:, :, None] <= score).all() and (score <= upper[:, :, None]).all()
    order = rtree._str_order(x, [0, 1], np.arange(64), 8)
    assert sorted(order) == list(range(64))


def test_pruning_skips_boxes(monkeypatch):
    """With well-separated clusters a query opens few of the leaves."""
    g = np.random.default_rng(8)
    middle = g.integers(-2_000, 2_000, (40, 3))
    x = np.repeat(middle, rtree.LEAF_ROWS, axis=0) + g.integers(-5, 6, (40 * rtree.LEAF_ROWS, 3))
    begin = np.arange(0, len(x), rtree.LEAF_ROWS)
    low, high = rtree._boxes(x, begin)
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                opened.append(key.start)
            return super().__getitem__(key)

    labels = np.zeros(len(x), np.int64)
    tile = {"vectors": x.astype(float).view(Counted), "labels": labels, "ids": np.arange(len(x)), "null": np.zeros(len(x), np.int64), "leaf_low": low.astype(float), "leaf_high": high.astype(float)}
    best = int((x.astype(np.int64) ** 2).sum(axis=1).argmax())
    one = lambda v: np.full((1, 1), float(v))
    q = rtree.Queries(np.array([best]), x[[best]].astype(float), labels[:1], one(rtree.LOWEST), one(rtree.HIGHEST), one(rtree.LOWEST))
    (_, _, row, score), _ = rtree._search(tile, q, 5, True, True)
    every = (x[best] @ x.T).astype(np.int64)
    every[best] = rtree.LOWEST
    assert sorted(score.tolist(), reverse=True) == sorted(every.tolist(), reverse=True)[:5]
    assert len(opened) < 10
