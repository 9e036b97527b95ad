import random

import numpy as np
import pytest

from hazardframe.llm import decontaminate as dc


def slow_score(window, item):
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, x in enumerate(item):
        for j, y in enumerate(window):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best / (2 * max(1, len(item)))


def test_alignment_score():
    r = np.random.default_rng(3)
    for _ in range(60):
        w, i = r.integers(0, 6, r.integers(0, 40)), r.integers(0, 6, r.integers(1, 20))
        score, lo, hi = dc.smith_waterman(w, i)
        assert abs(score - slow_score(w.tolist(), i.tolist())) < 1e-12 and 0 <= lo <= hi <= len(w)
        if score:
            assert abs(slow_score(w[lo:hi].tolist(), i.tolist()) - score) < 1e-12


def corpus():
    r = random.Random(7)
    word = lambda: "v" + str(r.randrange(4000))
    items = [(k, " ".join(word() for _ in range(r.choice([2, 6, 30])))) for k in range(20)]
    docs, want = [], set()
    for k in range(300):
        words = [word() for _ in range(120)]
        if k % 10 == 0:
            item = items[k // 10 % 20]
            copy = item[1].split()
            if k % 20 == 0 and len(copy) > 20:  # edited: every seventh word replaced, one dropped
                copy = [word() if j % 7 == 3 else w for j, w in enumerate(copy)]
                del copy[10]
            words[50:50] = [w.upper() + "," for w in copy]
            want.add((k, item[0]))
        docs.append((k, " ".join(words)))
    return docs, items, want


@pytest.mark.parametrize("carried", [1_000_000, 0])
def test_planted_copies_and_nothing_else(spark, carried):
    docs, items, want = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    got = dc.contaminated(d, i, max_carried_seeds=carried).collect()
    short = {k for k, t in items if len(t.split()) == 2}
    found = {(r.doc_id, r.item_id) for r in got}
    assert want <= found and all(i in short or (d, i) in want for d, i in found)
    assert all(0.5 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("carried", [1_000_000, 0])
def test_odd_rows(spark, odd, odd_rows, carried):
    text = {r[0]: r[1] for r in odd_rows if r[0] in (3, 7)}
    words = text[7].split()
    items = [(1, " ".join(text[3].split()[10:40])), (2, " ".join(words[20_000:20_030])), (None, " ".join(words[100:130])), (3, None)]
    i = spark.createDataFrame([(*x, "clash", "clash") for x in [*items, items[0]]], "item_id bigint, text string, doc_id string, seed string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in dc.contaminated(odd, i, max_carried_seeds=carried).collect())
    assert got == [("3", "1"), ("7", "2"), ("7", "None")]


def test_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string")
    assert dc.contaminated(empty, items).count() == 0
    assert dc.contaminated(odd, items.where("false")).count() == 0


@pytest.mark.parametrize("carried", [1_000_000, 0])
def test_copies_in_all_documents_or_in_half_of_them(spark, carried):
    r = random.Random(11)
    word = lambda: "v" + str(r.randrange(4000))
    items = [(k, " ".join(word() for _ in range(15))) for k in range(2)]
    docs = []
    for k in range(60):
        words = [word() for _ in range(60)]
        words[20:20] = (items[0][1] + (" " + items[1][1] if k % 2 else "")).split()
        docs.append((k, " ".join(words)))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.score for x in dc.contaminated(d, i, max_carried_seeds=carried).collect()}
    assert got == {**{(k, 0): 1.0 for k in range(60)}, **{(k, 1): 1.0 for k in range(1, 60, 2)}}
