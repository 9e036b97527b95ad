import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardframe.llm import backoff, exchange


def brute(texts, order):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in docs), Counter()) for n in range(1, order + 1)]
    corpus = sum(map(len, docs))
    out = []
    for w in docs:
        own = [grams(w, n) for n in range(1, order + 1)]
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731

        def score(g):
            c = left(g)
            if len(g) == 1:
                return math.log(max(c, 1) / max(corpus - len(w) + (c == 0), 1))  # noqa: B023
            return math.log(c / left(g[:-1])) if c > 0 else math.log(0.4) + score(g[1:])

        out.append((len(w), sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(odd, odd_rows, order):
    got = backoff.backoff_scores(odd, order=order).collect()
    want = brute([r[1] for r in odd_rows], order)
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    assert sorted(map(key, got)) == sorted(key((r[0], *w)) for r, w in zip(odd_rows, want))
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_many_batches_give_the_same(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(backoff, "BATCH_BYTES", 64)
    got = backoff.backoff_scores(odd.coalesce(2)).collect()
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    assert sorted(map(key, got)) == sorted(key((r[0], *w)) for r, w in zip(odd_rows, brute([r[1] for r in odd_rows], 3)))


def test_no_text_has_a_word(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, " \n")], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in backoff.backoff_scores(df).collect()), key=str) == sorted([(i, 0, 0.0, None) for i in (1, 2, None)], key=str)


def test_batches_travel_without_their_texts(spark):
    rows = [(k, None if k == 7 else np.random.default_rng(k).bytes(3000).hex()) for k in range(40)]
    batches, _ = exchange.write_batches(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2), "doc_id", "text", 20_000)
    got = batches.collect()
    assert len(got) > 8 and sum(len(str(r)) for r in got) < 40 * 6000 / 10
    texts = {}
    for r in got:
        texts.update(zip(r.ids, exchange.batch_texts(pa.array([r.texts.asDict()], exchange.PLACE)).to_pylist()))
    assert texts == {k: t or "" for k, t in rows}
    answers = spark.createDataFrame([(got[0].batch, "x"), (got[0].batch, "y")], "batch bigint, a string")
    beside = exchange.beside(batches, answers, F.sort_array(F.collect_list("a")), "all")
    assert {r.batch: r["all"] for r in beside.collect()} == {r.batch: ["x", "y"] if r.batch == got[0].batch else None for r in got}
    assert beside.rdd.getNumPartitions() == exchange.tasks_for(batches)


def test_words_of_a_batch_are_hashed_slice_by_slice():
    texts = pa.array([("ab cd " * 120_000) + str(k) for k in range(3)] + ["", "x"])
    lanes, text_of, at = backoff._gram_lanes(texts, 3)
    alone = [backoff._gram_lanes(texts.slice(k, 1), 3) for k in range(5)]
    assert all((h == np.concatenate([a[0][n] for a in alone])).all() for n, h in enumerate(lanes))
    assert np.bincount(text_of, minlength=5).tolist() == [240_001] * 3 + [0, 1] and (at == np.concatenate([a[2] for a in alone])).all()


def test_empty(empty):
    assert backoff.backoff_scores(empty).count() == 0


def test_the_default_tells_word_order_apart_by_trigrams(spark):
    rows = [(k, t) for k, t in enumerate(["a b c", "x b d", "a b c", "x b d", "a b d", "b c d b"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r.log_score for r in backoff.backoff_scores(df).collect()}
    want = brute([t for _, t in rows], 3)
    assert all(abs(got[k] - w[1]) < 1e-9 for k, w in enumerate(want)) and want != brute([t for _, t in rows], 2)
