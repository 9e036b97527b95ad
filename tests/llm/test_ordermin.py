import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hazardframe.llm import backoff, decontaminate, ordermin


def shingles(text, k=5):
    words = (text or "").split()
    seen, out = Counter(), []
    for i in range(max(1, len(words) - k + 1)):
        s = tuple(words[i : i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def aligned(a, b):
    """Longest common subsequence of labelled shingles over all of them, the slow way."""
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    return best[-1] / (len(a) + len(b) - best[-1])


def near_copies(seed, groups=25):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(3000))
    line = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 8, 40, 150]))]
        if r.random() < 0.3:
            base += line
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.randrange(5)):
                at = r.randrange(len(copy))
                copy[at : at + r.randrange(2)] = [word()] * r.randrange(2)
            out.append(" ".join(copy))
    return list(enumerate(out))


def classes_by_hand(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if set(sets[i]) & set(sets[j]) and aligned(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    return sorted(sorted(map(str, m)) for m in members.values())


def classes_of(df):
    members = defaultdict(list)
    for r in ordermin.near_duplicate_classes(df).collect():
        members[r.root].append((r.id, r.class_id))
    for m in members.values():
        known = [i for i, _ in m if i is not None]
        assert all(c == (min(known) if known else None) for _, c in m)
    return sorted(sorted(str(i) for i, _ in m) for m in members.values())


def test_classes_against_all_pairs(spark):
    rows = near_copies(3)
    assert classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == classes_by_hand(rows)


def test_a_large_group_and_a_common_passage(spark):
    """More near copies than a sub-bucket holds, and many different texts that share a passage."""
    r = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(700):
        copy = list(base)
        copy[r.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + k, " ".join(f"q{k}_{j}" for j in range(40)) + " " + passage) for k in range(400)]
    got = classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert Counter(map(len, got)) == {700: 1, 1: 400}


def test_alignment_needs_order_and_band():
    a = np.arange(100, dtype=np.uint32)
    assert ordermin.aligned_similarity(a, a) == 1.0
    assert ordermin.aligned_similarity(a, a[::-1].copy()) == 0.0
    assert ordermin.aligned_similarity(a, np.concatenate([a[50:], a[:50]])) == 0.0
    b = np.concatenate([a[:40], np.arange(1000, 1010, dtype=np.uint32), a[40:]])
    assert abs(ordermin.aligned_similarity(a, b) - 100 / 110) < 1e-9
    r = np.random.default_rng(4)
    for _ in range(50):
        x = r.permutation(60)[: r.integers(1, 60)].astype(np.uint32) if r.random() < 0.3 else np.sort(r.permutation(60)[:50]).astype(np.uint32)
        y = np.sort(r.permutation(60)[:52]).astype(np.uint32)
        want = aligned(x.tolist(), y.tolist())
        got = ordermin.aligned_similarity(x, y)
        assert abs(got - want) < 1e-9 if want >= 0.8 else got == 0.0


def test_odd_rows(odd, odd_rows):
    got = ordermin.near_duplicate_classes(odd).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    of = {str(r.id): r.class_id for r in got if r.id not in (None, 8)}
    assert of["1"] == of["2"] == of["10"] == 1 and of["4"] == of["5"] == of["6"] == of["12"] == 4 and of["7"] == 7 and of["11"] == 11


def test_one_row_of_each_class_stays(odd):
    kept = ordermin.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    assert got == sorted(["1", "3", "4", "7", "8", "8", "9", "11", "None"])


def test_empty(empty):
    assert ordermin.near_duplicate_classes(empty).count() == 0
    assert ordermin.drop_near_duplicates(empty).columns == empty.columns


@pytest.mark.parametrize("one_task", [0, 50, 100_000])
def test_components_of_a_chain_a_star_and_a_loop(spark, monkeypatch, one_task):
    monkeypatch.setattr(ordermin, "ONE_TASK", one_task)
    links = [(100 + k, 101 + k) for k in range(40)] + [(900, 900 - k) for k in range(1, 60)] + [(7, 7), (300, 301), (301, 302), (302, 300), (300, 301)]
    got = dict(map(tuple, ordermin.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {k: 100 for k in range(100, 141)} | {k: 841 for k in range(841, 901)} | {300: 300, 301: 300, 302: 300}
    assert ordermin.components(spark.createDataFrame([(7, 7)], "a bigint, b bigint")).count() == 0


def test_edits_of_one_text_that_are_far_from_each_other(spark):
    """A star: 400 texts near one text only, which is the pivot of few buckets."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(204)]
    rows = [(0, " ".join(base))]
    for k in range(1, 401):
        copy = list(base)
        for j, at in enumerate(r.sample(range(10, 194, 10), 3)):
            copy[at + r.randrange(5)] = f"x{k}_{j}"
        rows.append((k, " ".join(copy)))
    assert aligned(shingles(rows[0][1]), shingles(rows[1][1])) >= 0.8
    far = sum(aligned(shingles(rows[i][1]), shingles(rows[i + 1][1])) < 0.8 for i in range(1, 21))
    assert far > 15
    got = classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert list(map(len, got)) == [401]


def test_pairs_among_many_of_a_bucket_without_a_common_centre(spark):
    """Texts alike in two thirds, all in the same buckets, of which some pairs are near copies."""
    passage = [f"p{k}" for k in range(104)]
    rows = []
    for k in range(60):
        own = [f"q{k}_{j}" for j in range(50)]
        rows.append((2 * k, " ".join(passage + own)))
        own[20] = "changed"
        rows.append((2 * k + 1, " ".join(passage + own)))
    got = classes_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert Counter(map(len, got)) == {2: 60}


def test_long_words_differ_behind_their_first_bytes():
    texts = pa.array(["x" * 512 + "a", "x" * 512 + "b", "x" * 2000 + "a", "x" * 2000 + "b", "pad " + "x" * 2000 + "b"])
    kmers, begin = ordermin.labelled_kmers(texts)
    assert len(set(kmers[begin[:-1]].tolist())) == 5
    lanes, _, _ = backoff._gram_lanes(texts, 1)
    words, first = decontaminate.word_hashes(texts)
    for hashes in (lanes[0], words):
        assert len(set(hashes.tolist())) == 5 and hashes[3] == hashes[5]
