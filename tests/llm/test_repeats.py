import hashlib
import random

import numpy as np
import pytest

from hazardframe.llm import bwt


def brute(rows, length):
    """Keeps rows of equal id in the given order."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted(
        ((r.id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in bwt.remove_repeats(df, **options).collect()), key=str
    )


def collage(seed, alphabet, docs=60):
    """Texts cut from few sources, so that copies overlap, shift and repeat inside a text."""
    r = random.Random(seed)
    sources = ["".join(r.choice(alphabet) for _ in range(400)) for _ in range(4)]
    out = []
    for k in range(docs):
        parts = []
        for _ in range(r.randrange(5)):
            s = r.choice(sources)
            a = r.randrange(350)
            parts.append(s[a : a + r.randrange(250)] + "".join(r.choice(alphabet) for _ in range(r.randrange(4))))
        out.append((k, "".join(parts)))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghé ", "a"])
@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_against_brute_force(spark, alphabet, hot_rows):
    rows = collage(len(alphabet), alphabet)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert run(df, hot_rows=hot_rows) == brute(rows, 100)


def test_other_lengths(spark):
    rows = collage(5, "abc", 30)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert run(df, length=20, gram=8) == brute(rows, 20)


def test_odd_rows(spark, odd, odd_rows):
    got, want = run(odd), brute([r[:2] for r in odd_rows], 100)
    assert got == want


def test_empty(empty):
    assert bwt.remove_repeats(empty).count() == 0


def test_merge_is_the_sorted_order():
    r = np.random.default_rng(1)
    block, words = r.integers(0, 3, 500).astype(np.uint64), r.integers(0, 2, (500, 4)).astype(np.uint64)
    rows = np.arange(500)
    shards = [bwt.sorted_shard(block[i], words[i], i) for i in (rows[:200], rows[200:201], rows[201:])]
    merged = bwt.merge_shards(bwt.merge_shards(shards[0], shards[1]), shards[2])
    keys = [(int(b), *map(int, w)) for b, w in zip(merged.block, merged.words)]
    assert keys == sorted((int(b), *map(int, w)) for b, w in zip(block, words)) and sorted(merged.row.tolist()) == rows.tolist()
    assert all((words[i] == w).all() and block[i] == b for i, w, b in zip(merged.row, merged.words, merged.block))


def test_equal_rows_are_settled_before_merging(monkeypatch):
    r, n, length, reach = np.random.default_rng(3), 900, 20, 12
    hashes = r.integers(0, 4, n).astype(np.uint64)
    suffix, before = r.integers(0, 2, (n, length)).astype(np.uint8), r.integers(0, 2, (n, reach)).astype(np.uint8)
    suffix[:, :8], low, high = hashes[:, None], r.integers(0, 4, n), r.integers(4, reach + 1, n)
    for k in range(300):  # copies, whole and changed
        i, j = r.integers(0, n, 2)
        for c in (hashes, suffix, before, low, high):
            c[j] = c[i]
        if k % 3 == 0:
            suffix[j, r.integers(8, length)] ^= 1
    suffix[np.arange(length) >= (length - low)[:, None]] = 0
    before[np.arange(reach) >= high[:, None]] = 0
    age, merged, merge = r.permutation(n), [], bwt.merge_shards
    monkeypatch.setattr(bwt, "merge_shards", lambda a, b: merged.append(len(a.row) + len(b.row)) or merge(a, b))
    monkeypatch.setattr(bwt, "SHARD_ROWS", 100)
    got, seen = bwt.all_repeated_starts(hashes, suffix, before, low, high, age, length), set()
    assert len(merged) < n // 100 and max(merged) < n  # batches do not count, and copies are not merged
    for i in np.argsort(age):
        for x in range(reach + 1):
            stretch = (x, int(hashes[i]), bytes(before[i, :x]), bytes(suffix[i, : length - x]))
            inside = low[i] <= x <= high[i]
            assert got[i, x] == (inside and stretch in seen), (i, x)
            if inside:
                seen.add(stretch)
    assert got.any()


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
def test_anchors_are_the_leftmost_smallest_grams(alphabet):
    r = random.Random(2)
    texts = ["".join(r.choice(alphabet) for _ in range(k)) for k in (0, 19, 20, 21, 90, 0, 200)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    starts = np.arange(len(data) - 7)
    h = bwt.tb.range_hash(bwt.tb.prefix_hash(data), starts, starts + 8)
    want = [(int(h[p : p + 13].min()), p + int(h[p : p + 13].argmin()), p, k) for k in range(len(texts)) for p in range(offsets[k], offsets[k + 1] - 19)]
    got = [(int(v), int(a), p, int(k)) for v, a, f, l, k in zip(*bwt.anchors(data, offsets, 20, 8)) for p in range(f, l + 1)]
    assert got == want
