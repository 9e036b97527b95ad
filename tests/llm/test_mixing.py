import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hazardframe.llm import mixing


def sized(df):
    return df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), "target", "part")


def targets_by_hand(sizes: dict, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_budgets_and_limits(odd, odd_rows):
    rows = mixing.mix(sized(odd), "size").collect()
    assert len(rows) == len(odd_rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.part
    want = targets_by_hand(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and taken[s] == int(target[s] + 1e-9)
    for r in odd_rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        assert any(x.doc_id == r[0] and x.size == n for x in rows)


def test_reruns_agree(odd):
    one = mixing.mix(sized(odd), "size").select("doc_id", "size", "taken").collect()
    two = mixing.mix(sized(odd.repartition(7)), "size").select("doc_id", "size", "taken").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_emitted_words_are_the_words_taken(odd):
    df = odd.select(F.struct(*odd.columns).alias("r"), "doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(df, "size")
    out = mixing.emit(mixed, "size", "r")
    assert out.columns == odd.columns
    have, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        have[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in mixed.collect():
        want[r.source] += r.taken
    assert all(have[s] == n for s, n in want.items())


def test_empty(empty):
    assert mixing.mix(sized(empty), "size").count() == 0
