import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.llm import periods
from hazardframe.llm.queries import with_repeated_part

HASHES = np.random.default_rng(1).integers(1, 1 << 63, 2_000, dtype=np.uint64)


def by_comparison(words):
    """Every (start, length, period) by comparing the words with themselves at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x < n - q:
            y = x
            while y < n - q and words[y] == words[y + q]:
                y += 1
            if y > x and y + q - x >= max(12, 2 * q):
                found.setdefault((x, y + q), q)
            x = max(y, x + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(r: random.Random, kind: str) -> list[int]:
    alphabet = r.choice([2, 3, 50, 1_000])
    some = lambda n: [r.randrange(alphabet) for _ in range(n)]
    if kind == "random":
        return some(r.randrange(400))
    if kind == "periodic tail":
        words, a = some(r.randrange(1, 500)), 0
        a = r.randrange(len(words))
        p = 1 + (len(words) - a) // (3 + r.randrange(8))
        return [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
    if kind == "phase breaks":
        block, out = some(r.randrange(1, 6)), []
        for _ in range(r.randrange(1, 8)):
            at = r.randrange(len(block))
            out += [block[(at + i) % len(block)] for i in range(r.randrange(1, 120))]
        return out
    if kind == "nested":
        words = (some(r.randrange(1, 30)) * r.randrange(1, 9) + some(r.randrange(30))) * r.randrange(1, 5)
        return words[r.randrange(1 + len(words) // 3) :]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 370:
            a, b = b, b + a
        return b
    block = some(r.randrange(20, 150))
    return block + block[: r.randrange(len(block))] + block + block


@pytest.mark.parametrize("kind", ["random", "periodic tail", "phase breaks", "nested", "fibonacci", "blocks"])
def test_every_run_is_found(kind):
    r = random.Random(kind)
    for _ in range(3 if kind == "fibonacci" else 25):
        texts = [made(r, kind) for _ in range(4)] + [[]]
        sizes = np.array([len(t) for t in texts])
        ids = HASHES[np.concatenate([np.array(t, int) for t in texts])]
        got = periods.find_runs(ids, sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])
        for k, text in enumerate(texts):
            own = got[:, (got[0] >= first[k]) & (got[0] < first[k + 1])]
            assert sorted((int(s - first[k]), int(e - s), int(q)) for s, e, q in own.T) == by_comparison(text)


def expected(text):
    words = [w.decode() for w in (text or "").encode().split()]  # bytes are split at ASCII white space only
    runs = by_comparison(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_odd_rows(spark, odd, odd_rows, empty):
    small = odd.where((F.col("doc_id") != 7) | F.col("doc_id").isNull())
    again = spark.createDataFrame([(20, "na " * 40), (21, "a b " * 9 + "c"), (22, "x\ty z\n" * 12)], "doc_id bigint, text string")
    got = [(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
           for r in periods.periodic_runs(small.select("doc_id", "text", "digest").unionByName(again, allowMissingColumns=True)).collect()]
    texts = [(r[0], r[1]) for r in odd_rows if r[0] != 7] + [tuple(r) for r in again.collect()]
    assert sorted(map(str, got)) == sorted(str((i, *expected(t))) for i, t in texts)
    assert periods.periodic_runs(empty).count() == 0
    assert periods.periodic_runs(odd).where("id = 7").count() == 2


def test_query_against_comparison(spark, tmp_path, entry_queries):
    import zlib

    r = random.Random(7)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(200)))) for i in range(60)] + [(None, "w " * 30), (99, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in entry_queries["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        words = (text or "").split()
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
            planted += 1
        _, runs, rest = expected(" ".join(words))
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        x = got[i]
        assert x["n_runs"] == len(runs) and x["collapsed_sha256"] == hashlib.sha256(rest.encode()).hexdigest()
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert (x["start"], x["length"], x["period"]) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert x["exponent_milli"] == (1000 * -best[0] // best[2] if best else None)
    assert planted >= 3 and with_repeated_part(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == len(rows)
