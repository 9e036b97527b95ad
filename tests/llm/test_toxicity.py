import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from hazardframe.llm import toxicity

FILLER = "river stone garden window letter music winter market bridge yellow simple quiet carpet button kitchen planet".split()


def labelled(seed=5, n=600):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [r.choice(FILLER) + r.choice(["", "s", "ed"]) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grubwit", "snarfel" + r.choice(["a", "on", "is", "ur", "em"]) + r.choice("xyz")]))
        docs.append((k, " ".join(words) + "."))
        labels.append((k, int(toxic)))
    return docs, labels


def test_machine_tells_uses_apart():
    scanner = toxicity.Scanner({"grubwit": 5.0}, {})
    texts = ["grubwit", "you grubwit", "she is not a grubwit", "he said that you are a grubwit", "they will kill you", "kill. you", "fine words", None, "He said: fine. A grubwit!"]
    found = [dict(zip(toxicity.USES, row)) for row in scanner.features(pa.array(texts))]
    use = [next((u for u, v in f.items() if v), None) for f in found]
    assert use == ["plain", "aimed", "denied", "reported", "threat", None, None, None, "plain"]


def test_composition_is_the_product():
    machine = toxicity.grammar()
    assert all(set(row) == set(toxicity.SYMBOLS) and all(0 <= s < len(machine.arcs) for s, _ in row.values()) for row in machine.arcs)


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(d, known)
    assert "grubwit" in model.words and any(p.startswith("snar") for p in model.prefixes)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model, keep=["doc_id"]).collect()}
    wrong = [k for k, y in labels if k % 3 == 0 and (got[k] >= 0.7) != bool(y)]
    assert len(wrong) <= 4


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (7, None), (9, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    scored = toxicity.score_toxicity(odd, model)
    rows = scored.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows) and set(scored.columns) == set(odd.columns)
    texts = {r.doc_id: r.score for r in rows}
    assert texts[4] == texts[5] == texts[12]
    assert toxicity.score_toxicity(empty, model).count() == 0
    nothing = toxicity.fit_toxicity(empty, labels.where("false"))
    assert toxicity.score_toxicity(odd, nothing).where(F.col("score") >= 0.7).count() == 0


def test_one_text_for_each_labelled_id(spark):
    rows = [(1, f"text {k % 50}") for k in range(500)] + [(2, "other"), (2, "other"), (3, None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int")
    got = sorted(map(tuple, toxicity.training_rows(documents, labels, "doc_id", "text", "toxic", 100).collect()))
    smallest = min((f"text {k}" for k in range(50)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == [("", 0), ("other", 0), (smallest, 1)]
