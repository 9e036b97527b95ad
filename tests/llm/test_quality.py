import re

from hazardframe.llm import quality


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n, repeat = len(words), len(inside)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


TEXTS = [
    "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d e f g", "x " * 40, "one line\none line\n\n \none line", "# * $ % & | < >", "日本 語 ü", "a b c d e a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2,
]


def test_figures_by_hand(spark, odd, odd_rows):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, t in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == figures(t), t
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    odd_got = sorted(str((r.doc_id, *[r[c] for c in columns])) for r in quality.quality(odd).collect())
    assert odd_got == sorted(str((r[0], *figures(r[1]))) for r in odd_rows)


def test_one_stage_without_python(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = quality.quality(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_verdict(spark):
    good = "the cat of one man was in that house and it is on the hill with no name for all to see but they left by noon so we sang"
    symbols = "w1 *** w2 $$$ w3 %%% w4 &&& w5 ### w6 *** w7 %%% w8 ###"
    rows = [(1, good), (2, symbols), (3, None), (4, "too few words"), (5, " ".join(f"word{k}" for k in range(60)))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False), 5: (False, False)}


def test_empty(empty):
    assert quality.quality(empty).count() == 0
