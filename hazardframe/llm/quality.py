"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every figure of a text is an expression over its words and lines, so a document is judged inside the scan stage, without
a shuffle and without Python. Ratios are compared as whole numbers (``100 * part <= percent * whole``), which keeps
verdicts free of rounding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5

# Frequent function words of English, German, French and Spanish, lower case.
STOP_WORDS = (
    "a al an and are as at aus auf be by como con das dans de del den der des die du ein eine el en es est et für for from"
    " had have he im in is ist it la las le les lo los mit n ne nicht no not of on or ou para par pas por pour que qui se"
    " si sich son su sur te that the this to un una und une unos von was were which will with y zu"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high`` for texts of at least ``from_words`` words; shorter texts pass."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0

    def sql(self) -> str:
        bounds = []
        if self.low is not None:
            bounds.append(f"100 * {self.part} >= {self.low} * {self.whole}")
        if self.high is not None:
            bounds.append(f"100 * {self.part} <= {self.high} * {self.whole}")
        passed = f"({' AND '.join(bounds)})"
        return f"(n_words < {self.from_words} OR {passed})" if self.from_words else passed


BASE_RULES = (
    Rule("enough words", "n_words", "1", low=1000),
    Rule("repeated five-word windows", "n_repeat_words", "n_words", high=20),
)
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=300, high=1000),
    Rule("symbols per word", "n_symbols", "n_words", high=10),
    Rule("stop words per word", "n_stop_words", "n_words", low=5, from_words=40),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
)


def verdict_sql(rules: Sequence[Rule]) -> str:
    return " AND ".join(rule.sql() for rule in rules) or "true"


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words inside windows that occur twice or more in the text. A window is its 64-bit hash; only texts with a repeated
    hash are sorted, so the work stays near linear in the text's length."""
    at = ", ".join(f"get(_q_words, i + {k})" for k in range(WINDOW))
    df = df.withColumn(
        "_q_hashes",
        F.expr(
            f"CASE WHEN size(_q_words) < {WINDOW + 1} THEN array() "
            f"ELSE transform(sequence(0, size(_q_words) - {WINDOW}), i -> xxhash64({at})) END"
        ).cast("array<bigint>"),
    )
    df = df.withColumn(
        "_q_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_q_hashes)) < size(_q_hashes) "
            "THEN sort_array(transform(_q_hashes, (h, i) -> named_struct('h', h, 'i', i))) END"
        ),
    )
    df = df.withColumn(
        "_q_again",
        F.expr(
            "sort_array(transform(filter(_q_sorted, (s, i) -> s.h <=> get(_q_sorted, i - 1).h OR s.h <=> get(_q_sorted, i + 1).h), s -> s.i))"
        ),
    )
    return df.withColumn(
        "n_repeat_words",
        F.expr(
            "coalesce(aggregate(transform(_q_again, (s, i) -> "
            f"CAST(least({WINDOW}, coalesce(get(_q_again, i + 1) - s, {WINDOW})) AS BIGINT)), 0L, (a, b) -> a + b), 0L)"
        ),
    )


def quality(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Figures and verdict of each text: ``keep`` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_stop_words, n_repeat_words, base_failed, kept.

    A NULL or empty text has no words and fails the base rules. Repeated rows are judged each for itself; an empty table
    gives an empty table. Columns other than ``keep`` and ``text`` are not read, so their names cannot clash.
    """
    stop = F.col("_q_words")
    out = df.select(*[F.col(c).alias(f"_q_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_q_text"))
    out = out.withColumn("_q_words", F.regexp_extract_all("_q_text", F.lit(WORD), 0))
    out = _repeat_words(out)
    has_word = lambda line: line.rlike(WORD)
    out = out.withColumn("_q_lines", F.filter(F.split("_q_text", "\n", -1), has_word))
    symbols: Column = F.length(F.regexp_replace("_q_text", r"[^#*$%&|<>]+", ""))
    out = out.select(
        *[F.col(f"_q_k{i}").alias(c) for i, c in enumerate(keep)],
        F.size("_q_words").cast("long").alias("n_words"),
        F.aggregate("_q_words", F.lit(0).cast("long"), lambda total, word: total + F.length(word)).alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(stop, lambda word: word.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        "n_repeat_words",
    )
    base = F.expr(verdict_sql(BASE_RULES))
    return out.select("*", (~base).alias("base_failed"), (base & F.expr(verdict_sql(rules))).alias("kept"))
