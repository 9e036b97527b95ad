"""Column expressions; all of them stay inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from hazardframe.schema import AGE_EDGES, AGE_LABELS, DAYS_PER_MONTH, DEFAULT_SAMPLE_CODE, NA_TOKENS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number, NaN included, becomes NULL."""
    number = col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def blank_tokens(c: Column | str, tokens: Sequence[str] = tuple(NA_TOKENS)) -> Column:
    """Missing-value tokens to NULL."""
    return F.when(~col(c).isin(*tokens), col(c))


def status_flag(c: Column | str, words: Sequence[str] = ("DECEASED",)) -> Column:
    """1 where the status starts the code ``1:`` or holds one of the words, 0 otherwise (0 for NULL too)."""
    text = col(c)
    hit = text.contains("1:")
    for word in words:
        hit = hit | F.upper(text).contains(word)
    return F.when(hit, 1).otherwise(0)


def recurrence_flag(c: Column | str) -> Column:
    return status_flag(c, ("RECURRED", "PROGRESSED"))


def status_matches(c: Column | str, pattern: str = "1:|DECEASED") -> Column:
    return F.coalesce(F.upper(col(c)).rlike(pattern).cast("int"), F.lit(0))


def months_to_days(c: Column | str) -> Column:
    return col(c) * F.lit(DAYS_PER_MONTH)


def normalise_barcode(c: Column | str) -> Column:
    """Upper case, first four dash-separated parts."""
    return F.substring_index(F.upper(col(c)), "-", 4)


def sample_type_code(c: Column | str) -> Column:
    """The fourth dash-separated part."""
    return F.coalesce(F.get(F.split(col(c), "-"), F.lit(3)), F.lit(DEFAULT_SAMPLE_CODE))


def label_codes(c: Column | str, labels: dict[int, str]) -> Column:
    """Recode integers; codes without a label become NULL."""
    out = F.lit(None).cast("string")
    for code, label in labels.items():
        out = F.when(col(c) == code, label).otherwise(out)
    return out


def bin_right_closed(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] holding the value, NULL outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = F.when((col(c) > lo) & (col(c) <= hi), label).otherwise(out)
    return out


def age_group(c: Column | str = "AGE") -> Column:
    return bin_right_closed(c, AGE_EDGES, AGE_LABELS)


def age_group_order(c: Column | str = "AGE") -> Column:
    return bin_right_closed(c, AGE_EDGES, [str(i) for i in range(len(AGE_LABELS))]).cast("int")


def clip(c: Column | str, lower: Column | float | None = None, upper: Column | float | None = None) -> Column:
    """Limit to a range; NULL stays NULL."""
    value = col(c)
    out = value
    if lower is not None:
        out = F.greatest(out, lower if isinstance(lower, Column) else F.lit(lower))
    if upper is not None:
        out = F.least(out, upper if isinstance(upper, Column) else F.lit(upper))
    return F.when(value.isNotNull(), out)


def log2_plus_one(c: Column | str) -> Column:
    return F.log2(col(c) + 1)


def log10_plus_one(c: Column | str) -> Column:
    return F.log10(col(c) + 1)


def first_known(*columns: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(*[col(c) for c in columns], F.lit(default))


def strata_key(*columns: Column | str) -> Column:
    return F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit("UNK")) for c in columns])


def join_scores(c: Column | str) -> Column:
    """Array of scores as text with four decimals (halves to even, as Python formats them)."""
    return F.array_join(F.transform(col(c), lambda s: F.format_string("%.4f", F.bround(s, 4))), ", ")


def threshold_label(c: Column | str) -> Column:
    return F.format_string("%03d", F.rint(col(c) * 100).cast("int"))


def synthetic_id(ordinal: Column | str) -> Column:
    return F.format_string("ROW_%07d", col(ordinal))


def dot(values: Column | str, weights: Sequence[float]) -> Column:
    """Dot product of an array column with a fixed weight vector."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    products = F.zip_with(col(values), fixed, lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def is_finite(c: Column | str) -> Column:
    value = col(c).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def all_finite(array: Column | str) -> Column:
    return F.forall(col(array), is_finite)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    value = F.round(col(c).cast("double"), digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)
