"""Column profiles: missingness, descriptions, contingency, histograms, box and density numbers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from hazardframe.functions import scalars as S
from hazardframe.operators.ordered import exact_quantiles, join_on, look_up, unpivot_numbers, value_counts


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that count as numeric features; flags do too."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def _one_row_to_long(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}__{i}").alias(f) for f in fields]) for i, c in enumerate(columns)]
    return row.select("_rows", F.explode(F.array(*structs)).alias("_s")).select("_rows", "_s.*")


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and fraction of each column, found in one pass."""
    columns = list(columns or df.columns)
    aggs = [F.count_if(F.col(c).isNull()).alias(f"missing_count__{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    out = _one_row_to_long(row, columns, ["missing_count"])
    return out.select("column", "missing_count", (F.col("missing_count") / F.col("_rows")).alias("missing_frac")).orderBy(
        F.desc("missing_frac"), "column"
    )


def sparse_columns(df: DataFrame, limit: float = 0.8) -> list[str]:
    """Columns with more than ``limit`` missing; the percentage is compared after rounding to one decimal."""
    found = missingness(df).where(F.round(F.col("missing_frac") * 100, 1) > limit * 100).select("column").collect()
    return [r["column"] for r in found]


def numeric_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max, one row per column."""
    long = unpivot_numbers(df, columns)
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["feature"])
    return basic.join(quartiles, "feature", "left")


def categorical_overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, and the most frequent value (missing counts as one) with its share."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    named = counts.withColumn("shown", F.coalesce("value", F.lit("<NA>")))
    top = F.min(F.struct((-F.col("n")).alias("k"), "shown"))
    return named.groupBy("column").agg(
        F.count("value").alias("n_unique"), top.alias("top"), F.sum("n").alias("total")
    ).select(
        "column", "n_unique", F.col("top.shown").alias("top_value"), (-F.col("top.k")).alias("top_count"),
        (-F.col("top.k") / F.col("total")).alias("top_frac"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, names: Sequence[str]) -> DataFrame:
    """Contingency table with one column per listed value, 0 where a pair does not occur."""
    table = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)
    return table.toDF(row, *names)


def zero_variance_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without two different finite numbers; NaN counts as missing.

    The extremes decide: a standard deviation joined over partitions is not exactly 0 for every constant.
    """
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        known = F.when(~F.isnan(x), x)
        aggs += [F.min(known).alias(f"lo{i}"), F.max(known).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    bounds = [(c, row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)]
    return [c for c, lo, hi in bounds if lo is None or not (math.isfinite(lo) and math.isfinite(hi) and lo < hi)]


def histogram(df: DataFrame, value: str, bins: int, keys: Iterable[str] = ()) -> DataFrame:
    """Equal-width histogram over the range of each key; the last bin is closed. Empty bins have count 0."""
    keys = list(keys)
    lo, hi = F.min(value), F.max(value)
    same = lo == hi
    bounds = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.when(same, lo - 0.5).otherwise(lo).cast("double").alias("lo"),
        F.when(same, hi + 0.5).otherwise(hi).cast("double").alias("hi"),
    ).where(F.col("lo").isNotNull())
    bin_number = F.least(F.expr(f"width_bucket(cast({value} as double), lo, hi, {bins})"), F.lit(bins)).cast("int")
    bounded, bounds = look_up(value_counts(df, value, keys), bounds, keys)
    filled = bounded.withColumn("bin", bin_number).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    frame = bounds.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("hi") - F.col("lo")) / bins
    return join_on(frame, filled, [*keys, "bin"], "left").select(  # a row for each bin on both sides
        *keys, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def box_stats(df: DataFrame, value: str, keys: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends inside the fence, and the number of values outside it."""
    quartiles = exact_quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys)
    iqr = F.col("q75") - F.col("q25")
    fences = quartiles.withColumns({"lower_fence": F.col("q25") - k * iqr, "upper_fence": F.col("q75") + k * iqr})
    counts = value_counts(df, value, keys)
    inside = F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))
    fenced, fences = look_up(counts, fences, keys)
    whiskers = fenced.groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
    )
    return join_on(fences.select(*quartiles.columns), whiskers, keys)  # a row for each key on both sides


def density_grid(df: DataFrame, value: str, keys: Sequence[str], points: int = 64, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid per key, Scott bandwidth.

    The grid is a fixed number of points, and partial sums per (key, point) are formed before the shuffle.
    """
    counts = value_counts(df, value, keys)
    spread = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    ).withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where((F.col("_h") > 0) & (F.col("_lo") < F.col("_hi")))
    start, stop = F.col("_lo") - cut * F.col("_h"), F.col("_hi") + cut * F.col("_h")
    spread_out, _ = look_up(counts, spread, keys)
    rows = spread_out.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = start + F.col("point") * (stop - start) / (points - 1)
    z = (F.col("_x") - F.col(value)) / F.col("_h")
    weight = F.col("n") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    return rows.withColumn("_x", at).groupBy(*keys, "point").agg(F.max("_x").alias("x"), F.sum(weight).alias("density"))


def dataset_summary(df: DataFrame, time: str = "OS_MONTHS", event: str = "OS_EVENT") -> DataFrame:
    """Rows, columns, rows with a usable endpoint, events and censored rows among them; one pass."""
    t, e = S.to_number(time), S.to_number(event)
    usable = F.coalesce(t > 0, F.lit(False)) & e.isNotNull()
    code = F.when(usable, e.cast("int"))
    return df.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.lit(len(df.columns)).cast("bigint").alias("cols_total"),
        F.count_if(usable).alias("rows_analyzed"),
        F.coalesce(F.sum(code.cast("bigint")), F.lit(0)).alias("events"),
        F.coalesce(F.sum((1 - code).cast("bigint")), F.lit(0)).alias("censored"),
        F.avg(code).alias("event_rate"),
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type (a fact about the schema, no scan)."""
    rows = df.sparkSession.createDataFrame([(t,) for _, t in df.dtypes], "dtype string")
    return rows.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def column_groups(df: DataFrame, ids: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Number of columns by role."""
    from hazardframe.schema import CNA, EXPR

    def role(c: str) -> str:
        if c in ids:
            return "ID / metadata"
        if c in targets:
            return "Survival targets"
        if c == "MUTATION_BURDEN":
            return "Mutation burden"
        if c.startswith(EXPR):
            return "Expression"
        return "CNA" if c.startswith(CNA) else "Clinical covars"

    rows = df.sparkSession.createDataFrame([(role(c), c) for c in df.columns], "role string, column string")
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n_columns"))


def layer_coverage(df: DataFrame, layers: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows with data in each layer, and in all of them at once."""
    every = None
    for column in layers.values():
        every = F.col(column).isNotNull() if every is None else every & F.col(column).isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"has_{name}") for name, c in layers.items()],
        F.count_if(every).alias("has_all"),
        *[(F.avg(F.col(c).isNotNull().cast("int")) * 100).alias(f"{name}_pct") for name, c in layers.items()],
    )
