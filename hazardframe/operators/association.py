"""Tests of every column against the outcome, on long tables: one grouped plan for all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hazardframe.functions.tails import chi_square_p, normal_p, student_p
from hazardframe.operators.ordered import average_ranks, cut_points, cut_points_of, ordered_columns, unpivot_numbers, with_piece
from hazardframe.session import cut_lineage

MIN_GROUP = 20
MAX_CATEGORIES = 30
MIN_PAIRS = 100
MIN_DISTINCT = 3


def mann_whitney(long: DataFrame, event: str = "event") -> DataFrame:
    """U of the censored group, two-sided p (ties and continuity corrected), rank-biserial effect, group medians.

    Values are first counted per (feature, value, group), so ties cost nothing; ranks are running counts.
    """
    known = long.where(F.col("value").isNotNull() & F.col(event).isin(0, 1))
    counts = known.groupBy("feature", "value").agg(
        F.count_if(F.col(event) == 0).alias("c0"), F.count_if(F.col(event) == 1).alias("c1"), F.count(F.lit(1)).alias("c")
    )
    ranked = ordered_columns(
        with_piece(counts, "value", cut_points(known, "value")), ["value"], ["feature"],
        sums={"u": "c", "u0": "c0", "u1": "c1"}, totals={"n0": "c0", "n1": "c1"},
    )
    c, u = F.col("c").cast("double"), F.col("u").cast("double")
    aggs = [
        F.max("n0").alias("n0"), F.max("n1").alias("n1"),
        F.sum(F.col("c0") * (u - (c - 1) / 2)).alias("rank_sum"), F.sum(c * c * c - c).alias("ties"),
        F.count_if(F.col("c0") > 0).alias("d0"), F.count_if(F.col("c1") > 0).alias("d1"),
    ]
    for g in ("0", "1"):
        for tag, at in (("lo", F.floor((F.col(f"n{g}") - 1) / 2)), ("hi", F.ceil((F.col(f"n{g}") - 1) / 2))):
            here = (F.col(f"u{g}") - F.col(f"c{g}") <= at) & (at < F.col(f"u{g}"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"m{g}_{tag}"))
    found = ranked.groupBy("feature").agg(*aggs)
    found = found.where((F.col("n0") >= MIN_GROUP) & (F.col("n1") >= MIN_GROUP) & ((F.col("d0") > 1) | (F.col("d1") > 1)))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    statistic = F.col("rank_sum") - n0 * (n0 + 1) / 2
    spread = F.sqrt(n0 * n1 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(F.col("statistic"), n0 * n1 - F.col("statistic")) - n0 * n1 / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return found.withColumn("statistic", statistic).withColumn("z", F.greatest(z, F.lit(0.0))).select(
        "feature", F.lit("numeric").alias("type"), "n0", "n1", "statistic", normal_p("z").alias("p_value"),
        (2 * F.col("statistic") / (n0 * n1) - 1).alias("effect_size"),
        ((F.col("m0_lo") + F.col("m0_hi")) / 2).alias("median_event0"),
        ((F.col("m1_lo") + F.col("m1_hi")) / 2).alias("median_event1"),
    )


def category_counts(df: DataFrame, columns: Sequence[str], event: str = "OS_EVENT") -> DataFrame:
    """(feature, value, c0, c1): rows of each category by outcome; missing values are the category ``NA``."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("_c"), F.col(event).alias("_e")).select("_c.*", "_e")
    return long.groupBy("feature", F.coalesce("value", F.lit("NA")).alias("value")).agg(
        F.count_if(F.col("_e") == 0).alias("c0"), F.count_if(F.col("_e") == 1).alias("c1"),
        F.max(F.col("value").isNotNull().cast("int")).alias("known"),
    )


def chi_square(counts: DataFrame) -> DataFrame:
    """Chi-square test (Yates-corrected for 2 x 2 tables) and Cramér's V (never corrected) of each feature."""
    totals = counts.groupBy("feature").agg(
        F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.count(F.lit(1)).alias("k"), F.sum("known").alias("distinct")
    ).where((F.col("distinct") <= MAX_CATEGORIES) & (F.col("k") >= 2) & (F.col("n0") > 0) & (F.col("n1") > 0))
    cells = counts.join(totals, "feature")
    n = (F.col("n0") + F.col("n1")).cast("double")
    row = F.col("c0") + F.col("c1")
    plain, corrected = F.lit(0.0), F.lit(0.0)
    for g in ("0", "1"):
        expected = row * F.col(f"n{g}") / n
        gap = F.abs(F.col(f"c{g}") - expected)
        less = gap - F.when(F.col("k") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0)
        plain, corrected = plain + gap * gap / expected, corrected + less * less / expected
    found = cells.groupBy("feature").agg(
        F.max("n0").alias("n0"), F.max("n1").alias("n1"), F.max("k").alias("k"),
        F.sum(corrected).alias("statistic"), F.sum(plain).alias("_plain"),
    )
    return found.select(
        "feature", F.lit("categorical").alias("type"), "n0", "n1", "statistic",
        chi_square_p("statistic", (F.col("k") - 1).cast("double")).alias("p_value"),
        F.sqrt(F.col("_plain") / (F.col("n0") + F.col("n1"))).alias("effect_size"),
        F.lit(None).cast("double").alias("median_event0"), F.lit(None).cast("double").alias("median_event1"),
    )


def spearman(long: DataFrame, time: str = "time") -> DataFrame:
    """Rank correlation of each feature with time; time is ranked within the rows where the feature is known."""
    rows = long.where(F.col("value").isNotNull() & F.col(time).isNotNull())
    cuts = cut_points_of(rows, ["value", time])
    x = average_ranks(rows, "value", ["feature"], "rx", cuts["value"].cuts).select("feature", "value", "rx")
    y = average_ranks(rows, time, ["feature"], "ry", cuts[time].cuts).select("feature", time, "ry")
    distinct = x.groupBy("feature").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= MIN_DISTINCT)
    ranked = rows.join(x, ["feature", "value"]).join(y, ["feature", time])
    found = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("spearman_rho"))
    found = found.where(F.col("n") >= MIN_PAIRS).join(distinct, "feature", "left_semi")
    r, df = F.col("spearman_rho"), (F.col("n") - 2).cast("double")
    t = F.when(F.abs(r) < 1, r * F.sqrt(df / ((1 - r) * (1 + r)))).otherwise(F.lit(float("inf")))
    return found.select("feature", "n", "spearman_rho", student_p(t, df).alias("p_value"))


def adjust_false_discovery(tests: DataFrame, p: str = "p_value", q: str = "q_value_bh") -> DataFrame:
    """Benjamini-Hochberg q-values over the whole table; a missing p counts as 1.

    Works on distinct p-values: running counts give the rank, a running minimum from the top gives q.
    """
    filled = tests.withColumn("_p", F.coalesce(F.when(~F.isnan(p), F.col(p)), F.lit(1.0)))
    cuts = cut_points(filled, "_p")
    counts = filled.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_columns(with_piece(counts, "_p", cuts), ["_p"], sums={"_rank": "_c"}, totals={"_m": "_c"})
    scaled = ranked.withColumn("_v", F.col("_p") * F.col("_m") / F.col("_rank"))
    lowest = ordered_columns(with_piece(scaled, "_p", cuts), ["_p"], mins={"_q": "_v"}, descending=True)
    looked_up = lowest.select("_p", F.least(F.col("_q"), F.lit(1.0)).alias(q))
    return filled.join(looked_up, "_p").drop("_p")


def univariate_tests(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], event: str = "OS_EVENT") -> DataFrame:
    """Rank tests of the numeric and chi-square tests of the categorical columns, q-values over both together."""
    long = unpivot_numbers(df, [c for c in numeric if c != event], [event]).withColumnRenamed(event, "event")
    parts = mann_whitney(long)
    if categorical:
        parts = parts.unionByName(chi_square(category_counts(df, categorical, event)))
    # One row per column from here on; written once because the adjustment reads it several times.
    adjusted = adjust_false_discovery(cut_lineage(parts))
    return adjusted.withColumn("significant_q_lt_0_05", F.col("q_value_bh") < 0.05).orderBy("q_value_bh", "p_value", "feature")


def omics_spearman(long: DataFrame, time: str = "time") -> DataFrame:
    """Spearman scan of omic features (name starts with its layer's prefix) with q-values over all of them."""
    found = adjust_false_discovery(cut_lineage(spearman(long, time)))
    prefix = F.concat(F.substring_index("feature", "_", 1), F.lit("_"))
    return found.withColumn("prefix", prefix).orderBy("q_value_bh", "feature")

