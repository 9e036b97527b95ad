"""Imputation, outlier fences, winsorising, column pruning, leakage guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators.ordered import exact_quantiles, unpivot_numbers


def column_quantiles(df: DataFrame, columns: Sequence[str], levels: dict[str, float]) -> dict[str, dict[str, float]]:
    """Exact quantiles of several columns in one job: {column: {name: value}}. One driver row per column."""
    rows = exact_quantiles(unpivot_numbers(df, columns), "value", levels, ["feature"]).collect()
    found = {r["feature"]: {name: r[name] for name in levels} for r in rows}
    return {c: found.get(c, dict.fromkeys(levels)) for c in columns}


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing numbers with the exact median of their column."""
    medians = column_quantiles(df, columns, {"m": 0.5})
    fills = {c: m["m"] for c, m in medians.items() if m["m"] is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


def impute_constant(df: DataFrame, columns: Sequence[str], value: str | float = "Unknown") -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float) -> dict[str, tuple[float, float] | None]:
    out = {}
    for c, q in column_quantiles(df, columns, {"q1": 0.25, "q3": 0.75}).items():
        iqr = None if q["q1"] is None else q["q3"] - q["q1"]
        out[c] = None if iqr is None or not iqr > 0 else (q["q1"] - k * iqr, q["q3"] + k * iqr)
    return out


def iqr_outlier_counts(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values outside the fence of each column."""
    long = unpivot_numbers(df, columns).where(F.col("value").isNotNull())
    quartiles = exact_quantiles(long, "value", {"q1": 0.25, "q3": 0.75}, ["feature"]).collect()  # one row per column
    # The bounds are literals: a join on the few column names would bring all rows of a column together.
    literal = [x for r in quartiles for x in (F.lit(r["feature"]), F.struct(
        F.lit(r["q1"] - k * (r["q3"] - r["q1"])).alias("lo"), F.lit(r["q3"] + k * (r["q3"] - r["q1"])).alias("hi")))]
    if not literal:
        return long.select("feature", F.lit(0.0).alias("lower_bound"), F.lit(0.0).alias("upper_bound"), F.lit(0).cast("long").alias("n_outliers"))
    bounds = F.element_at(F.create_map(*literal), F.col("feature"))
    bounded = long.withColumns({"lower_bound": bounds["lo"], "upper_bound": bounds["hi"]})
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return bounded.groupBy("feature").agg(
        F.max("lower_bound").alias("lower_bound"), F.max("upper_bound").alias("upper_bound"),
        F.count_if(outside).alias("n_outliers"),
    )


def iqr_filter(df: DataFrame, columns: Sequence[str] = ("OS_MONTHS", "AGE"), k: float = 3.0) -> tuple[DataFrame, list[dict]]:
    """Leave out rows outside the fence of each column in turn; missing values stay. The fence of a later column is
    computed on the rows that are left. Returns the rows and one audit record per column."""
    rules: list[dict] = []
    left = df
    for c in columns:
        if c not in df.columns:
            rules.append({"column": c, "skipped": True, "reason": "column_not_found", "removed_rows": 0})
            continue
        number = left.withColumn("_n", S.to_number(c))
        q = column_quantiles(number, ["_n"], {"q1": 0.25, "q3": 0.75})["_n"]
        iqr = None if q["q1"] is None else q["q3"] - q["q1"]
        if iqr is None or not iqr > 0:
            rules.append({"column": c, "q1": q["q1"], "q3": q["q3"], "iqr": iqr, "skipped": True,
                          "reason": "non_positive_or_non_finite_iqr", "removed_rows": 0})
            continue
        lo, hi = q["q1"] - k * iqr, q["q3"] + k * iqr
        keep = F.col("_n").isNull() | F.col("_n").between(lo, hi)
        counts = number.agg(F.count(F.lit(1)).alias("n"), F.count_if(~keep).alias("removed")).first()
        rules.append({"column": c, "q1": q["q1"], "q3": q["q3"], "iqr": iqr, "lower_bound": lo, "upper_bound": hi,
                      "removed_rows": counts["removed"], "skipped": False})
        if counts["n"] and counts["n"] == counts["removed"]:
            raise ValueError(f"the fence of {c} removes all rows")
        left = number.where(keep).drop("_n")
    return left, rules


def winsorise(df: DataFrame, columns: Sequence[str] = ("OS_MONTHS", "DFS_MONTHS"), level: float = 0.99) -> DataFrame:
    """Limit values to the quantile of their column; missing values stay missing."""
    present = [c for c in columns if c in df.columns]
    caps = column_quantiles(df, present, {"cap": level})
    return df.withColumns({c: S.clip(c, upper=caps[c]["cap"]) for c in present if caps[c]["cap"] is not None})


def drop_listed(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Drop the listed columns that exist; also returns the dropped and the absent names."""
    present = [c for c in columns if c in df.columns]
    return df.drop(*present), present, [c for c in columns if c not in df.columns]


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def prefixed_columns(df: DataFrame, prefix: str, ordered: bool = False) -> list[str]:
    names = [c for c in df.columns if c.startswith(prefix)]
    return sorted(names) if ordered else names


def check_leakage(features: Sequence[str], forbidden: Sequence[str], prefixes: Sequence[str] = ("OS_", "DFS_")) -> None:
    """Raise if a feature is, or is derived from, the outcome."""
    bad = [c for c in features if c in forbidden or c.startswith(tuple(prefixes))]
    if bad:
        raise ValueError(f"outcome columns among the features: {sorted(bad)}")


def standardise_text(df: DataFrame) -> DataFrame:
    """Columns of no plain type become text, with NULL kept."""
    from pyspark.sql import types as T

    plain = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(*[F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string").alias(f.name) for f in df.schema])


def union_cohorts(frames: dict[str, DataFrame], label: str = "CANCER_TYPE") -> DataFrame:
    """Cohort tables one below the other by column name, tagged with their label; absent columns become NULL."""
    out: DataFrame | None = None
    for name, frame in frames.items():
        tagged = frame.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no cohorts given")
    return out
