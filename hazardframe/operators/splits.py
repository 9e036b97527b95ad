"""Stratified splits and folds by hash order.

The order inside a stratum is the md5 of seed and id. Its leading hex digits are the pieces of the ordering, so a
stratum holding a third of the table is numbered by thousands of tasks, without a pass to find cut points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hazardframe.operators.ordered import PIECE, hex_piece, join_on, ordered_columns

SEED = 42


def _numbered(df: DataFrame, id_column: str, strata: Sequence[str], seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    rows = df.withColumn("_digest", digest).withColumn(PIECE, hex_piece(F.col("_digest")))
    return ordered_columns(rows, ["_digest", id_column], strata, index="_pos", size="_n").drop("_digest")


def stratified_folds(
    df: DataFrame, id_column: str, strata: Sequence[str], folds: int = 5, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Add a fold number 0..folds-1; within each stratum the fold sizes differ by at most one."""
    numbered = _numbered(df, id_column, strata, seed)
    return numbered.withColumn(name, (F.col("_pos") % folds).cast("int")).drop("_pos", "_n")


def three_way_split(
    df: DataFrame, id_column: str, strata: Sequence[str], train: float = 0.6, calibration: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``split`` with the values train, calibration and test."""
    numbered = _numbered(df, id_column, strata, seed)
    first, second = F.round(F.col("_n") * F.lit(train)), F.round(F.col("_n") * F.lit(train + calibration))
    split = F.when(F.col("_pos") < first, "train").when(F.col("_pos") < second, "calibration").otherwise("test")
    return numbered.withColumn("split", split).drop("_pos", "_n")


def group_folds(
    df: DataFrame, id_column: str, strata: Sequence[str], folds: int = 5, seed: int = SEED
) -> DataFrame:
    """Folds over distinct ids, joined back, so that all rows of an id share a fold."""
    ids = df.groupBy(id_column).agg(*[F.min(c).alias(c) for c in strata])
    folded = stratified_folds(ids, id_column, strata, folds, seed).select(id_column, "fold")
    return join_on(df, folded, [id_column])


def fold_count(df: DataFrame, event: str = "OS_EVENT", wanted: int = 5) -> int:
    """Number of folds the rarer class allows; raises if a class is missing or has a single row."""
    row = df.agg(F.count_if(F.col(event) == 1).alias("one"), F.count_if(F.col(event) == 0).alias("zero")).first()
    smaller = min(row["one"], row["zero"])
    if smaller == 0:
        raise ValueError("both event classes are needed")
    if smaller < 2:
        raise ValueError("too few rows in the smaller class for cross-validation")
    return min(wanted, smaller)


def split_report(df: DataFrame, split: str = "split", event: str = "OS_EVENT") -> DataFrame:
    """Rows, events, censored rows and event rate of each split."""
    return (
        df.groupBy(split)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(event).cast("bigint")).alias("events"))
        .withColumn("censored", F.col("rows") - F.col("events"))
        .withColumn("event_rate", F.col("events") / F.col("rows"))
    )


def require_both_classes(report: DataFrame) -> None:
    """Raise if a split of the report has one class only (the report has one row per split)."""
    bad = report.where((F.col("events") == 0) | (F.col("censored") == 0)).collect()
    if bad:
        raise ValueError(f"splits with a single class: {sorted(r['split'] for r in bad)}")
