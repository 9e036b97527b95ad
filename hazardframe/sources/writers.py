"""Sinks: Parquet, CSV and JSON tables, nested reports, manifests, previews, fitted models."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardframe.operators import clean, cox
from hazardframe.operators.boosting import TREE_SCHEMA, QuantileModel
from hazardframe.sources.readers import path_exists


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Snappy Parquet; columns of no plain type are written as text with NULL kept."""
    clean.standardise_text(df).write.mode(mode).option("compression", "snappy").parquet(path, partitionBy=list(partition_by) or None)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per row."""
    df.write.mode(mode).json(path)


def report_frame(spark: SparkSession, report: Mapping) -> DataFrame:
    """A nested report (dictionary) as a one-row table with inferred structs."""
    lines = spark.createDataFrame([(json.dumps(report, default=str),)], "value string")
    schema = lines.select(F.schema_of_json(F.lit(json.dumps(report, default=str)))).first()[0]
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_report(spark: SparkSession, report: Mapping, path: str) -> None:
    write_json(report_frame(spark, report).coalesce(1), path)


def convert_folder(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """CSV files to snappy Parquet beside them. The sources stay; removing them is left to the caller."""
    out = []
    for path in paths:
        target = path.removesuffix(".csv") + ".parquet"
        write_parquet(spark.read.csv(path, header=True, inferSchema=True), target)
        out.append(target)
    return out


def prune_tables(spark: SparkSession, source: str, target: str, drops: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop listed columns of each table, write it with the suffix ``_cleaned``, and return the manifest."""
    rows = []
    for name, columns in drops.items():
        path = f"{source}/{name}.parquet"
        if not path_exists(spark, path):
            continue
        df = spark.read.parquet(path)
        pruned, dropped, absent = clean.drop_listed(df, columns)
        write_parquet(pruned, f"{target}/{name}_cleaned.parquet")
        rows.append(manifest_record(df, pruned, f"{name}.parquet", f"{name}_cleaned.parquet", dropped, absent))
    return manifest(spark, source, target, rows)


def manifest_record(before: DataFrame, after: DataFrame, source: str, target: str, dropped: Sequence[str], absent: Sequence[str]) -> tuple:
    n, m = len(before.columns), len(after.columns)
    return source, target, after.count(), n, m, n - m, list(dropped), list(absent)


def manifest(spark: SparkSession, source: str, target: str, records: Sequence[tuple]) -> DataFrame:
    schema = (
        "source_file string, output_file string, rows bigint, before_columns bigint, after_columns bigint, dropped_count bigint, "
        "dropped_columns array<string>, declared_but_missing_columns array<string>"
    )
    files = spark.createDataFrame(list(records), schema)
    return files.agg(F.collect_list(F.struct(*files.columns)).alias("files")).select(  # one record per table
        F.lit(source).alias("source_dir"), F.lit(target).alias("output_dir"), "files"
    )


def preview(df: DataFrame, path: str, n: int = 5) -> None:
    """The first n rows as CSV."""
    write_csv(df.limit(n).coalesce(1), path)


def save_fits(df: DataFrame, fits: Sequence[cox.Fit], names: Sequence[str], path: str) -> None:
    """Coefficients of fitted models as a Parquet table."""
    cox.coefficient_table(df, fits, names).coalesce(1).write.mode("overwrite").parquet(path)


def load_coefficients(spark: SparkSession, path: str) -> dict[tuple[str, int], list[float]]:
    """Coefficient vectors by (label, fold); a table of models x features."""
    rows = spark.read.parquet(path).orderBy("label", "fold", "coef_index").collect()
    out: dict[tuple[str, int], list[float]] = {}
    for r in rows:
        out.setdefault((r["label"], r["fold"]), []).append(r["coef_value"])
    return out


def save_quantile_model(model: QuantileModel, spark: SparkSession, path: str) -> None:
    """A boosted quantile model: its trees and its constants as tables."""
    spark.createDataFrame(model.tree_rows(), TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    head = [(model.quantile, model.start, model.rate)]
    spark.createDataFrame(head, "quantile double, start double, rate double").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def load_quantile_model(spark: SparkSession, path: str) -> QuantileModel:
    head = spark.read.parquet(f"{path}/head").first()
    return QuantileModel.from_rows(head["quantile"], head["start"], head["rate"], spark.read.parquet(f"{path}/trees").toPandas())
