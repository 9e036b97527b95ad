"""Scans of clinical, matrix, mutation and report files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hazardframe.functions import scalars as S
from hazardframe.operators import cohort, genes
from hazardframe.operators.clean import union_cohorts
from hazardframe.schema import DEFAULT_NA, NA_TOKENS

ORDINAL = "_ordinal"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _header(spark: SparkSession, path: str, comment: str | None) -> list[str]:
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    return lines.first()["value"].rstrip("\r").split("\t")


def read_tsv(spark: SparkSession, path: str, comment: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One tab-separated file as text columns plus its line order in ``_ordinal``.

    Lines that start with ``comment`` are skipped at the top of the file only; later ones are data.
    """
    names = _header(spark, path, comment)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.csv(path, schema=schema, sep="\t", header=False, quote="", mode="PERMISSIVE").withColumn(
        ORDINAL, F.monotonically_increasing_id()
    )
    is_header = F.col(f"`{names[0]}`") == names[0]
    for c in names[1:3]:
        is_header = is_header & (F.col(f"`{c}`") == c)
    first = raw.where(is_header).select(ORDINAL).first()[ORDINAL]
    rows = raw.where(F.col(ORDINAL) > first)
    wanted = names if columns is None else [c for c in columns if c in names]
    return rows.select(*[F.col(f"`{c}`") for c in wanted], ORDINAL)


def read_clinical(spark: SparkSession, path: str, tokens: Sequence[str] = (*NA_TOKENS, *DEFAULT_NA)) -> DataFrame:
    """Clinical file: leading comment lines skipped, missing-value tokens as NULL, all columns text."""
    rows = read_tsv(spark, path, comment="#")
    return rows.select(*[c if c == ORDINAL else S.blank_tokens(F.col(f"`{c}`"), tokens).alias(c) for c in rows.columns])


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns whose known values are all numbers become doubles; one pass decides for all columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    bad = df.agg(*[
        (F.count(c) - F.count(F.col(c).try_cast("double"))).alias(f"b{i}") for i, c in enumerate(texts)
    ], *[F.count(c).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    numeric = [c for i, c in enumerate(texts) if bad[f"b{i}"] == 0 and bad[f"n{i}"] > 0]
    return df.withColumns({c: S.to_number(c) for c in numeric})


def read_mutations(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mutation calls; name ``columns`` to read only those."""
    return read_tsv(spark, path, columns=columns).drop(ORDINAL)


def read_matrix(spark: SparkSession, path: str, label: str, normalise: bool = False) -> DataFrame:
    """Genes x samples file in long form (sample_id, cohort, gene, value); of repeated genes the first line counts."""
    long = genes.matrix_to_long(read_tsv(spark, path)).withColumn("cohort", F.lit(label))
    if normalise:
        long = long.withColumn("sample_id", S.normalise_barcode("sample_id"))
    return genes.drop_duplicate_genes(long).select("sample_id", "cohort", "gene", "value")


def read_cohorts(reader: Callable[[str], DataFrame], paths: Mapping[str, str]) -> DataFrame:
    """One file per cohort, tagged with its label; columns that a cohort lacks are NULL."""
    return union_cohorts({label: reader(path) for label, path in paths.items()})


def read_matrices(spark: SparkSession, paths: Mapping[str, str], normalise: bool = False) -> DataFrame:
    out: DataFrame | None = None
    for label, path in paths.items():
        part = read_matrix(spark, path, label, normalise)
        out = part if out is None else out.unionByName(part)
    return out


def read_cohort_mutations(spark: SparkSession, paths: Mapping[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    return read_cohorts(lambda p: read_mutations(spark, p, columns), paths)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the suffix of its path."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith((".tsv", ".txt")):
        return infer_numbers(read_clinical(spark, path)).drop(ORDINAL)
    if path.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unknown table format: {path}")


def read_parquet_or_csv(spark: SparkSession, stem: str) -> DataFrame:
    """``stem``.parquet if it exists, else ``stem``.csv."""
    for suffix in (".parquet", ".csv"):
        if path_exists(spark, stem + suffix):
            return read_table(spark, stem + suffix)
    raise FileNotFoundError(stem)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A prepared table if it was written, else what ``build`` makes of the raw files."""
    return spark.read.parquet(path) if path_exists(spark, path) else build()


def read_run_metrics(spark: SparkSession, metrics: str, collinearity: str | None = None) -> DataFrame:
    """One flat row from the nested reports of a run; absent keys give NULL.

    Month intervals are found under either of their two keys.
    """
    report = spark.read.json(metrics, multiLine=True)

    def at(df: DataFrame, *path: str):
        """Nested field, NULL where any step is absent."""
        kind, names = df.schema, []
        for step in path:
            if not isinstance(kind, T.StructType) or step not in kind.names:
                return F.lit(None)
            kind = kind[step].dataType
            names.append(f"`{step}`")
        return F.col(".".join(names))

    def first_of(*options) -> F.col:
        return F.coalesce(*[o.cast("double") for o in options])

    months = ("conformal_month_interval", "cqr_month_interval")
    plain = ["cv_best_mean_c_index", "c_index_train", "c_index_calibration", "c_index_test"]
    counts = ["n_train", "n_calibration", "n_test", "events_train", "events_calibration", "events_test"]
    row = report.select(
        *[at(report, c).cast("double").alias(c) for c in plain],
        first_of(*[at(report, m, "coverage_test_events_only") for m in months]).alias("coverage_test_events_only"),
        first_of(*[at(report, m, k) for m in months for k in ("mean_interval_width_months_test", "mean_interval_width_months_all_test")])
        .alias("mean_interval_width_months_test"),
        *[at(report, c).cast("bigint").alias(c) for c in counts],
    )
    if collinearity is None or not path_exists(spark, collinearity):
        return row
    c = spark.read.json(collinearity, multiLine=True)
    fields = {
        "expr_before": ("feature_counts", "expr_before"), "expr_after": ("feature_counts", "expr_after"),
        "expr_dropped": ("expression", "dropped_count"),
        "clinical_before": ("feature_counts", "clinical_before"), "clinical_after": ("feature_counts", "clinical_after"),
        "clinical_dropped": ("clinical_numeric", "dropped_count"),
    }
    pairs = F.coalesce(at(c, "expression", "method_details", "n_pairs_above_threshold").cast("bigint"),
                       at(c, "expression", "n_pairs_above_threshold").cast("bigint"))
    counts_row = c.select(*[at(c, *p).cast("bigint").alias(k) for k, p in fields.items()],
                          pairs.alias("collinearity_pairs_above_threshold")).first()
    return row.withColumns({k: F.lit(counts_row[k]).cast("bigint") for k in counts_row.asDict()})


def cohort_patients(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Clinical patient files of all cohorts, numbers typed, ready for the cleaning chain."""
    return infer_numbers(read_cohorts(lambda p: read_clinical(spark, p), paths))


def cohort_samples(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Clinical sample files of all cohorts with their derived metadata."""
    return cohort.sample_metadata(read_cohorts(lambda p: read_clinical(spark, p), paths).drop(ORDINAL))
