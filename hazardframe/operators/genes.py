"""Gene-level operators. Matrices are kept long (sample, cohort, gene, value); wide form only at the model edge."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hazardframe.functions import scalars as S
from hazardframe.operators import collinearity
from hazardframe.operators.cohort import first_row
from hazardframe.operators.ordered import exact_quantiles, join_on


def matrix_to_long(matrix: DataFrame, gene: str = "Hugo_Symbol", drop: Sequence[str] = ("Entrez_Gene_Id",)) -> DataFrame:
    """Genes x samples to (sample_id, gene, value), the transpose in long form."""
    wide = matrix.drop(*drop)
    samples = [c for c in wide.columns if c != gene and not c.startswith("_")]
    keep = [c for c in wide.columns if c.startswith("_")]
    typed = wide.select(F.col(gene).alias("gene"), *keep, *[S.to_number(F.col(f"`{c}`")).alias(c) for c in samples])
    return typed.unpivot(["gene", *keep], samples, "sample_id", "value")


def drop_duplicate_genes(rows: DataFrame, ordinal: str = "_ordinal") -> DataFrame:
    """Keep the first line of a gene in file order, for each sample."""
    return first_row(rows, ["sample_id", "cohort", "gene"], [ordinal])


def long_to_wide(rows: DataFrame, genes: Sequence[str], prefix: str, ids: Sequence[str] = ("sample_id", "cohort")) -> DataFrame:
    """One column per listed gene, named with a prefix."""
    wide = rows.groupBy(*ids).pivot("gene", list(genes)).agg(F.first("value"))
    return wide.select(*ids, *[F.col(f"`{g}`").alias(prefix + g) for g in genes])


def align_genes(rows: DataFrame, genes: Sequence[str], prefix: str, ids: Sequence[str] = ("sample_id", "cohort")) -> DataFrame:
    """As ``long_to_wide``, with 0 for genes that no sample has; genes that exist keep their NULLs."""
    listed = rows.where(F.col("gene").isin(*genes))
    present = {r["gene"] for r in listed.select("gene").distinct().collect()}  # at most len(genes) rows
    wide = long_to_wide(rows, genes, prefix, ids)
    return wide.select(*ids, *[prefix + g if g in present else F.lit(0.0).alias(prefix + g) for g in genes])


def gene_variance(rows: DataFrame, value: str = "value", by: Sequence[str] = ("gene",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.var_samp(value).alias("variance"))


def top_variable_genes(rows: DataFrame, n: int, value: str = "value") -> DataFrame:
    """The n genes with the largest variance, ties by name."""
    return gene_variance(rows, value).orderBy(F.desc_nulls_last("variance"), "gene").limit(n)


def variance_profile(rows: DataFrame, value: str = "value") -> DataFrame:
    """Genes numbered by falling variance. One row per gene, so the single ordering is over the gene list only."""
    order = Window.orderBy(F.desc_nulls_last("variance"), "gene")
    return gene_variance(rows, value).withColumn("gene_rank", F.row_number().over(order))


def top_variable_genes_by_cohort(rows: DataFrame, n: int = 50, value: str = "value", cohort: str = "cohort") -> DataFrame:
    """(cohort, gene, variance, mean, gene_rank): the n genes that vary most within each cohort, ties by name."""
    known = rows.groupBy(cohort, "gene").agg(F.var_samp(value).alias("variance"), F.avg(value).alias("mean"))
    order = Window.partitionBy(cohort).orderBy(F.desc_nulls_last("variance"), "gene")  # rows are genes of a cohort
    return known.withColumn("gene_rank", F.row_number().over(order)).where(F.col("gene_rank") <= n)


def cohort_correlations(rows: DataFrame, n: int = 50, value: str = "value", cohort: str = "cohort") -> DataFrame:
    """(cohort, gene_a, gene_b, r): correlations of the n genes that vary most within each cohort, over its samples.

    Every cohort has its own list of genes. A sample becomes one vector in the order of its cohort's list; tasks add up
    an n x n matrix of sums for each cohort they meet, missing values left out pair by pair, and the matrices of a
    cohort meet in one task. Undefined correlations are left out; rows without a cohort form one.
    """
    top = top_variable_genes_by_cohort(rows, n, value, cohort).select(cohort, "gene", "mean", (F.col("gene_rank") - 1).alias("_at"))
    listed = join_on(rows.select("sample_id", cohort, "gene", F.col(value).cast("double").alias("_v")), top, [cohort, "gene"])
    cells = listed.where(F.col("_v").isNotNull()).select("sample_id", cohort, F.struct("_at", (F.col("_v") - F.col("mean")).alias("_v")).alias("_c"))
    samples = cells.groupBy("sample_id", cohort).agg(F.collect_list("_c").alias("_c")).select(cohort, "_c")  # at most n cells
    kind, arrow = samples.schema[cohort].dataType.simpleString(), to_arrow_type(samples.schema[cohort].dataType)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            listed, size = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy()
            x = np.full((batch.num_rows, n), np.nan)
            x[np.repeat(np.arange(batch.num_rows), size), listed.field(0).to_numpy()] = listed.field(1).to_numpy()
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for c in set(names.tolist()):
                own = np.array([k == c for k in names])
                sums = np.stack(collinearity.tile_sums(x[own], slice(0, n), slice(0, n), False))
                total[c] = total.get(c, 0) + sums
        yield pa.RecordBatch.from_arrays([pa.array(list(total), arrow), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=[cohort, "sums"])

    def lay_out(parts: pa.Table) -> pa.Table:
        r = collinearity.correlations(sum(np.frombuffer(v, float).reshape(6, n, n) for v in parts["sums"].to_pylist()))
        a, b = np.nonzero(np.isfinite(r) & np.triu(np.ones((n, n), bool), 1))
        key = pa.concat_arrays([parts[cohort].combine_chunks().slice(0, 1)] * len(a)) if len(a) else parts[cohort].combine_chunks().slice(0, 0)
        return pa.table({cohort: key, "_a": pa.array(a.astype(np.int32)), "_b": pa.array(b.astype(np.int32)), "r": pa.array(r[a, b])})

    found = samples.mapInArrow(add, f"`{cohort}` {kind}, sums binary").groupBy(cohort).applyInArrow(lay_out, f"`{cohort}` {kind}, _a int, _b int, r double")
    for side in ("a", "b"):
        names = top.select(cohort, F.col("_at").alias(f"_{side}"), F.col("gene").alias(f"gene_{side}"))
        found = join_on(found, names, [cohort, f"_{side}"])
    ordered = F.col("gene_a") < F.col("gene_b")
    return found.select(cohort, F.when(ordered, F.col("gene_a")).otherwise(F.col("gene_b")).alias("gene_a"), F.when(ordered, F.col("gene_b")).otherwise(F.col("gene_a")).alias("gene_b"), "r")


def top_values(rows: DataFrame, value: str, n: int, group: str | None = "CANCER_TYPE") -> DataFrame:
    """The n most frequent values of each group (or of all rows), ties by name."""
    keys = [group] if group else []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return counts.orderBy(F.desc("n"), value).limit(n)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(value))
    return counts.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def mutation_frequency(calls: DataFrame, top: int = 20) -> DataFrame:
    """Share of a cohort's samples with a mutation in each of the overall most mutated genes, in percent."""
    genes = top_values(calls, "Hugo_Symbol", top, group=None).select("Hugo_Symbol")
    barcode = "Tumor_Sample_Barcode"
    cohorts = calls.select("CANCER_TYPE", barcode).distinct().groupBy("CANCER_TYPE").agg(F.count(barcode).alias("n_samples"))
    pairs = calls.join(genes, "Hugo_Symbol", "left_semi").select("CANCER_TYPE", "Hugo_Symbol", barcode).distinct()
    hits = pairs.groupBy("Hugo_Symbol", "CANCER_TYPE").agg(F.count(barcode).alias("n_mutated"))
    return join_on(hits, cohorts, ["CANCER_TYPE"]).select(
        "Hugo_Symbol", "CANCER_TYPE", (F.col("n_mutated") / F.col("n_samples") * 100).alias("frequency_pct")
    )


def frequency_matrix(frequency: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    """Genes x cohorts, 0 where a gene is not mutated."""
    return frequency.groupBy("Hugo_Symbol").pivot("CANCER_TYPE", list(cohorts)).agg(F.first("frequency_pct")).na.fill(0.0)


def genes_in_all_cohorts(rows: DataFrame, gene: str = "gene", cohort: str = "cohort") -> DataFrame:
    pairs = rows.select(gene, cohort).distinct()
    cohorts = pairs.select(cohort).distinct().agg(F.count(F.lit(1)).alias("k"))
    counts = pairs.groupBy(gene).agg(F.count(F.lit(1)).alias("c"))
    return counts.join(cohorts, counts["c"] == cohorts["k"]).select(gene)


def cna_frequency(rows: DataFrame) -> DataFrame:
    """Share of samples (missing values counted in) with an amplification or a deep deletion, in percent."""
    n = F.count(F.lit(1))
    return rows.groupBy("cohort", "gene").agg(
        (F.count_if(F.col("value") == 2) / n * 100).alias("amp_pct"),
        (F.count_if(F.col("value") == -2) / n * 100).alias("del_pct"),
    )


def top_amplified_and_deleted(frequency: DataFrame, top: int = 15, extra: int = 5) -> DataFrame:
    """Per cohort the most amplified genes, then some of the most deleted that are not among them."""
    by = Window.partitionBy("cohort")  # rows are genes of a cohort
    ranked = frequency.withColumns(
        {
            "amp_pos": F.row_number().over(by.orderBy(F.desc("amp_pct"), "gene")),
            "del_pos": F.row_number().over(by.orderBy(F.desc("del_pct"), "gene")),
        }
    )
    amplified = ranked.where(F.col("amp_pos") <= top).withColumn("pos", F.col("amp_pos"))
    others = ranked.where((F.col("del_pos") <= top) & (F.col("amp_pos") > top))
    others = others.withColumn("pos", top + F.row_number().over(by.orderBy("del_pos"))).where(F.col("pos") <= top + extra)
    return amplified.unionByName(others).select("cohort", "gene", "pos", "amp_pct", (-F.col("del_pct")).alias("neg_del_pct"))


def sample_medians(rows: DataFrame) -> DataFrame:
    """Median over the genes of each sample; a sample has one row per gene, which bounds the group."""
    return rows.groupBy("sample_id", "cohort").agg(F.median("value").alias("median_value"))


def median_of_medians(rows: DataFrame, by: Sequence[str] = ("cohort",)) -> DataFrame:
    return exact_quantiles(sample_medians(rows), "median_value", {"overall_median": 0.5}, by)


def matrix_summary(rows: DataFrame, by: Sequence[str] = ("cohort",)) -> DataFrame:
    """Range, percentage of zeros and missing values of a matrix."""
    return rows.groupBy(*by).agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        (F.count_if(F.col("value") == 0) / F.count(F.lit(1)) * 100).alias("zero_pct"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )
