"""Patient and sample selection: endpoints, metadata, burden, first samples, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators.ordered import exact_quantiles, join_on
from hazardframe.schema import PRIMARY_CODE


def survival_endpoint(df: DataFrame, time: str = "OS_MONTHS", event: str = "OS_EVENT") -> DataFrame:
    """Rows with a positive time and a known event; the event becomes an int."""
    numeric = df.withColumn(time, S.to_number(time)).withColumn(event, S.to_number(event))
    kept = numeric.where(F.col(time).isNotNull() & F.col(event).isNotNull() & (F.col(time) > 0))
    return kept.withColumn(event, F.col(event).cast("int"))


def strict_endpoint(
    df: DataFrame, time: str = "OS_MONTHS", event: str = "OS_EVENT", id_column: str = "PATIENT_ID", min_rows: int = 20
) -> DataFrame:
    """As ``survival_endpoint``, but any positive indicator is an event, ids are made if absent, and the result is
    checked for size and for both classes."""
    for name in (time, event):
        if name not in df.columns:
            raise ValueError(f"missing column {name}")
    numeric = df.withColumn(time, S.to_number(time)).withColumn(event, S.to_number(event))
    kept = numeric.where(F.col(time).isNotNull() & F.col(event).isNotNull() & (F.col(time) > 0))
    kept = kept.withColumn(event, (F.col(event) > 0).cast("int"))
    if id_column not in kept.columns:
        kept = kept.withColumn(id_column, S.synthetic_id(F.monotonically_increasing_id()))
    kept = kept.withColumn(id_column, F.col(id_column).cast("string"))
    row = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(event).alias("events")).first()
    if row["n"] < min_rows:
        raise ValueError(f"too few rows after cleaning: {row['n']}")
    if row["events"] in (0, row["n"]):
        raise ValueError("both events and censored rows are needed")
    return kept


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``.

    An aggregation of structs, not a window: partial results are combined before the shuffle, so a key with a third of
    all rows sends one row per task. Rows that tie in ``order`` are told apart by their remaining columns.
    """
    rest = [c for c in df.columns if c not in keys]
    ranking = [S.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    pick = F.max if last else F.min
    best = pick(F.struct(*ranking, F.struct(*rest).alias("_row"))).getField("_row")
    picked = df.groupBy(*keys).agg(best.alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def with_ordinal(df: DataFrame, name: str = "_ordinal") -> DataFrame:
    """Scan order of a file source. To be called right after the scan, before any shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def first_in_file_order(df: DataFrame, keys: Sequence[str], ordinal: str = "_ordinal") -> DataFrame:
    return first_row(df, keys, [ordinal])


def sample_metadata(df: DataFrame) -> DataFrame:
    """Normalised id, collection day, type code and primary flag of each sample.

    The two raw day columns may hold missing-value tokens; the first known wins, then 0; negative days become 0.
    """
    day = S.first_known(*[S.to_number(c) for c in ("DAYS_TO_COLLECTION", "DAYS_TO_SPECIMEN_COLLECTION") if c in df.columns])
    code = S.sample_type_code("SAMPLE_ID")
    kept = [c for c in df.columns if not c.startswith("DAYS_TO_")]
    return df.select(
        *kept,
        S.normalise_barcode("SAMPLE_ID").alias("SAMPLE_ID_NORM"),
        S.clip(day, lower=0.0).alias("SAMPLE_DAY"),
        code.alias("SAMPLE_TYPE_CODE"),
        (code == PRIMARY_CODE).alias("IS_PRIMARY"),
    )


def primary_samples(samples: DataFrame) -> DataFrame:
    """The first primary sample of each patient by sample id."""
    return first_row(samples.where("IS_PRIMARY").select("PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE"), ["PATIENT_ID"], ["SAMPLE_ID"])


def fallback_samples(samples: DataFrame, patients: DataFrame) -> DataFrame:
    """The first sample of each listed patient who has no primary sample."""
    covered = samples.where("IS_PRIMARY").select("PATIENT_ID").distinct()
    uncovered = patients.select("PATIENT_ID").distinct().join(covered, "PATIENT_ID", "left_anti")
    candidates = samples.select("PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE")
    return first_row(candidates, ["PATIENT_ID"], ["SAMPLE_ID"]).join(uncovered, "PATIENT_ID", "left_semi")


def selected_samples(samples: DataFrame, patients: DataFrame) -> DataFrame:
    """Primary samples of all patients plus fallback samples of the listed ones, tagged.

    One aggregation gives both: primaries sort first, and a fallback only counts for a listed patient.
    """
    rows = samples.select("PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE", "IS_PRIMARY")
    best = first_row(rows, ["PATIENT_ID"], [(~F.col("IS_PRIMARY")), "SAMPLE_ID"])
    primary = best.where("IS_PRIMARY")
    fallback = best.where(~F.col("IS_PRIMARY")).join(patients.select("PATIENT_ID").distinct(), "PATIENT_ID", "left_semi")
    return primary.unionByName(fallback).select(
        "PATIENT_ID", "SAMPLE_ID", "CANCER_TYPE", (~F.col("IS_PRIMARY")).alias("IS_FALLBACK")
    )


def mutation_burden(calls: DataFrame, keys: Sequence[str] = ("Tumor_Sample_Barcode", "CANCER_TYPE")) -> DataFrame:
    """Mutation rows per sample. Rows with a column ``N_CALLS`` stand for so many."""
    return calls.groupBy(*keys).agg(_call_count(calls).alias("MUTATION_COUNT"))


def _call_count(calls: DataFrame) -> Column:
    return F.sum("N_CALLS") if "N_CALLS" in calls.columns else F.count(F.lit(1))


def burden_summary(calls: DataFrame, group: str = "CANCER_TYPE") -> DataFrame:
    """Mean, largest and median burden of each cohort's samples."""
    burden = mutation_burden(calls)
    basic = burden.groupBy(group).agg(F.avg("MUTATION_COUNT").alias("mean_burden"), F.max("MUTATION_COUNT").alias("max_burden"))
    return join_on(basic, exact_quantiles(burden, "MUTATION_COUNT", {"median_burden": 0.5}, [group]), [group])


def burden_by_normalised_sample(calls: DataFrame) -> DataFrame:
    """Mutation rows per normalised sample id and cohort, summed over the barcodes that share one."""
    return (
        calls.groupBy(S.normalise_barcode("Tumor_Sample_Barcode").alias("SAMPLE_ID_NORM"), "CANCER_TYPE")
        .agg(_call_count(calls).alias("MUTATION_BURDEN"))
    )


def drop_post_outcome(samples: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Leave out samples taken after the end of follow-up."""
    return samples.where(F.col("SAMPLE_DAY") <= F.col("OS_DAYS") + tolerance)


def last_interval(intervals: DataFrame, value: str, keys: Sequence[str] = ("PATIENT_ID",)) -> DataFrame:
    """The value at the latest stop time of each key."""
    return intervals.groupBy(*keys).agg(F.max_by(value, "T_STOP").alias(value), F.max("T_STOP").alias("T_STOP"))


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"),
    )


def outcome_by_group(
    df: DataFrame, group: str = "CANCER_TYPE", id_column: str = "PATIENT_ID", time: str = "OS_MONTHS", event: str = "OS_EVENT"
) -> DataFrame:
    """Rows, events, event rate and median time of each group."""
    from hazardframe.operators.ordered import exact_quantiles, join_on

    sums = df.groupBy(group).agg(
        F.count(id_column).alias("n"),
        F.sum(F.col(event).cast("bigint")).alias("events"),
        F.avg(event).alias("event_rate"),
    )
    medians = exact_quantiles(df, time, {"median_os_months": 0.5}, [group])
    return join_on(sums, medians, [group], "left").orderBy(F.desc("event_rate"), group)
