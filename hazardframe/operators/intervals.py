"""Start/stop survival intervals from day-stamped samples (counting-process form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hazardframe.functions import scalars as S
from hazardframe.operators.cohort import first_row
from hazardframe.operators.ordered import PIECE, join_on, ordered_columns
from hazardframe.schema import DEFAULT_SAMPLE_CODE

KEYS = ["PATIENT_ID", "CANCER_TYPE"]
SAMPLE_COLUMNS = ["SAMPLE_ID", "SAMPLE_ID_NORM", "SAMPLE_TYPE_CODE", "IS_PRIMARY", "MUTATION_BURDEN"]
DAYS_PER_PIECE = 365


def samples_or_baseline(
    patients: DataFrame, samples: DataFrame, payload: Sequence[str] = (), carried: Sequence[str] = ()
) -> DataFrame:
    """Samples of each patient; a patient without any gets one row at day 0 with default values.

    ``carried`` are patient columns to keep on every row.
    """
    columns = [c for c in SAMPLE_COLUMNS if c in samples.columns] + list(payload)
    own = samples.select(*KEYS, "SAMPLE_DAY", *columns)
    joined = join_on(patients.select(*KEYS, "OS_DAYS", *carried), own, KEYS, "left")
    defaults = {"SAMPLE_TYPE_CODE": F.lit(DEFAULT_SAMPLE_CODE), "IS_PRIMARY": F.lit(False), "MUTATION_BURDEN": F.lit(0)}
    filled = [F.coalesce(c, defaults[c]).alias(c) if c in defaults else F.col(c) for c in columns]
    return joined.select(*KEYS, "OS_DAYS", *carried, F.coalesce("SAMPLE_DAY", F.lit(0.0)).alias("SAMPLE_DAY"), *filled)


def one_per_day(rows: DataFrame) -> DataFrame:
    """The first sample of each day, by normalised id with missing ids last."""
    order = [F.col("SAMPLE_ID_NORM").isNull(), "SAMPLE_ID_NORM", "SAMPLE_ID"]
    return first_row(rows, [*KEYS, "SAMPLE_DAY"], order)


def _anchor_values() -> dict[str, Column]:
    return {
        "SAMPLE_DAY": F.lit(0.0),
        "SAMPLE_ID": F.lit(None).cast("string"),
        "SAMPLE_ID_NORM": F.lit(None).cast("string"),
        "SAMPLE_TYPE_CODE": F.lit(DEFAULT_SAMPLE_CODE),
        "IS_PRIMARY": F.lit(False),
    }


def day0_anchors(rows: DataFrame) -> DataFrame:
    """Where a patient's earliest sample is later than day 0: a copy of it at day 0 that carries no sample id."""
    earliest = first_row(rows, KEYS, ["SAMPLE_DAY"]).where(F.col("SAMPLE_DAY") > 0)
    return earliest.withColumns({c: v for c, v in _anchor_values().items() if c in earliest.columns})


def carry_forward(rows: DataFrame) -> DataFrame:
    """Turn day-stamped rows into [T_START, T_STOP) intervals that last until the next row or the end of follow-up.

    Days are limited to just below the end of follow-up. A patient whose earliest sample is later than day 0 gets an
    anchor interval before it (as ``day0_anchors``). The interval number is given before empty intervals are left out,
    so numbers may have gaps; the event sits on the last row of the patient.
    """
    upper = F.greatest(F.col("OS_DAYS") - 1e-6, F.lit(1e-6))
    days = rows.withColumn("_day", S.clip("SAMPLE_DAY", F.lit(0.0), upper))
    # Years are the pieces of a patient's time line, so even one patient with very many samples is split.
    pieced = days.withColumn(PIECE, F.floor(F.col("_day") / DAYS_PER_PIECE).cast("int"))
    ordered = ordered_columns(
        pieced, ["_day", "SAMPLE_DAY"], KEYS, index="_pos", following={"_next": "_day"}, lows={"_first": "SAMPLE_DAY"}
    )
    late, values = F.col("_first") > 0, _anchor_values()
    kept = [c for c in rows.columns if c != "SAMPLE_DAY"]
    own = F.struct(
        *kept, F.col("_day").alias("SAMPLE_DAY"), (F.col("_pos") + late.cast("int")).alias("INTERVAL_INDEX"),
        F.col("_day").alias("T_START"), F.coalesce("_next", "OS_DAYS").alias("T_STOP"),
        F.when(F.col("_next").isNull(), F.col("OS_EVENT")).otherwise(F.lit(0)).alias("EVENT"),
    )
    anchor = F.struct(
        *[values[c].alias(c) if c in values else F.col(c) for c in kept], values["SAMPLE_DAY"].alias("SAMPLE_DAY"),
        F.lit(0).cast("bigint").alias("INTERVAL_INDEX"), F.lit(0.0).alias("T_START"), F.col("_day").alias("T_STOP"),
        F.lit(0).alias("EVENT"),
    )
    both = F.when(late & (F.col("_pos") == 0), F.array(anchor, own)).otherwise(F.array(own))
    spans = ordered.select(F.explode(both).alias("_s")).select("_s.*")
    return spans.where(F.col("T_STOP") > F.col("T_START"))


def survival_intervals(
    patients: DataFrame, samples: DataFrame, covariates: Sequence[str] = (), payload: Sequence[str] = ()
) -> DataFrame:
    """Intervals of all patients with their covariates and the sample values that hold during each interval."""
    carried = ["OS_EVENT", *covariates]
    patients = first_row(patients.select(*KEYS, "OS_DAYS", *carried), KEYS, ["OS_DAYS"])
    rows = samples_or_baseline(patients, samples, payload, carried)
    out = carry_forward(one_per_day(rows))
    sample_columns = [c for c in ["SAMPLE_ID", "SAMPLE_ID_NORM", "SAMPLE_DAY", *SAMPLE_COLUMNS[2:]] if c in out.columns]
    return out.select(
        *KEYS, F.col("INTERVAL_INDEX").cast("int").alias("INTERVAL_INDEX"), "T_START", "T_STOP", "EVENT", "OS_DAYS",
        "OS_EVENT", *sample_columns, *covariates, *payload,
    )
