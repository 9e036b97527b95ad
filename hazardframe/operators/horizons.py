"""Known event status at fixed horizons, and classification metrics of probabilities at those horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hazardframe.operators.ordered import cut_points, join_on, ordered_columns, with_piece
from hazardframe.schema import HORIZONS_MONTHS

GRID = 200  # thresholds 0, 1/200, ..., 1


def horizon_labels(
    df: DataFrame, horizons: Sequence[int] = tuple(HORIZONS_MONTHS), time: str = "OS_MONTHS", event: str = "OS_EVENT"
) -> DataFrame:
    """Each row once per horizon where its status is known: 1 if the event came by then, 0 if follow-up is longer."""
    rows = df.withColumn("horizon_months", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    h = F.col("horizon_months")
    label = F.when((F.col(event) == 1) & (F.col(time) <= h), 1).when(F.col(time) > h, 0)
    return rows.withColumn("y_true_by_horizon", label).where(F.col("y_true_by_horizon").isNotNull())


def youden_thresholds(df: DataFrame, p: str = "p_event_hat", y: str = "y_true_by_horizon", keys: Sequence[str] = ("horizon_months",)) -> DataFrame:
    """The grid threshold with the largest sensitivity + specificity - 1, the lowest of them on a tie.

    Rows are counted by the highest threshold they reach; summing those counts from above gives all confusion tables.
    """
    keys = list(keys)
    near = F.least(F.floor(F.col(p) * GRID).cast("int"), F.lit(GRID))
    reached = (
        F.when((near < GRID) & (F.col(p) >= (near + 1) * F.lit(1.0 / GRID)), near + 1)
        .when(F.col(p) < near * F.lit(1.0 / GRID), near - 1)
        .otherwise(near)
    )
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, reached.alias("k")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    frame = counts.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    whole = Window.partitionBy(*keys)  # GRID + 1 rows
    above = whole.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    filled = join_on(frame, counts, [*keys, "k"], "left").na.fill(0, ["pos", "neg"])
    tables = filled.select(
        *keys, "k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("p_all"), F.sum("neg").over(whole).alias("n_all"),
    )
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    j = rate(F.col("tp"), F.col("p_all")) + rate(F.col("n_all") - F.col("fp"), F.col("n_all")) - 1.0
    best = F.max(F.struct(F.round(j, 12).alias("j"), (-F.col("k")).alias("k"))).alias("b")
    return tables.groupBy(*keys).agg(best).select(*keys, (-F.col("b.k") * F.lit(1.0 / GRID)).alias("threshold"), F.col("b.j").alias("youden_j"))


def confusion(df: DataFrame, p: str = "p_event_hat", y: str = "y_true_by_horizon", threshold: str = "threshold",
              keys: Sequence[str] = ("horizon_months",)) -> DataFrame:
    """Confusion counts and what follows from them; undefined ratios are 0, an undefined specificity NULL."""
    hit, truth = F.col(p) >= F.col(threshold), F.col(y) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & ~truth).alias("tn"), F.count_if(~hit & truth).alias("fn"),
        F.avg(F.col(y)).alias("event_rate"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.withColumns(
        {
            "accuracy": (tp + tn) / (tp + fp + tn + fn),
            "precision": ratio(tp, tp + fp),
            "recall_sensitivity": ratio(tp, tp + fn),
            "specificity": F.when(tn + fp > 0, tn / (tn + fp)),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def ranking_metrics(df: DataFrame, p: str = "p_event_hat", y: str = "y_true_by_horizon", keys: Sequence[str] = ("horizon_months",)) -> DataFrame:
    """ROC AUC and average precision of each key, from running counts over distinct scores; NULL with one class."""
    keys = list(keys)
    known = df.where(F.col(p).isNotNull())
    counts = known.groupBy(*keys, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    ranked = ordered_columns(
        with_piece(counts, p, cut_points(known, p)), [p], keys, sums={"tp": "pos", "fp": "neg"},
        totals={"p_all": "pos", "n_all": "neg"}, descending=True,
    )
    pos, neg, tp, fp, all_pos, all_neg = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp", "p_all", "n_all"))
    # Each positive beats the negatives ranked strictly below it and half of those that tie.
    wins = pos * ((all_neg - fp) + neg / 2)
    return ranked.groupBy(*keys).agg(
        F.sum(wins).alias("_w"), F.sum(pos * tp / (tp + fp)).alias("_ap"), F.max(all_pos).alias("_p"), F.max(all_neg).alias("_n")
    ).select(
        *keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(F.col("_p") > 0, F.col("_ap") / F.col("_p")).alias("pr_auc"),
    )


def classification_report(df: DataFrame, keys: Sequence[str] = ("horizon_months",)) -> DataFrame:
    """One row per horizon: event rate, threshold, AUCs, Brier score, confusion counts and their ratios."""
    keys = list(keys)
    base = confusion(df, keys=[*keys, "threshold"])
    return join_on(base, ranking_metrics(df, keys=keys), keys).select(
        *keys, (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_test_known"),
        F.col("event_rate").alias("event_rate_test_known"), F.col("threshold").alias("threshold_from_calibration"),
        "roc_auc", "pr_auc", "brier", "accuracy", "precision", "recall_sensitivity", "specificity", "f1", "tp", "fp", "tn", "fn",
    )
