"""Mixing sources to target weights.

Documents get a hash-random key and are ordered by it within their source. A running sum of sizes over that order, built
from sums of key ranges and a local window inside each range, tells for every document how much of its source comes
before it; the cut lies exactly at the source's budget, and a budget above the source's size starts further epochs.
The keys are hashes of the ids: equal ranges of the key hold equal shares of any source, so a source with a third of
all rows is spread over as many ranges as the rest, and a rerun takes the same words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """One row per source: _m_source, source_size, target. ``sizes`` has the columns _m_source and _m_size.

    Sources in code-point order, NULL last, take the weights in turn. Where a weight would give more than ``max_epochs``
    times what the source has, the source gets just that and the rest is shared by weight again. The sources that are
    capped are those with the smallest size per weight, so running sums in that order find the final share at once.
    """
    per_source = sizes.groupBy("_m_source").agg(F.sum("_m_size").alias("source_size"))
    # One row per source: windows without a partition key see as many rows as there are sources.
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("_m_source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = per_source.select(
        "_m_source", "source_size",
        F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("_m_weight"),
        F.row_number().over(by_name).alias("_m_rank"),
        F.sum("source_size").over(everything).alias("_m_total"),
    )
    cap = F.col("source_size") * F.lit(max_epochs)
    order = everything.orderBy((cap / F.col("_m_weight")).asc(), F.col("_m_rank").asc())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_m_total") * F.lit(float(share)) - F.coalesce(F.sum(cap).over(earlier), F.lit(0))
    level = F.greatest(left, F.lit(0.0)) / F.sum("_m_weight").over(onward)
    # The first source in this order that is not capped sets the level for all after it.
    levels = ranked.select("*", F.when(level * F.col("_m_weight") <= cap, level).alias("_m_level"))
    free = F.min(F.when(F.col("_m_level").isNotNull(), F.struct((cap / F.col("_m_weight")).alias("r"), "_m_rank", "_m_level"))).over(everything)
    wanted = F.col("_m_weight") * free["_m_level"]
    return levels.select(
        "_m_source", "source_size", F.coalesce(F.least(wanted, cap.cast("double")), cap.cast("double")).alias("target")
    )


def mix(
    df: DataFrame,
    size: str,
    id_column: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.0,
    max_epochs: int = 3,
    tie: Sequence[str] = (),
) -> DataFrame:
    """The rows of ``df`` with source_size, target (their source's), taken, epochs and part.

    ``epochs`` whole copies of the row are in the mix, and ``part`` units of one more copy (0: none); ``taken`` is
    ``epochs * size + part``. The sum of ``taken`` over a source is its target rounded down, so no row exceeds
    ``max_epochs`` times its size. A NULL or negative size counts 0 and takes 0; a NULL source is a source of its own; a
    NULL id orders by the key of the empty text. Rows with equal id order by size and the ``tie`` columns; rows equal in
    all of them are interchangeable. An empty table gives an empty table. Columns of ``df`` that carry the names of the
    result are replaced by it.
    """
    added = ("source_size", "target", "taken", "epochs", "part")
    kept = [c for c in df.columns if c not in added]
    units = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(
        F.struct(*kept).alias("_m_row"), F.col(source).alias("_m_source"), units.alias("_m_size"),
        F.col(id_column).alias("_m_id"), F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("_m_key"),
        F.array(*[F.col(c).cast("string") for c in tie]).cast("array<string>").alias("_m_tie"),
    ).withColumn("_m_range", F.substring("_m_key", 1, RANGE_DIGITS))

    targets = source_targets(rows.select("_m_source", "_m_size"), weights, share, max_epochs)
    per_range = rows.groupBy("_m_source", "_m_range").agg(F.sum("_m_size").alias("_m_sum"))
    before = Window.partitionBy("_m_source").orderBy("_m_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("_m_source", "_m_range", F.coalesce(F.sum("_m_sum").over(before), F.lit(0)).alias("_m_offset"))
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o._m_source").eqNullSafe(F.col("t._m_source"))).select(
        F.col("o._m_source").alias("_o_source"), F.col("_m_range").alias("_o_range"), "_m_offset", "source_size", "target"
    )
    inside = Window.partitionBy("_m_source", "_m_range").orderBy("_m_key", "_m_id", "_m_size", "_m_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_m_before", F.coalesce(F.sum("_m_size").over(inside), F.lit(0))).join(
        offsets, F.col("_m_source").eqNullSafe(F.col("_o_source")) & (F.col("_m_range") == F.col("_o_range"))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("_m_offset") + F.col("_m_before")
    part = F.greatest(F.lit(0), F.least(F.col("_m_size"), budget - F.col("_m_epochs") * F.col("source_size") - start)).cast("long")
    out = placed.withColumn("_m_epochs", epochs).withColumn("_m_part", part)
    return out.select(
        *[F.col("_m_row")[c].alias(c) for c in kept],
        "source_size", "target",
        (F.col("_m_epochs") * F.col("_m_size") + F.col("_m_part")).alias("taken"),
        F.col("_m_epochs").alias("epochs"), F.col("_m_part").alias("part"),
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word, with the white space between the words as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), words), "")


def emit(mixed: DataFrame, size: str, row: str, text: str = "text") -> DataFrame:
    """The mix itself: the fields of the struct column ``row`` once for each copy, the text of the partial copy cut after
    its last word taken."""
    copies = F.when(F.col("part") > 0, F.col("epochs") + 1).otherwise(F.col("epochs")).cast("int")
    rows = mixed.where(copies > 0).select(row, size, "epochs", "part", F.explode(F.sequence(F.lit(1), copies)).alias("_m_copy"))
    cut = (F.col("_m_copy") > F.col("epochs")) & (F.col("part") < F.col(size))
    whole = F.col(row)[text]
    fields = mixed.schema[row].dataType.names
    return rows.select(*[
        (F.when(cut, first_words(whole, F.col("part").cast("int"))).otherwise(whole) if c == text else F.col(row)[c]).alias(c) for c in fields
    ])
