"""Ordered computations without sorting a whole group in one task.

``Window.partitionBy(key).orderBy(value)`` puts all rows of a key into one task, and a window without keys puts the
whole table into one. Here the order column is first cut into *pieces* at approximate quantiles of the whole table,
so that a (key, piece) group holds at most about ``rows / pieces`` rows however large the key is. Each result is the
local window over (key, piece) combined with what the earlier pieces of that key add up to, which is read from a
summary table of one row per (key, piece).

Callers reduce their rows to one per (key, value) first; a value shared by a third of all rows is then one row.
Where the cut points lie only affects balance, never the result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = "_piece"
MIN_PIECES = 8
MAX_PIECES = 1024
ROWS_PER_PIECE = 500_000
LITERAL_KEYS = 64


def join_on(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key meets a missing key; the key columns of ``left`` stay. For inner and left joins."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def look_up(rows: DataFrame, table: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the columns of ``table``, which has one row per key, and the table itself.

    A table of at most LITERAL_KEYS rows is read once and becomes literals: a join on a handful of keys would bring all rows of
    a key together. A larger one is joined; what is found is the same.
    """
    keys = list(keys)
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    found = table.withColumn("_name", name).limit(LITERAL_KEYS + 1).collect()
    if len(found) > LITERAL_KEYS:
        return join_on(rows, table, keys), table
    fields = [f for f in table.schema if f.name not in keys]
    small = table.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], table.schema)
    if not found:
        return rows.where(F.lit(False)).withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields}), small
    entries = [x for r in found for x in (F.lit(r["_name"]), F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]))]
    value = F.element_at(F.create_map(*entries), name)
    return rows.where(value.isNotNull()).withColumns({f.name: value[f.name] for f in fields}), small


def cut_points(df: DataFrame, column: str, pieces: int | None = None) -> list[float]:
    """Approximate quantiles of ``column``: at most ``MAX_PIECES - 1`` numbers, found in one pass."""
    return cut_points_of(df, [column], pieces)[column].cuts


@dataclass(frozen=True)
class Cuts:
    """Cut points of a column, and the pieces that hold a single, heavy value."""

    cuts: list[float]
    isolated: frozenset[int] = frozenset()
    rows: int = 0


def cut_points_of(
    df: DataFrame, columns: Sequence[str], pieces: int | None = None, limit: int = MAX_PIECES, isolate: bool = False
) -> dict[str, Cuts]:
    """Cut points of several columns in one pass. With ``isolate`` a value that fills a whole piece by itself gets a
    piece of its own, so that callers can treat it apart."""
    # Written as text: a column expression would cost one call to the JVM for each level.
    levels = ", ".join(repr(i / MAX_PIECES) for i in range(1, MAX_PIECES))
    values = [F.col(c).cast("double") for c in columns]
    typed = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(values)])
    quantiles_of = [F.expr(f"percentile_approx(v{i}, array({levels}), {4 * MAX_PIECES})").alias(f"q{i}") for i in range(len(values))]
    row = typed.agg(F.count(F.lit(1)).alias("n"), *quantiles_of).first()
    wanted = pieces or min(limit, max(MIN_PIECES, row["n"] // ROWS_PER_PIECE))
    out = {}
    for i, c in enumerate(columns):
        quantiles = row[f"q{i}"] or []
        picked = [quantiles[max(0, round(k * MAX_PIECES / wanted) - 1)] for k in range(1, wanted)] if quantiles else []
        picked = [v for v in picked if abs(v) != float("inf")]
        heavy = {v for v in picked if picked.count(v) > 1} if isolate else set()
        cuts = sorted({*picked, *(math.nextafter(v, math.inf) for v in heavy)})
        out[c] = Cuts(cuts, frozenset(cuts.index(v) + 1 for v in heavy), row["n"])
    return out


def with_piece(df: DataFrame, column: str, cuts: Sequence[float], name: str = PIECE) -> DataFrame:
    """Number the piece of each row; a piece is the half-open range between two cut points."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    inf = float("inf")
    bucketizer = Bucketizer(
        splits=[-inf, *cuts, inf], inputCol="_cut_by", outputCol=name, handleInvalid="keep"
    )
    out = bucketizer.transform(df.withColumn("_cut_by", F.col(column).cast("double"))).drop("_cut_by")
    return out.withColumn(name, F.col(name).cast("int"))


def hex_piece(digest: Column, digits: int = 3) -> Column:
    """Piece of a row ordered by a hex digest: its leading digits, which are evenly spread by construction."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def ordered_columns(
    df: DataFrame,
    order: Sequence[str],
    keys: Iterable[str] = (),
    *,
    sums: Mapping[str, str] | None = None,
    mins: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    lows: Mapping[str, str] | None = None,
    index: str | None = None,
    size: str | None = None,
    following: Mapping[str, str] | None = None,
    descending: bool = False,
    piece: str = PIECE,
) -> DataFrame:
    """Add ordered columns to rows that already carry a piece number.

    ``sums`` and ``mins`` are running values up to and including the row, ``totals`` and ``lows`` sums and
    minima over the whole key, ``index`` the 0-based position, ``size`` the row count of the key, ``following`` the next row's value.
    """
    keys = list(keys)
    sums, mins, totals, following = dict(sums or {}), dict(mins or {}), dict(totals or {}), dict(following or {})
    lows = dict(lows or {})
    flip = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    row_order = [flip(c) for c in order]

    aggs = [F.count(F.lit(1)).alias("_c")]
    aggs += [F.sum(c).alias(f"_s_{o}") for o, c in sums.items()]
    aggs += [F.min(c).alias(f"_m_{o}") for o, c in mins.items()]
    aggs += [F.sum(c).alias(f"_t_{o}") for o, c in totals.items()]
    aggs += [F.min(c).alias(f"_l_{o}") for o, c in lows.items()]
    first = F.max if descending else F.min
    aggs += [first(F.struct(*order, F.col(c).alias("_v"))).getField("_v").alias(f"_f_{o}") for o, c in following.items()]
    summary = df.groupBy(*keys, piece).agg(*aggs)

    # One row per piece: at most MAX_PIECES rows for each key.
    whole = Window.partitionBy(*keys)
    by_piece = whole.orderBy(flip(piece))
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    extra = []
    if index:
        extra.append(F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"))
    if size:
        extra.append(F.sum("_c").over(whole).alias(size))
    extra += [F.sum(f"_s_{o}").over(earlier).alias(f"_s0_{o}") for o in sums]
    extra += [F.min(f"_m_{o}").over(earlier).alias(f"_m0_{o}") for o in mins]
    extra += [F.sum(f"_t_{o}").over(whole).alias(o) for o in totals]
    extra += [F.min(f"_l_{o}").over(whole).alias(o) for o in lows]
    extra += [F.lead(f"_f_{o}").over(by_piece).alias(f"_f0_{o}") for o in following]
    offsets = summary.select(*keys, piece, *extra)

    local = Window.partitionBy(*keys, piece).orderBy(*row_order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    joined = join_on(df, offsets, [*keys, piece])
    out = [F.col(c) for c in df.columns if c != piece]
    if index:
        out.append((F.row_number().over(local) - 1 + F.col("_c0")).alias(index))
    if size:
        out.append(F.col(size))
    out += [(F.sum(c).over(running) + F.coalesce(F.col(f"_s0_{o}"), F.lit(0))).alias(o) for o, c in sums.items()]
    out += [F.least(F.min(c).over(running), F.col(f"_m0_{o}")).alias(o) for o, c in mins.items()]
    out += [F.col(o) for o in [*totals, *lows]]
    out += [
        F.when(F.lead(F.lit(1)).over(local).isNotNull(), F.lead(c).over(local)).otherwise(F.col(f"_f0_{o}")).alias(o)
        for o, c in following.items()
    ]
    return joined.select(*out)


def value_counts(df: DataFrame, value: str, keys: Iterable[str] = (), count: str = "n") -> DataFrame:
    """Rows per (keys, value), missing values left out. Map-side combining takes the weight out of hot values."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))


def order_statistics(
    df: DataFrame,
    value: str,
    positions: Mapping[str, Column],
    keys: Iterable[str] = (),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact values at fractional 0-based positions of the sorted values of each key, linear between neighbours.

    A position is an expression over ``_size``, the number of values of the key; a NULL position gives NULL. One row
    per key, with the columns of ``positions`` and ``_size``.
    """
    keys = list(keys)
    cuts = cut_points(df, value) if cuts is None else cuts
    counts = value_counts(df, value, keys, "_n")
    ranked = ordered_columns(
        with_piece(counts, value, cuts), [value], keys, sums={"_upto": "_n"}, totals={"_size": "_n"}
    )
    start = F.col("_upto") - F.col("_n")
    aggs = [F.max("_size").alias("_size")]
    for name, position in positions.items():
        for tag, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (start <= at) & (at < F.col("_upto"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{tag}"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name, position in positions.items():
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *out, "_size")


def exact_quantiles(
    df: DataFrame,
    value: str,
    levels: Mapping[str, float],
    keys: Iterable[str] = (),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key."""
    positions = {name: (F.col("_size") - 1) * F.lit(float(level)) for name, level in levels.items()}
    return order_statistics(df, value, positions, keys, cuts).drop("_size")


def exact_medians(df: DataFrame, columns: Sequence[str], keys: Iterable[str] = ()) -> DataFrame:
    """Medians of several columns in long form: (keys, feature, median), computed together."""
    return exact_quantiles(unpivot_numbers(df, columns, keys), "value", {"median": 0.5}, [*keys, "feature"])


def leave_out_medians(df: DataFrame, columns: Sequence[str], group: str, groups: Sequence[int], cuts: Sequence[float] | None = None) -> DataFrame:
    """Exact medians of several columns over "all rows but those of group g", for every g of ``groups`` at once: g, feature,
    median (NULL without a value).

    Rows are counted once by (column, value) and group. What a training set holds of a value is all of its rows less those
    of the group left out, so the running sums of these differences place the medians of all sets in one ordering, and no
    row is copied for the sets that it belongs to.
    """
    values = unpivot_numbers(df, columns, [group]).where(F.col("value").isNotNull())
    cuts = cut_points(values, "value") if cuts is None else cuts
    counts = values.groupBy("feature", "value").agg(*[F.count_if(F.col(group) != g).alias(f"n{i}") for i, g in enumerate(groups)])
    ranked = ordered_columns(
        with_piece(counts, "value", cuts), ["value"], ["feature"],
        sums={f"upto{i}": f"n{i}" for i in range(len(groups))}, totals={f"size{i}": f"n{i}" for i in range(len(groups))},
    )
    sets = []
    for i, g in enumerate(groups):
        start, middle = F.col(f"upto{i}") - F.col(f"n{i}"), (F.col(f"size{i}") - 1) / F.lit(2.0)

        def value_at(position: Column) -> Column:
            return F.max(F.when((start <= position) & (position < F.col(f"upto{i}")), F.col("value")))

        low, high = value_at(F.floor(middle)), value_at(F.ceil(middle))
        sets.append(F.struct(F.lit(g).alias("g"), (low + (high - low) * F.lit(0.5)).alias("median")))
    picked = ranked.groupBy("feature").agg(F.array(*sets).alias("sets"))
    return picked.select("feature", F.explode("sets").alias("s")).select("s.g", "feature", "s.median")


def unpivot_numbers(df: DataFrame, columns: Sequence[str], ids: Iterable[str] = ()) -> DataFrame:
    """Wide numeric columns to (ids, feature, value)."""
    ids = list(ids)
    values = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*ids, F.explode(F.array(*values)).alias("_f")).select(*ids, "_f.feature", "_f.value")


def average_ranks(
    df: DataFrame, value: str, keys: Iterable[str] = (), rank: str = "rank", cuts: Sequence[float] | None = None
) -> DataFrame:
    """Average rank of each distinct value in its key (ties share the mean rank): keys, value, n, size, rank."""
    keys = list(keys)
    cuts = cut_points(df, value) if cuts is None else cuts
    counts = with_piece(value_counts(df, value, keys, "n"), value, cuts)
    ranked = ordered_columns(counts, [value], keys, sums={"_upto": "n"}, totals={"size": "n"})
    return ranked.select(
        *keys, value, "n", "size", (F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).alias(rank)
    )
