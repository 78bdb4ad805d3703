"""Exact ranks, quantiles, shifts and running sums without a single-task window.

A window without PARTITION BY, or one partitioned by a key that holds a third of all rows, runs in
one task. Here the rows are range-partitioned by (keys, order) and pinned; every slice is numbered
on its own, and a table with one row per (slice, key) supplies the offsets. No task ever holds more
than one slice, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import pin

_SLICE, _SEQ = "_slice", "_seq"


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Join condition that also matches null with null."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``names`` with null = null, keeping the left copy of the keys."""
    renamed = right.select(
        *[F.col(n).alias(f"_r_{n}") for n in names],
        *[F.col(c) for c in right.columns if c not in names],
    )
    cond = reduce(lambda a, b: a & b, [left[n].eqNullSafe(renamed[f"_r_{n}"]) for n in names])
    return left.join(renamed, cond, how).drop(*[f"_r_{n}" for n in names])


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    by = [F.col(k) for k in keys] + list(order)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = placed.withColumn(_SEQ, F.monotonically_increasing_id())
    return pin(numbered).withColumn(_SLICE, F.shiftright(F.col(_SEQ), 33))


def number_rows(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (),
                number: str = "rn", total: str = "n_rows") -> DataFrame:
    """Row number (1-based) and row count within ``keys``; ``order`` must end in a unique column."""
    rows = _slices(df, keys, order)
    spans = rows.groupBy(_SLICE, *keys).agg(F.min(_SEQ).alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        _SLICE, *keys, "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(total),
    )
    joined = join_null_safe(rows, spans, [_SLICE, *keys])
    return joined.withColumn(number, F.col("_offset") + F.col(_SEQ) - F.col("_first") + 1).drop(
        _SLICE, _SEQ, "_first", "_offset")


def running_sum(df: DataFrame, value: str, order: Sequence[Column], keys: Sequence[str] = (),
                name: str = "running", total: str | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys``."""
    rows = _slices(df, keys, order)
    spans = rows.groupBy(_SLICE, *keys).agg(F.sum(value).alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        _SLICE, *keys,
        F.sum("_w").over(earlier).alias("_offset"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias("_all"),
    )
    here = Window.partitionBy(_SLICE, *keys).orderBy(_SEQ).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_here", F.sum(value).over(here))
    joined = join_null_safe(local, spans, [_SLICE, *keys])
    out = joined.withColumn(name, F.col("_here") + F.coalesce(F.col("_offset"), F.lit(0)))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop(_SLICE, _SEQ, "_here", "_offset", "_all")


def shift(df: DataFrame, columns: Sequence[str], order: Sequence[Column], keys: Sequence[str] = (),
          by: int = 1, prefix: str = "next_") -> DataFrame:
    """LEAD (``by`` > 0) or LAG (``by`` < 0) as an equi-join on the row number, so no hot group."""
    rows = number_rows(df, order, keys, "_rn", "_n")
    other = rows.select(*keys, (F.col("_rn") - by).alias("_rn"),
                        *[F.col(c).alias(prefix + c) for c in columns])
    return join_null_safe(rows, other, [*keys, "_rn"], "left").drop("_rn", "_n")


def ntile(rn: Column, n_rows: Column, tiles: int) -> Column:
    """SQL NTILE from a row number and a row count."""
    size, extra = F.floor(n_rows / F.lit(tiles)), n_rows % F.lit(tiles)
    big = extra * (size + 1)
    return F.when(rn <= big, F.ceil(rn / (size + 1))).otherwise(
        extra + F.ceil(F.try_divide(rn - big, size))).cast("int")


def rank_quantile_bin(rn: Column, n_rows: Column, bins: int) -> Column:
    """Bin of a first-come rank under linear-interpolated edges (differs from NTILE)."""
    return F.greatest(F.lit(1), F.ceil(F.try_divide((rn - 1) * F.lit(bins), n_rows - 1))).cast("int")


def value_positions(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct (keys, value): ``cnt``, rows ``before`` it and ``total`` rows.

    Counting first folds ties on the map side, so a value held by a third of the rows is one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    out = running_sum(counts, "cnt", [F.col(value)], keys, "_upto", "total")
    return out.withColumn("before", F.col("_upto") - F.col("cnt")).drop("_upto")


def rank_by_value(df: DataFrame, value: str, keys: Sequence[str] = (), descending: bool = False,
                  source: DataFrame | None = None) -> DataFrame:
    """Adds ``rank`` (ties share the lowest), ``percent_rank_avg`` (average ties, 0..1]) per ``keys``.

    ``source`` holds the same values in a frame that is cheaper to read again than ``df``.
    """
    places = value_positions(df if source is None else source, value, keys)
    first = (F.col("total") - F.col("before") - F.col("cnt")) if descending else F.col("before")
    places = places.select(
        *keys, value, (first + 1).alias("rank"),
        ((first + 1 + (F.col("cnt") - 1) / F.lit(2.0)) / F.col("total")).alias("percent_rank_avg"),
    )
    return join_null_safe(df, places, [*keys, value], "left")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per (keys, column_name), columns q0..qk.

    All columns go through one sort; nothing is collected, unlike ``percentile``, whose buffer
    keeps every distinct value of a group in one task.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(*keys, pairs.alias("_p")).select(*keys, "_p.column_name", "_p.value")
    places = value_positions(long.where(~F.isnan("value")), "value", [*keys, "column_name"])
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, edge in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("before") <= edge) & (edge < F.col("before") + F.col("cnt"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"_{side}{i}"))
    found = places.groupBy(*keys, "column_name").agg(F.max("total").alias("n_values"), *picks)
    out = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n_values") - 1)
        frac = at - F.floor(at)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(f"q{i}"))
    return found.select(*keys, "column_name", "n_values", *out)


def group_quantiles(df: DataFrame, column: str, named: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of one column per group as named columns (``{"median_price": 0.5}``)."""
    probs = list(named.values())
    q = quantiles(df, [column], probs, keys)
    return q.select(*keys, *[F.col(f"q{i}").alias(n) for i, n in enumerate(named)])


def mode_value(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent value per group, the lowest on ties; counts first, so no group is collected."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_c"))
    best = F.min_by(F.col(column), F.struct(-F.col("_c"), F.col(column)))
    return counts.groupBy(*keys).agg(best.alias(name))
