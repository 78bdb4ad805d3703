"""Aggregates and ratios that give the same double on every run.

Money is summed as decimal and only the final sum becomes a double, so the result does not depend on
the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dsum(c: Column | str) -> Column:
    return F.sum(col(c)).cast("double")


def davg(c: Column | str) -> Column:
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)))


def money_avg(c: Column | str) -> Column:
    """Mean of a decimal column rounded half-up to cents; divided as decimal, so ties round exactly."""
    return F.round(F.try_divide(F.sum(col(c)), F.count(col(c)).cast("decimal(20,0)")), 2).cast("double")


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """``top / bottom`` as double; null or ``default`` when the divisor is zero or null."""
    out = F.try_divide(top.cast("double"), bottom.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def pct(top: Column, bottom: Column, default: float | None = None) -> Column:
    return ratio(top.cast("double") * 100, bottom, default)


def pct2(top: Column, bottom: Column) -> Column:
    """Percentage of two counts rounded half-up to two decimals on the exact quotient; 0 without rows."""
    exact = F.try_divide(top.cast("decimal(20,0)") * 100, bottom.cast("decimal(20,0)"))
    return F.coalesce(F.round(exact, 2).cast("double"), F.lit(0.0))



def ladder(value: Column, steps: list[tuple[object, str]], default: str | None) -> Column:
    """First label whose condition holds; a plain number means ``value > number``."""
    out = None
    for test, label in steps:
        cond = test if isinstance(test, Column) else value > F.lit(test)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(default))


def grand_total(grouped: DataFrame, *columns: str) -> Column:
    """Sums of ``columns`` over all rows of a grouped frame, as a struct.

    Ask for all its aggregates: then both uses of ``grouped`` have the same plan and Spark runs its shuffle once, so the rows below are read once.
    """
    return grouped.agg(F.struct(*[F.sum(c).alias(c) for c in columns]).alias("t")).scalar()
