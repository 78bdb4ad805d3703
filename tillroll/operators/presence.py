"""Distinct counts that add up: one bitmap of members per finest bucket, coarser buckets by OR, retention by AND, without another look at the rows.

A member is a whole number; bitmaps of 32,768 numbers each, so one row per (keys, range of numbers). Dense numbers (``ml.recommend.dense_ids``) make small tables, but any will do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(rows: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """keys, part, bitmap: who occurs in each finest bucket; null members are left out. This is what is stored."""
    number = F.col(member).cast("bigint")
    return rows.where(number.isNotNull()).groupBy(*keys, F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))


def merged(*stored: DataFrame) -> DataFrame:
    """Bitmaps of the same keys from several tables (a new day next to the old ones) as one table."""
    rows = reduce(DataFrame.unionByName, stored)
    return rows.groupBy(*[c for c in rows.columns if c != "bitmap"]).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def coarser(stored: DataFrame, **keys: Column) -> DataFrame:
    """Bitmaps by expressions of the finer keys (``month=F.trunc("day", "month")``); no keys: one bucket."""
    return stored.select(*[c.alias(n) for n, c in keys.items()], "part", "bitmap").groupBy(*keys, "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members that are in the bitmaps of both sides for the same keys."""
    names = [c for c in left.columns if c != "bitmap"]
    return left.unionByName(right).groupBy(*names).agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("_sides")).where("_sides = 2").drop("_sides")


def members(stored: DataFrame, keys: Sequence[str] = (), name: str = "members") -> DataFrame:
    """How many different members each bucket holds: bits of different parts never meet, so their numbers add up."""
    return stored.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("bigint").alias(name))


def cube(stored: DataFrame, day: str, name: str = "members") -> DataFrame:
    """A-30: grain (day, month, year, all), bucket and distinct members, all from one table of day bitmaps."""
    out = None
    for grain, start in (("day", F.col(day)), ("month", F.trunc(day, "month")), ("year", F.trunc(day, "year")), ("all", F.lit(None).cast("date"))):
        part = members(coarser(stored, bucket=start), ["bucket"], name).select(F.lit(grain).alias("grain"), "bucket", name)
        out = part if out is None else out.unionByName(part)
    return out


def retention(stored: DataFrame, day: str) -> DataFrame:
    """A-34: month, active members, those of them active in the month before, and the share kept of that month's members."""
    months = coarser(stored, month=F.trunc(day, "month"))
    after = months.withColumn("month", F.add_months("month", 1))
    active = members(months, ["month"], "active")
    kept = members(common(months, after), ["month"], "retained")
    before = members(after, ["month"], "_before")
    out = active.join(kept, "month", "left").join(before, "month", "left")
    return out.select("month", "active", F.coalesce("retained", F.lit(0)).alias("retained"), F.round(F.try_divide(F.coalesce("retained", F.lit(0)).cast("double"), F.col("_before")), 6).alias("retention_rate"))
