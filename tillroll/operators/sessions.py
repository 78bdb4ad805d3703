"""Sessions in batch: gap-based session numbers and the session fact.

``session_window`` sorts all rows of a user in one task. Here rows are range-sliced by (user, time), so a
user with a third of all events is spread over many slices; per (slice, user) one row carries the last
timestamp and the number of session starts to the next slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numbers import dsum, ratio
from tillroll.operators.ordering import _SEQ, _SLICE, _slices, join_null_safe


def sessionize(df: DataFrame, key: str, ts: str, tie: str, gap_minutes: int = 30) -> DataFrame:
    """Adds ``session_no`` (1-based per user): a new session starts after a gap of ``gap_minutes`` or more."""
    rows = _slices(df, [key], [F.col(ts), F.col(tie)])
    here = Window.partitionBy(_SLICE, key).orderBy(_SEQ)
    rows = rows.withColumn("_prev", F.lag(ts).over(here))
    ends = rows.groupBy(_SLICE, key).agg(F.max(ts).alias("_last"))
    ends = ends.select(_SLICE, key, F.lag("_last").over(Window.partitionBy(key).orderBy(_SLICE)).alias("_carried"))
    rows = join_null_safe(rows, ends, [_SLICE, key])
    before = F.coalesce("_prev", "_carried")
    starts = before.isNull() | (F.col(ts) >= before + F.expr(f"INTERVAL {gap_minutes} MINUTE"))
    rows = rows.withColumn("_new", F.when(starts, 1).otherwise(0))
    rows = rows.withColumn("_local", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy(_SLICE, key).agg(F.sum("_new").alias("_c"))
    earlier = Window.partitionBy(key).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(_SLICE, key, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_offset"))
    out = join_null_safe(rows, counts, [_SLICE, key])
    return out.withColumn("session_no", F.col("_offset") + F.col("_local")).drop(
        _SLICE, _SEQ, "_prev", "_carried", "_new", "_local", "_offset")


def session_fact(events: DataFrame, key: str = "customer_id", ts: str = "ts", view: str = "view", cart: str = "click", buy: str = "purchase") -> DataFrame:
    """A-36: duration, views, cart, purchases, bounce, conversion and abandonment per session."""
    kind = F.col("activity_type")
    g = events.groupBy(key, "session_no").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"), F.count_if(kind == view).alias("page_views"),
        F.count_if(kind == cart).alias("added_to_cart"), F.count_if(kind == buy).alias("purchases"), dsum("value").alias("value"))
    seconds = F.unix_timestamp(F.col("session_end").cast("timestamp")) - F.unix_timestamp(F.col("session_start").cast("timestamp"))
    return g.select("*", seconds.alias("duration_seconds"), (F.col("events") == 1).alias("is_bounce"), (F.col("purchases") > 0).alias("is_conversion"),
                    ((F.col("added_to_cart") > 0) & (F.col("purchases") == 0)).alias("is_cart_abandoned"))


def session_rates(fact: DataFrame) -> DataFrame:
    """A-36: bounce, conversion and abandonment rates over all sessions."""
    return fact.agg(F.count("*").alias("sessions"), ratio(F.count_if("is_bounce"), F.count("*")).alias("bounce_rate"), ratio(F.count_if("is_conversion"), F.count("*")).alias("conversion_rate"),
                    ratio(F.count_if("is_cart_abandoned"), F.count_if(F.col("added_to_cart") > 0)).alias("abandonment_rate"))
