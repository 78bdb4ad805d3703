"""Dimension lookups, star summaries, validity joins and statistics joined back to rows.

Dimension sides carry no broadcast hint: Spark broadcasts a side whose size statistics fall under
``spark.sql.autoBroadcastJoinThreshold`` and sort-merge joins the rest, where adaptive execution
splits skewed keys. Only frames whose size is fixed by the code (rule tables) are hinted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import davg, dsum, grand_total, pct, ratio
from tillroll.operators.ordering import quantiles


def current(dim: DataFrame) -> DataFrame:
    """Rows of a versioned dimension that are current."""
    return dim.where("is_current") if "is_current" in dim.columns else dim


def lookup_keys(facts: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]], how: str = "left",
                default: int | None = None, drop_natural: bool = True) -> DataFrame:
    """J-01, J-02, J-03: natural key -> surrogate key for each dimension.

    ``dims`` maps the natural key column to (dimension, surrogate column, output column). ``how="inner"``
    drops unmatched facts; ``default=-1`` fills them.
    """
    out = facts
    for natural, (dim, surrogate, name) in dims.items():
        out = out.join(current(dim).select(natural, F.col(surrogate).alias(name)), natural, how)
        if default is not None:
            out = out.withColumn(name, F.coalesce(name, F.lit(default).cast("bigint")))
    return out.drop(*dims) if drop_natural else out


def surrogate(*parts: Column | str) -> Column:
    """Deterministic surrogate key: a 64-bit hash of the natural key (and version)."""
    return F.xxhash64(*parts)


def wide_orders(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """J-04: orders with customers, items and products by left joins; clashing names get a suffix."""
    out = orders
    for side, on, tag in ((customers, "customer_id", "_cust"), (items, "order_id", "_item"),
                          (products, "product_id", "_prod")):
        clash = [c for c in side.columns if c in out.columns and c != on]
        out = out.join(side.withColumnsRenamed({c: c + tag for c in clash}), on, "left")
    return out


def growth_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """J-04: row counts before and after a widening join."""
    a = after.agg(F.count("*").alias("n")).scalar()
    return before.agg(F.count("*").alias("rows_before")).withColumn("rows_after", a).withColumn(
        "growth", ratio(F.col("rows_after"), F.col("rows_before")))


def star_summary(items: DataFrame, orders: DataFrame, customers: DataFrame, place: str = "region",
                 how: str = "inner", finished: str = "F") -> DataFrame:
    """J-05, J-06, A-08, W-10: orders, quantity, revenue, finished share and share of the month by place.

    Lines are folded to one row per order before the dimension join, so the wide join moves orders.
    """
    net = F.col("item_total") * (1 - F.col("discount"))
    per_order = items.groupBy("order_id").agg(F.sum("quantity").alias("q"), F.sum(net).alias("v"))
    rows = per_order.join(orders, "order_id").join(customers.select("customer_id", place), "customer_id", how)
    g = rows.groupBy(place, F.trunc("order_date", "month").alias("month")).agg(
        F.count("*").alias("orders"), dsum("q").alias("quantity"), F.sum("v").alias("_v"),
        pct(F.count_if(F.col("order_status") == finished), F.count("*")).alias("finished_pct"))
    total = g.groupBy("month").agg(F.sum("_v").alias("_m"))
    return g.join(total, "month").select(
        place, "month", "orders", "quantity", F.col("_v").cast("double").alias("net_revenue"),
        ratio(F.col("_v"), F.col("orders")).alias("avg_order_value"), "finished_pct",
        pct(F.col("_v"), F.col("_m")).alias("share_of_month_pct"))


def previous_day(daily: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str],
                 prefix: str = "prev_") -> DataFrame:
    """J-07: the same keys one day earlier, as an equi-join on the shifted date."""
    before = daily.select(*keys, F.date_add(day, 1).alias(day), *[F.col(c).alias(prefix + c) for c in columns])
    return daily.join(before, [*keys, day], "left")


def share_of_total(df: DataFrame, by: str, value: str) -> DataFrame:
    """J-08, J-14: sum per group and its share of the grand total (scalar subquery over the groups)."""
    g = df.groupBy(by).agg(F.sum(value).alias("_v"))
    return g.withColumn("_t", grand_total(g, "_v")).select(by, F.col("_v").cast("double").alias("value"), pct(F.col("_v"), F.col("_t._v")).alias("share_pct"))


def with_partner(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """J-09: rows that have a partner."""
    return df.join(other.select(on).distinct(), on, "left_semi")


def without_partner(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """J-10: rows that have no partner."""
    return df.join(other.select(on), on, "left_anti")


def orphan_counts(checks: Mapping[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """J-10, Q-15: references without a parent, one row per rule."""
    out = None
    for name, (child, parent, on) in checks.items():
        part = without_partner(child.where(F.col(on).isNotNull()), parent, on).agg(
            F.count("*").alias("orphans"), F.countDistinct(on).alias("orphan_keys")).withColumn("rule", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _edges_below(value: Column, edges: Sequence[int], or_equal: bool) -> Column:
    """How many of the sorted ``edges`` lie below ``value`` (or equal it): a balanced tree of conditions."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = F.lit(edges[mid])
        return F.when(value < edge if or_equal else value <= edge, tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(edges))


def validity_join(left: DataFrame, ts: str, right: DataFrame, start: str, end: str, how: str = "inner", slices: int = 64) -> DataFrame:
    """J-11: pairs with ``start <= ts <= end``, by slices of time; a null start or end is open.

    The bounds of the slices are quantiles of the left side's times, so slices hold about equally many rows. An interval is carried into every slice that it touches, and rows meet intervals
    of their slice only: nearly all that meet are pairs of the result, whatever the lengths of the intervals. A time that is several bounds at once (a hot day) has several slices,
    among which its rows are dealt by their content and into all of which its intervals go. The quantiles decide on balance only, never on the result.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    edges = left.agg(F.percentile_approx(micros(ts), [i / slices for i in range(1, slices)], 2000)).first()[0] or []
    first, last = (_edges_below(F.col("_at"), edges, e) for e in (False, True))
    dealt = first if len(set(edges)) == len(edges) else first + F.pmod(F.xxhash64(*left.columns), last - first + 1)
    rows = left.withColumn("_at", micros(ts)).withColumn("_slice", dealt.cast("int")).drop("_at")
    ends = right.withColumns({"_since": micros(start), "_until": micros(end)})
    since = F.when(F.col("_since").isNull(), 0).otherwise(_edges_below(F.col("_since"), edges, False))
    until = F.when(F.col("_until").isNull(), len(edges)).otherwise(_edges_below(F.col("_until"), edges, True))
    spans = ends.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) <= F.col(end)))
    spans = spans.withColumn("_slice", F.explode(F.sequence(since, until))).drop("_since", "_until")
    cond = (rows["_slice"] == spans["_slice"]) & (spans[start].isNull() | (rows[ts] >= spans[start])) & (spans[end].isNull() | (rows[ts] <= spans[end]))
    if how == "inner":
        rows = rows.where(F.col(ts).isNotNull())
    return rows.join(spans, cond, how).drop(rows["_slice"]).drop(spans["_slice"])


def as_of_version(facts: DataFrame, dim: DataFrame, key: str, ts: str) -> DataFrame:
    """J-13: the dimension version valid at the fact's day."""
    d = dim.withColumnRenamed(key, "_k")
    day = F.to_date(facts[ts])
    cond = (facts[key] == d["_k"]) & (d["effective_date"] <= day) & (
        d["expiry_date"].isNull() | (day <= d["expiry_date"]))
    return facts.join(d, cond, "left").drop("_k")


def decorrelated_count(df: DataFrame, detail: DataFrame, key: str, name: str = "uses") -> DataFrame:
    """J-15: correlated COUNT(*) as pre-aggregate and left join."""
    n = detail.groupBy(key).agg(F.count("*").alias(name))
    return df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def enrich_stream(stream: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """J-17: stream-static left joins; each side is read again for every micro-batch."""
    out = stream
    for key, dim in dims.items():
        out = out.join(current(dim), key, "left")
    return out


def group_stats_back(df: DataFrame, by: str, value: str, how: str = "left", extra: Mapping[str, float] | None = None,
                     source: DataFrame | None = None) -> DataFrame:
    """J-18, W-08: group mean, median, std and count on every row, and the row's ratio to them.

    Statistics are computed per group and joined back, not by a window, so a hot group is never sorted
    in one task. ``extra`` names further quantiles; ``source`` holds the same
    values in a frame that is cheaper to read. ``how="inner"`` drops rows with a null group as a pandas merge would.
    """
    rows = (df if source is None else source).where(F.col(by).isNotNull())
    g = rows.groupBy(by).agg(davg(value).alias(f"{value}_mean"), F.count(value).alias(f"{value}_count"),
                             F.round(F.stddev_samp(F.col(value).cast("double")), 4).alias(f"{value}_std"))
    extra = extra or {}
    q = quantiles(rows, [value], [0.5, *extra.values()], [by]).select(
        by, F.col("q0").alias(f"{value}_median"), *[F.col(f"q{i + 1}").alias(n) for i, n in enumerate(extra)])
    out = df.join(g.join(q, by, "left"), by, how)
    return out.withColumn(f"{value}_vs_mean", ratio(F.col(value), F.col(f"{value}_mean"))).withColumn(
        f"{value}_vs_median", ratio(F.col(value), F.col(f"{value}_median"))).withColumn(
        f"{value}_minus_mean", F.col(value).cast("double") - F.col(f"{value}_mean"))


