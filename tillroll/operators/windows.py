"""Ranking, binning, lags and rolling means, and the top-k family.

Ranks over raw rows use ``tillroll.operators.ordering``. A plain window appears only where the rows per
partition are bounded: one row per day or month of a series, or row_number with ``<= k``, which Spark
limits to k rows per group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numbers import dsum, grand_total, pct, ratio
from tillroll.operators.ordering import (
    join_null_safe, mode_value, ntile, number_rows, quantiles, rank_by_value, rank_quantile_bin, shift,
)
from tillroll.session import pin

QUINTILE_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]


def ntile_score(df: DataFrame, value: str, key: str, name: str, tiles: int = 5, descending: bool = False) -> DataFrame:
    """W-01: NTILE with the key as tie-break."""
    order = [F.desc(value) if descending else F.asc(value), F.col(key)]
    rows = number_rows(df, order, (), "_rn", "_n")
    return rows.withColumn(name, ntile(F.col("_rn"), F.col("_n"), tiles)).drop("_rn", "_n")


def rank_quintile(df: DataFrame, value: str, key: str, name: str, bins: int = 5, reverse: bool = False) -> DataFrame:
    """W-02: quantile bin of the first-come rank (G-02)."""
    rows = number_rows(df, [F.asc(value), F.col(key)], (), "_rn", "_n")
    bin_no = rank_quantile_bin(F.col("_rn"), F.col("_n"), bins)
    return rows.withColumn(name, (F.lit(bins + 1) - bin_no) if reverse else bin_no).drop("_rn", "_n")


def value_bins(df: DataFrame, value: str, name: str, labels: Sequence[object], source: DataFrame | None = None) -> DataFrame:
    """W-16: equal-count bins of the value: exact interpolated edges, right-closed, equal edges merged.

    The edges come from ``source`` if given: the same values in a frame that is cheaper to read.
    """
    probs = [i / len(labels) for i in range(len(labels))]
    edges = quantiles(df if source is None else source, [value], probs).select(
        F.array(*[F.col(f"q{i}") for i in range(len(probs))])).scalar()
    # Counting distinct edges between the minimum and the value merges equal edges.
    lowest = F.col("_edges")[0]
    below = F.size(F.array_distinct(F.filter(F.col("_edges"), lambda e: (F.col(value).cast("double") > e) & (e > lowest))))
    out = df.withColumn("_edges", edges)
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), below + 1)
    return out.withColumn(name, F.when(F.col(value).isNotNull(), label)).drop("_edges")


def width_bins(df: DataFrame, value: str, name: str, bins: int = 5) -> DataFrame:
    """W-17: equal-width bins, right-closed, the lowest edge included."""
    edges = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("e")).scalar()
    step = (F.col("_e.hi") - F.col("_e.lo")) / bins
    at = F.ceil(F.try_divide(F.col(value).cast("double") - F.col("_e.lo"), step)).cast("int")
    return df.withColumn("_e", edges).withColumn(name, F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(at, F.lit(1))))).drop("_e")


def fixed_bins(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """W-18, P-15: right-closed bins; at or below the lowest edge and above the highest give null (G-04)."""
    out = F.when(value <= F.lit(edges[0]), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(value <= F.lit(edge), label)
    return out.otherwise(F.lit(None).cast("string"))


def sales_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """W-03: position by value, the key breaks ties."""
    g = df.groupBy(by).agg(F.sum(value).alias("_v"))
    return number_rows(g, [F.desc("_v"), F.col(by)], (), "rank_position", "_n").select(
        by, F.col("_v").cast("double").alias(value), "rank_position")


def rank_measures(df: DataFrame, key: str, measures: Sequence[str]) -> DataFrame:
    """W-04: RANK, highest first, for several measures."""
    out = df
    for m in measures:
        out = rank_by_value(out, m, descending=True).withColumnRenamed("rank", f"{m}_rank").drop("percent_rank_avg")
    return out


def mean_gap(orders: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """W-06: mean whole days to the next order, slice by slice (``next_in_slices``): no task holds more than one slice of a customer's orders."""
    rows = next_in_slices(orders.select(key, ts, tie), [key], [ts, tie], [ts])
    gap = F.floor((F.unix_timestamp(F.col(f"next_{ts}").cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))) / 86400)
    return rows.withColumn("_gap", gap).groupBy(key).agg(
        F.count("*").alias("orders"), ratio(F.sum("_gap"), F.count("_gap")).alias("avg_days_to_next"))


def next_in_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], rows: int = 1, prefix: str = "next_") -> DataFrame:
    """LEAD by ``rows`` within ``keys``, in the order of ``order`` (unique within the keys), by halo rows.

    The table is range-partitioned by keys and order; the first ``rows`` rows of every slice are copied to the slice before, where a window over (slice, key) runs, and the copies leave again.
    Where slices hold fewer rows of a key than that, those of up to ``rows`` later slices are looked at, so each slice receives the next ``rows`` rows of its last key wherever they are.
    """
    by = [F.col(c) for c in (*keys, *order)]
    placed = pin(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_slice", F.spark_partition_id()))
    in_slice = Window.partitionBy("_slice", *keys).orderBy(*order)
    heads = placed.select(*keys, *order, *[c for c in columns if c not in order], "_slice").withColumn("_r", F.row_number().over(in_slice)).where(F.col("_r") <= rows).drop("_r")
    # At most ``rows`` rows per slice and key are left; a key of one slice needs none.
    spread = heads.groupBy(*keys).agg(F.sort_array(F.collect_set("_slice")).alias("_slices")).where(F.size("_slices") > 1)
    # Every one of the ``rows`` slices before may need them, none further away does.
    before = F.slice(F.reverse(F.filter("_slices", lambda s: s < F.col("_slice"))), 1, rows)
    halo = join_null_safe(heads, spread, keys).withColumn("_to", F.explode(before)).drop("_slices")
    near = Window.partitionBy("_to", *keys).orderBy(*order)
    halo = halo.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= rows).drop("_r", "_slice").withColumnRenamed("_to", "_slice").withColumn("_halo", F.lit(True))
    both = placed.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    out = both.withColumns({prefix + c: F.lead(c, rows).over(in_slice) for c in columns})
    return out.where(~F.col("_halo")).drop("_halo", "_slice")


def percent_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "pct_rank", source: DataFrame | None = None) -> DataFrame:
    """W-07: rank as a share of the rows, ties averaged."""
    return rank_by_value(df, value, by, source=source).withColumnRenamed("percent_rank_avg", name).drop("rank")


def above_quantile(df: DataFrame, value: str, by: str, p: float, name: str) -> DataFrame:
    """W-09: 1 where the value exceeds its group's quantile."""
    q = quantiles(df, [value], [p], [by]).select(by, F.col("q0").alias("_edge"))
    return df.join(q, by, "left").withColumn(name, (F.col(value).cast("double") > F.col("_edge")).cast("int")).drop("_edge")


def nested_shares(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """W-10: rows per (outer, inner), share of the outer group and of all rows."""
    g = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    o = g.groupBy(outer).agg(F.sum("n").alias("_o"))
    return g.join(o, outer).withColumn("_t", grand_total(g, "n")).withColumn("share_of_group_pct", pct(F.col("n"), F.col("_o"))).withColumn(
        "share_of_all_pct", pct(F.col("n"), F.col("_t.n"))).drop("_o", "_t")


def daily_series(rows: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """One row per (by, day): the bounded input of the series operators."""
    return rows.groupBy(by, F.to_date(ts).alias("day")).agg(dsum(value).alias("y"))


def lag_features(series: DataFrame, by: str, lags: Sequence[int] = (1, 7, 30), day: str = "day", y: str = "y") -> DataFrame:
    """W-11: row lags of a daily series."""
    w = Window.partitionBy(by).orderBy(day)
    return series.select("*", *[F.lag(y, n).over(w).alias(f"{y}_lag_{n}") for n in lags])


def rolling_means(series: DataFrame, by: str, spans: Sequence[int] = (7, 30), full: bool = True, day: str = "day", y: str = "y") -> DataFrame:
    """W-12: rolling mean over the last n rows; null until n rows exist when ``full`` (G-06).

    The sum runs over decimals, so the mean does not depend on how the window is evaluated.
    """
    out = []
    for n in spans:
        w = Window.partitionBy(by).orderBy(day).rowsBetween(-(n - 1), 0)
        mean = F.sum(F.col(y).cast("decimal(18,2)")).over(w).cast("double") / F.count(y).over(w)
        out.append((F.when(F.count(y).over(w) >= n, mean) if full else mean).alias(f"{y}_ma_{n}"))
    return series.select("*", *out)


def month_over_month(df: DataFrame, ts: str, value: str) -> DataFrame:
    """W-13: change against the previous month; an equi-join on the shifted month."""
    m = df.groupBy(F.trunc(ts, "month").alias("month")).agg(dsum(value).alias("value"))
    prev = m.select(F.add_months("month", 1).alias("month"), F.col("value").alias("previous"))
    return m.join(prev, "month", "left").withColumn("change", ratio(F.col("value"), F.col("previous")) - 1)


def rank_change(daily: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """W-14: rank per day, rank change and growth against the day before.

    The input has one row per product and day, so a day is at most the catalogue: a window per day, which spills if it must.
    """
    ranked = daily.withColumn("rank_position", F.row_number().over(Window.partitionBy(day).orderBy(F.desc(value), key)).cast("bigint"))
    before = ranked.select(key, F.date_add(day, 1).alias(day), F.col("rank_position").alias("previous_rank"),
                           F.col(value).alias("_pv"))
    grown = F.when(F.col("_pv") > 0, (F.col(value) - F.col("_pv")) / F.col("_pv") * 100).otherwise(100.0)
    return ranked.join(before, [key, day], "left").select(
        key, day, value, "rank_position", "previous_rank",
        F.coalesce(F.col("previous_rank") - F.col("rank_position"), F.lit(0)).alias("rank_change"),
        F.round(F.coalesce(grown, F.lit(100.0)), 6).alias("growth_pct"))


def end_trend(series: DataFrame, by: str, day: str = "day", y: str = "y", points: int = 3) -> DataFrame:
    """W-15: mean of the first and last points of a series: increasing, decreasing, stable or insufficient."""
    first, last = Window.partitionBy(by).orderBy(day), Window.partitionBy(by).orderBy(F.desc(day))
    rows = series.withColumn("_a", F.row_number().over(first)).withColumn("_b", F.row_number().over(last))
    cents = F.col(y).cast("decimal(18,2)")
    head, tail = F.when(F.col("_a") <= points, cents), F.when(F.col("_b") <= points, cents)
    g = rows.groupBy(by).agg(F.count("*").alias("points"),
                             ratio(F.sum(head), F.count(head)).alias("earlier_avg"),
                             ratio(F.sum(tail), F.count(tail)).alias("recent_avg"))
    change = F.coalesce(F.try_divide((F.col("recent_avg") - F.col("earlier_avg")) * 100, F.col("earlier_avg")), F.lit(0.0))
    trend = (F.when(F.col("points") < 2, "insufficient_data").when(change > 10, "increasing")
             .when(change < -10, "decreasing").otherwise("stable"))
    return g.select("*", change.alias("change_percent"), trend.alias("trend"))


def top_k(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """T-01: largest k groups by summed value."""
    g = df.groupBy(by).agg(dsum(value).alias(value))
    return g.orderBy(F.desc(value), by).limit(k)


def top_k_per_group(df: DataFrame, group: str, key: str, score: Column, k: int) -> DataFrame:
    """T-02, T-03: best k per group; the ``<= k`` filter limits each task before the shuffle.

    Sessions of this library lift Spark's threshold on k for that (1000).
    """
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    ranked = df.withColumn("score", score).withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= k)


def best_per_group(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """T-03: top key of each group, by max_by."""
    return df.groupBy(group).agg(F.min_by(F.struct(key, value), F.struct(-F.col(value), F.col(key))).alias("_b")).select(
        group, "_b.*")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """T-04: one page of an ordered list."""
    return df.orderBy(*order).offset(offset).limit(limit)


def value_counts(df: DataFrame, by: str, k: int) -> DataFrame:
    """T-05: most frequent values."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def recent_per_topic(df: DataFrame, topic: str, ts: str, tie: str, n: int) -> DataFrame:
    """T-06: newest n events per topic."""
    w = Window.partitionBy(topic).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def hits(recommended: DataFrame, actual: DataFrame, user: str, item: str) -> DataFrame:
    """S-02: size of the overlap of recommended and actual items per user."""
    both = recommended.select(user, item).distinct().join(actual.select(user, item).distinct(), [user, item])
    return both.groupBy(user).agg(F.count("*").alias("hits"))


def most_frequent(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mode per group, lowest on ties (G-14)."""
    return mode_value(df, value, [by], "mode")
