"""Sales aggregations: KPI rows, period reports, customer marts, cubes, snapshots and sessions.

Inputs use the retail column names of ``tillroll.schemas``. Every distinct count or sum is a plain
groupBy, which Spark combines on the map side, so a customer or category holding a third of the rows
reaches the shuffle as a few partial rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numbers import davg, dsum, grand_total, money_avg, pct, ratio
from tillroll.operators.ordering import quantiles

#: Order lines that one task folds at a time.
SLICE_ROWS = 1 << 19


def order_day() -> Column:
    return F.to_date("order_date")


def sales_kpis(orders: DataFrame) -> DataFrame:
    """A-01: one row of headline figures."""
    per_order = orders.groupBy("customer_id", "order_id").agg(F.sum("total_amount").alias("_v"), F.count("total_amount").alias("_c"))
    per_customer = per_order.groupBy("customer_id").agg(F.count("order_id").alias("_o"), F.sum("_v").alias("_v"), F.sum("_c").alias("_c"))
    base = per_customer.agg(F.count("customer_id").alias("total_customers"), F.coalesce(F.sum("_o"), F.lit(0)).alias("total_orders"), dsum("_v").alias("total_revenue"), ratio(F.sum("_v"), F.sum("_c")).alias("avg_order_value"))
    return base.select("*", ratio(F.col("total_orders"), F.col("total_customers"), 0).alias("orders_per_customer"),
                       ratio(F.col("total_revenue"), F.col("total_customers"), 0).alias("revenue_per_customer"))


def mean_order_value(items: DataFrame) -> DataFrame:
    """A-02: mean of per-order sums."""
    per_order = items.groupBy("order_id").agg(F.sum("item_total").alias("v"))
    return per_order.agg(davg("v").alias("avg_order_value"), F.count("*").alias("orders"))


def daily_sales(orders: DataFrame, finished: str = "F") -> DataFrame:
    """A-03: orders, revenue, AOV, customers and finished / open orders per day."""
    return orders.groupBy(order_day().alias("day")).agg(
        F.count("*").alias("orders"), dsum("total_amount").alias("revenue"),
        money_avg("total_amount").alias("avg_order_value"),
        F.countDistinct("customer_id").alias("customers"),
        F.count_if(F.col("order_status") == finished).alias("finished_orders"),
        F.count_if(F.col("order_status") != finished).alias("unfinished_orders"))


def monthly_revenue(orders: DataFrame) -> DataFrame:
    """A-04: revenue, orders and first-time customers per month (``yyyy-MM``)."""
    first = orders.groupBy("customer_id").agg(F.min("order_date").alias("order_date"))
    month = F.date_format("order_date", "yyyy-MM").alias("month")
    joined = first.groupBy(month).agg(F.count("*").alias("new_customers"))
    sums = orders.groupBy(month).agg(F.count("*").alias("orders"), dsum("total_amount").alias("revenue"))
    return sums.join(joined, "month", "left").fillna(0, ["new_customers"])


def calendar_month_profile(orders: DataFrame) -> DataFrame:
    """A-05: best and worst calendar month by revenue."""
    m = orders.groupBy(F.month("order_date").alias("m")).agg(F.sum("total_amount").alias("v"))
    return m.agg(F.max_by("m", F.struct("v", -F.col("m"))).alias("best_month"),
                 dsum_max("v").alias("best_revenue"),
                 F.min_by("m", F.struct("v", "m")).alias("worst_month"),
                 F.min("v").cast("double").alias("worst_revenue"))


def dsum_max(c: str) -> Column:
    return F.max(c).cast("double")


def distribution(df: DataFrame, by: str, value: str | None = None) -> DataFrame:
    """A-06: rows and optional value per ``by``, with the share of all rows."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), *([F.sum(value).alias("value")] if value else []))
    out = g.withColumn("_t", grand_total(g, "n", *(["value"] if value else [])))
    out = out.withColumn("share_pct", pct(F.col("n"), F.col("_t.n"))).drop("_t")
    return out.withColumn("value", F.col("value").cast("double")) if value else out


def group_performance(items: DataFrame, orders: DataFrame, side: DataFrame, on: str, by: str) -> DataFrame:
    """A-07: revenue, orders, AOV, unique customers, revenue per customer for a category or a place.

    Folded per order, then per customer, then per group: the distinct counts become row counts, and no
    row is expanded once per distinct aggregate. Lines meet their orders in slices of about ``SLICE_ROWS`` lines,
    which are folded per order where they are, so a task's memory does not grow with the tables.
    """
    slices = max(items.count() // SLICE_ROWS + 1, items.sparkSession.sparkContext.defaultParallelism)
    orders, side = orders.select("order_id", "customer_id"), side.select(on, by)
    if on in orders.columns:
        orders = orders.join(side, on)
    else:
        items = items.join(side, on)
    rows = items.repartition(slices, "order_id").join(orders.repartition(slices, "order_id"), "order_id")
    per_order = rows.groupBy(by, "order_id", "customer_id").agg(F.sum("item_total").alias("v"))
    per_customer = per_order.groupBy(by, "customer_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    out = per_customer.groupBy(by).agg(F.sum("n").alias("orders"), dsum("v").alias("revenue"), F.count("*").alias("unique_customers"))
    return out.select("*", ratio(F.col("revenue"), F.col("orders")).alias("avg_order_value"),
                      ratio(F.col("revenue"), F.col("unique_customers")).alias("revenue_per_customer"))


def conditional_shares(df: DataFrame, by: Sequence[str], tests: Mapping[str, Column], value: str) -> DataFrame:
    """A-08: conditional counts, sums and percentages per group."""
    aggs = [F.count("*").alias("n")]
    for name, test in tests.items():
        aggs += [F.count_if(test).alias(f"{name}_n"),
                 F.coalesce(dsum(F.when(test, F.col(value))), F.lit(0.0)).alias(f"{name}_value"),
                 pct(F.count_if(test), F.count("*")).alias(f"{name}_pct")]
    return df.groupBy(*by).agg(*aggs)


def customer_mart(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
                  finished: str = "F") -> DataFrame:
    """A-09: lifetime figures per customer; customers without orders stay with zeros."""
    o = orders.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"), F.sum("total_amount").alias("spent"),
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"),
        F.countDistinct("payment_method").alias("payment_methods"),
        F.count_if(F.col("order_status") == finished).alias("finished"))
    c = (items.select("order_id", "product_id").join(orders.select("order_id", "customer_id"), "order_id")
         .join(products.select("product_id", "category"), "product_id")
         .groupBy("customer_id").agg(F.countDistinct("category").alias("categories")))
    out = customers.select("customer_id", "customer_segment").join(o, "customer_id", "left").join(
        c, "customer_id", "left")
    n = F.coalesce(F.col("total_orders"), F.lit(0))
    return out.select(
        "customer_id", "customer_segment", n.alias("total_orders"),
        F.coalesce(F.col("spent").cast("double"), F.lit(0.0)).alias("total_spent"),
        ratio(F.col("spent"), n, 0).alias("avg_order_value"), "first_order", "last_order",
        F.coalesce("categories", F.lit(0)).alias("categories"),
        F.coalesce("payment_methods", F.lit(0)).alias("payment_methods"),
        pct(F.col("finished"), n, 0).alias("finished_pct"))


def place_period_kpis(orders: DataFrame, customers: DataFrame, place: str, period: str) -> DataFrame:
    """A-10: KPI per place and quarter (or per platform and month), with one method's adoption rate."""
    label = F.date_trunc(period, "order_date").cast("date").alias("period_start")
    rows = orders.join(customers.select("customer_id", place), "customer_id")
    # Folded per order, then per customer, so the distinct counts are row counts and no row is copied per count.
    per_order = rows.groupBy(place, label, "customer_id", "order_id").agg(F.count("*").alias("_l"), F.sum("total_amount").alias("_v"), F.count("total_amount").alias("_c"), F.count_if(F.col("payment_method") == "1-URGENT").alias("_u"))
    per_customer = per_order.groupBy(place, "period_start", "customer_id").agg(F.count("*").alias("_o"), *[F.sum(c).alias(c) for c in ("_l", "_v", "_c", "_u")])
    return per_customer.groupBy(place, "period_start").agg(
        F.sum("_o").alias("orders"), F.count("*").alias("customers"), dsum("_v").alias("revenue"), ratio(F.sum("_v"), F.sum("_c")).alias("avg_order_value"),
        pct(F.sum("_u"), F.sum("_l")).alias("adoption_pct"))


def hourly_rollup(activity: DataFrame, by: str) -> DataFrame:
    """A-11: activity per hour and customer (or product)."""
    return activity.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), by).agg(
        F.count("*").alias("events"), dsum("value").alias("value"),
        F.count_if(F.col("activity_type") == "purchase").alias("purchases"))


def group_summary(df: DataFrame, by: Sequence[str], value: str, distinct: str | None = None) -> DataFrame:
    """A-12, A-17: count, mean, median, sum and std per group; rows with a null key are dropped (G-05)."""
    rows = df.dropna(subset=list(by))
    aggs = [F.count("*").alias("n"), dsum(value).alias("total"), davg(value).alias("mean"),
            F.round(F.stddev_samp(F.col(value).cast("double")), 4).alias("std")]
    if distinct:
        aggs.append(F.countDistinct(distinct).alias("distinct_n"))
    q = quantiles(rows, [value], [0.5], by).select(*by, F.round("q0", 4).alias("median"))
    return rows.groupBy(*by).agg(*aggs).join(q, list(by), "left")


def distinct_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """A-13: drop exact duplicates, then keep the newest row per key (map-side ``max_by``, no window)."""
    cols = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*cols), F.struct(order, F.struct(*cols)))
    return df.dropDuplicates().groupBy(key).agg(newest.alias("_r")).select(key, "_r.*")


def frequent(df: DataFrame, by: str, at_least: int) -> DataFrame:
    """A-14: groups that reach a minimum count."""
    return df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def distinct_list(df: DataFrame, by: str, value: str) -> DataFrame:
    """A-15: sorted distinct values of a small domain per group (deduplicated before collecting)."""
    return df.groupBy(by, value).agg(F.lit(1)).groupBy(by).agg(
        F.sort_array(F.collect_list(value)).alias(f"{value}_list"), F.count(value).alias(f"{value}_n"))


def spend_distribution(orders: DataFrame) -> DataFrame:
    """A-16: mean, std and quantiles of spend per customer."""
    spend = orders.groupBy("customer_id").agg(F.sum("total_amount").alias("spent"))
    q = quantiles(spend, ["spent"], [0.25, 0.5, 0.75, 0.95])
    stats = spend.agg(F.count("*").alias("customers"), davg("spent").alias("mean"),
                      F.round(F.stddev_samp(F.col("spent").cast("double")), 4).alias("std"))
    picks = q.select(F.struct(*[F.round(f"q{i}", 4).alias(f"q{i}") for i in range(4)])).scalar()
    return stats.withColumn("_q", picks).select("customers", "mean", "std", F.col("_q.q0").alias("p25"),
                                                F.col("_q.q1").alias("median"), F.col("_q.q2").alias("p75"),
                                                F.col("_q.q3").alias("p95"))


def purchase_profile(orders: DataFrame) -> DataFrame:
    """A-18: first and last order, counts and monthly frequency ``orders / (days + 1) * 30``."""
    g = orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"),
        F.count("*").alias("orders"), dsum("total_amount").alias("spent"))
    days = F.datediff("last_order", "first_order")
    return g.select("*", days.alias("active_days"),
                    (F.col("orders") / (days + 1).cast("double") * 30).alias("monthly_frequency"))


def pivot_quantity(rows: DataFrame, key: str, by: str, values: Sequence[str], value: str) -> DataFrame:
    """A-19: one column per listed value; the list is given, so Spark runs no extra job to find it."""
    wide = rows.groupBy(key).pivot(by, list(values)).agg(F.sum(value).cast("double"))
    return wide.fillna(0.0)


def basket_breadth(rows: DataFrame) -> DataFrame:
    """A-20: orders by number of distinct categories."""
    per_order = rows.groupBy("order_id").agg(F.countDistinct("category").alias("categories"))
    return per_order.groupBy("categories").agg(F.count("*").alias("orders"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A-21, S-01: one row per table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def daily_summary(orders: DataFrame, products: DataFrame, customers: DataFrame, day: str) -> DataFrame:
    """A-22: three metric families in one shape, with the share of all counts."""
    def block(df: DataFrame, name: str, value: Column, mean: Column, distinct: str) -> DataFrame:
        return df.agg(F.count("*").alias("total_count"), value.alias("total_value"), mean.alias("average_value"),
                      F.countDistinct(distinct).alias("distinct_n")).withColumn("metric", F.lit(name))
    zero = F.lit(0.0)
    out = block(orders.where(order_day() == F.lit(day).cast("date")), "orders",
                F.coalesce(dsum("total_amount"), zero), F.coalesce(davg("total_amount"), zero), "customer_id")
    out = out.unionByName(block(products, "products", davg("price"), davg("stock_quantity"), "category"))
    out = out.unionByName(block(customers, "customers", zero, zero, "region"))
    whole = out.agg(F.sum("total_count").alias("n")).scalar()
    return out.withColumn("percentage_of_total", F.round(pct(F.col("total_count"), whole), 2))


def customer_insights(customers: DataFrame, orders: DataFrame, items: DataFrame, place: str) -> DataFrame:
    """A-23: orders, revenue, products per place and segment, order frequency and LTV tier by quartile.

    Orders and items are aggregated separately before the join, so revenue is not repeated per item.
    """
    who = customers.select("customer_id", place, "customer_segment")
    keys = [place, "customer_segment"]
    per = orders.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("total_amount").alias("v"))
    o = who.join(per, "customer_id", "left").groupBy(*keys).agg(
        F.count("*").alias("customer_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"),
        F.coalesce(dsum("v"), F.lit(0.0)).alias("total_revenue"), ratio(F.sum("v"), F.sum("n"), 0).alias("avg_order_value"))
    i = (items.select("order_id", "product_id").join(orders.select("order_id", "customer_id"), "order_id")
         .join(who, "customer_id").groupBy(*keys).agg(F.countDistinct("product_id").alias("unique_products")))
    out = o.join(i, keys, "left")
    edges = quantiles(out, ["total_revenue"], [0.25, 0.5, 0.75]).select(F.struct("q0", "q1", "q2")).scalar()
    tier = (F.when(F.col("total_revenue") <= F.col("_e.q0"), "Low").when(F.col("total_revenue") <= F.col("_e.q1"), "Medium")
            .when(F.col("total_revenue") <= F.col("_e.q2"), "High").otherwise("Premium"))
    return out.withColumn("_e", edges).select(
        *keys, "customer_count", "total_orders", "total_revenue", "avg_order_value",
        F.coalesce("unique_products", F.lit(0)).alias("unique_products"),
        F.round(ratio(F.col("total_orders"), F.col("customer_count")), 2).alias("order_frequency"),
        tier.alias("ltv_tier"))


def product_performance(products: DataFrame, items: DataFrame, by: Sequence[str]) -> DataFrame:
    """A-23: performance score 0.5 revenue + 0.3 orders + 0.2 quality, and the stock recommendation."""
    out = products.join(items, "product_id", "left").groupBy(*by).agg(
        F.countDistinct("product_id").alias("product_count"), F.countDistinct("order_id").alias("order_count"),
        F.coalesce(dsum("quantity"), F.lit(0.0)).alias("quantity_sold"),
        F.coalesce(dsum("item_total"), F.lit(0.0)).alias("total_revenue"), davg("quality").alias("avg_quality"))
    top = out.agg(F.struct(F.max("total_revenue").alias("r"), F.max("order_count").alias("o")).alias("m")).scalar()
    score = F.round(ratio(F.col("total_revenue"), F.col("_m.r"), 0) * 0.5
                    + ratio(F.col("order_count"), F.col("_m.o"), 0) * 0.3 + F.col("avg_quality") / 10 * 0.2, 3)
    advice = F.when(F.col("performance_score") > 0.7, "Increase").when(
        F.col("performance_score") < 0.3, "Decrease").otherwise("Maintain")
    return out.withColumn("_m", top).withColumn("performance_score", score).withColumn(
        "inventory_recommendation", advice).drop("_m")


def sales_trend(orders: DataFrame, items: DataFrame) -> DataFrame:
    """A-24: by date, hour and weekday (Sunday = 0); counts are per item, as in the source report."""
    rows = orders.join(items.select("order_id", "product_id"), "order_id")
    return rows.groupBy(order_day().alias("day"), F.hour("order_date").alias("hour_of_day"),
                        (F.dayofweek("order_date") - 1).alias("day_of_week")).agg(
        F.count("*").alias("order_count"), dsum("total_amount").alias("revenue"),
        davg("total_amount").alias("avg_order_value"), F.countDistinct("customer_id").alias("customers"),
        F.countDistinct("product_id").alias("products"))


def platform_months(orders: DataFrame, by: str) -> DataFrame:
    """A-26: new and returning customers and retention per month and platform."""
    first = orders.groupBy("customer_id").agg(F.trunc(F.min("order_date"), "month").alias("first_month"))
    per = orders.groupBy("customer_id", by, F.trunc("order_date", "month").alias("month")).agg(
        F.count("*").alias("n"), F.sum("total_amount").alias("v"))
    rows = per.join(first, "customer_id")
    new = F.col("month") == F.col("first_month")
    out = rows.groupBy("month", by).agg(
        F.sum("n").alias("orders"), dsum("v").alias("revenue"), F.count("*").alias("customers"),
        F.count_if(new).alias("new_customers"), F.count_if(~new).alias("returning_customers"))
    return out.withColumn("retention_pct", pct(F.col("returning_customers"), F.col("customers")))


METRICS = {"sum": dsum, "avg": davg, "count": F.count, "min": lambda c: F.min(c).cast("double"),
           "max": lambda c: F.max(c).cast("double"), "distinct": F.countDistinct}
GRAINS = ("minute", "hour", "day", "week", "month", "quarter", "year")


def metric_query(df: DataFrame, metric: str, agg: str, ts: str, start: str, end: str,
                 filters: Mapping[str, object] | None = None, grain: str = "hour") -> DataFrame:
    """A-27: one whitelisted aggregate per time bucket in ``[start, end)`` under equality filters."""
    if agg not in METRICS or grain not in GRAINS or metric not in df.columns:
        raise ValueError(f"unsupported metric query: {agg}({metric}) by {grain}")
    rows = df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    for name, want in (filters or {}).items():
        rows = rows.where(F.col(name).isin(want) if isinstance(want, (list, tuple)) else F.col(name) == F.lit(want))
    return rows.groupBy(F.date_trunc(grain, ts).cast("timestamp_ntz").alias("time_bucket")).agg(
        METRICS[agg](metric).alias("value"), F.count("*").alias("n"))


def last_hour_stats(activity: DataFrame, as_of: str, path: str = "$.k", hours: int = 1) -> DataFrame:
    """A-28: count, sum, mean, active customers of the last hours from a JSON payload."""
    recent = activity.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {hours} HOUR"))
    amount = F.get_json_object("props", path).cast("bigint")
    return recent.agg(F.count("*").alias("events"), F.sum(amount).alias("total"),
                      ratio(F.sum(amount), F.count(amount)).alias("mean"),
                      F.countDistinct("customer_id").alias("active_customers"))


def last_hour_top(activity: DataFrame, as_of: str, path: str = "$.k", hours: int = 1, k: int = 5) -> DataFrame:
    """A-28: the k most frequent payload values of the last hours."""
    recent = activity.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {hours} HOUR"))
    g = recent.groupBy(F.get_json_object("props", path).cast("bigint").alias("item")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "item").limit(k)


def freshness_ratio(tables: Mapping[str, tuple[DataFrame, str]], as_of: str, days: int) -> DataFrame:
    """A-29: fresh rows, all rows and newest timestamp per table."""
    out = None
    for name, (df, ts) in tables.items():
        fresh = F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY")
        part = df.agg(F.count_if(fresh).alias("fresh_rows"), F.count("*").alias("total_rows"),
                      F.max(ts).alias("latest")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("fresh_ratio", ratio(F.col("fresh_rows"), F.col("total_rows"), 0))


def summary_cube(activity: DataFrame, dims: Sequence[str], grains: Sequence[str] = ("hour", "day", "month")) -> DataFrame:
    """A-30: one row per (bucket, granularity, dims); built from the finest grain, read once."""
    fine = activity.groupBy(F.date_trunc(grains[0], "ts").alias("_t"), *dims).agg(
        F.count("*").alias("events"), F.sum("value").alias("value"))
    levels = F.array(*[F.struct(F.lit(g).alias("granularity"),
                                F.date_trunc(g, "_t").cast("timestamp_ntz").alias("time_bucket")) for g in grains])
    rows = fine.withColumn("_l", F.explode(levels))
    return rows.groupBy("_l.granularity", "_l.time_bucket", *dims).agg(
        F.sum("events").alias("events"), dsum("value").alias("value"))


def dimension_cube(activity: DataFrame, sets: Sequence[Sequence[str]], dims: Sequence[str]) -> DataFrame:
    """A-30: grouping sets over the dimensions with their grouping id."""
    return activity.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        F.grouping_id().alias("grouping_level"), F.count("*").alias("events"), dsum("value").alias("value"))


def topic_activity(activity: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """A-31: count and newest event per topic, in all and in the last minutes."""
    fresh = F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {minutes} MINUTE")
    return activity.groupBy(F.col("activity_type").alias("topic")).agg(
        F.count("*").alias("total"), F.count_if(fresh).alias("recent"), F.max("ts").alias("latest"))


def catalogue_summary(products: DataFrame) -> DataFrame:
    """A-32: brands, price range, mean, median and discounted products."""
    q = quantiles(products, ["price"], [0.5]).select(F.round("q0", 4)).scalar()
    return products.agg(
        F.count("*").alias("total_products"), F.countDistinct("brand").alias("unique_brands"),
        F.countDistinct("category").alias("categories"), F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"), davg("price").alias("avg_price"),
        F.count_if(F.col("stock_quantity") < 10).alias("low_stock_products")).withColumn("median_price", q)


def daily_aggregate(orders: DataFrame, items: DataFrame, customers: DataFrame, platform: str, place: str) -> DataFrame:
    """A-33: daily sales by platform and place with new and returning customers and item figures."""
    first = orders.groupBy("customer_id").agg(F.to_date(F.min("order_date")).alias("first_day"))
    per_order = items.groupBy("order_id").agg(
        F.sum("quantity").alias("units"), F.sum(F.col("item_total") * F.col("discount")).alias("disc"),
        F.sum(F.col("item_total") * F.col("tax")).alias("tax"), F.count("*").alias("lines"))
    rows = orders.join(per_order, "order_id", "left").join(first, "customer_id").join(
        customers.select("customer_id", place), "customer_id")
    per = rows.groupBy(order_day().alias("day"), platform, place, "customer_id").agg(
        F.count("*").alias("n"), F.max(F.col("first_day") == order_day()).alias("new"),
        *[F.sum(c).alias(c) for c in ("total_amount", "units", "disc", "tax", "lines")])
    out = per.groupBy("day", platform, place).agg(
        F.sum("n").alias("orders"), F.count("*").alias("customers"), F.count_if("new").alias("new_customers"),
        dsum("total_amount").alias("gross"), F.coalesce(dsum("disc"), F.lit(0.0)).alias("discount"),
        F.coalesce(dsum("tax"), F.lit(0.0)).alias("tax"), F.coalesce(dsum("units"), F.lit(0.0)).alias("units"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return out.select("*", (F.col("customers") - F.col("new_customers")).alias("returning_customers"),
                      ratio(F.col("lines"), F.col("orders")).alias("items_per_order"),
                      (F.col("gross") - F.col("discount")).alias("net"))


def monthly_customers(orders: DataFrame, customers: DataFrame, place: str) -> DataFrame:
    """A-34: active, new, reactivated and churned customers and retention per month and place.

    The window runs over customer-months (at most one row per month of history), never over orders.
    """
    per = orders.groupBy("customer_id", F.trunc("order_date", "month").alias("month")).agg(
        F.count("*").alias("n"), F.sum("total_amount").alias("v"))
    w = Window.partitionBy("customer_id").orderBy("month")
    rows = per.join(customers.select("customer_id", place), "customer_id").select(
        "*", F.lag("month").over(w).alias("_prev"), F.lead("month").over(w).alias("_next"))
    gap = F.months_between("month", "_prev").cast("int")
    active = rows.groupBy("month", place).agg(
        F.count("*").alias("active"), F.count_if(F.col("_prev").isNull()).alias("new_customers"),
        F.count_if(gap > 1).alias("reactivated"), F.count_if(gap == 1).alias("retained"),
        F.sum("n").alias("orders"), dsum("v").alias("revenue"))
    follow = F.add_months("month", 1)
    left = rows.where(F.col("_next").isNull() | (F.col("_next") > follow)).groupBy(
        follow.alias("month"), place).agg(F.count("*").alias("churned"))
    before = active.select(F.add_months("month", 1).alias("month"), place, F.col("active").alias("_before"))
    out = active.join(left, ["month", place], "left").join(before, ["month", place], "left")
    return out.select("month", place, "active", "new_customers", "reactivated", "retained", "orders", "revenue",
                      F.coalesce("churned", F.lit(0)).alias("churned"),
                      pct(F.col("retained"), F.col("_before"), 0).alias("retention_pct"),
                      ratio(F.col("orders"), F.col("active")).alias("orders_per_customer"))


def inventory_snapshot(moves: DataFrame, products: DataFrame) -> DataFrame:
    """A-35: daily stock per product: beginning + received + returned - sold.

    ``moves`` has product_id, day, received, returned, sold. They are summed per product and day first,
    so the running window of one product is at most its number of days.
    """
    d = moves.groupBy("product_id", "day").agg(*[F.sum(c).alias(c) for c in ("received", "returned", "sold")])
    w = Window.partitionBy("product_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("received") + F.col("returned") - F.col("sold")
    out = d.join(products.select("product_id", "stock_quantity", "price"), "product_id").withColumn(
        "_end", F.col("stock_quantity") + F.sum(change).over(w))
    return out.select(
        "product_id", "day", (F.col("_end") - change).cast("double").alias("beginning"),
        *[F.col(c).cast("double").alias(c) for c in ("received", "returned", "sold")],
        F.col("_end").cast("double").alias("ending"), (F.col("_end") * F.col("price")).cast("double").alias("stock_value"),
        (F.col("_end") <= 0).alias("stockout"))


def stock_turnover(snapshot: DataFrame) -> DataFrame:
    """A-35: days held, stockout days, turnover and days of inventory per product."""
    g = snapshot.groupBy("product_id").agg(
        F.count("*").alias("days"), F.count_if(F.col("stockout")).alias("stockout_days"),
        F.sum(F.col("sold").cast("decimal(18,2)")).cast("double").alias("sold"),
        ratio(F.sum(F.col("ending").cast("decimal(18,2)")), F.count("*")).alias("avg_stock"))
    return g.select("*", ratio(F.col("sold"), F.col("avg_stock")).alias("turnover"),
                    ratio(F.col("avg_stock") * F.col("days"), F.col("sold")).alias("days_of_inventory"))


def platform_catalogue(products: DataFrame, by: str) -> DataFrame:
    """A-37: count, mean price and mean rating per platform."""
    return products.groupBy(by).agg(F.count("*").alias("products"), davg("price").alias("avg_price"),
                                    davg("rating").alias("avg_rating"))


def run_metrics(runs: DataFrame, as_of: str, hours: int, ok: Column) -> DataFrame:
    """A-38: runs, mean duration, records and success rate per type in the last hours."""
    recent = runs.where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {hours} HOUR"))
    return recent.groupBy("run_type").agg(
        F.count("*").alias("runs"), davg("duration").alias("avg_duration"), F.sum("records").alias("records"),
        ratio(F.sum(F.when(ok, 1).otherwise(0)), F.count("*")).alias("success_rate"))


def day_summary(orders: DataFrame, as_of: str, hours: int = 24, recent_hours: int = 1) -> DataFrame:
    """A-39: rows, customers, recent rows, AOV and last update of the last 24 hours."""
    rows = orders.where(F.col("order_date") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {hours} HOUR"))
    late = F.col("order_date") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {recent_hours} HOUR")
    return rows.agg(F.count("*").alias("orders"), F.countDistinct("customer_id").alias("customers"),
                    F.count_if(late).alias("recent_orders"), davg("total_amount").alias("avg_order_value"),
                    F.max("order_date").alias("last_update"))


def sum_back(df: DataFrame, totals: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """J-16: write aggregate columns back onto rows, keeping the old value where there is none."""
    new = totals.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = df.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_n_{c}", c) if c in df.columns else F.col(f"_n_{c}"))
    return out.drop(*[f"_n_{c}" for c in columns])


