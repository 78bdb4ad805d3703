"""Product analytics: best sellers, trends, rankings, stock alerts, feature tables, KPI rules.

Expected columns: ``sales`` = order lines joined to their order (product_id, order_id, customer_id, quantity,
item_total, order_date); ``products`` = product_id, product_name, category, brand, price, stock_quantity.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import text as X
from tillroll.functions.dates import TET_JAN20_FEB20, in_season
from tillroll.functions.numbers import davg, dsum, money_avg, pct
from tillroll.operators.joins import group_stats_back, previous_day
from tillroll.operators.ordering import number_rows
from tillroll.operators.sales import sales_kpis
from tillroll.operators.windows import fixed_bins, percent_rank, rank_by_value, value_bins, width_bins
from tillroll.session import pin

# Look-back of each timeframe.
TIMEFRAMES = {"hour": "1 HOUR", "day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}


def _at(as_of: str, *back: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}'" + "".join(f" - INTERVAL {b}" for b in back))


def trend_class(current: Column, previous: Column) -> tuple[Column, Column]:
    """Trend name and percentage change; nothing before counts as a rise of 100."""
    change = F.when(previous == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise(F.try_divide((current - previous) * 100, previous))
    name = (F.when((previous == 0) & (current > 10), "explosive").when((previous == 0) & (current > 0), "rising").when(previous == 0, "stable")
            .when(change > 50, "explosive").when(change > 10, "rising").when(change < -30, "declining").when(change < -10, "falling").otherwise("stable"))
    return name, change


def period_sales(sales: DataFrame, now: Column, before: Column) -> DataFrame:
    """Units, revenue, orders and customers of products sold in the period ``now``, and their units of the period ``before``; the lines are read once."""
    per_order = sales.where(now | before).groupBy("product_id", "customer_id", "order_id").agg(
        F.count_if(now).alias("_lines"), F.sum(F.when(now, F.col("quantity"))).alias("_q"), F.sum(F.when(now, F.col("item_total"))).alias("_v"),
        F.sum(F.when(before, F.col("quantity"))).alias("_pq"))
    sums = [F.sum(c).alias(c) for c in ("_q", "_v", "_pq")]
    per_customer = per_order.groupBy("product_id", "customer_id").agg(F.count_if(F.col("_lines") > 0).alias("order_count"), *sums)
    out = per_customer.groupBy("product_id").agg(F.sum("order_count").alias("order_count"), F.count_if(F.col("order_count") > 0).alias("unique_customers"), *sums)
    return out.where("order_count > 0")


def fold_buyers(rows: DataFrame, by: str, **sums: str) -> DataFrame:
    """Sums, orders and customers per ``by``: folded per order, then per customer, so the distinct counts are row counts and no line is copied per count."""
    per_order = rows.groupBy(by, "customer_id", "order_id").agg(F.count("*").alias("_lines"), *[F.sum(c).alias(n) for n, c in sums.items()])
    per_customer = per_order.groupBy(by, "customer_id").agg(F.count("*").alias("order_count"), *[F.sum(n).alias(n) for n in sums])
    return per_customer.groupBy(by).agg(F.sum("order_count").alias("order_count"), F.count("*").alias("unique_customers"), *[F.sum(n).alias(n) for n in sums])


def best_sellers(products: DataFrame, sales: DataFrame, views: DataFrame, as_of: str, timeframe: str = "day", limit: int | None = 50,
                 category: str | None = None, overlap: bool = False) -> DataFrame:
    """D-15: sales, margin, conversion, rank, previous rank, trend and days to stockout.

    The previous period ends where the current one starts; ``overlap=True`` repeats the source, whose
    previous period starts a day earlier and has no end (G-09). The limit is the length of the report.
    """
    back = TIMEFRAMES[timeframe]
    p = products.where(F.col("category") == category) if category else products
    day = F.col("order_date")
    now = day >= _at(as_of, back)
    before = day >= _at(as_of, "1 DAY", back) if overlap else (day >= _at(as_of, back, back)) & (day < _at(as_of, back))
    v = views.groupBy("product_id").agg(F.count("*").alias("view_count"))
    # One row per product, read by both rankings.
    rows = pin(p.join(period_sales(sales, now, before), "product_id").join(v, "product_id", "left"))
    units, prev = F.col("_q").cast("double"), F.coalesce(F.col("_pq").cast("double"), F.lit(0.0))
    cost = F.coalesce(F.col("cost_price"), F.col("price") * F.lit("0.6").cast("decimal(4,2)")) if "cost_price" in p.columns else (
        F.col("price") * F.lit("0.6").cast("decimal(4,2)"))
    name, change = trend_class(units, prev)
    out = rows.select(
        "product_id", "product_name", "category", "brand", "stock_quantity", units.alias("sales_volume"), F.col("_v").cast("double").alias("revenue"),
        "order_count", "unique_customers", prev.alias("prev_sales_volume"), F.coalesce("view_count", F.lit(0)).alias("view_count"),
        F.round(pct(units, F.col("view_count"), 0), 2).alias("conversion_rate"),
        F.round((F.col("price") - cost).cast("double") / F.col("price").cast("double") * 100, 2).alias("profit_margin"),
        name.alias("trend_direction"), change.alias("trend_percentage"))
    ranked = number_rows(out, [F.desc("sales_volume"), F.col("product_id")], (), "current_rank", "_n").drop("_n")
    prev_rank = number_rows(rows.where("_pq IS NOT NULL").select("product_id", "_pq"), [F.desc("_pq"), F.col("product_id")], (), "previous_rank", "_n")
    ranked = ranked.join(prev_rank.select("product_id", "previous_rank"), "product_id", "left")
    daily = F.col("sales_volume") / (1 if timeframe == "day" else 7)
    ranked = ranked.withColumn("rank_change", F.coalesce(F.col("previous_rank") - F.col("current_rank"), F.lit(0))).withColumn(
        "days_to_stockout", F.floor(F.try_divide(F.col("stock_quantity"), daily)).cast("int"))
    return ranked.where(F.col("current_rank") <= limit) if limit else ranked


def trending(products: DataFrame, sales: DataFrame, as_of: str, days: int = 7, at_least: int = 5, limit: int | None = 20) -> DataFrame:
    """D-16: velocity and confidence of the last days; LOG is base 10 (G-15)."""
    g = sales.where(F.col("order_date") >= _at(as_of, f"{days} DAY")).groupBy("product_id").agg(
        dsum("quantity").alias("current_sales"), F.countDistinct(F.to_date("order_date")).alias("active_days"),
        F.min("order_date").alias("first_sale_date"), F.max("order_date").alias("last_sale_date")).where(F.col("current_sales") >= at_least)
    s, d = F.col("current_sales"), F.col("active_days")
    out = products.select("product_id", "product_name", "category").join(g, "product_id").withColumns({
        "growth_rate": F.round(s / F.greatest(d, F.lit(1)) * 100, 2),
        "velocity_score": F.round(F.when(d >= 3, s * F.log10(s + 1) / d).otherwise(s), 2),
        "confidence_score": F.round(F.least(s / 20.0, F.lit(1.0)) * F.least(d / 7.0, F.lit(1.0)), 2)})
    return out.orderBy(F.desc("velocity_score"), "product_id").limit(limit) if limit else out


def category_performance(products: DataFrame, sales: DataFrame, views: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """D-17: products, orders, conversion, market share, growth against the period before, top product."""
    is_now = F.col("order_date") >= _at(as_of, f"{days} DAY")
    rows = sales.where(F.col("order_date") >= _at(as_of, f"{2 * days} DAY")).join(products.select("product_id", "category"), "product_id")
    # One row per product and order, read by all measures below.
    rows = pin(rows.groupBy("category", "product_id", "customer_id", "order_id").agg(
        F.count_if(is_now).alias("_lines"), F.sum(F.when(is_now, F.col("quantity"))).alias("_q"), F.sum(F.when(is_now, F.col("item_total"))).alias("_v"),
        F.sum(F.when(~is_now, F.col("quantity"))).alias("_pq")))
    now = rows.where("_lines > 0")
    v = views.groupBy("product_id").agg(F.count("*").alias("_views"))
    # One row per product first: the mean over lines becomes a ratio of sums.
    p = now.groupBy("category", "product_id").agg(F.sum("_q").alias("_q"), F.sum("_v").alias("_v"), F.sum("_lines").alias("_lines")).join(
        v, "product_id", "left")
    conv = F.coalesce(F.try_divide(F.col("_q").cast("double") * 100, F.col("_views")), F.lit(0.0))
    g = p.groupBy("category").agg(
        F.count("*").alias("total_products"), F.sum("_q").alias("_q"), F.sum("_v").alias("_v"), F.sum(conv).alias("_c"), F.sum("_lines").alias("_l"),
        F.min_by("product_id", F.struct(-F.col("_q"), F.col("product_id"))).alias("top_product_id"), F.max("_q").cast("double").alias("top_product_sales"))
    orders = fold_buyers(now, "category").withColumnRenamed("order_count", "total_orders")
    past = rows.groupBy("category").agg(F.sum("_pq").alias("_pq"))
    market = now.agg(F.sum("_v").alias("m")).scalar()
    units, prev = F.col("_q").cast("double"), F.coalesce(F.col("_pq").cast("double"), F.lit(0.0))
    return g.join(orders, "category").join(past, "category", "left").select(
        "category", "total_products", "total_orders", "unique_customers", units.alias("total_sales"), F.col("_v").cast("double").alias("total_revenue"),
        F.round(F.col("_c") / F.col("_l"), 4).alias("avg_conversion_rate"), prev.alias("prev_total_sales"),
        F.round(F.coalesce(F.try_divide((units - prev) * 100, prev), F.lit(0.0)), 4).alias("growth_rate"), pct(F.col("_v"), market).alias("market_share"),
        "top_product_id", "top_product_sales")


def today_metrics(products: DataFrame, sales: DataFrame, orders: DataFrame, day: str) -> DataFrame:
    """D-18: orders, revenue, customers, top product and fastest growing category of one day."""
    today = F.lit(day).cast("date")
    is_day = F.to_date("order_date") == today
    head = orders.where(is_day).agg(F.countDistinct("order_id").alias("total_orders"), F.coalesce(dsum("total_amount"), F.lit(0.0)).alias("revenue"),
                                    F.countDistinct("customer_id").alias("active_customers"))
    rows = sales.where(F.to_date("order_date").between(F.date_sub(today, 1), today)).join(products.select("product_id", "category"), "product_id")
    per = rows.groupBy("category", "product_id").agg(F.sum(F.when(is_day, F.col("quantity"))).alias("_t"),
                                                     F.sum(F.when(~is_day, F.col("quantity"))).alias("_y"))
    top = per.where("_t IS NOT NULL").agg(F.min_by("product_id", F.struct(-F.col("_t"), F.col("product_id"))).alias("p")).scalar()
    cat = per.groupBy("category").agg(F.sum("_t").alias("_t"), F.sum("_y").alias("_y")).where("_t IS NOT NULL")
    grown = F.coalesce(F.try_divide((F.col("_t") - F.col("_y")).cast("double") * 100, F.col("_y").cast("double")), F.lit(100.0))
    fast = cat.select("category", grown.alias("_g")).agg(F.min_by("category", F.struct(-F.col("_g"), F.col("category"))).alias("c")).scalar()
    return head.withColumn("top_product_id", top).withColumn("fastest_category", fast)


def compare_periods(reports: Mapping[str, DataFrame]) -> DataFrame:
    """D-19: totals of several best-seller reports."""
    out = None
    for name, df in reports.items():
        conv = F.when(F.col("conversion_rate") > 0, F.col("conversion_rate"))
        part = df.agg(F.sum("sales_volume").alias("total_sales"), F.round(F.sum("revenue"), 2).alias("total_revenue"),
                      F.round(F.coalesce(F.avg(conv), F.lit(0.0)), 6).alias("avg_conversion")).withColumn("period", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def velocity(sales: Column, views: Column, hours: int) -> Column:
    """D-20: sales per hour, times conversion, times recency, log-damped above 10."""
    base = sales / F.lit(float(hours))
    base = F.when(views > 0, base * (sales / views) * 100).otherwise(base)
    base = base * F.lit(1.0 + (24.0 - hours) / 24.0 * 0.5)
    return F.round(F.when(base > 10, 10 + F.log10(base - 9)).otherwise(base), 2)


def velocity_scores(tracking: DataFrame, as_of_day: str, hours: int = 24) -> DataFrame:
    """D-20 per product from an hourly tracking table (product_id, tracking_date, sales_volume, views)."""
    first = F.date_sub(F.lit(as_of_day).cast("date"), max(1, round(hours / 24)))
    g = tracking.where(F.col("tracking_date") >= first).groupBy("product_id").agg(
        dsum("sales_volume").alias("total_sales"), F.sum("views").alias("total_views"))
    return g.withColumn("velocity_score", velocity(F.col("total_sales"), F.col("total_views"), hours))


def rankings(products: DataFrame, sales: DataFrame, first: str | None = None, last: str | None = None, limit: int | None = None) -> DataFrame:
    """D-22: daily ranking table of all days or of ``first``..``last``.

    ``limit`` cuts the shown list. Trends and rank changes need the whole ranking: a product that enters the list has a place of the day before.
    """
    day = F.to_date("order_date")
    rows = sales
    if first is not None:
        rows = rows.where(day >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(day <= F.lit(last).cast("date"))
    g = rows.groupBy(day.alias("date"), "product_id").agg(dsum("quantity").alias("sales_volume"), dsum("item_total").alias("revenue"))
    ranked = g.withColumn("rank_position", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("sales_volume"), "product_id")).cast("bigint"))
    ranked = ranked.where(F.col("rank_position") <= limit) if limit else ranked
    return ranked.join(products.select("product_id", "category"), "product_id")


def detect_trends(ranking: DataFrame, scores: DataFrame, day: str) -> DataFrame:
    """D-21: velocity, confidence and strength of ranked products with at least 5 sales."""
    rows = previous_day(ranking.select("product_id", "date", "sales_volume"), ["product_id"], "date", ["sales_volume"]).where(
        (F.col("date") == F.lit(day).cast("date")) & (F.col("sales_volume") >= 5))
    growth = F.when(F.col("prev_sales_volume") > 0, (F.col("sales_volume") - F.col("prev_sales_volume")) / F.col("prev_sales_volume")).otherwise(1.0)
    v = F.col("velocity_score")
    strength = (F.when((v > 50) & (growth > 1.5), "explosive").when((v > 25) & (growth > 1.0), "strong").when(v > 10, "moderate").otherwise("weak"))
    conf = F.least(F.col("sales_volume") / 20.0, F.lit(1.0)) * F.least(growth + 0.5, F.lit(1.0))
    return rows.join(scores.select("product_id", "velocity_score"), "product_id").where(v > 5).select(
        "product_id", "velocity_score", F.round(conf, 6).alias("confidence_score"), strength.alias("trend_strength"))


def dashboard(products: DataFrame, ranking: DataFrame, limit: int | None = 100) -> DataFrame:
    """D-23: rank change, growth, stock status and days to stockout for the first ``limit`` places of every day of a whole ranking."""
    cols = ["rank_position", "sales_volume"]
    rows = previous_day(ranking.select("product_id", "date", "revenue", *cols), ["product_id"], "date", cols)
    rows = rows.where(F.col("rank_position") <= limit) if limit else rows
    grown = F.when(F.col("prev_sales_volume") > 0, F.round((F.col("sales_volume") - F.col("prev_sales_volume")) / F.col("prev_sales_volume") * 100, 2)).otherwise(100.0)
    stock = F.col("stock_quantity")
    status = F.when(stock <= 10, "critical").when(stock <= 50, "low").when(stock <= 100, "medium").otherwise("good")
    return rows.join(products.select("product_id", "product_name", "stock_quantity"), "product_id").select(
        "product_id", "product_name", "stock_quantity", "date", "rank_position", "sales_volume", "revenue", F.col("prev_rank_position").alias("previous_rank"),
        F.coalesce(F.col("rank_position") - F.col("prev_rank_position"), F.lit(0)).alias("rank_change"), grown.alias("growth_percentage"),
        status.alias("stock_status"), F.when(F.col("sales_volume") > 0, F.round(stock / F.col("sales_volume"), 1)).alias("days_to_stockout"))


def category_daily(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Category figures per day, the input of the comparison."""
    rows = sales.join(products.select("product_id", "category"), "product_id")
    return rows.groupBy("category", F.to_date("order_date").alias("date")).agg(dsum("quantity").alias("total_sales"), dsum("item_total").alias("total_revenue"))


def category_comparison(daily: DataFrame, day: str) -> DataFrame:
    """D-23: previous day, growth rating and revenue / growth ranks of one day."""
    today = F.lit(day).cast("date")
    rows = previous_day(pin(daily.where(F.col("date").between(F.date_sub(today, 1), today))), ["category"], "date", ["total_sales", "total_revenue"]).where(F.col("date") == today)
    rows = rows.withColumn("growth_rate", F.coalesce(pct(F.col("total_sales") - F.col("prev_total_sales"), F.col("prev_total_sales")), F.lit(0.0)))
    g = F.col("growth_rate")
    rating = F.when(g > 20, "excellent").when(g > 10, "good").when(g > 0, "positive").when(g > -10, "declining").otherwise("poor")
    rows = rows.withColumn("performance_rating", rating)
    out = rank_by_value(rows, "total_revenue", descending=True).withColumnRenamed("rank", "revenue_rank").drop("percent_rank_avg")
    return rank_by_value(out, "growth_rate", descending=True).withColumnRenamed("rank", "growth_rank").drop("percent_rank_avg")


def momentum(velocity_score: Column, confidence: Column) -> Column:
    """D-23: momentum strength."""
    return (F.when((velocity_score > 100) & (confidence > 0.7), "explosive").when((velocity_score > 50) & (confidence > 0.5), "strong")
            .when(velocity_score > 20, "moderate").otherwise("weak"))


def stock_alerts(board: DataFrame) -> DataFrame:
    """D-24: alerts for ranked products with little stock; texts and limits are fixed values."""
    stock, days = F.col("stock_quantity"), F.col("days_to_stockout")
    rows = board.where((stock <= 50) | (days <= 7))
    text = F.concat(F.lit("Sản phẩm #"), F.col("rank_position"), F.lit(" ("), F.col("product_name"), F.lit(") chỉ còn "), stock,
                    F.lit(" sản phẩm, ước tính "), F.coalesce(days.cast("string"), F.lit("N/A")), F.lit(" ngày hết hàng"))
    detail = F.to_json(F.struct("rank_position", F.col("sales_volume").alias("daily_sales"), "days_to_stockout"))
    return rows.select(
        "product_id", "date", F.when(stock <= 0, "stock_out").otherwise("stock_low").alias("alert_type"),
        F.when(days <= 1, "critical").when(days <= 3, "high").otherwise("medium").alias("severity"),
        F.when(stock <= 0, "Sản phẩm bán chạy đã hết hàng").otherwise("Sản phẩm bán chạy sắp hết hàng").alias("title"), text.alias("description"),
        F.when(stock <= 0, 1).otherwise(20).alias("threshold_value"), stock.alias("actual_value"), detail.alias("alert_data"))


def seller_insights(best: DataFrame, rising: DataFrame, categories: DataFrame) -> DataFrame:
    """D-25: stock, trend and category insights in one list."""
    stock = best.where((F.col("days_to_stockout") > 0) & (F.col("days_to_stockout") <= 3)).select(
        F.lit("stock_alert").alias("type"), F.lit("high").alias("priority"), F.col("product_id").cast("string").alias("subject"),
        F.col("days_to_stockout").cast("double").alias("figure"))
    trend = rising.where((F.col("confidence_score") > 0.7) & (F.col("growth_rate") > 100)).select(
        F.lit("trending_opportunity").alias("type"), F.lit("medium").alias("priority"), F.col("product_id").cast("string").alias("subject"), F.col("growth_rate").alias("figure"))
    fastest = categories.agg(F.min_by(F.struct("category", "growth_rate"), F.struct(-F.col("growth_rate"), F.col("category"))).alias("c")).select("c.*")
    growth = fastest.where(F.col("growth_rate") > 50).select(
        F.lit("category_growth").alias("type"), F.lit("medium").alias("priority"), F.col("category").alias("subject"), F.col("growth_rate").alias("figure"))
    return stock.unionByName(trend).unionByName(growth)


def kpi_rules(orders: DataFrame, top_products: Column) -> DataFrame:
    """D-42: rows for the KPI rules that fire; limits and texts are fixed values.

    The four rules are expressions over the one KPI row, exploded, so there is no join.
    """
    k = sales_kpis(orders)
    def rule(test: Column, kind: str, priority: str, title: str, value: Column, target: float | None) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(title).alias("title"),
                                     value.cast("double").alias("metric_value"), F.lit(target).cast("double").alias("target_value")))
    opc = F.col("orders_per_customer")
    rules = F.array(
        rule(F.col("total_revenue") < 1000000, "opportunity", "high", "Tăng Doanh Thu", F.col("total_revenue"), 1000000.0),
        rule(F.col("avg_order_value") < 500000, "action", "medium", "Tăng Giá Trị Đơn Hàng Trung Bình", F.col("avg_order_value"), 500000.0),
        rule((F.col("total_customers") > 0) & (opc < 2), "alert", "high", "Tỷ Lệ Khách Hàng Quay Lại Thấp", opc, 3.0),
        rule(top_products < 10, "opportunity", "medium", "Mở Rộng Danh Mục Sản Phẩm", F.lit(None), None))
    return k.select(F.explode(F.array_compact(rules)).alias("r")).select("r.*")


def business_insights(orders: DataFrame, sales: DataFrame, products: DataFrame, customers: DataFrame, low_stock: int = 10) -> DataFrame:
    """D-43: revenue, mean monthly growth, customer value, repeat rate, best category, low stock, best and worst month."""
    base = orders.agg(dsum("total_amount").alias("total_revenue"))
    m = orders.groupBy(F.trunc("order_date", "month").alias("m")).agg(dsum("total_amount").alias("v"))
    p = m.select(F.add_months("m", 1).alias("m"), F.col("v").alias("p"))
    growth = m.join(p, "m").agg(F.round(F.avg(F.col("v") / F.col("p") - 1) * 100, 6).alias("g")).scalar()
    c = orders.groupBy("customer_id").agg(F.sum("total_amount").alias("v"), F.countDistinct("order_id").alias("n"))
    cust = c.agg(F.struct(davg("v").alias("value"), F.count_if(F.col("n") > 1).alias("repeat")).alias("s")).scalar()
    people = customers.agg(F.count("*").alias("n")).scalar()
    best = sales.join(products.select("product_id", "category"), "product_id").groupBy("category").agg(F.sum("quantity").alias("q")).agg(
        F.min_by("category", F.struct(-F.col("q"), F.col("category"))).alias("c")).scalar()
    low = products.agg(F.count_if(F.col("stock_quantity") < low_stock).alias("n")).scalar()
    cal = orders.groupBy(F.month("order_date").alias("m")).agg(F.sum("total_amount").alias("v")).agg(
        F.struct(F.min_by("m", F.struct(-F.col("v"), F.col("m"))).alias("best"), F.min_by("m", F.struct("v", "m")).alias("worst")).alias("s")).scalar()
    out = base.withColumn("monthly_growth_pct", growth).withColumn("_c", cust).withColumn("_n", people).withColumn(
        "bestseller_category", best).withColumn("low_stock_products", low).withColumn("_m", cal)
    return out.select("total_revenue", "monthly_growth_pct", F.col("_c.value").alias("avg_customer_value"),
                      pct(F.col("_c.repeat"), F.col("_n")).alias("repeat_rate_pct"), "bestseller_category", "low_stock_products",
                      F.col("_m.best").alias("best_month"), F.col("_m.worst").alias("worst_month"))


def season_impact(orders: DataFrame, year: int, span=TET_JAN20_FEB20) -> DataFrame:
    """D-45: orders and revenue inside and outside the Tet season."""
    name = F.when(in_season(F.col("order_date"), span), "Mùa Tết").otherwise("Bình thường")
    return orders.where(F.year("order_date") == year).groupBy(name.alias("period_type")).agg(
        F.count("*").alias("total_orders"), dsum("total_amount").alias("total_revenue"), davg("total_amount").alias("avg_order_value"))


def platform_share(events: DataFrame, year: int) -> DataFrame:
    """D-45: share of orders and of revenue per platform."""
    rows = events.where(F.year("order_timestamp") == year)
    g = rows.groupBy("platform").agg(F.count("*").alias("actual_orders"), F.sum("total_amount_vnd").alias("_v"))
    whole = rows.agg(F.struct(F.count("*").alias("n"), F.sum("total_amount_vnd").alias("v")).alias("s")).scalar()
    return g.withColumn("_s", whole).select("platform", "actual_orders", pct(F.col("actual_orders"), F.col("_s.n")).alias("order_share"),
                                            F.col("_v").alias("gmv_vnd"), pct(F.col("_v"), F.col("_s.v")).alias("gmv_share"))


def popularity(sold: Column, rating: Column, reviews: Column) -> Column:
    """D-47: weighted popularity."""
    return sold * 0.4 + F.coalesce(rating, F.lit(0.0)) * 0.3 + F.coalesce(reviews, F.lit(0)) * 0.3


def recommendation_score(pop: Column, rating: Column, reviews: Column, revenue_per_sold: Column) -> Column:
    """D-47."""
    return pop * 0.4 + F.coalesce(rating, F.lit(3.0)) * F.coalesce(reviews, F.lit(1)) * 0.3 + revenue_per_sold * 0.3


def clv_features(orders: DataFrame, as_of: str) -> DataFrame:
    """D-47: age, mean gap and spending velocity per customer."""
    now = F.lit(as_of).cast("timestamp_ntz")
    g = orders.groupBy("customer_id").agg(F.count("*").alias("total_orders"), dsum("total_amount").alias("total_spent"),
                                          F.min("order_date").alias("_f"), F.max("order_date").alias("_l"))
    age = F.datediff(now, "_f")
    return g.select(
        "customer_id", "total_orders", "total_spent", (F.col("total_spent") / F.greatest("total_orders", F.lit(1))).alias("average_order_value"),
        age.alias("customer_age_days"), F.datediff(now, "_l").alias("days_since_last_order"), (F.datediff(now, "_l") <= 30).cast("int").alias("active_last_30d"),
        (age / F.greatest("total_orders", F.lit(1))).alias("avg_days_between_orders"), (F.col("total_spent") / F.greatest(age, F.lit(1))).alias("spending_velocity"))


def product_features(products: DataFrame) -> DataFrame:
    """D-48: the product feature table. Needs price, category, brand, product_name, rating.

    Rows with a null category stay (left join); quantiles and ranks are exact and run as range-partitioned
    jobs, so a category holding a third of the products is no hot task.
    """
    base = products.select("category", "brand", "price", "rating")  # every statistic reads this, not the growing frame
    out = percent_rank(products, "price", name="price_percentile", source=base)
    out = percent_rank(out, "price", ["category"], "price_rank_in_category", source=base)
    out = value_bins(out, "price", "price_category", ["Very Low", "Low", "Medium", "High", "Very High"], source=base)
    out = group_stats_back(out, "category", "price", extra={"price_q75": 0.75}, source=base)
    whole = base.agg(F.count("*").alias("n")).scalar()
    per_category = base.where("category IS NOT NULL").groupBy("category").agg(
        davg("rating").alias("category_rating_mean"), (F.count("*") / whole).alias("category_market_share"))
    brands = base.groupBy("brand").agg(F.count("*").alias("brand_product_count"))
    out = out.join(per_category, "category", "left").join(brands, "brand", "left")
    out = value_bins(out, "brand_product_count", "brand_size_category", ["Small", "Medium", "Large"], source=base.join(brands, "brand"))
    out = out.withColumn("is_premium_in_category", (F.col("price").cast("double") > F.col("price_q75")).cast("int")).drop("price_q75")
    log_price, r = F.log1p(F.col("price").cast("double")), F.col("rating")
    return out.withColumns({
        "log_price": F.round(log_price, 6), "rating_tier": fixed_bins(r, [0.0, 2.0, 3.0, 4.0, 4.5, 5.0], ["Poor", "Fair", "Good", "Very Good", "Excellent"]),
        "rating_vs_category_avg": r - F.col("category_rating_mean"), "price_rating_ratio": F.col("price").cast("double") / (r + 1),
        "value_score": F.round(r / (log_price + 1), 6), **X.text_features("product_name", "price")})


def source_reliability(df: DataFrame, source: str) -> DataFrame:
    """D-49: one minus the share of null cells per source."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.groupBy(source).agg((1 - nulls / (F.count("*") * len(df.columns)).cast("double")).alias("source_reliability_score"))


# Demand factor per calendar month.
SEASONAL = [0.8, 0.9, 1.1, 1.0, 1.0, 1.2, 1.3, 1.1, 1.0, 1.1, 1.4, 1.6]


def estimated_sales(df: DataFrame, date: str) -> DataFrame:
    """D-51: sales estimated from reviews and price with the monthly factor, per day and category."""
    factor = F.element_at(F.array(*[F.lit(x) for x in SEASONAL]), F.month(date))
    est = F.round(F.col("num_reviews") * 0.1 + F.lit(1000.0) / F.col("price").cast("double"), 0) * factor
    return df.withColumn("_e", est.cast("decimal(18,2)")).groupBy(F.to_date(date).alias("day"), "category").agg(
        dsum("_e").alias("estimated_sales"), davg("price").alias("avg_price"), F.sum("num_reviews").alias("num_reviews"))


def forecast_insights(series: DataFrame, day: str = "day", y: str = "y") -> DataFrame:
    """D-52: totals, weekday and weekend means."""
    cents = F.col(y).cast("decimal(18,2)")
    weekend = F.weekday(day) >= 5
    return series.agg(
        F.countDistinct(day).alias("forecast_days"), F.countDistinct("category").alias("categories"), davg(cents).alias("avg_daily"), dsum(cents).alias("total"),
        davg(F.when(~weekend, cents)).alias("weekday_avg"), davg(F.when(weekend, cents)).alias("weekend_avg"))


def top_categories(series: DataFrame, k: int = 3, y: str = "y") -> DataFrame:
    """D-52: categories with the largest total."""
    return series.groupBy("category").agg(dsum(F.col(y).cast("decimal(18,2)")).alias("total"), money_avg(F.col(y).cast("decimal(18,2)")).alias("mean")).orderBy(
        F.desc("total"), "category").limit(k)


def month_pattern(series: DataFrame, day: str = "day", y: str = "y") -> DataFrame:
    """D-52: mean per calendar month."""
    return series.groupBy(F.month(day).alias("month")).agg(davg(F.col(y).cast("decimal(18,2)")).alias("mean"))


def customer_stats(sales: DataFrame) -> DataFrame:
    """D-53: spend, lines and orders per customer."""
    return sales.groupBy("customer_id").agg(dsum("item_total").alias("total_spent"), money_avg("item_total").alias("avg_line_value"),
                                            F.count("*").alias("total_lines"), F.countDistinct("order_id").alias("unique_orders"))


def spend_by_age_bin(sales: DataFrame, customers: DataFrame, bins: int = 5) -> DataFrame:
    """D-53: mean spend per equal-width age bin."""
    rows = customer_stats(sales).join(customers.select("customer_id", "age"), "customer_id")
    return width_bins(rows, "age", "age_bin", bins).groupBy("age_bin").agg(
        F.count("*").alias("customers"), davg(F.col("total_spent").cast("decimal(18,2)")).alias("avg_spent"))


