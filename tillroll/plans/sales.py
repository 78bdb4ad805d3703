"""Queries for the sales aggregations (A-01..A-39)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import presence as PR
from tillroll.operators import sales as S
from tillroll.plans.registry import plan
from tillroll.plans.tables import AS_OF, EVENTS_AS_OF


@plan("a01_sales_kpis", """SELECT count(DISTINCT customer_id) AS total_customers, count(DISTINCT order_id) AS total_orders,
  sum(total_amount)::DOUBLE AS total_revenue, sum(total_amount)::DOUBLE / count(total_amount) AS avg_order_value,
  count(DISTINCT order_id)::DOUBLE / count(DISTINCT customer_id) AS orders_per_customer,
  sum(total_amount)::DOUBLE / count(DISTINCT customer_id) AS revenue_per_customer FROM ord""")
def _(t):
    return S.sales_kpis(t.ord)


@plan("a02_mean_order_value", """SELECT sum(v)::DOUBLE / count(v) AS avg_order_value, count(*) AS orders
  FROM (SELECT sum(item_total) AS v FROM itm GROUP BY order_id)""")
def _(t):
    return S.mean_order_value(t.itm)


@plan("a03_daily_sales", """SELECT order_date::DATE AS day, count(*) AS orders, sum(total_amount)::DOUBLE AS revenue,
  ((sum(total_amount) * 200)::HUGEINT + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS avg_order_value, count(DISTINCT customer_id) AS customers,
  count(*) FILTER (order_status = 'F') AS finished_orders, count(*) FILTER (order_status <> 'F') AS unfinished_orders
  FROM ord GROUP BY 1""")
def _(t):
    return S.daily_sales(t.ord)


@plan("a04_monthly_revenue", """WITH f AS (SELECT strftime(min(order_date), '%Y-%m') AS month FROM ord GROUP BY customer_id),
  n AS (SELECT month, count(*) AS new_customers FROM f GROUP BY 1)
  SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS orders, sum(total_amount)::DOUBLE AS revenue,
  coalesce(max(new_customers), 0) AS new_customers
  FROM ord LEFT JOIN n ON n.month = strftime(order_date, '%Y-%m') GROUP BY 1""")
def _(t):
    return S.monthly_revenue(t.ord)


@plan("a05_calendar_month_profile", """WITH m AS (SELECT month(order_date)::INTEGER AS m, sum(total_amount) AS v FROM ord GROUP BY 1)
  SELECT (SELECT m FROM m ORDER BY v DESC, m LIMIT 1) AS best_month, (SELECT max(v)::DOUBLE FROM m) AS best_revenue,
  (SELECT m FROM m ORDER BY v, m LIMIT 1) AS worst_month, (SELECT min(v)::DOUBLE FROM m) AS worst_revenue""")
def _(t):
    return S.calendar_month_profile(t.ord)


@plan("a06_payment_distribution", """SELECT payment_method, count(*) AS n, sum(total_amount)::DOUBLE AS value,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ord) AS share_pct FROM ord GROUP BY 1""")
def _(t):
    return S.distribution(t.ord, "payment_method", "total_amount")


@plan("a06_segment_distribution", """SELECT customer_segment, count(*) AS n,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cst) AS share_pct FROM cst GROUP BY 1""")
def _(t):
    return S.distribution(t.cst, "customer_segment")


_PERF = """SELECT {by}, count(DISTINCT order_id) AS orders, sum(item_total)::DOUBLE AS revenue,
  count(DISTINCT customer_id) AS unique_customers, sum(item_total)::DOUBLE / count(DISTINCT order_id) AS avg_order_value,
  sum(item_total)::DOUBLE / count(DISTINCT customer_id) AS revenue_per_customer
  FROM itm JOIN ord USING (order_id) JOIN {side} USING ({on}) GROUP BY 1"""


@plan("a07_category_performance", _PERF.format(by="category", side="prd", on="product_id"))
def _(t):
    return S.group_performance(t.itm, t.ord, t.prd, "product_id", "category")


@plan("a07_region_performance", _PERF.format(by="region", side="cst", on="customer_id"))
def _(t):
    return S.group_performance(t.itm, t.ord, t.cst, "customer_id", "region")


@plan("a08_conditional_shares", """SELECT payment_method, count(*) AS n, count(*) FILTER (order_status = 'F') AS finished_n,
  coalesce(sum(total_amount) FILTER (order_status = 'F')::DOUBLE, 0) AS finished_value,
  count(*) FILTER (order_status = 'F') * 100.0::DOUBLE / count(*) AS finished_pct,
  count(*) FILTER (total_amount > 300000) AS large_n,
  coalesce(sum(total_amount) FILTER (total_amount > 300000)::DOUBLE, 0) AS large_value,
  count(*) FILTER (total_amount > 300000) * 100.0::DOUBLE / count(*) AS large_pct FROM ord GROUP BY 1""")
def _(t):
    return S.conditional_shares(t.ord, ["payment_method"], {
        "finished": F.col("order_status") == "F", "large": F.col("total_amount") > 300000}, "total_amount")


@plan("a09_customer_mart", """WITH o AS (SELECT customer_id, count(*) AS n, sum(total_amount) AS v, min(order_date) AS f,
  max(order_date) AS l, count(DISTINCT payment_method) AS p, count(*) FILTER (order_status = 'F') AS fin FROM ord GROUP BY 1),
  c AS (SELECT customer_id, count(DISTINCT category) AS k FROM itm JOIN ord USING (order_id) JOIN prd USING (product_id) GROUP BY 1)
  SELECT cst.customer_id, customer_segment, coalesce(n, 0) AS total_orders, coalesce(v::DOUBLE, 0) AS total_spent,
  coalesce(v::DOUBLE / n, 0) AS avg_order_value, f AS first_order, l AS last_order, coalesce(k, 0) AS categories,
  coalesce(p, 0) AS payment_methods, coalesce(fin * 100.0::DOUBLE / n, 0) AS finished_pct
  FROM cst LEFT JOIN o USING (customer_id) LEFT JOIN c USING (customer_id)""")
def _(t):
    return S.customer_mart(t.cst, t.ord, t.itm, t.prd)


_PLACE = """SELECT {place}, date_trunc('{period}', order_date)::DATE AS period_start, count(DISTINCT order_id) AS orders,
  count(DISTINCT customer_id) AS customers, sum(total_amount)::DOUBLE AS revenue,
  sum(total_amount)::DOUBLE / count(*) AS avg_order_value,
  count(*) FILTER (payment_method = '1-URGENT') * 100.0::DOUBLE / count(*) AS adoption_pct
  FROM ord JOIN cst USING (customer_id) GROUP BY 1, 2"""


@plan("a10_region_quarter_kpis", _PLACE.format(place="region", period="quarter"))
def _(t):
    return S.place_period_kpis(t.ord, t.cst, "region", "quarter")


@plan("a10_segment_month_kpis", _PLACE.format(place="customer_segment", period="month"))
def _(t):
    return S.place_period_kpis(t.ord, t.cst, "customer_segment", "month")


@plan("a11_hourly_rollup", """SELECT date_trunc('hour', ts) AS hour, customer_id, count(*) AS events,
  sum(value)::DOUBLE AS value, count(*) FILTER (activity_type = 'purchase') AS purchases FROM act GROUP BY 1, 2""")
def _(t):
    return S.hourly_rollup(t.act, "customer_id")


@plan("a12_group_summary", """SELECT category, brand, count(*) AS n, sum(price)::DOUBLE AS total,
  sum(price)::DOUBLE / count(*) AS mean, round(stddev_samp(price::DOUBLE), 4) AS std,
  round(quantile_cont(price::DOUBLE, 0.5), 4) AS median, count(DISTINCT stock_quantity) AS distinct_n
  FROM prd GROUP BY 1, 2""")
def _(t):
    return S.group_summary(t.prd, ["category", "brand"], "price", "stock_quantity")


@plan("a13_distinct_latest", """SELECT DISTINCT ON (customer_id) customer_id, order_id, order_date, order_status
  FROM ord ORDER BY customer_id, order_date DESC, order_id DESC""")
def _(t):
    return S.distinct_latest(t.ord.select("customer_id", "order_id", "order_date", "order_status"),
                             "customer_id", "order_date")


@plan("a14_frequent_customers", "SELECT customer_id, count(*) AS n FROM ord GROUP BY 1 HAVING count(*) >= 10")
def _(t):
    return S.frequent(t.ord, "customer_id", 10)


@plan("a15_distinct_list", """SELECT customer_id, list_sort(list(DISTINCT payment_method)) AS payment_method_list,
  count(DISTINCT payment_method) AS payment_method_n FROM ord GROUP BY 1""")
def _(t):
    return S.distinct_list(t.ord, "customer_id", "payment_method")


@plan("a16_spend_distribution", """WITH s AS (SELECT sum(total_amount) AS v FROM ord GROUP BY customer_id)
  SELECT count(*) AS customers, sum(v)::DOUBLE / count(*) AS mean, round(stddev_samp(v::DOUBLE), 4) AS std,
  round(quantile_cont(v::DOUBLE, 0.25), 4) AS p25, round(quantile_cont(v::DOUBLE, 0.5), 4) AS median,
  round(quantile_cont(v::DOUBLE, 0.75), 4) AS p75, round(quantile_cont(v::DOUBLE, 0.95), 4) AS p95 FROM s""")
def _(t):
    return S.spend_distribution(t.ord)


@plan("a17_category_stats", """SELECT category, count(*) AS n, sum(price)::DOUBLE AS total, sum(price)::DOUBLE / count(*) AS mean,
  round(stddev_samp(price::DOUBLE), 4) AS std, round(quantile_cont(price::DOUBLE, 0.5), 4) AS median FROM prd GROUP BY 1""")
def _(t):
    return S.group_summary(t.prd, ["category"], "price")


@plan("a18_purchase_profile", """SELECT customer_id, min(order_date) AS first_order, max(order_date) AS last_order,
  count(*) AS orders, sum(total_amount)::DOUBLE AS spent,
  date_diff('day', min(order_date), max(order_date))::INTEGER AS active_days,
  count(*) / (date_diff('day', min(order_date), max(order_date)) + 1)::DOUBLE * 30 AS monthly_frequency FROM ord GROUP BY 1""")
def _(t):
    return S.purchase_profile(t.ord)


_TYPES = ["ECONOMY", "STANDARD", "PROMO", "MEDIUM", "SMALL", "LARGE"]


@plan("a19_category_pivot", "SELECT customer_id, " + ", ".join(
    f"coalesce(sum(quantity) FILTER (category = '{c}'), 0)::DOUBLE AS \"{c}\"" for c in _TYPES)
    + " FROM itm JOIN ord USING (order_id) JOIN prd USING (product_id) GROUP BY 1")
def _(t):
    return S.pivot_quantity(t.sales.join(t.prd, "product_id"), "customer_id", "category", _TYPES, "quantity")


@plan("a20_basket_breadth", """SELECT categories, count(*) AS orders FROM (SELECT order_id, count(DISTINCT category) AS categories
  FROM itm JOIN prd USING (product_id) GROUP BY 1) GROUP BY 1""")
def _(t):
    return S.basket_breadth(t.itm.join(t.prd, "product_id"))


@plan("a21_table_counts", """SELECT 'orders' AS table_name, count(*) AS n FROM ord UNION ALL SELECT 'items', count(*) FROM itm
  UNION ALL SELECT 'products', count(*) FROM prd UNION ALL SELECT 'customers', count(*) FROM cst""")
def _(t):
    return S.table_counts({"orders": t.ord, "items": t.itm, "products": t.prd, "customers": t.cst})


@plan("a22_daily_summary", """WITH b AS (
  SELECT 'orders' AS metric, count(*) AS total_count, coalesce(sum(total_amount)::DOUBLE, 0) AS total_value,
    coalesce(sum(total_amount)::DOUBLE / count(*), 0) AS average_value, count(DISTINCT customer_id) AS distinct_n
    FROM ord WHERE order_date::DATE = DATE '2001-07-31'
  UNION ALL SELECT 'products', count(*), sum(price)::DOUBLE / count(*), sum(stock_quantity)::DOUBLE / count(*),
    count(DISTINCT category) FROM prd
  UNION ALL SELECT 'customers', count(*), 0, 0, count(DISTINCT region) FROM cst)
  SELECT *, round(total_count * 100.0::DOUBLE / (SELECT sum(total_count) FROM b), 2) AS percentage_of_total FROM b""")
def _(t):
    return S.daily_summary(t.ord, t.prd, t.cst, "2001-07-31")


@plan("a23_customer_insights", """WITH o AS (SELECT region, customer_segment, count(DISTINCT customer_id) AS customer_count,
    count(order_id) AS total_orders, coalesce(sum(total_amount)::DOUBLE, 0) AS total_revenue,
    coalesce(sum(total_amount)::DOUBLE / count(total_amount), 0) AS avg_order_value
    FROM cst LEFT JOIN ord USING (customer_id) GROUP BY 1, 2),
  i AS (SELECT region, customer_segment, count(DISTINCT product_id) AS unique_products
    FROM itm JOIN ord USING (order_id) JOIN cst USING (customer_id) GROUP BY 1, 2),
  e AS (SELECT quantile_cont(total_revenue, 0.25) AS a, quantile_cont(total_revenue, 0.5) AS b,
    quantile_cont(total_revenue, 0.75) AS c FROM o)
  SELECT o.*, coalesce(unique_products, 0) AS unique_products,
  round(total_orders::DOUBLE / customer_count, 2) AS order_frequency,
  CASE WHEN total_revenue <= a THEN 'Low' WHEN total_revenue <= b THEN 'Medium' WHEN total_revenue <= c THEN 'High'
  ELSE 'Premium' END AS ltv_tier FROM o LEFT JOIN i USING (region, customer_segment), e""")
def _(t):
    return S.customer_insights(t.cst, t.ord, t.itm, "region")


@plan("a23_product_performance", """WITH g AS (SELECT category, count(DISTINCT product_id) AS product_count,
    count(DISTINCT order_id) AS order_count, coalesce(sum(quantity)::DOUBLE, 0) AS quantity_sold,
    coalesce(sum(item_total)::DOUBLE, 0) AS total_revenue,
    sum(stock_quantity)::DOUBLE / count(stock_quantity) AS avg_quality FROM prd LEFT JOIN itm USING (product_id) GROUP BY 1),
  s AS (SELECT *, round(total_revenue / (SELECT max(total_revenue) FROM g) * 0.5::DOUBLE
    + order_count::DOUBLE / (SELECT max(order_count) FROM g) * 0.3::DOUBLE + avg_quality / 10 * 0.2::DOUBLE, 3) AS performance_score FROM g)
  SELECT *, CASE WHEN performance_score > 0.7 THEN 'Increase' WHEN performance_score < 0.3 THEN 'Decrease'
  ELSE 'Maintain' END AS inventory_recommendation FROM s""")
def _(t):
    return S.product_performance(t.prd.withColumn("quality", F.col("stock_quantity")), t.itm, ["category"])


@plan("a24_sales_trend", """SELECT order_date::DATE AS day, hour(order_date)::INTEGER AS hour_of_day,
  dayofweek(order_date)::INTEGER AS day_of_week, count(*) AS order_count, sum(total_amount)::DOUBLE AS revenue,
  sum(total_amount)::DOUBLE / count(*) AS avg_order_value, count(DISTINCT customer_id) AS customers,
  count(DISTINCT product_id) AS products FROM ord JOIN itm USING (order_id) GROUP BY 1, 2, 3""")
def _(t):
    return S.sales_trend(t.ord, t.itm)


@plan("a26_platform_months", """WITH f AS (SELECT customer_id, date_trunc('month', min(order_date))::DATE AS fm FROM ord GROUP BY 1),
  p AS (SELECT customer_id, payment_method, date_trunc('month', order_date)::DATE AS month, count(*) AS n,
    sum(total_amount) AS v FROM ord GROUP BY 1, 2, 3)
  SELECT month, payment_method, sum(n)::BIGINT AS orders, sum(v)::DOUBLE AS revenue, count(*) AS customers,
  count(*) FILTER (month = fm) AS new_customers, count(*) FILTER (month <> fm) AS returning_customers,
  count(*) FILTER (month <> fm) * 100.0::DOUBLE / count(*) AS retention_pct FROM p JOIN f USING (customer_id) GROUP BY 1, 2""")
def _(t):
    return S.platform_months(t.ord, "payment_method")


@plan("a27_metric_query", """SELECT date_trunc('hour', ts) AS time_bucket, sum(value)::DOUBLE AS value, count(*) AS n FROM act
  WHERE ts >= '2024-01-10' AND ts < '2024-01-20' AND activity_type IN ('purchase', 'view') AND platform = 'web' GROUP BY 1""")
def _(t):
    return S.metric_query(t.act, "value", "sum", "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00",
                          {"activity_type": ["purchase", "view"], "platform": "web"}, "hour")


@plan("a27_minute_customers", """SELECT date_trunc('minute', ts) AS time_bucket, count(DISTINCT customer_id) AS value, count(*) AS n
  FROM act WHERE ts >= '2024-01-01' AND ts < '2024-01-31' GROUP BY 1""")
def _(t):
    return S.metric_query(t.act, "customer_id", "distinct", "ts", "2024-01-01 00:00:00", EVENTS_AS_OF, None, "minute")


@plan("a28_last_hours_stats", f"""SELECT count(*) AS events, sum((props->>'$.k')::BIGINT)::BIGINT AS total,
  sum((props->>'$.k')::BIGINT)::DOUBLE / count(*) AS mean, count(DISTINCT customer_id) AS active_customers FROM act
  WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR""")
def _(t):
    return S.last_hour_stats(t.act, EVENTS_AS_OF, "$.k", 24)


@plan("a28_last_hours_top", f"""SELECT (props->>'$.k')::BIGINT AS item, count(*) AS n FROM act
  WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR GROUP BY 1 ORDER BY n DESC, item LIMIT 5""")
def _(t):
    return S.last_hour_top(t.act, EVENTS_AS_OF, "$.k", 24, 5)


@plan("a29_freshness_ratio", """SELECT 'orders' AS table_name, count(*) FILTER (order_date >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS fresh_rows,
  count(*) AS total_rows, max(order_date) AS latest,
  count(*) FILTER (order_date >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY)::DOUBLE / count(*) AS fresh_ratio FROM ord
  UNION ALL SELECT 'items', count(*) FILTER (ship_date >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY), count(*), max(ship_date),
  count(*) FILTER (ship_date >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY)::DOUBLE / count(*) FROM itm""")
def _(t):
    return S.freshness_ratio({"orders": (t.ord, "order_date"), "items": (t.itm, "ship_date")}, AS_OF, 30)


@plan("a30_summary_cube", " UNION ALL ".join(
    f"""SELECT '{g}' AS granularity, date_trunc('{g}', ts)::TIMESTAMP AS time_bucket, activity_type, platform, count(*) AS events,
    sum(value)::DOUBLE AS value FROM act GROUP BY ALL""" for g in ("hour", "day", "month")))
def _(t):
    return S.summary_cube(t.act, ["activity_type", "platform"])


@plan("a30_dimension_cube", """SELECT activity_type, platform, grouping(activity_type, platform)::BIGINT AS grouping_level,
  count(*) AS events, sum(value)::DOUBLE AS value FROM act
  GROUP BY GROUPING SETS ((activity_type, platform), (activity_type), (platform), ())""")
def _(t):
    return S.dimension_cube(t.act, [["activity_type", "platform"], ["activity_type"], ["platform"], []],
                            ["activity_type", "platform"])


@plan("a31_topic_activity", f"""SELECT activity_type AS topic, count(*) AS total,
  count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 600 MINUTE) AS recent, max(ts) AS latest FROM act GROUP BY 1""")
def _(t):
    return S.topic_activity(t.act, EVENTS_AS_OF, 600)


@plan("a32_catalogue_summary", """SELECT count(*) AS total_products, count(DISTINCT brand) AS unique_brands,
  count(DISTINCT category) AS categories, min(price)::DOUBLE AS min_price, max(price)::DOUBLE AS max_price,
  sum(price)::DOUBLE / count(*) AS avg_price, round(quantile_cont(price::DOUBLE, 0.5), 4) AS median_price,
  count(*) FILTER (stock_quantity < 10) AS low_stock_products FROM prd""")
def _(t):
    return S.catalogue_summary(t.prd)


@plan("a33_daily_aggregate", """WITH f AS (SELECT customer_id, min(order_date)::DATE AS fd FROM ord GROUP BY 1),
  p AS (SELECT order_id, sum(quantity) AS u, sum(item_total * discount) AS d, sum(item_total * tax) AS x, count(*) AS l FROM itm GROUP BY 1),
  g AS (SELECT order_date::DATE AS day, payment_method, region, count(*) AS orders, count(DISTINCT customer_id) AS customers,
    count(DISTINCT CASE WHEN fd = order_date::DATE THEN customer_id END) AS new_customers, sum(total_amount)::DOUBLE AS gross,
    coalesce(sum(d)::DOUBLE, 0) AS discount, coalesce(sum(x)::DOUBLE, 0) AS tax, coalesce(sum(u)::DOUBLE, 0) AS units,
    coalesce(sum(l), 0)::BIGINT AS lines
    FROM ord LEFT JOIN p USING (order_id) JOIN f USING (customer_id) JOIN cst USING (customer_id) GROUP BY 1, 2, 3)
  SELECT *, customers - new_customers AS returning_customers, lines::DOUBLE / orders AS items_per_order, gross - discount AS net FROM g""")
def _(t):
    return S.daily_aggregate(t.ord, t.itm, t.cst, "payment_method", "region")


@plan("a34_monthly_customers", """WITH p AS (SELECT customer_id, date_trunc('month', order_date)::DATE AS month, count(*) AS n,
    sum(total_amount) AS v FROM ord GROUP BY 1, 2),
  r AS (SELECT *, lag(month) OVER w AS pv, lead(month) OVER w AS nx FROM p JOIN cst USING (customer_id)
    WINDOW w AS (PARTITION BY customer_id ORDER BY month)),
  a AS (SELECT month, region, count(*) AS active, count(*) FILTER (pv IS NULL) AS new_customers,
    count(*) FILTER (date_diff('month', pv, month) > 1) AS reactivated, count(*) FILTER (date_diff('month', pv, month) = 1) AS retained,
    sum(n)::BIGINT AS orders, sum(v)::DOUBLE AS revenue FROM r GROUP BY 1, 2),
  c AS (SELECT (month + INTERVAL 1 MONTH)::DATE AS month, region, count(*) AS churned FROM r
    WHERE nx IS NULL OR date_diff('month', month, nx) > 1 GROUP BY 1, 2)
  SELECT a.month, a.region, a.active, a.new_customers, a.reactivated, a.retained, a.orders, a.revenue,
  coalesce(c.churned, 0) AS churned, coalesce(a.retained * 100.0::DOUBLE / b.active, 0) AS retention_pct,
  a.orders::DOUBLE / a.active AS orders_per_customer
  FROM a LEFT JOIN c USING (month, region) LEFT JOIN a b ON b.region = a.region AND (b.month + INTERVAL 1 MONTH)::DATE = a.month""")
def _(t):
    return S.monthly_customers(t.ord, t.cst, "region")


def _moves(t):
    part = lambda test: F.when(test, F.col("quantity")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return t.itm.select("product_id", F.to_date("ship_date").alias("day"),
                        part(F.col("line_status") == "O").alias("received"),
                        part(F.col("return_flag") == "R").alias("returned"), F.col("quantity").alias("sold"))


_SNAP = """d AS (SELECT product_id, ship_date::DATE AS day, sum(CASE WHEN line_status = 'O' THEN quantity ELSE 0 END) AS received,
    sum(CASE WHEN return_flag = 'R' THEN quantity ELSE 0 END) AS returned, sum(quantity) AS sold FROM itm GROUP BY 1, 2),
  w AS (SELECT d.*, price, stock_quantity + sum(received + returned - sold) OVER (PARTITION BY product_id ORDER BY day) AS e
    FROM d JOIN prd USING (product_id)),
  snap AS (SELECT product_id, day, (e - (received + returned - sold))::DOUBLE AS beginning, received::DOUBLE AS received,
    returned::DOUBLE AS returned, sold::DOUBLE AS sold, e::DOUBLE AS ending, (e::DECIMAL(18,2) * price)::DOUBLE AS stock_value,
    e <= 0 AS stockout FROM w)"""


@plan("a35_inventory_snapshot", f"WITH {_SNAP} SELECT * FROM snap")
def _(t):
    return S.inventory_snapshot(_moves(t), t.prd)


@plan("a35_stock_turnover", f"""WITH {_SNAP}, g AS (SELECT product_id, count(*) AS days, count(*) FILTER (stockout) AS stockout_days,
    sum(sold::DECIMAL(18,2))::DOUBLE AS sold, sum(ending::DECIMAL(18,2))::DOUBLE / count(*) AS avg_stock FROM snap GROUP BY 1)
  SELECT *, CASE WHEN avg_stock <> 0 THEN sold / avg_stock END AS turnover,
  CASE WHEN sold <> 0 THEN avg_stock * days / sold END AS days_of_inventory FROM g""")
def _(t):
    return S.stock_turnover(S.inventory_snapshot(_moves(t), t.prd))


@plan("a37_platform_catalogue", """SELECT brand, count(*) AS products, sum(price)::DOUBLE / count(*) AS avg_price,
  sum(stock_quantity % 6)::DOUBLE / count(*) AS avg_rating FROM prd GROUP BY 1""")
def _(t):
    return S.platform_catalogue(t.prd.withColumn("rating", F.col("stock_quantity") % 6), "brand")


@plan("a38_run_metrics", f"""SELECT activity_type AS run_type, count(*) AS runs, sum(value)::DOUBLE / count(*) AS avg_duration,
  sum((props->>'$.k')::BIGINT)::BIGINT AS records, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS success_rate
  FROM act WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 100 HOUR GROUP BY 1""")
def _(t):
    runs = t.act.select("ts", F.col("activity_type").alias("run_type"), F.col("value").alias("duration"),
                        F.get_json_object("props", "$.k").cast("bigint").alias("records"))
    return S.run_metrics(runs, EVENTS_AS_OF, 100, F.col("duration") < 50)


@plan("a39_day_summary", f"""SELECT count(*) AS orders, count(DISTINCT customer_id) AS customers,
  count(*) FILTER (order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS recent_orders,
  sum(total_amount)::DOUBLE / count(*) AS avg_order_value, max(order_date) AS last_update FROM ord
  WHERE order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR""")
def _(t):
    return S.day_summary(t.ord, AS_OF, 72, 24)


def _day_bitmaps(t, member="customer_id"):
    return PR.presence(t.ord.select(F.to_date("order_date").alias("day"), member), ["day"], member)


@plan("a01_bitmap_totals", "SELECT (SELECT count(DISTINCT customer_id) FROM ord) AS customers, (SELECT count(DISTINCT order_id) FROM ord) AS orders")
def _(t):
    one = lambda member, name: PR.members(PR.coarser(_day_bitmaps(t, member)), (), name)
    return one("customer_id", "customers").withColumn("orders", one("order_id", "orders").scalar())


@plan("a30_bitmap_cube", """WITH d AS (SELECT order_date::DATE AS day, customer_id FROM ord)
  SELECT 'day' AS grain, day AS bucket, count(DISTINCT customer_id) AS members FROM d GROUP BY 2 UNION ALL SELECT 'month', date_trunc('month', day)::DATE, count(DISTINCT customer_id) FROM d GROUP BY 2
  UNION ALL SELECT 'year', date_trunc('year', day)::DATE, count(DISTINCT customer_id) FROM d GROUP BY 2 UNION ALL SELECT 'all', NULL::DATE, count(DISTINCT customer_id) FROM d""")
def _(t):
    return PR.cube(_day_bitmaps(t), "day")


@plan("a34_bitmap_retention", """WITH m AS (SELECT DISTINCT date_trunc('month', order_date)::DATE AS month, customer_id FROM ord), n AS (SELECT month, count(*) AS active FROM m GROUP BY 1),
  k AS (SELECT m.month, count(*) AS retained FROM m JOIN m p ON p.customer_id = m.customer_id AND p.month = (m.month - INTERVAL 1 MONTH)::DATE GROUP BY 1)
  SELECT n.month, n.active, coalesce(retained, 0) AS retained, round(coalesce(retained, 0)::DOUBLE / b.active, 6) AS retention_rate FROM n LEFT JOIN k USING (month) LEFT JOIN n b ON b.month = (n.month - INTERVAL 1 MONTH)::DATE""")
def _(t):
    return PR.retention(_day_bitmaps(t), "day")
