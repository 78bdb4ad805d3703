"""Queries for the product domain and KPI rules (D-15..D-25, D-42, D-43, D-45, D-47..D-53)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import products as P
from tillroll.plans.functions import sql_words
from tillroll.operators.table_functions import register_table_functions
from tillroll.plans.registry import plan
from tillroll.plans.tables import AS_OF
from tillroll.plans.windows import series

DAY = "2001-07-31"


def views(t):
    """Product views: view events; the product is the number in the JSON payload."""
    return t.act.where("activity_type = 'view'").select(F.get_json_object("props", "$.k").cast("bigint").alias("product_id"), "ts")


_SAL = "sal AS (SELECT * FROM itm JOIN ord USING (order_id))"
_VW = "vw AS (SELECT (props->>'$.k')::BIGINT AS product_id, count(*) AS view_count FROM act WHERE activity_type = 'view' GROUP BY 1)"


def _best(name, first, before, per_day, prev_end=True):
    end = f" AND order_date < {first}" if prev_end else ""
    return f"""{name}c AS (SELECT product_id, sum(quantity)::DOUBLE AS q, sum(item_total)::DOUBLE AS v, count(DISTINCT order_id) AS oc, count(DISTINCT customer_id) AS uc FROM sal WHERE order_date >= {first} GROUP BY 1),
  {name}p AS (SELECT product_id, sum(quantity)::DOUBLE AS pq FROM sal WHERE order_date >= {before}{end} GROUP BY 1),
  {name}r AS (SELECT product_id, product_name, category, brand, stock_quantity, q AS sales_volume, v AS revenue, oc AS order_count, uc AS unique_customers, coalesce(pq, 0) AS prev_sales_volume,
    coalesce(view_count, 0) AS view_count, round(CASE WHEN view_count > 0 THEN q * 100 / view_count ELSE 0 END, 2) AS conversion_rate,
    round((price - price * 0.6::DECIMAL(4,2))::DOUBLE / price::DOUBLE * 100, 2) AS profit_margin, pq, coalesce(pq, 0) AS z FROM prd JOIN {name}c USING (product_id) LEFT JOIN {name}p USING (product_id) LEFT JOIN vw USING (product_id)),
  {name}t AS (SELECT *, CASE WHEN z = 0 THEN CASE WHEN sales_volume > 0 THEN 100.0 ELSE 0.0 END::DOUBLE ELSE (sales_volume - z) * 100 / z END AS trend_percentage FROM {name}r),
  {name}b AS (SELECT *, CASE WHEN z = 0 AND sales_volume > 10 THEN 'explosive' WHEN z = 0 AND sales_volume > 0 THEN 'rising' WHEN z = 0 THEN 'stable' WHEN trend_percentage > 50 THEN 'explosive'
    WHEN trend_percentage > 10 THEN 'rising' WHEN trend_percentage < -30 THEN 'declining' WHEN trend_percentage < -10 THEN 'falling' ELSE 'stable' END AS trend_direction,
    row_number() OVER (ORDER BY sales_volume DESC, product_id) AS current_rank, floor(stock_quantity / (sales_volume / {per_day}))::INTEGER AS days_to_stockout,
    CASE WHEN pq IS NOT NULL THEN row_number() OVER (ORDER BY pq DESC NULLS LAST, product_id) END AS previous_rank FROM {name}t),
  {name} AS (SELECT * EXCLUDE (pq, z), coalesce(previous_rank - current_rank, 0) AS rank_change FROM {name}b)"""


_NOW = f"TIMESTAMP '{AS_OF}'"
_MONTH = _best("bm", f"{_NOW} - INTERVAL 1 MONTH", f"{_NOW} - INTERVAL 1 MONTH - INTERVAL 1 MONTH", 7)
_DAYB = _best("bd", f"{_NOW} - INTERVAL 1 DAY", f"{_NOW} - INTERVAL 1 DAY - INTERVAL 1 DAY", 1)


@plan("d15_best_sellers", f"WITH {_SAL}, {_VW}, {_MONTH} SELECT * FROM bm WHERE current_rank <= 50")
def _(t):
    return P.best_sellers(t.prd, t.sales, views(t), AS_OF, "month", 50)


@plan("d15_best_sellers_category", f"""WITH {_SAL.replace('USING (order_id)', "USING (order_id) JOIN (SELECT product_id FROM prd WHERE category = 'PROMO') USING (product_id)")}, {_VW}, {_MONTH} SELECT * FROM bm""")
def _(t):
    return P.best_sellers(t.prd, t.sales, views(t), AS_OF, "month", None, "PROMO")


@plan("d15_best_sellers_overlap", f"WITH {_SAL}, {_VW}, {_best('bo', _NOW + ' - INTERVAL 7 DAY', _NOW + ' - INTERVAL 1 DAY - INTERVAL 7 DAY', 7, False)} SELECT * FROM bo")
def _(t):
    return P.best_sellers(t.prd, t.sales, views(t), AS_OF, "week", None, overlap=True)


_TREND = """trd AS (SELECT product_id, product_name, category, sum(quantity)::DOUBLE AS current_sales, count(DISTINCT order_date::DATE) AS active_days, min(order_date) AS first_sale_date,
    max(order_date) AS last_sale_date FROM prd JOIN sal USING (product_id) WHERE order_date >= {now} - INTERVAL {days} DAY GROUP BY 1, 2, 3 HAVING sum(quantity) >= 5),
  trend AS (SELECT *, round(current_sales / greatest(active_days, 1) * 100, 2) AS growth_rate, round(CASE WHEN active_days >= 3 THEN current_sales * log10(current_sales + 1) / active_days ELSE current_sales END, 2) AS velocity_score,
    round(least(current_sales / 20.0::DOUBLE, 1) * least(active_days / 7.0::DOUBLE, 1), 2) AS confidence_score FROM trd)"""


@plan("d16_trending", f"WITH {_SAL}, {_TREND.format(now=_NOW, days=90)} SELECT * FROM trend ORDER BY velocity_score DESC, product_id LIMIT 200")
def _(t):
    return P.trending(t.prd, t.sales, AS_OF, 90, 5, 200)


_CATP = f"""cn AS (SELECT sal.*, category, view_count FROM sal JOIN prd USING (product_id) LEFT JOIN vw USING (product_id) WHERE order_date >= {_NOW} - INTERVAL 30 DAY),
  cp AS (SELECT category, product_id, sum(quantity) AS q FROM cn GROUP BY 1, 2), tp AS (SELECT DISTINCT ON (category) category, product_id AS top_product_id, q::DOUBLE AS top_product_sales FROM cp ORDER BY category, q DESC, product_id),
  pc AS (SELECT category, sum(quantity)::DOUBLE AS pq FROM sal JOIN prd USING (product_id) WHERE order_date >= {_NOW} - INTERVAL 60 DAY AND order_date < {_NOW} - INTERVAL 30 DAY GROUP BY 1),
  cg AS (SELECT category, count(DISTINCT product_id) AS total_products, count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS unique_customers, sum(quantity)::DOUBLE AS total_sales,
    sum(item_total)::DOUBLE AS total_revenue, round(avg(CASE WHEN view_count > 0 THEN quantity::DOUBLE / view_count * 100 ELSE 0 END), 4) AS avg_conversion_rate FROM cn GROUP BY 1),
  catp AS (SELECT cg.*, coalesce(pq, 0) AS prev_total_sales, round(CASE WHEN pq > 0 THEN (total_sales - pq) * 100 / pq ELSE 0 END, 4) AS growth_rate,
    total_revenue * 100 / (SELECT sum(item_total) FROM cn)::DOUBLE AS market_share, top_product_id, top_product_sales FROM cg JOIN tp USING (category) LEFT JOIN pc USING (category))"""


@plan("d17_category_performance", f"WITH {_SAL}, {_VW}, {_CATP} SELECT * FROM catp")
def _(t):
    return P.category_performance(t.prd, t.sales, views(t), AS_OF, 30)


@plan("d18_today_metrics", f"""WITH {_SAL}, c AS (SELECT category, sum(quantity) FILTER (order_date::DATE = DATE '{DAY}') AS a, sum(quantity) FILTER (order_date::DATE = DATE '{DAY}' - 1) AS y
    FROM sal JOIN prd USING (product_id) GROUP BY 1 HAVING a IS NOT NULL)
  SELECT count(DISTINCT order_id) AS total_orders, coalesce(sum(total_amount)::DOUBLE, 0) AS revenue, count(DISTINCT customer_id) AS active_customers,
  (SELECT product_id FROM sal WHERE order_date::DATE = DATE '{DAY}' GROUP BY 1 ORDER BY sum(quantity) DESC, product_id LIMIT 1) AS top_product_id,
  (SELECT category FROM c ORDER BY coalesce((a - y)::DOUBLE * 100 / y::DOUBLE, 100) DESC, category LIMIT 1) AS fastest_category FROM ord WHERE order_date::DATE = DATE '{DAY}'""")
def _(t):
    return P.today_metrics(t.prd, t.sales, t.ord, DAY)


@plan("d19_compare_periods", f"""WITH {_SAL}, {_VW}, {_MONTH}, {_best('bw', _NOW + ' - INTERVAL 7 DAY', _NOW + ' - INTERVAL 7 DAY - INTERVAL 7 DAY', 7)}
  SELECT 'month' AS period, sum(sales_volume) AS total_sales, round(sum(revenue), 2) AS total_revenue, round(coalesce(avg(conversion_rate) FILTER (conversion_rate > 0), 0), 6) AS avg_conversion FROM bm WHERE current_rank <= 20
  UNION ALL SELECT 'week', sum(sales_volume), round(sum(revenue), 2), round(coalesce(avg(conversion_rate) FILTER (conversion_rate > 0), 0), 6) FROM bw WHERE current_rank <= 20""")
def _(t):
    return P.compare_periods({f: P.best_sellers(t.prd, t.sales, views(t), AS_OF, f, 20) for f in ("month", "week")})


def tracking(t):
    """Daily tracking table: units sold per product and day with that product's views spread over the days."""
    return t.sales.groupBy("product_id", F.to_date("order_date").alias("tracking_date")).agg(
        F.sum("quantity").alias("sales_volume"), F.count_if(F.col("product_id") % 2 == 0).alias("views"))


def _velocity(days, hours):
    factor = 1.0 + (24.0 - hours) / 24.0 * 0.5
    return f"""tk AS (SELECT product_id, order_date::DATE AS d, sum(quantity) AS s, CASE WHEN product_id % 2 = 0 THEN count(*) ELSE 0 END AS w FROM sal GROUP BY 1, 2),
  vg AS (SELECT product_id, sum(s)::DOUBLE AS total_sales, sum(w)::BIGINT AS total_views FROM tk WHERE d >= DATE '{DAY}' - {days} GROUP BY 1),
  vb AS (SELECT *, CASE WHEN total_views > 0 THEN total_sales / {hours}.0::DOUBLE * (total_sales / total_views) * 100 ELSE total_sales / {hours}.0::DOUBLE END * {factor}::DOUBLE AS b FROM vg),
  vel AS (SELECT product_id, total_sales, total_views, round(CASE WHEN b > 10 THEN 10 + log10(b - 9) ELSE b END, 2) AS velocity_score FROM vb)"""


@plan("d20_velocity_scores", f"WITH {_SAL}, {_velocity(2, 48)} SELECT * FROM vel")
def _(t):
    return P.velocity_scores(tracking(t), DAY, 48)


_RANK = """rk AS (SELECT order_date::DATE AS date, product_id, sum(quantity)::DOUBLE AS sales_volume, sum(item_total)::DOUBLE AS revenue FROM sal GROUP BY 1, 2),
  rkn AS (SELECT rk.*, category, row_number() OVER (PARTITION BY date ORDER BY sales_volume DESC, product_id) AS rank_position FROM rk JOIN prd USING (product_id))"""


def ranking(t):
    return P.rankings(t.prd, t.sales)


@plan("d22_rankings", f"WITH {_SAL}, {_RANK} SELECT * FROM rkn WHERE rank_position <= 100")
def _(t):
    return P.rankings(t.prd, t.sales, limit=100)


_TRENDS = f"""WITH {_SAL}, {_RANK}, {_velocity(1, 24)}, j AS (SELECT c.product_id, c.sales_volume AS s, CASE WHEN p.sales_volume > 0 THEN (c.sales_volume - p.sales_volume) / p.sales_volume ELSE 1.0::DOUBLE END AS g, velocity_score
    FROM rkn c LEFT JOIN rkn p ON p.product_id = c.product_id AND p.date = c.date - 1 JOIN vel ON vel.product_id = c.product_id WHERE c.date = DATE '{DAY}' AND c.sales_volume >= 5)
  SELECT product_id, velocity_score, round(least(s / 20.0::DOUBLE, 1) * least(g + 0.5, 1), 6) AS confidence_score, CASE WHEN velocity_score > 50 AND g > 1.5 THEN 'explosive'
  WHEN velocity_score > 25 AND g > 1 THEN 'strong' WHEN velocity_score > 10 THEN 'moderate' ELSE 'weak' END AS trend_strength FROM j WHERE velocity_score > 5"""


@plan("d21_detect_trends", _TRENDS)
def _(t):
    return P.detect_trends(ranking(t), P.velocity_scores(tracking(t), DAY, 24), DAY)


@plan("u08_trending_products", _TRENDS)
def _(t):
    register_table_functions(t.spark, bestseller_rankings=ranking(t), velocity_scores=P.velocity_scores(tracking(t), DAY, 24))
    return t.spark.sql(f"SELECT * FROM detect_trending_products(DATE '{DAY}')")


_BOARD = """lagged AS (SELECT *, lag(date) OVER o = date - 1 AS has, lag(rank_position) OVER o AS pr, lag(sales_volume) OVER o AS pv FROM rkn WINDOW o AS (PARTITION BY product_id ORDER BY date)),
  brd AS (SELECT c.product_id, product_name, stock_quantity, c.date, rank_position, sales_volume, revenue, CASE WHEN has THEN pr END AS previous_rank, CASE WHEN has THEN rank_position - pr ELSE 0 END AS rank_change,
    CASE WHEN has AND pv > 0 THEN round((sales_volume - pv) / pv * 100, 2) ELSE 100 END AS growth_percentage,
    CASE WHEN stock_quantity <= 10 THEN 'critical' WHEN stock_quantity <= 50 THEN 'low' WHEN stock_quantity <= 100 THEN 'medium' ELSE 'good' END AS stock_status,
    round(stock_quantity / sales_volume, 1) AS days_to_stockout FROM lagged c JOIN prd ON prd.product_id = c.product_id WHERE rank_position <= 100)"""


@plan("d23_dashboard", f"WITH {_SAL}, {_RANK}, {_BOARD} SELECT * FROM brd")
def _(t):
    return P.dashboard(t.prd, ranking(t))


@plan("d23_category_comparison", f"""WITH {_SAL}, d AS (SELECT category, order_date::DATE AS date, sum(quantity)::DOUBLE AS total_sales, sum(item_total)::DOUBLE AS total_revenue FROM sal JOIN prd USING (product_id) GROUP BY 1, 2),
  j AS (SELECT c.*, p.total_sales AS prev_total_sales, p.total_revenue AS prev_total_revenue, coalesce((c.total_sales - p.total_sales) * 100 / nullif(p.total_sales, 0), 0) AS growth_rate
    FROM d c LEFT JOIN d p ON p.category = c.category AND p.date = c.date - 1 WHERE c.date = DATE '{DAY}')
  SELECT *, CASE WHEN growth_rate > 20 THEN 'excellent' WHEN growth_rate > 10 THEN 'good' WHEN growth_rate > 0 THEN 'positive' WHEN growth_rate > -10 THEN 'declining' ELSE 'poor' END AS performance_rating,
  rank() OVER (ORDER BY total_revenue DESC) AS revenue_rank, rank() OVER (ORDER BY growth_rate DESC) AS growth_rank FROM j""")
def _(t):
    return P.category_comparison(P.category_daily(t.prd, t.sales), DAY)


@plan("d23_trend_momentum", f"""WITH {_SAL}, {_TREND.format(now=_NOW, days=90)} SELECT product_id, velocity_score, confidence_score, floor((epoch({_NOW}) - epoch(first_sale_date)) / 86400)::BIGINT AS trend_duration_days,
  CASE WHEN velocity_score > 100 AND confidence_score > 0.7 THEN 'explosive' WHEN velocity_score > 50 AND confidence_score > 0.5 THEN 'strong' WHEN velocity_score > 20 THEN 'moderate' ELSE 'weak' END AS momentum_strength FROM trend""")
def _(t):
    from tillroll.functions.dates import whole_days
    tr = P.trending(t.prd, t.sales, AS_OF, 90, 5, None)
    return tr.select("product_id", "velocity_score", "confidence_score", whole_days(F.col("first_sale_date"), F.lit(AS_OF).cast("timestamp_ntz")).alias("trend_duration_days"),
                     P.momentum(F.col("velocity_score"), F.col("confidence_score")).alias("momentum_strength"))


@plan("d24_stock_alerts", f"""WITH {_SAL}, {_RANK}, {_BOARD} SELECT product_id, date, CASE WHEN stock_quantity <= 0 THEN 'stock_out' ELSE 'stock_low' END AS alert_type,
  CASE WHEN days_to_stockout <= 1 THEN 'critical' WHEN days_to_stockout <= 3 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN stock_quantity <= 0 THEN 'Sản phẩm bán chạy đã hết hàng' ELSE 'Sản phẩm bán chạy sắp hết hàng' END AS title,
  'Sản phẩm #' || rank_position || ' (' || product_name || ') chỉ còn ' || stock_quantity || ' sản phẩm, ước tính ' || coalesce(days_to_stockout::VARCHAR, 'N/A') || ' ngày hết hàng' AS description,
  CASE WHEN stock_quantity <= 0 THEN 1 ELSE 20 END AS threshold_value, stock_quantity AS actual_value,
  '{{"rank_position":' || rank_position || ',"daily_sales":' || sales_volume || ',"days_to_stockout":' || days_to_stockout || '}}' AS alert_data FROM brd WHERE stock_quantity <= 50 OR days_to_stockout <= 7""")
def _(t):
    return P.stock_alerts(P.dashboard(t.prd, ranking(t)))


@plan("d25_seller_insights", f"""WITH {_SAL}, {_VW}, {_MONTH}, {_TREND.format(now=_NOW, days=90)}, {_CATP}
  SELECT 'stock_alert' AS type, 'high' AS priority, product_id::VARCHAR AS subject, days_to_stockout::DOUBLE AS figure FROM bm WHERE current_rank <= 100 AND days_to_stockout BETWEEN 1 AND 3
  UNION ALL SELECT 'trending_opportunity', 'medium', product_id::VARCHAR, growth_rate FROM (SELECT * FROM trend ORDER BY velocity_score DESC, product_id LIMIT 100) WHERE confidence_score > 0.7 AND growth_rate > 100
  UNION ALL SELECT 'category_growth', 'medium', category, growth_rate FROM (SELECT * FROM catp ORDER BY growth_rate DESC, category LIMIT 1) WHERE growth_rate > 50""")
def _(t):
    return P.seller_insights(P.best_sellers(t.prd, t.sales, views(t), AS_OF, "month", 100), P.trending(t.prd, t.sales, AS_OF, 90, 5, 100),
                             P.category_performance(t.prd, t.sales, views(t), AS_OF, 30))


@plan("d42_kpi_rules", """WITH k AS (SELECT sum(total_amount)::DOUBLE AS r, sum(total_amount)::DOUBLE / count(*) AS a, count(DISTINCT order_id)::DOUBLE / count(DISTINCT customer_id) AS o,
    (SELECT count(DISTINCT category) FROM prd) AS c FROM ord)
  SELECT 'opportunity' AS type, 'high' AS priority, 'Tăng Doanh Thu' AS title, r AS metric_value, 1000000.0::DOUBLE AS target_value FROM k WHERE r < 1000000
  UNION ALL SELECT 'action', 'medium', 'Tăng Giá Trị Đơn Hàng Trung Bình', a, 500000 FROM k WHERE a < 500000
  UNION ALL SELECT 'alert', 'high', 'Tỷ Lệ Khách Hàng Quay Lại Thấp', o, 3 FROM k WHERE o < 2
  UNION ALL SELECT 'opportunity', 'medium', 'Mở Rộng Danh Mục Sản Phẩm', NULL, NULL FROM k WHERE c < 10""")
def _(t):
    return P.kpi_rules(t.ord, t.prd.agg(F.countDistinct("category").alias("n")).scalar())


@plan("d43_business_insights", f"""WITH {_SAL}, m AS (SELECT date_trunc('month', order_date) AS m, sum(total_amount)::DOUBLE AS v FROM ord GROUP BY 1),
  c AS (SELECT customer_id, sum(total_amount) AS v, count(DISTINCT order_id) AS n FROM ord GROUP BY 1), y AS (SELECT month(order_date)::INTEGER AS m, sum(total_amount) AS v FROM ord GROUP BY 1)
  SELECT (SELECT sum(total_amount)::DOUBLE FROM ord) AS total_revenue, (SELECT round(avg(m.v / p.v - 1) * 100, 6) FROM m JOIN m p ON p.m + INTERVAL 1 MONTH = m.m) AS monthly_growth_pct,
  (SELECT sum(v)::DOUBLE / count(*) FROM c) AS avg_customer_value, (SELECT count(*) FILTER (n > 1) * 100.0::DOUBLE / (SELECT count(*) FROM cst) FROM c) AS repeat_rate_pct,
  (SELECT category FROM sal JOIN prd USING (product_id) GROUP BY 1 ORDER BY sum(quantity) DESC, 1 LIMIT 1) AS bestseller_category, (SELECT count(*) FROM prd WHERE stock_quantity < 10) AS low_stock_products,
  (SELECT m FROM y ORDER BY v DESC, m LIMIT 1) AS best_month, (SELECT m FROM y ORDER BY v, m LIMIT 1) AS worst_month""")
def _(t):
    return P.business_insights(t.ord, t.sales, t.prd, t.cst)


@plan("d45_season_impact", """SELECT CASE WHEN month(order_date) * 100 + day(order_date) BETWEEN 120 AND 220 THEN 'Mùa Tết' ELSE 'Bình thường' END AS period_type, count(*) AS total_orders,
  sum(total_amount)::DOUBLE AS total_revenue, sum(total_amount)::DOUBLE / count(*) AS avg_order_value FROM ord WHERE year(order_date) = 2000 GROUP BY 1""")
def _(t):
    return P.season_impact(t.ord, 2000)


@plan("d45_platform_share", """SELECT platform, count(*) AS actual_orders, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS order_share, sum(total_amount_vnd)::BIGINT AS gmv_vnd,
  sum(total_amount_vnd)::DOUBLE * 100 / sum(sum(total_amount_vnd)) OVER ()::DOUBLE AS gmv_share FROM sev WHERE year(order_timestamp) = 2000 GROUP BY 1""")
def _(t):
    return P.platform_share(t.sev, 2000)


@plan("d47_popularity", """WITH g AS (SELECT product_id, coalesce(sum(quantity)::DOUBLE, 0) AS sold, coalesce(sum(item_total)::DOUBLE, 0) AS rev FROM prd LEFT JOIN itm USING (product_id) GROUP BY 1),
  p AS (SELECT product_id, sold, rev, (stock_quantity % 11) / 2.0::DOUBLE AS rating, stock_quantity AS reviews FROM g JOIN prd USING (product_id)),
  s AS (SELECT *, sold * 0.4::DOUBLE + rating * 0.3::DOUBLE + reviews * 0.3::DOUBLE AS popularity_score FROM p)
  SELECT product_id, round(popularity_score, 6) AS popularity_score, round(popularity_score * 0.4::DOUBLE + rating * reviews * 0.3::DOUBLE + coalesce(rev / nullif(sold, 0), 0) * 0.3::DOUBLE, 6) AS recommendation_score FROM s""")
def _(t):
    g = t.itm.groupBy("product_id").agg(F.sum("quantity").cast("double").alias("s"), F.sum("item_total").cast("double").alias("v"))
    rows = t.prd.join(g, "product_id", "left")
    sold, rating = F.coalesce("s", F.lit(0.0)), (F.col("stock_quantity") % 11) / F.lit(2.0)
    pop = P.popularity(sold, rating, F.col("stock_quantity"))
    each = F.coalesce(F.try_divide(F.coalesce("v", F.lit(0.0)), sold), F.lit(0.0))
    return rows.select("product_id", F.round(pop, 6).alias("popularity_score"),
                       F.round(P.recommendation_score(pop, rating, F.col("stock_quantity"), each), 6).alias("recommendation_score"))


@plan("d47_clv_features", f"""WITH g AS (SELECT customer_id, count(*) AS n, sum(total_amount)::DOUBLE AS v, date_diff('day', min(order_date), {_NOW})::INTEGER AS a, date_diff('day', max(order_date), {_NOW})::INTEGER AS l FROM ord GROUP BY 1)
  SELECT customer_id, n AS total_orders, v AS total_spent, v / greatest(n, 1) AS average_order_value, a AS customer_age_days, l AS days_since_last_order, (l <= 30)::INTEGER AS active_last_30d,
  a / greatest(n, 1) AS avg_days_between_orders, v / greatest(a, 1) AS spending_velocity FROM g""")
def _(t):
    return P.clv_features(t.ord, AS_OF)


_PR = """((rank() OVER ({w} ORDER BY price) + (count(*) OVER (PARTITION BY {p}price) - 1) / 2.0::DOUBLE) / count(*) OVER ({w}))"""
_FEAT = f"""b AS (SELECT *, (stock_quantity % 11) / 2.0::DOUBLE AS rating FROM prd), e AS (SELECT quantile_cont(price::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS q FROM b),
  cs AS (SELECT category, sum(price)::DOUBLE / count(*) AS m, count(*) AS n, round(stddev_samp(price::DOUBLE), 4) AS s, quantile_cont(price::DOUBLE, 0.5) AS d, quantile_cont(price::DOUBLE, 0.75) AS q75,
    sum(rating::DECIMAL(18,2))::DOUBLE / count(*) AS rm FROM b GROUP BY 1),
  bs AS (SELECT brand, count(*) AS bn FROM b GROUP BY 1), be AS (SELECT list_distinct(quantile_cont(bn::DOUBLE, [1/3.0::DOUBLE, 2/3.0::DOUBLE])) AS q3, min(bn) AS lo3 FROM b JOIN bs USING (brand))"""


@plan("d48_product_features", f"""WITH {_FEAT} SELECT product_id, brand, category, product_name, rating, price::DOUBLE AS price, {_PR.format(w='', p='')} AS price_percentile,
  {_PR.format(w='PARTITION BY category', p='category, ')} AS price_rank_in_category, CASE WHEN price::DOUBLE <= q[1] THEN 'Very Low' WHEN price::DOUBLE <= q[2] THEN 'Low' WHEN price::DOUBLE <= q[3] THEN 'Medium'
  WHEN price::DOUBLE <= q[4] THEN 'High' ELSE 'Very High' END AS price_category, m AS price_mean, n AS price_count, s AS price_std, round(d, 6) AS price_median, price::DOUBLE / m AS price_vs_mean,
  round(price::DOUBLE / d, 6) AS price_vs_median, price::DOUBLE - m AS price_minus_mean, rm AS category_rating_mean, n / (SELECT count(*) FROM b) AS category_market_share, bn AS brand_product_count,
  ['Small', 'Medium', 'Large'][1 + len(list_filter(q3, lambda x: bn > x AND x > lo3))::INTEGER] AS brand_size_category, (price::DOUBLE > q75)::INTEGER AS is_premium_in_category, round(ln(1 + price::DOUBLE), 6) AS log_price,
  CASE WHEN rating <= 0 THEN NULL WHEN rating <= 2 THEN 'Poor' WHEN rating <= 3 THEN 'Fair' WHEN rating <= 4 THEN 'Good' WHEN rating <= 4.5 THEN 'Very Good' ELSE 'Excellent' END AS rating_tier,
  rating - rm AS rating_vs_category_avg, price::DOUBLE / (rating + 1) AS price_rating_ratio, round(rating / (ln(1 + price::DOUBLE) + 1), 6) AS value_score, length(product_name)::INTEGER AS name_length,
  len({sql_words('product_name')})::INTEGER AS name_word_count, length(replace(product_name, ' ', ''))::DOUBLE / len({sql_words('product_name')}) AS avg_word_length,
  regexp_matches(product_name, '[0-9]')::INTEGER AS name_contains_numbers, regexp_matches(product_name, '[^a-zA-Z0-9\\s]')::INTEGER AS name_has_special_chars,
  price::DOUBLE / (len({sql_words('product_name')}) + 1) AS price_per_word FROM b JOIN cs USING (category) JOIN bs USING (brand), e, be""")
def _(t):
    rows = t.prd.select("product_id", "brand", "category", "product_name", F.col("price").cast("decimal(18,2)").alias("price"),
                        ((F.col("stock_quantity") % 11) / F.lit(2.0)).cast("decimal(18,2)").alias("rating"))
    out = P.product_features(rows)
    return out.withColumns({"price": F.col("price").cast("double"), "price_median": F.round("price_median", 6), "price_vs_median": F.round("price_vs_median", 6)}).withColumns(
        {c: F.col(c).cast("double") for c in ("rating", "rating_vs_category_avg", "price_rating_ratio", "value_score")})


@plan("d49_source_reliability", """SELECT payment_method, 1 - (count(*) FILTER (order_id % 7 = 0) + count(*) FILTER (order_id % 5 = 0))::DOUBLE / (count(*) * 3)::DOUBLE AS source_reliability_score FROM ord GROUP BY 1""")
def _(t):
    k = F.col("order_id")
    rows = t.ord.select("payment_method", F.when(k % 7 != 0, F.col("total_amount")).alias("a"), F.when(k % 5 != 0, F.col("order_date")).alias("b"))
    return P.source_reliability(rows, "payment_method")


_SEASON = "[" + ", ".join(map(str, P.SEASONAL)) + "][month(ship_date)]::DOUBLE"


@plan("d51_estimated_sales", f"""WITH e AS (SELECT ship_date::DATE AS day, category, (round(line_number * 10 * 0.1::DOUBLE + 1000.0::DOUBLE / price::DOUBLE, 0) * {_SEASON})::DECIMAL(18,2) AS s, price, line_number * 10 AS nr
    FROM itm JOIN prd USING (product_id)) SELECT day, category, sum(s)::DOUBLE AS estimated_sales, sum(price)::DOUBLE / count(*) AS avg_price, sum(nr)::BIGINT AS num_reviews FROM e GROUP BY 1, 2""")
def _(t):
    rows = t.itm.join(t.prd, "product_id").withColumn("num_reviews", F.col("line_number") * 10)
    return P.estimated_sales(rows, "ship_date")


_SER = """ser AS (SELECT category, order_date::DATE AS day, sum(item_total)::DOUBLE AS y FROM itm JOIN ord USING (order_id) JOIN prd USING (product_id) GROUP BY 1, 2)"""


@plan("d52_forecast_insights", f"""WITH {_SER}, d AS (SELECT *, y::DECIMAL(18,2) AS c FROM ser) SELECT count(DISTINCT day) AS forecast_days, count(DISTINCT category) AS categories, sum(c)::DOUBLE / count(*) AS avg_daily,
  sum(c)::DOUBLE AS total, sum(c) FILTER (isodow(day) < 6)::DOUBLE / count(*) FILTER (isodow(day) < 6) AS weekday_avg, sum(c) FILTER (isodow(day) >= 6)::DOUBLE / count(*) FILTER (isodow(day) >= 6) AS weekend_avg FROM d""")
def _(t):
    return P.forecast_insights(series(t))


@plan("d52_top_categories", f"""WITH {_SER}, d AS (SELECT category, sum(y::DECIMAL(18,2)) AS s, count(*) AS n FROM ser GROUP BY 1)
  SELECT category, s::DOUBLE AS total, ((s * 200)::HUGEINT + n) // (2 * n) / 100.0::DOUBLE AS mean FROM d ORDER BY total DESC, category LIMIT 3""")
def _(t):
    return P.top_categories(series(t))


@plan("d52_month_pattern", f"WITH {_SER} SELECT month(day)::INTEGER AS month, sum(y::DECIMAL(18,2))::DOUBLE / count(*) AS mean FROM ser GROUP BY 1")
def _(t):
    return P.month_pattern(series(t))


@plan("d53_customer_stats", f"""WITH {_SAL} SELECT customer_id, sum(item_total)::DOUBLE AS total_spent, ((sum(item_total) * 200)::HUGEINT + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS avg_line_value,
  count(*) AS total_lines, count(DISTINCT order_id) AS unique_orders FROM sal GROUP BY 1""")
def _(t):
    return P.customer_stats(t.sales)


@plan("d53_spend_by_age_bin", f"""WITH {_SAL}, c AS (SELECT customer_id, sum(item_total) AS v, 18 + customer_id % 60 AS age FROM sal GROUP BY 1), e AS (SELECT min(age)::DOUBLE AS lo, max(age)::DOUBLE AS hi FROM c)
  SELECT least(5, greatest(1, ceil((age - lo) / ((hi - lo) / 5))))::INTEGER AS age_bin, count(*) AS customers, sum(v)::DOUBLE / count(*) AS avg_spent FROM c, e GROUP BY 1""")
def _(t):
    return P.spend_by_age_bin(t.sales, t.cst.withColumn("age", 18 + F.col("customer_id") % 60))
