"""Queries for ranks, bins, series and top-k (W-01..W-18, T-01..T-06, S-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import windows as W
from tillroll.plans.registry import plan

_SPEND = """s AS (SELECT customer_id, count(*) AS orders, sum(total_amount)::DOUBLE AS spent,
  date_diff('day', max(order_date), TIMESTAMP '2001-08-01')::INTEGER AS recency FROM ord GROUP BY 1)"""


def spend(t):
    return t.ord.groupBy("customer_id").agg(
        F.count("*").alias("orders"), F.sum("total_amount").cast("double").alias("spent"),
        F.datediff(F.lit("2001-08-01").cast("date"), F.max("order_date")).alias("recency"))


@plan("w01_ntile_scores", f"""WITH {_SPEND} SELECT *, ntile(5) OVER (ORDER BY recency, customer_id)::INTEGER AS recency_score,
  ntile(5) OVER (ORDER BY orders DESC, customer_id)::INTEGER AS frequency_score,
  ntile(5) OVER (ORDER BY spent DESC, customer_id)::INTEGER AS monetary_score FROM s""")
def _(t):
    out = W.ntile_score(spend(t), "recency", "customer_id", "recency_score")
    out = W.ntile_score(out, "orders", "customer_id", "frequency_score", descending=True)
    return W.ntile_score(out, "spent", "customer_id", "monetary_score", descending=True)


@plan("w02_rank_quintile", f"""WITH {_SPEND}, r AS (SELECT *, row_number() OVER (ORDER BY orders, customer_id) AS rn, count(*) OVER () AS n FROM s)
  SELECT customer_id, orders, spent, recency, greatest(1, ceil((rn - 1) * 5 / (n - 1)::DOUBLE))::INTEGER AS frequency_score,
  (6 - greatest(1, ceil((rn2 - 1) * 5 / (n - 1)::DOUBLE)))::INTEGER AS recency_score
  FROM (SELECT *, row_number() OVER (ORDER BY recency, customer_id) AS rn2 FROM r)""")
def _(t):
    out = W.rank_quintile(spend(t), "orders", "customer_id", "frequency_score")
    return W.rank_quintile(out, "recency", "customer_id", "recency_score", reverse=True)


@plan("w03_sales_rank", """WITH g AS (SELECT product_id, sum(quantity)::DOUBLE AS quantity FROM itm GROUP BY 1)
  SELECT *, row_number() OVER (ORDER BY quantity DESC, product_id) AS rank_position FROM g""")
def _(t):
    return W.sales_rank(t.itm, "product_id", "quantity")


@plan("w04_rank_measures", """WITH g AS (SELECT product_id, sum(quantity)::DOUBLE AS units, count(*) AS lines FROM itm GROUP BY 1)
  SELECT *, rank() OVER (ORDER BY units DESC) AS units_rank, rank() OVER (ORDER BY lines DESC) AS lines_rank FROM g""")
def _(t):
    g = t.itm.groupBy("product_id").agg(F.sum("quantity").cast("double").alias("units"), F.count("*").alias("lines"))
    return W.rank_measures(g, "product_id", ["units", "lines"])


@plan("w05_latest_per_key", """SELECT DISTINCT ON (customer_id) customer_id, activity_type, ts FROM act
  ORDER BY customer_id, ts DESC, event_id DESC""")
def _(t):
    from tillroll.operators.load import newest_per_key
    rows = t.act.select("customer_id", "activity_type", "ts", "event_id")
    return newest_per_key(rows, ["customer_id"], ["ts", "event_id"]).drop("event_id")


@plan("w06_mean_gap", """WITH g AS (SELECT customer_id, date_diff('day', order_date,
    lead(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id)) AS d FROM ord)
  SELECT customer_id, count(*) AS orders, sum(d)::DOUBLE / nullif(count(d), 0) AS avg_days_to_next FROM g GROUP BY 1""")
def _(t):
    return W.mean_gap(t.ord, "customer_id", "order_date", "order_id")


_PCT = """((rank() OVER ({w} ORDER BY price) + (count(*) OVER (PARTITION BY {p}price) - 1) / 2.0::DOUBLE) / count(*) OVER ({w}))"""


@plan("w07_percent_rank", f"""SELECT product_id, category, price::DOUBLE AS price, {_PCT.format(w='', p='')} AS pct_rank,
  {_PCT.format(w='PARTITION BY category', p='category, ')} AS pct_rank_in_category FROM prd""")
def _(t):
    rows = t.prd.select("product_id", "category", F.col("price").cast("double").alias("price"))
    return W.percent_rank(W.percent_rank(rows, "price"), "price", ["category"], "pct_rank_in_category")


@plan("w09_above_quantile", """WITH q AS (SELECT category, quantile_cont(price::DOUBLE, 0.75) AS e FROM prd GROUP BY 1)
  SELECT product_id, category, price::DOUBLE AS price, (price::DOUBLE > e)::INTEGER AS is_premium FROM prd JOIN q USING (category)""")
def _(t):
    rows = t.prd.select("product_id", "category", F.col("price").cast("double").alias("price"))
    return W.above_quantile(rows, "price", "category", 0.75, "is_premium")


@plan("w10_nested_shares", """WITH g AS (SELECT region, payment_method, count(*) AS n FROM ord JOIN cst USING (customer_id) GROUP BY 1, 2)
  SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY region) AS share_of_group_pct,
  n * 100.0::DOUBLE / sum(n) OVER () AS share_of_all_pct FROM g""")
def _(t):
    return W.nested_shares(t.ord.join(t.cst, "customer_id"), "region", "payment_method")


_SERIES = """s AS (SELECT category, order_date::DATE AS day, sum(item_total)::DOUBLE AS y FROM itm JOIN ord USING (order_id)
  JOIN prd USING (product_id) GROUP BY 1, 2)"""


def series(t):
    return W.daily_series(t.sales.join(t.prd, "product_id"), "category", "order_date", "item_total")


@plan("w11_lag_features", f"""WITH {_SERIES} SELECT *, lag(y, 1) OVER w AS y_lag_1, lag(y, 7) OVER w AS y_lag_7,
  lag(y, 30) OVER w AS y_lag_30 FROM s WINDOW w AS (PARTITION BY category ORDER BY day)""")
def _(t):
    return W.lag_features(series(t), "category")


def _roll(n, full):
    w = f"(PARTITION BY category ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    mean = f"sum(y::DECIMAL(18,2)) OVER {w}::DOUBLE / count(y) OVER {w}"
    return (f"CASE WHEN count(y) OVER {w} >= {n} THEN {mean} END" if full else mean) + f" AS y_ma_{n}"


@plan("w12_rolling_full", f"WITH {_SERIES} SELECT *, {_roll(7, True)}, {_roll(30, True)} FROM s")
def _(t):
    return W.rolling_means(series(t), "category")


@plan("w12_rolling_partial", f"WITH {_SERIES} SELECT *, {_roll(7, False)}, {_roll(30, False)} FROM s")
def _(t):
    return W.rolling_means(series(t), "category", full=False)


@plan("w13_month_over_month", """WITH m AS (SELECT date_trunc('month', order_date)::DATE AS month, sum(total_amount)::DOUBLE AS value FROM ord GROUP BY 1)
  SELECT m.*, p.value AS previous, m.value / p.value - 1 AS change FROM m LEFT JOIN m p ON (p.month + INTERVAL 1 MONTH)::DATE = m.month""")
def _(t):
    return W.month_over_month(t.ord, "order_date", "total_amount")


@plan("w14_rank_change", """WITH d AS (SELECT product_id, order_date::DATE AS day, sum(quantity)::DOUBLE AS units FROM itm JOIN ord USING (order_id) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY units DESC, product_id) AS rank_position FROM d),
  l AS (SELECT *, lag(day) OVER o = day - 1 AS has, lag(rank_position) OVER o AS pr, lag(units) OVER o AS pu FROM r WINDOW o AS (PARTITION BY product_id ORDER BY day))
  SELECT product_id, day, units, rank_position, CASE WHEN has THEN pr END AS previous_rank, CASE WHEN has THEN pr - rank_position ELSE 0 END AS rank_change,
  round(CASE WHEN has AND pu > 0 THEN (units - pu) / pu * 100 ELSE 100 END, 6) AS growth_pct FROM l""")
def _(t):
    d = t.sales.groupBy("product_id", F.to_date("order_date").alias("day")).agg(F.sum("quantity").cast("double").alias("units"))
    return W.rank_change(d, "product_id", "day", "units")


@plan("w15_end_trend", f"""WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY day) AS a,
    row_number() OVER (PARTITION BY category ORDER BY day DESC) AS b FROM s),
  g AS (SELECT category, count(*) AS points, sum(y::DECIMAL(18,2)) FILTER (a <= 3)::DOUBLE / count(*) FILTER (a <= 3) AS earlier_avg,
    sum(y::DECIMAL(18,2)) FILTER (b <= 3)::DOUBLE / count(*) FILTER (b <= 3) AS recent_avg FROM r GROUP BY 1),
  c AS (SELECT *, coalesce((recent_avg - earlier_avg) * 100 / nullif(earlier_avg, 0), 0) AS change_percent FROM g)
  SELECT *, CASE WHEN points < 2 THEN 'insufficient_data' WHEN change_percent > 10 THEN 'increasing'
  WHEN change_percent < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM c""")
def _(t):
    return W.end_trend(series(t), "category")


def _bin_sql(value, edges, labels):
    cases = " ".join(f"WHEN {value} <= {e} THEN '{lab}'" for e, lab in zip(edges, labels))
    return f"CASE {cases} ELSE '{labels[-1]}' END"


_Q5 = """e AS (SELECT quantile_cont(price::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS q FROM prd)"""


@plan("w16_value_bins", f"""WITH {_Q5} SELECT product_id, price::DOUBLE AS price, {_bin_sql('price::DOUBLE', [f'q[{i}]' for i in (1, 2, 3, 4)],
  W.QUINTILE_LABELS)} AS price_bin FROM prd, e""")
def _(t):
    rows = t.prd.select("product_id", F.col("price").cast("double").alias("price"))
    return W.value_bins(rows, "price", "price_bin", W.QUINTILE_LABELS)


@plan("w16_value_bins_ties", """WITH c AS (SELECT brand, count(*) AS n FROM prd GROUP BY 1), r AS (SELECT product_id, n FROM prd JOIN c USING (brand)),
  e AS (SELECT list_distinct(quantile_cont(n::DOUBLE, [1/3.0::DOUBLE, 2/3.0::DOUBLE])) AS q, min(n) AS lo FROM r)
  SELECT product_id, n, ['Small', 'Medium', 'Large'][1 + len(list_filter(q, lambda x: n > x AND x > lo))::INTEGER] AS brand_size FROM r, e""")
def _(t):
    n = t.prd.groupBy("brand").agg(F.count("*").alias("n"))
    rows = t.prd.select("product_id", "brand").join(n, "brand").drop("brand")
    return W.value_bins(rows, "n", "brand_size", ["Small", "Medium", "Large"])


@plan("w17_width_bins", """WITH e AS (SELECT min(balance)::DOUBLE AS lo, max(balance)::DOUBLE AS hi FROM cst)
  SELECT customer_id, balance::DOUBLE AS balance, least(5, greatest(1, ceil((balance::DOUBLE - lo) / ((hi - lo) / 5))))::INTEGER AS balance_bin FROM cst, e""")
def _(t):
    rows = t.cst.select("customer_id", F.col("balance").cast("double").alias("balance"))
    return W.width_bins(rows, "balance", "balance_bin")


RATING_EDGES = [0.0, 2.0, 3.0, 4.0, 4.5, 5.0]
RATING_LABELS = ["Poor", "Fair", "Good", "Very Good", "Excellent"]


@plan("w18_fixed_bins", """SELECT product_id, (stock_quantity % 11) / 2.0::DOUBLE AS rating, CASE WHEN (stock_quantity % 11) / 2.0 <= 0 THEN NULL
  WHEN (stock_quantity % 11) / 2.0 <= 2 THEN 'Poor' WHEN (stock_quantity % 11) / 2.0 <= 3 THEN 'Fair' WHEN (stock_quantity % 11) / 2.0 <= 4 THEN 'Good'
  WHEN (stock_quantity % 11) / 2.0 <= 4.5 THEN 'Very Good' ELSE 'Excellent' END AS rating_tier FROM prd""")
def _(t):
    rows = t.prd.select("product_id", ((F.col("stock_quantity") % 11) / F.lit(2.0)).alias("rating"))
    return rows.withColumn("rating_tier", W.fixed_bins(F.col("rating"), RATING_EDGES, RATING_LABELS))


@plan("t01_top_products", "SELECT product_id, sum(item_total)::DOUBLE AS item_total FROM itm GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return W.top_k(t.itm, "product_id", "item_total", 10)


@plan("t01_top_customers", "SELECT customer_id, sum(total_amount)::DOUBLE AS total_amount FROM ord GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return W.top_k(t.ord, "customer_id", "total_amount", 20)


_TOPCAT = """g AS (SELECT category, product_id, sum(quantity)::DOUBLE AS units, sum(item_total)::DOUBLE AS revenue
  FROM itm JOIN prd USING (product_id) GROUP BY 1, 2)"""


def _topcat(t):
    return t.itm.join(t.prd, "product_id").groupBy("category", "product_id").agg(
        F.sum("quantity").cast("double").alias("units"), F.sum("item_total").cast("double").alias("revenue"))


@plan("t02_top_per_category", f"""WITH {_TOPCAT}, s AS (SELECT *, units * 0.3::DOUBLE + revenue * 0.7::DOUBLE AS score FROM g)
  SELECT *, (row_number() OVER (PARTITION BY category ORDER BY score DESC, product_id))::INTEGER AS position FROM s
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, product_id) <= 5""")
def _(t):
    return W.top_k_per_group(_topcat(t), "category", "product_id",
                             F.col("units") * 0.3 + F.col("revenue") * 0.7, 5)


@plan("t03_best_per_category", f"""WITH {_TOPCAT} SELECT DISTINCT ON (category) category, product_id, units FROM g ORDER BY category, units DESC, product_id""")
def _(t):
    return W.best_per_group(_topcat(t), "category", "product_id", "units")


@plan("t04_page", """SELECT customer_id, balance::DOUBLE AS balance FROM cst ORDER BY balance DESC, customer_id LIMIT 50 OFFSET 100""")
def _(t):
    rows = t.cst.select("customer_id", F.col("balance").cast("double").alias("balance"))
    return W.page(rows, [F.desc("balance"), F.asc("customer_id")], 50, 100)


@plan("t05_value_counts", "SELECT brand, count(*) AS n FROM prd GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return W.value_counts(t.prd, "brand", 10)


@plan("t06_recent_per_topic", """SELECT activity_type, event_id, ts FROM act
  QUALIFY row_number() OVER (PARTITION BY activity_type ORDER BY ts DESC, event_id DESC) <= 1000""")
def _(t):
    return W.recent_per_topic(t.act.select("activity_type", "event_id", "ts"), "activity_type", "ts", "event_id", 1000)


@plan("s02_hits", """WITH r AS (SELECT DISTINCT customer_id, product_id FROM ord JOIN itm USING (order_id) WHERE order_date < '2000-01-01'),
  a AS (SELECT DISTINCT customer_id, product_id FROM ord JOIN itm USING (order_id) WHERE order_date >= '2000-01-01')
  SELECT customer_id, count(*) AS hits FROM r JOIN a USING (customer_id, product_id) GROUP BY 1""")
def _(t):
    return W.hits(t.sales.where("order_date < '2000-01-01'"), t.sales.where("order_date >= '2000-01-01'"),
                  "customer_id", "product_id")


@plan("g14_mode_per_group", """WITH c AS (SELECT category, stock_quantity, count(*) AS n FROM prd GROUP BY 1, 2)
  SELECT DISTINCT ON (category) category, stock_quantity AS mode FROM c ORDER BY category, n DESC, stock_quantity""")
def _(t):
    return W.most_frequent(t.prd, "category", "stock_quantity")
