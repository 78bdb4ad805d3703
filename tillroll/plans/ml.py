"""Queries for the ML pipelines and user functions (M-01..M-22, U-01, U-02, U-05, U-07).

Fitted models have no SQL twin and are checked for rows and metric floors; metrics, similarity and error
tables are compared with SQL.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tillroll.ml import models as M
from tillroll.ml import recommend as R
from tillroll.ml import udf as U
from tillroll.operators.customers import recency_profile
from tillroll.plans.registry import plan
from tillroll.plans.windows import _SERIES, series
from tillroll.session import pin

_NUM = ["recency", "frequency", "monetary"]


def profile(t):
    return recency_profile(t.ord).withColumn("frequency", F.col("frequency").cast("double")).withColumn("recency", F.col("recency").cast("double"))


def goods(t):
    return t.prd.select("product_id", "brand", "category", F.col("stock_quantity").cast("double").alias("size"), F.length("product_name").cast("double").alias("name_length"),
                        F.col("price").cast("double").alias("price"))


def buyers(t):
    """Customer features from the orders before 2001 and their spend after."""
    old = t.ord.where("order_date < '2001-01-01'").groupBy("customer_id").agg(
        F.count("*").cast("double").alias("orders"), F.sum("total_amount").cast("double").alias("spent"), F.avg(F.col("total_amount").cast("double")).alias("aov"),
        F.datediff(F.lit("2001-01-01").cast("date"), F.max("order_date")).cast("double").alias("recency"))
    new = t.ord.where("order_date >= '2001-01-01'").groupBy("customer_id").agg(F.sum("total_amount").cast("double").alias("future"))
    return old.join(new, "customer_id", "left").fillna(0.0, ["future"])


@plan("m01_prepare")
def _(t):
    from pyspark.ml.functions import vector_to_array
    _, out = M.prepare(goods(t), ["size", "name_length", "price"], ["brand", "category"])
    return out.select("product_id", vector_to_array("features").alias("features"))


@plan("m02_price_regression")
def _(t):
    train, test = M.split(goods(t), "product_id")
    name, model, _ = M.fit_best(train, "price", M.regressors("price", 10, 5), M.preparation(["size", "name_length"], ["brand", "category"], scale=False))
    return model.transform(test).select("product_id", "price", F.col("prediction"), F.lit(name).alias("model"))


@plan("m03_clusters")
def _(t):
    _, out, _ = M.best_kmeans(profile(t), _NUM, range(3, 6))
    return M.cluster_profiles(out)


@plan("m04_calinski_harabasz")
def _(t):
    _, out, _ = M.best_kmeans(profile(t), _NUM, [4])
    return M.calinski_harabasz(out)


@plan("m05_two_components")
def _(t):
    _, ready = M.prepare(profile(t), _NUM)
    return M.two_components(ready).select("customer_id", "pc1", "pc2")


@plan("m06_churn")
def _(t):
    rows = M.balanced_weights(M.churn_rows(profile(t)), "label")
    train, test = M.split(rows, "customer_id")
    model = M.fit_classifier(train, "label", M.preparation(["frequency", "monetary"], scale=False), weight="weight", trees=10)
    out = M.score(model, test, "customer_id", ["frequency", "monetary"])
    return out.withColumn("risk_level", M.risk_level(F.col("probability")))


@plan("m20_risk_levels", """SELECT customer_id, customer_id % 101 / 100.0::DOUBLE AS probability,
  CASE WHEN customer_id % 101 >= 70 THEN 'high' WHEN customer_id % 101 >= 40 THEN 'medium' ELSE 'low' END AS risk_level FROM cst""")
def _(t):
    return t.cst.select("customer_id", (F.col("customer_id") % 101 / 100.0).alias("probability")).withColumn("risk_level", M.risk_level(F.col("probability")))


@plan("m07_clv_regression")
def _(t):
    train, test = M.split(buyers(t), "customer_id")
    _, model, _ = M.fit_best(train, "future", M.regressors("future", 10, 5), M.preparation(["orders", "spent", "aov", "recency"], scale=False))
    out = M.score(model, test, "customer_id", ["orders", "spent"])
    return out.withColumn("clv_level", M.clv_level(F.col("prediction")))


@plan("m08_category_classes")
def _(t):
    from pyspark.ml.feature import StringIndexer
    rows = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(goods(t)).transform(goods(t))
    train, test = M.split(rows, "product_id")
    model = M.fit_classifier(train, "label", M.preparation(["size", "price", "name_length"], ["brand"], scale=False), "logistic")
    return M.classification_metrics(model.transform(test), "label", "prediction")


@plan("m09_forecast")
def _(t):
    s = pin(series(t))  # one row per category and day; fits and folds read it many times
    _, model, _, _ = M.fit_forecast(s, trees=5)
    return M.project(s, model, 30)


@plan("m09_time_folds", f"""WITH {_SERIES}, c AS (SELECT ceil(unnest(quantile_cont(date_diff('day', DATE '1970-01-01', day)::DOUBLE, [0.25, 0.5, 0.75])))::INT AS n FROM s),
  f AS (SELECT row_number() OVER (ORDER BY n) AS fold, DATE '1970-01-01' + n AS starts, DATE '1970-01-01' + lead(n) OVER (ORDER BY n) AS ends FROM (SELECT DISTINCT n FROM c))
  SELECT fold::INT AS fold, count(*) FILTER (WHERE day < starts) AS n_learn, max(CASE WHEN day < starts THEN day END)::DATE AS learned_until,
    count(*) FILTER (WHERE day >= starts AND (ends IS NULL OR day < ends)) AS n_held, min(CASE WHEN day >= starts THEN day END)::DATE AS held_from FROM f CROSS JOIN s GROUP BY fold""")
def _(t):
    """Rows to learn from and to judge of each expanding fold of the daily series."""
    folds = M.time_folds(pin(series(t)), "day")
    size = lambda df, n, end: df.agg(F.count("*").alias(n), end)
    sizes = [size(a, "n_learn", F.max("day").alias("learned_until")).withColumn("fold", F.lit(k)).join(size(b, "n_held", F.min("day").alias("held_from")).withColumn("fold", F.lit(k)), "fold") for k, (a, b) in enumerate(folds, 1)]
    return functools.reduce(lambda x, y: x.unionByName(y), sizes)


@plan("m09_fold_errors")
def _(t):
    """Mean and spread of each forecast model's error over expanding folds of the training days."""
    train, _ = M.forecast_split(pin(series(t)))
    errors = M.fold_errors(M.time_folds(train, "day"), "y", M.regressors("y", 5), M.preparation(M.FORECAST_FEATURES, ["category"], scale=False))
    return M.fold_report(t.spark, errors)


_TOK = """tk AS (SELECT product_id, unnest(list_filter(regexp_split_to_array(lower(product_name || ' ' || category || ' ' || brand), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2)) AS token FROM prd),
  tf AS (SELECT product_id, token, count(*) AS tf FROM tk GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  wt AS (SELECT product_id, token, tf * (ln((1 + (SELECT count(*) FROM prd)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)),
  nm AS (SELECT product_id, sqrt(sum(w * w)) AS n FROM wt GROUP BY 1), uv AS (SELECT product_id, token, w / n AS w FROM wt JOIN nm USING (product_id)),
  pr AS (SELECT a.product_id, b.product_id AS other, round(sum(a.w * b.w), 6) AS similarity FROM uv a JOIN uv b ON a.token = b.token AND a.product_id <> b.product_id GROUP BY 1, 2)"""


@plan("m10_similar_products", f"""WITH {_TOK} SELECT product_id, other, similarity, (row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, other))::INTEGER AS position FROM pr
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, other) <= 5""")
def _(t):
    return R.similar_products(t.prd, 5)


@plan("m11_factor_recommendations")
def _(t):
    ratings = R.interactions(t.sales)
    pinned = pin(ratings)
    return R.unseen_recommendations(R.fit_factors(ratings, pinned=pinned), pinned, 10)


@plan("m12_hybrid")
def _(t):
    ratings = R.interactions(t.sales)
    pinned = pin(ratings)
    collab = R.unseen_recommendations(R.fit_factors(ratings, pinned=pinned), pinned, 10)
    popular = t.itm.groupBy("product_id").agg(F.sum("quantity").cast("double").alias("score"))
    return R.hybrid(R.recent_items(t.sales), R.similar_products(t.prd, 5), collab, popular, t.cst, 10)


_HALF = """a AS (SELECT DISTINCT customer_id, product_id FROM ord JOIN itm USING (order_id) WHERE order_date >= '2000-01-01'),
  r AS (SELECT customer_id, product_id FROM (SELECT customer_id, product_id, max(order_date) AS t FROM ord JOIN itm USING (order_id) WHERE order_date < '2000-01-01' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY t DESC, product_id) <= 10),
  h AS (SELECT customer_id, count(*) AS hits FROM r JOIN a USING (customer_id, product_id) GROUP BY 1), n AS (SELECT customer_id, count(*) AS m FROM a GROUP BY 1),
  pu AS (SELECT customer_id, coalesce(hits, 0) AS hits, coalesce(hits, 0) / 10.0::DOUBLE AS precision_at_k, coalesce(hits, 0)::DOUBLE / m AS recall_at_k FROM (SELECT DISTINCT customer_id FROM r) JOIN n USING (customer_id) LEFT JOIN h USING (customer_id)),
  mk AS (SELECT *, coalesce(2 * precision_at_k * recall_at_k / nullif(precision_at_k + recall_at_k, 0), 0) AS f1_at_k FROM pu)"""


def at_k(t):
    rec = R.recent_items(t.sales.where("order_date < '2000-01-01'"), 10)
    return R.metrics_at_k(rec, t.sales.where("order_date >= '2000-01-01'"), 10)


@plan("m13_metrics_at_k", f"WITH {_HALF} SELECT * FROM mk")
def _(t):
    return at_k(t)


@plan("m13_mean_metrics", f"WITH {_HALF} SELECT count(*) AS users, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(f1_at_k), 6) AS f1_at_k FROM mk")
def _(t):
    return R.mean_metrics(at_k(t))


@plan("m14_similar_customers", """WITH b AS (SELECT customer_id, product_id, sum(quantity)::DOUBLE AS q FROM ord JOIN itm USING (order_id) GROUP BY 1, 2), n AS (SELECT customer_id, sqrt(sum(q * q)) AS n FROM b GROUP BY 1),
  u AS (SELECT customer_id, product_id, q / n AS w FROM b JOIN n USING (customer_id)), p AS (SELECT x.customer_id, y.customer_id AS other, round(sum(x.w * y.w), 6) AS similarity FROM u x JOIN u y ON x.product_id = y.product_id AND x.customer_id <> y.customer_id GROUP BY 1, 2)
  SELECT *, (row_number() OVER (PARTITION BY customer_id ORDER BY similarity DESC, other))::INTEGER AS position FROM p WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY similarity DESC, other) <= 5""")
def _(t):
    return R.similar_customers(t.sales, 5)


@plan("m15_tier_model")
def _(t):
    rows = M.tier_label(buyers(t), "spent")
    train, test = M.split(rows, "customer_id")
    model = M.fit_classifier(train, "label", M.preparation(["orders", "aov"], scale=False), trees=10)
    return M.classification_metrics(model.transform(test), "label", "prediction")


@plan("m15_demand_model")
def _(t):
    sold = t.itm.groupBy("product_id").agg(F.sum("quantity").cast("double").alias("units"), F.count("*").cast("double").alias("lines"), F.avg(F.col("item_total").cast("double")).alias("mean_total"))
    rows = M.demand_label(sold, "units")
    train, test = M.split(rows, "product_id")
    model = M.fit_classifier(train, "label", M.preparation(["lines", "mean_total"], scale=False), "boosted", trees=5)
    return M.confusion(model.transform(test), "label", "prediction")


@plan("m15_quantity_model")
def _(t):
    """Units of a category and day from the calendar, the mean price and the day before."""
    sold = t.sales.join(t.prd.select("product_id", "category", "price"), "product_id")
    daily = pin(sold.groupBy("category", F.to_date("order_date").alias("day")).agg(F.sum("quantity").cast("double").alias("units"), F.avg(F.col("price").cast("double")).alias("price")))
    before = daily.select("category", F.date_add("day", 1).alias("day"), F.col("units").alias("units_before"))
    rows = daily.join(before, ["category", "day"], "left").fillna(0.0, ["units_before"]).withColumns({"weekday": F.weekday("day").cast("double"), "month": F.month("day").cast("double")})
    train, test = rows.where(F.year("day") < 2001), rows.where(F.year("day") >= 2001)
    name, model, _ = M.fit_best(train, "units", M.regressors("units", 5, 4), M.preparation(["price", "units_before", "weekday", "month"], ["category"], scale=False), by="day")
    return M.regression_metrics(model.transform(test), "units", "prediction").withColumn("model", F.lit(name))


@plan("m16_grid_search")
def _(t):
    rows = buyers(t).drop("customer_id")
    return M.grid_report(t.spark, M.grid_search(rows, "future", M.preparation(["orders", "spent", "aov", "recency"], scale=False), (3, 6), (2, 4)))


_BUY = """o AS (SELECT customer_id, count(*)::DOUBLE AS orders, sum(total_amount)::DOUBLE AS spent, avg(total_amount::DOUBLE) AS aov, date_diff('day', max(order_date), TIMESTAMP '2001-01-01')::DOUBLE AS recency FROM ord WHERE order_date < '2001-01-01' GROUP BY 1),
  n AS (SELECT customer_id, sum(total_amount)::DOUBLE AS future FROM ord WHERE order_date >= '2001-01-01' GROUP BY 1), b AS (SELECT o.*, coalesce(future, 0) AS y FROM o LEFT JOIN n USING (customer_id))"""


@plan("m17_select_features", f"WITH {_BUY}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) ** 2 * (count(*) - 2) / (1 - corr({c}, y) ** 2) AS f FROM b" for c in ("orders", "spent", "aov", "recency"))
      + ") SELECT feature, round(f, 6) AS f_score, row_number() OVER (ORDER BY f DESC, feature) <= 3 OR f >= (SELECT median(f) FROM f) AS selected FROM f")
def _(t):
    return M.select_features(buyers(t), ["orders", "spent", "aov", "recency"], "future").withColumn("f_score", F.round("f_score", 6))


_PRED = "pd AS (SELECT order_id, total_amount::DOUBLE AS y, total_amount::DOUBLE * (1 + ((order_id % 21) - 10) / 100.0::DOUBLE) AS p FROM ord)"


def predicted(t):
    y = F.col("total_amount").cast("double")
    return t.ord.select("order_id", y.alias("y"), (y * (1 + ((F.col("order_id") % 21) - 10) / F.lit(100.0))).alias("p"))


@plan("m18_regression_metrics", f"""WITH {_PRED} SELECT round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs((y - p) / y)) * 100, 6) AS mape FROM pd""")
def _(t):
    digits = {"mae": 4, "mse": 2, "rmse": 4, "r2": 6, "mape": 6}
    return M.regression_metrics(predicted(t), "y", "p").select(*[F.round(c, d).alias(c) for c, d in digits.items()])


_CLASS = "cl AS (SELECT (order_id % 3)::DOUBLE AS y, (CASE WHEN order_id % 7 = 0 THEN (order_id + 1) % 3 ELSE order_id % 3 END)::DOUBLE AS p FROM ord)"


def guessed(t):
    k = F.col("order_id")
    return t.ord.select((k % 3).cast("double").alias("y"), F.when(k % 7 == 0, (k + 1) % 3).otherwise(k % 3).cast("double").alias("p"))


@plan("m18_area_under_curve", """WITH s AS (SELECT order_id % 3 = 0 AS y, (order_id * 7 % 50 + CASE WHEN order_id % 3 = 0 THEN 9 ELSE 0 END)::DOUBLE AS s FROM ord),
  r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS k FROM s)
  SELECT round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS area_under_curve FROM r""")
def _(t):
    k = F.col("order_id")
    rows = t.ord.select((k % 3 == 0).cast("int").alias("y"), (k * 7 % 50 + F.when(k % 3 == 0, 9).otherwise(0)).alias("s"))
    return M.area_rows(rows, "y", "s").select(F.round("area_under_curve", 9).alias("area_under_curve"))


@plan("m18_confusion", f"WITH {_CLASS} SELECT y AS label, p AS prediction, count(*) AS n FROM cl GROUP BY 1, 2")
def _(t):
    return M.confusion(guessed(t), "y", "p")


@plan("m18_classification_metrics", f"""WITH {_CLASS}, s AS (SELECT y, count(*) AS n, count(*) FILTER (y = p) AS tp FROM cl GROUP BY 1), q AS (SELECT p AS y, count(*) AS m FROM cl GROUP BY 1),
  c AS (SELECT n, tp, tp::DOUBLE / m AS p, tp::DOUBLE / n AS r FROM s JOIN q USING (y))
  SELECT round(sum(tp)::DOUBLE / sum(n), 6) AS accuracy, round(sum(p * n) / sum(n), 6) AS precision, round(sum(r * n) / sum(n), 6) AS recall, round(sum(2 * p * r / (p + r) * n) / sum(n), 6) AS f1 FROM c""")
def _(t):
    return M.classification_metrics(guessed(t), "y", "p").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@plan("m19_importances")
def _(t):
    train, _ = M.split(buyers(t), "customer_id")
    model = M.fit_classifier(M.tier_label(train, "spent"), "label", M.preparation(["orders", "aov", "recency"], scale=False), trees=5)
    return M.importance_rows(t.spark, model)


@plan("m22_prediction_errors", f"WITH {_PRED} SELECT order_id, y, p, p - y AS prediction_error, abs(p - y) * 100 / abs(y) AS abs_pct_error FROM pd")
def _(t):
    return M.prediction_errors(predicted(t), "y", "p")


@plan("u01_scorer", "SELECT doc_id, length(text)::DOUBLE / (1 + length(text) - length(replace(text, ' ', ''))) AS score FROM documents")
def _(t):
    scorer = U.register_scorer(t.spark, "chars_per_word", lambda s: s.str.len() / (1.0 + s.str.count(" ")))
    return t.raw("documents").select("doc_id", scorer("text").alias("score"))


@plan("u02_by_partition", "SELECT order_id, total_amount::DOUBLE * 2 AS doubled FROM ord")
def _(t):
    rows = t.ord.select("order_id", F.col("total_amount").cast("double").alias("v"))
    return U.by_partition(rows, lambda b: b.assign(doubled=b["v"] * 2)[["order_id", "doubled"]], "order_id bigint, doubled double")


@plan("u07_sql_functions", """SELECT order_id, (year(order_date) * 10000 + month(order_date) * 100 + day(order_date))::INTEGER AS time_key, (month(order_date) * 100 + day(order_date)) BETWEEN 120 AND 220 AS tet FROM ord""")
def _(t):
    U.register_sql_functions(t.spark)
    return t.ord.select("order_id", F.expr("get_time_key(cast(order_date as date))").alias("time_key"), F.expr("is_tet_season(cast(order_date as date))").alias("tet"))
