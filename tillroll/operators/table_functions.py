"""U-08: SQL table functions over named views, so that an analyst calls the operators' logic from SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRENDS = """CREATE OR REPLACE TEMPORARY FUNCTION detect_trending_products(on_day DATE)
RETURNS TABLE (product_id BIGINT, velocity_score DOUBLE, confidence_score DOUBLE, trend_strength STRING)
RETURN SELECT product_id, velocity_score, round(least(sales_volume / 20D, 1D) * least(growth + 0.5D, 1D), 6),
    CASE WHEN velocity_score > 50 AND growth > 1.5 THEN 'explosive' WHEN velocity_score > 25 AND growth > 1 THEN 'strong' WHEN velocity_score > 10 THEN 'moderate' ELSE 'weak' END
  FROM (SELECT r.product_id, s.velocity_score, r.sales_volume, CASE WHEN p.sales_volume > 0 THEN (r.sales_volume - p.sales_volume) / p.sales_volume ELSE 1D END AS growth
    FROM bestseller_rankings r JOIN velocity_scores s ON s.product_id = r.product_id
      LEFT JOIN (SELECT product_id, sales_volume FROM bestseller_rankings WHERE date = date_sub(on_day, 1)) p ON p.product_id = r.product_id
    WHERE r.date = on_day AND r.sales_volume >= 5)
  WHERE velocity_score > 5"""

ANOMALIES = """CREATE OR REPLACE TEMPORARY FUNCTION detect_sentiment_anomalies(as_of TIMESTAMP_NTZ, factor DOUBLE DEFAULT 1.5D, at_least BIGINT DEFAULT 3)
RETURNS TABLE (alert_type STRING, severity STRING, description STRING, product_id BIGINT)
RETURN SELECT 'negative_spike', CASE WHEN now > base * 2 THEN 'critical' ELSE 'high' END,
    concat('Negative feedback rate increased to ', round(now * 100, 1), '% (baseline: ', round(base * 100, 1), '%)'), CAST(NULL AS BIGINT)
  FROM (SELECT count_if(bad AND NOT new) / nullif(count_if(NOT new), 0) AS base, count_if(bad AND new) / nullif(count_if(new), 0) AS now
    FROM (SELECT sentiment_label IN ('negative', 'very_negative') AS bad, created_at >= as_of - INTERVAL 1 DAY AS new FROM feedback_analysis WHERE created_at >= as_of - INTERVAL 30 DAYS))
  WHERE now > base * factor
  UNION ALL
  SELECT 'product_quality_decline', 'high', concat('Product ', product_id, ' has ', n, ' negative reviews in last 24h'), product_id
  FROM (SELECT product_id, count_if(sentiment_label IN ('negative', 'very_negative')) AS n FROM feedback_analysis
    WHERE created_at >= as_of - INTERVAL 1 DAY AND product_id IS NOT NULL GROUP BY product_id)
  WHERE n >= at_least"""

RECOMMENDATIONS = """CREATE OR REPLACE TEMPORARY FUNCTION get_customer_voucher_recommendations(for_customer BIGINT, order_amount DOUBLE, as_of TIMESTAMP_NTZ)
RETURNS TABLE (voucher_id STRING, code STRING, estimated_discount DOUBLE, savings_percentage DOUBLE)
RETURN SELECT voucher_id, code, saved, CASE WHEN order_amount > 0 THEN saved * 100 / order_amount ELSE 0D END
  FROM (SELECT v.voucher_id, v.code, least(CASE voucher_type
        WHEN 'percentage' THEN CASE WHEN max_discount_amount > 0 THEN least(order_amount * (CAST(discount_value AS DOUBLE) / 100), CAST(max_discount_amount AS DOUBLE)) ELSE order_amount * (CAST(discount_value AS DOUBLE) / 100) END
        WHEN 'fixed_amount' THEN CAST(discount_value AS DOUBLE) WHEN 'free_shipping' THEN 30000D ELSE 0D END, order_amount) AS saved
    FROM vouchers v
      JOIN (SELECT customer_segment, city_id FROM customers WHERE customer_id = for_customer) c ON
        CASE target_type WHEN 'customer_segment' THEN coalesce(array_contains(target_segments, customer_segment), FALSE) WHEN 'specific_customers' THEN coalesce(target_city_id = city_id, FALSE) ELSE TRUE END
      LEFT JOIN (SELECT voucher_id, count(*) AS uses FROM voucher_usage GROUP BY voucher_id) u ON u.voucher_id = v.voucher_id
      LEFT JOIN (SELECT voucher_id, count(*) AS mine FROM voucher_usage WHERE customer_id = for_customer GROUP BY voucher_id) m ON m.voucher_id = v.voucher_id
    WHERE status = 'active' AND as_of BETWEEN start_date AND end_date AND (min_order_amount <= order_amount OR order_amount = 0)
      AND (usage_limit IS NULL OR coalesce(uses, 0) < usage_limit) AND coalesce(mine, 0) < usage_limit_per_customer)"""

#: The views that each function reads.
FUNCTIONS = {TRENDS: ("bestseller_rankings", "velocity_scores"), ANOMALIES: ("feedback_analysis",), RECOMMENDATIONS: ("vouchers", "customers", "voucher_usage")}


def register_table_functions(spark: SparkSession, **views: DataFrame) -> None:
    """Names the tables given as views and creates every table function all of whose views are among them.

    The functions are queries that Spark puts in place of the call: filters and columns reach the tables below. They stay until the session ends and see the views named last.
    """
    unknown = views.keys() - {v for needed in FUNCTIONS.values() for v in needed}
    if unknown:
        raise ValueError(f"no table function reads {', '.join(sorted(unknown))}")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for text, needed in FUNCTIONS.items():
        if views.keys() >= set(needed):
            spark.sql(text)
