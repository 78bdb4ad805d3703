"""Queries for vouchers (D-26..D-30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import vouchers as V
from tillroll.operators.table_functions import register_table_functions
from tillroll.plans.registry import plan
from tillroll.plans.tables import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
_DISC = """least(CASE voucher_type WHEN 'percentage' THEN CASE WHEN max_discount_amount > 0 THEN least({a}::DOUBLE * (discount_value::DOUBLE / 100), max_discount_amount::DOUBLE)
  ELSE {a}::DOUBLE * (discount_value::DOUBLE / 100) END WHEN 'fixed_amount' THEN discount_value::DOUBLE WHEN 'free_shipping' THEN 30000 ELSE 0 END, {a}::DOUBLE)"""
_CNT = """vc AS (SELECT voucher_id, count(*) AS uses, sum(discount_applied)::DOUBLE AS td FROM vus GROUP BY 1), cu AS (SELECT voucher_id, customer_id, count(*) AS mine FROM vus GROUP BY 1, 2)"""
_TARGET = """CASE target_type WHEN 'customer_segment' THEN coalesce(list_contains(target_segments, customer_segment), FALSE) WHEN 'specific_customers' THEN coalesce(target_city_id = city_id, FALSE) ELSE TRUE END"""


def requests(t):
    return t.ord.select("order_id", "customer_id", F.concat(F.lit("V"), F.col("order_id") % 27).alias("voucher_id"), F.col("total_amount").alias("order_amount"), "order_date")


@plan("d26_validate", f"""WITH {_CNT}, q AS (SELECT order_id, customer_id, 'V' || order_id % 27 AS voucher_id, total_amount AS order_amount, order_date FROM ord),
  j AS (SELECT * FROM q LEFT JOIN vch USING (voucher_id) LEFT JOIN vc USING (voucher_id) LEFT JOIN cu USING (voucher_id, customer_id)
    LEFT JOIN (SELECT customer_id, customer_segment, city_id FROM cst) USING (customer_id)),
  r AS (SELECT *, CASE WHEN NOT coalesce(status = 'active' AND order_date BETWEEN start_date AND end_date, FALSE) THEN 'not_found_or_expired' WHEN order_amount < min_order_amount THEN 'below_minimum'
    WHEN usage_limit <= coalesce(uses, 0) THEN 'used_up' WHEN usage_limit_per_customer <= coalesce(mine, 0) THEN 'customer_limit'
    WHEN NOT {_TARGET} THEN CASE target_type WHEN 'customer_segment' THEN 'segment_mismatch' ELSE 'customer_mismatch' END END AS reason FROM j)
  SELECT order_id, voucher_id, customer_id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN {_DISC.format(a='order_amount')} END AS discount_amount FROM r""")
def _(t):
    return V.validate(requests(t), t.vch, t.vus, t.cst, "order_date")


@plan("d27_discount", f"""SELECT order_id, voucher_id, {_DISC.format(a='(total_amount % 50000)')} AS discount_amount FROM ord JOIN vch ON voucher_id = 'V' || order_id % 25""")
def _(t):
    amount = F.col("total_amount") % 50000
    rows = t.ord.select("order_id", amount.alias("amount"), F.concat(F.lit("V"), F.col("order_id") % 25).alias("voucher_id")).join(t.vch, "voucher_id")
    return rows.select("order_id", "voucher_id", V.discount(F.col("voucher_type"), F.col("discount_value").cast("double"), F.col("max_discount_amount").cast("double"),
                                                           F.col("amount").cast("double")).alias("discount_amount"))


@plan("d28_recommend", f"""WITH {_CNT}, j AS (SELECT * FROM ord JOIN vch ON order_date BETWEEN start_date AND end_date AND min_order_amount <= total_amount JOIN (SELECT customer_id, customer_segment, city_id FROM cst) USING (customer_id)
    LEFT JOIN vc USING (voucher_id) LEFT JOIN cu USING (voucher_id, customer_id) WHERE status = 'active' AND (usage_limit IS NULL OR coalesce(uses, 0) < usage_limit) AND {_TARGET} AND coalesce(mine, 0) < usage_limit_per_customer)
  SELECT order_id, customer_id, voucher_id, code, {_DISC.format(a='total_amount')} AS estimated_discount, {_DISC.format(a='total_amount')} * 100 / total_amount::DOUBLE AS savings_percentage FROM j""")
def _(t):
    return V.recommend(t.ord, t.vch, t.vus, t.cst, "order_date")


@plan("u08_voucher_recommendations", f"""SELECT v.voucher_id, code, {_DISC.format(a='250000')} AS estimated_discount, {_DISC.format(a='250000')} * 100 / 250000::DOUBLE AS savings_percentage
  FROM vch v JOIN (SELECT customer_segment, city_id FROM cst WHERE customer_id = 7) ON {_TARGET} LEFT JOIN (SELECT voucher_id, count(*) AS uses, count(*) FILTER (customer_id = 7) AS mine FROM vus GROUP BY 1) u ON u.voucher_id = v.voucher_id
  WHERE status = 'active' AND {NOW} BETWEEN start_date AND end_date AND min_order_amount <= 250000 AND (usage_limit IS NULL OR coalesce(uses, 0) < usage_limit) AND coalesce(mine, 0) < usage_limit_per_customer""")
def _(t):
    register_table_functions(t.spark, vouchers=t.vch, customers=t.cst, voucher_usage=t.vus)
    return t.spark.sql(f"SELECT * FROM get_customer_voucher_recommendations(7, 250000D, TIMESTAMP_NTZ '{AS_OF}')")


@plan("d29_stats", f"""WITH {_CNT} SELECT voucher_id, code, voucher_type, coalesce(uses, 0) AS current_usage, coalesce(td, 0) AS total_discount_given,
  CASE WHEN usage_limit IS NULL THEN 100 ELSE coalesce(coalesce(uses, 0)::DOUBLE / nullif(usage_limit, 0) * 100, 0) END AS usage_percentage, CASE WHEN {NOW} > end_date THEN 'expired' WHEN coalesce(uses, 0) >= usage_limit THEN 'used_up'
  WHEN {NOW} < start_date THEN 'not_started' ELSE 'active' END AS current_status FROM vch LEFT JOIN vc USING (voucher_id)""")
def _(t):
    return V.stats(t.vch, t.vus, AS_OF)


@plan("d29_daily_usage", f"""SELECT used_at::DATE AS usage_date, count(*) AS total_usage, count(DISTINCT customer_id) AS unique_customers, sum(discount_applied)::DOUBLE AS total_discount_given,
  sum(order_amount)::DOUBLE / count(*) AS avg_order_value, count(DISTINCT voucher_id) AS vouchers_used FROM vus WHERE used_at >= {NOW} - INTERVAL 365 DAY GROUP BY 1""")
def _(t):
    return V.daily_usage(t.vus, AS_OF, 365)


@plan("d29_customer_patterns", """SELECT customer_id, count(*) AS total_vouchers_used, sum(discount_applied)::DOUBLE AS total_savings, sum(order_amount)::DOUBLE / count(*) AS avg_order_value, min(used_at) AS first_voucher_usage,
  max(used_at) AS last_voucher_usage, count(DISTINCT voucher_type) AS voucher_types_used, array_to_string(list_sort(list(DISTINCT voucher_type)), ',') AS preferred_voucher_types FROM vus JOIN vch USING (voucher_id) GROUP BY 1 HAVING count(*) >= 2""")
def _(t):
    return V.customer_patterns(t.vus, t.vch)


@plan("d29_monthly_summary", f"""SELECT count(*) AS monthly_usage, coalesce(sum(discount_applied)::DOUBLE, 0) AS monthly_discount, (SELECT count(*) FROM vch WHERE TIMESTAMP '2001-06-20' BETWEEN start_date AND end_date) AS active_vouchers
  FROM vus WHERE used_at >= TIMESTAMP '2001-06-01'""")
def _(t):
    return V.monthly_summary(t.vch, t.vus, "2001-06-20 00:00:00")


@plan("d29_top_vouchers", f"""WITH g AS (SELECT voucher_id, count(*) AS usage_count, sum(discount_applied)::DOUBLE AS total_discount FROM vus WHERE used_at >= {NOW} - INTERVAL 365 DAY GROUP BY 1)
  SELECT voucher_id, usage_count, total_discount, code, name, voucher_type FROM g JOIN vch USING (voucher_id) ORDER BY usage_count DESC, voucher_id LIMIT 10""")
def _(t):
    return V.top_vouchers(t.vch, t.vus, AS_OF, 365)


@plan("d30_status_changes", f"""WITH {_CNT} SELECT voucher_id, status AS old_status, CASE WHEN status = 'active' AND end_date < {NOW} THEN 'expired' WHEN status = 'active' AND uses >= usage_limit THEN 'used_up' ELSE status END AS status
  FROM vch LEFT JOIN vc USING (voucher_id)""")
def _(t):
    return V.status_changes(t.vch, t.vus, AS_OF)
