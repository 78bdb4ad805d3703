"""Queries for the customer domain (D-01..D-14, D-46, A-25, A-36, ST-11 in batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import customers as C
from tillroll.plans.registry import plan
from tillroll.plans.tables import AS_OF, EVENTS_AS_OF

_REG = "TIMESTAMP '1999-01-01' + to_days((customer_id % 1000)::INTEGER)"


def registered(t):
    return t.cst.withColumn("registration_date", F.expr(
        "TIMESTAMP_NTZ '1999-01-01 00:00:00' + make_dt_interval(cast(customer_id % 1000 as int))"))


_MET = f"""met AS (SELECT o.customer_id, any_value(customer_segment) AS current_segment, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
    count(DISTINCT order_id) AS order_frequency, count(DISTINCT date_trunc('month', order_date)) AS active_months, sum(total_amount)::DOUBLE AS total_monetary,
    sum(total_amount)::DOUBLE / count(DISTINCT order_id) AS avg_order_value,
    floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(order_date))) / 86400)::BIGINT AS recency_days,
    floor((epoch(TIMESTAMP '{AS_OF}') - epoch(any_value({_REG.replace('customer_id', 'o.customer_id')}))) / 86400) <= 90 AS is_new_customer
    FROM ord o LEFT JOIN cst USING (customer_id) WHERE order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1)"""


def _scores(first):
    r, f = ("DESC", "") if first else ("", "DESC")
    return f"""rfm AS (SELECT *, ntile(5) OVER (ORDER BY recency_days {r}, customer_id)::INTEGER AS recency_score,
    ntile(5) OVER (ORDER BY order_frequency {f}, customer_id)::INTEGER AS frequency_score, ntile(5) OVER (ORDER BY total_monetary {f}, customer_id)::INTEGER AS monetary_score FROM met)"""


@plan("d01_customer_metrics", f"WITH {_MET} SELECT * FROM met")
def _(t):
    return C.customer_metrics(t.ord, registered(t), AS_OF)


@plan("d01_rfm_scores", f"WITH {_MET}, {_scores(True)} SELECT *, recency_score + frequency_score + monetary_score AS total_rfm_score FROM rfm")
def _(t):
    return C.rfm_scores(C.customer_metrics(t.ord, registered(t), AS_OF))


@plan("d01_rfm_scores_one_is_best", f"WITH {_MET}, {_scores(False)} SELECT customer_id, recency_score, frequency_score, monetary_score, recency_score + frequency_score + monetary_score AS total_rfm_score FROM rfm")
def _(t):
    return C.rfm_scores(C.customer_metrics(t.ord, registered(t), AS_OF), best_is_high=False).select(
        "customer_id", "recency_score", "frequency_score", "monetary_score", "total_rfm_score")


_SEG = """CASE WHEN is_new_customer AND frequency_score >= 4 AND monetary_score >= 4 THEN 'promising' WHEN is_new_customer THEN 'new_customer'
  WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'champion' WHEN recency_score >= 3 AND frequency_score >= 3 AND monetary_score >= 3 THEN 'loyal'
  WHEN recency_score >= 3 AND frequency_score <= 2 AND monetary_score >= 4 THEN 'cannot_lose' WHEN recency_score >= 4 AND frequency_score <= 2 AND monetary_score >= 3 THEN 'potential_loyalist'
  WHEN recency_score >= 3 AND frequency_score >= 3 AND monetary_score <= 2 THEN 'need_attention' WHEN recency_score <= 2 AND frequency_score >= 3 AND monetary_score >= 3 THEN 'at_risk'
  WHEN recency_score <= 2 AND frequency_score >= 2 AND monetary_score >= 2 THEN 'about_to_sleep' WHEN recency_score <= 2 AND frequency_score <= 2 AND monetary_score >= 3 THEN 'hibernating'
  ELSE 'lost' END"""


@plan("d02_rfm_segments", f"WITH {_MET}, {_scores(True)} SELECT customer_id, {_SEG} AS rfm_segment FROM rfm")
def _(t):
    s = C.rfm_scores(C.customer_metrics(t.ord, registered(t), AS_OF))
    return s.select("customer_id", C.rfm_segment(F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score"), F.col("is_new_customer")).alias("rfm_segment"))


_PROF = """prof AS (SELECT customer_id, date_diff('day', max(order_date), (SELECT max(order_date) FROM ord)) AS recency, count(DISTINCT order_id) AS frequency,
    sum(total_amount)::DOUBLE AS monetary FROM ord GROUP BY 1),
  num AS (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS fr, row_number() OVER (ORDER BY monetary, customer_id) AS mr, count(*) OVER () AS n FROM prof),
  edg AS (SELECT quantile_cont(recency::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS rq, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS mq FROM prof)"""
_RB = "CASE WHEN recency <= rq[1] THEN 5 WHEN recency <= rq[2] THEN 4 WHEN recency <= rq[3] THEN 3 WHEN recency <= rq[4] THEN 2 ELSE 1 END"
_MB = "CASE WHEN monetary <= mq[1] THEN 1 WHEN monetary <= mq[2] THEN 2 WHEN monetary <= mq[3] THEN 3 WHEN monetary <= mq[4] THEN 4 ELSE 5 END"
_QR = "greatest(1, ceil(({0} - 1) * 5 / (n - 1)::DOUBLE))::INTEGER"
_D03 = f"""WITH {_PROF}, sc AS (SELECT customer_id, recency, frequency, monetary, {_RB} AS recency_score, {_QR.format('fr')} AS frequency_score, {_QR.format('mr')} AS monetary_score FROM num, edg),
  tot AS (SELECT *, recency_score * 100 + frequency_score * 10 + monetary_score AS rfm_score FROM sc)"""


@plan("d03_rfm_composite", _D03 + """ SELECT *, CASE WHEN rfm_score >= 444 THEN 'Champions' WHEN rfm_score >= 334 THEN 'Loyal Customers' WHEN rfm_score >= 313 THEN 'Potential Loyalists'
  WHEN rfm_score >= 155 THEN 'At Risk' ELSE 'Lost' END AS customer_segment_rfm FROM tot""")
def _(t):
    return C.rfm_composite(C.recency_profile(t.ord))


_CODES = " ".join(f"WHEN rfm_code IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in C.RFM_CODES.items())


@plan("d04_rfm_codes", f"""WITH {_PROF}, sc AS (SELECT customer_id, recency, frequency, monetary, {_RB} AS r_score, {_QR.format('fr')} AS f_score, {_MB} AS m_score FROM num, edg),
  c AS (SELECT *, r_score::VARCHAR || f_score || m_score AS rfm_code FROM sc) SELECT *, CASE {_CODES} ELSE 'Others' END AS segment FROM c""")
def _(t):
    return C.rfm_codes(C.recency_profile(t.ord))


@plan("a25_rfm_combinations", _D03 + " SELECT recency_score, frequency_score, monetary_score, count(*) AS customers FROM tot GROUP BY 1, 2, 3")
def _(t):
    return C.rfm_combinations(C.rfm_composite(C.recency_profile(t.ord)), "recency_score", "frequency_score", "monetary_score")


@plan("d05_order_count_segments", """WITH g AS (SELECT count(*) AS n, sum(total_amount) AS v FROM ord GROUP BY customer_id)
  SELECT CASE WHEN n >= 10 THEN 'VIP' WHEN n >= 5 THEN 'Loyal' WHEN n >= 2 THEN 'Regular' ELSE 'New' END AS segment, count(*) AS customers,
  sum(v)::DOUBLE AS revenue, sum(v)::DOUBLE / sum(n) AS avg_order_value FROM g GROUP BY 1""")
def _(t):
    return C.order_count_segments(t.ord)


@plan("d05_revenue_segments", """WITH g AS (SELECT sum(total_amount) AS v FROM ord GROUP BY customer_id)
  SELECT CASE WHEN v >= 5000000 THEN 'VIP' WHEN v >= 2000000 THEN 'Premium' WHEN v >= 500000 THEN 'Standard' ELSE 'Basic' END AS segment, count(*) AS customers,
  sum(v)::DOUBLE AS revenue, sum(v)::DOUBLE / count(*) AS avg_revenue FROM g GROUP BY 1""")
def _(t):
    return C.revenue_segments(t.ord)


def visits(t):
    """Events as shop sessions: one session id per user and day; decision minutes from the event value."""
    return t.act.select("customer_id", F.concat_ws("-", "customer_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
                        F.col("value").alias("decision_minutes"), "activity_type", "ts")


_BEH = """lin AS (SELECT order_id, max(discount > 0) AS d FROM itm GROUP BY 1),
  bo AS (SELECT customer_id, count(*) AS total_orders, count(*) FILTER (coalesce(d, FALSE)) AS discounted_orders, sum(total_amount)::DOUBLE / count(*) AS avg_order_value
    FROM ord LEFT JOIN lin USING (order_id) GROUP BY 1),
  bb AS (SELECT customer_id, count(DISTINCT brand) AS unique_brands FROM itm JOIN ord USING (order_id) JOIN prd USING (product_id) GROUP BY 1),
  bs AS (SELECT customer_id, count(DISTINCT ts::DATE) AS total_sessions, sum(value)::DOUBLE / count(value) AS avg_decision_minutes FROM act GROUP BY 1),
  bm AS (SELECT customer_id, total_orders, discounted_orders, avg_order_value, coalesce(unique_brands, 0) AS unique_brands, coalesce(total_sessions, 0) AS total_sessions,
    avg_decision_minutes, coalesce(total_orders::DOUBLE / total_sessions, 0) AS conversion_rate FROM bo LEFT JOIN bb USING (customer_id) LEFT JOIN bs USING (customer_id)),
  beh AS (SELECT *, CASE WHEN conversion_rate > 0.3 THEN 'converter' WHEN coalesce(avg_decision_minutes, 0) < 10 THEN 'impulse_buyer'
    WHEN discounted_orders / greatest(total_orders, 1) > 0.7 THEN 'bargain_hunter' WHEN unique_brands <= 2 THEN 'loyalist' WHEN total_orders BETWEEN 1 AND 3 THEN 'occasional' ELSE 'browser' END AS behavior_type FROM bm)"""


def behaviour(t):
    return C.behaviour_type(C.behaviour_metrics(t.ord, t.itm, t.prd, visits(t)))


@plan("d06_behaviour_types", f"WITH {_BEH} SELECT * FROM beh")
def _(t):
    return behaviour(t)


_CLS = f"""{_MET}, {_scores(True)}, {_BEH}, cls AS (SELECT rfm.*, behavior_type, {_SEG} AS rfm_segment,
    avg_order_value * (order_frequency / greatest(active_months, 1)) * 12 * CASE current_segment WHEN 'VIP' THEN 1.5 WHEN 'Premium' THEN 1.3 WHEN 'Basic' THEN 0.8 ELSE 1.0 END::DOUBLE AS clv_prediction,
    least(CASE WHEN recency_days > 180 THEN 0.8 WHEN recency_days > 90 THEN 0.6 WHEN recency_days > 30 THEN 0.3 ELSE 0.1 END::DOUBLE * CASE WHEN order_frequency > 10 AND total_monetary > 5000000 THEN 0.5
      WHEN order_frequency > 5 THEN 0.7 WHEN order_frequency <= 1 THEN 1.3 ELSE 1.0 END::DOUBLE, 1.0::DOUBLE) AS churn_probability
    FROM rfm LEFT JOIN (SELECT customer_id, behavior_type FROM beh) USING (customer_id))"""


def classified(t):
    return C.classify(t.ord, registered(t), behaviour(t), AS_OF)


@plan("d07_lifetime_value", f"WITH {_CLS} SELECT customer_id, clv_prediction FROM cls")
def _(t):
    return classified(t).select("customer_id", "clv_prediction")


@plan("d08_churn_probability", f"WITH {_CLS} SELECT customer_id, churn_probability FROM cls")
def _(t):
    return classified(t).select("customer_id", "churn_probability")


@plan("d09_segment_analytics", f"""WITH {_CLS} SELECT rfm_segment, count(*) AS customer_count, round(avg(clv_prediction), 6) AS avg_clv, round(avg(churn_probability), 6) AS avg_churn,
  round(avg(recency_days), 6) AS avg_recency, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cls) AS percentage FROM cls GROUP BY 1""")
def _(t):
    return C.segment_analytics(classified(t))


_ENG = f"""er AS (SELECT customer_id, count(*) FILTER (activity_type IN ('signup', 'error')) AS e, count(DISTINCT CASE WHEN activity_type IN ('view', 'click') THEN ts::DATE END) AS s FROM act
    WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY GROUP BY 1),
  ep AS (SELECT customer_id, count(*) AS p FROM ord WHERE order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1),
  eng AS (SELECT *, email_score * 0.3::DOUBLE + website_score * 0.3::DOUBLE + purchase_score * 0.4::DOUBLE AS overall_score FROM (SELECT customer_id, least(coalesce(e, 0) / 10.0::DOUBLE, 1) AS email_score,
    least(coalesce(s, 0) / 20.0::DOUBLE, 1) AS website_score, least(coalesce(p, 0) / 5.0::DOUBLE, 1) AS purchase_score FROM cst LEFT JOIN er USING (customer_id) LEFT JOIN ep USING (customer_id)))"""


def engagement(t):
    return C.engagement_scores(t.cst, visits(t), t.ord, EVENTS_AS_OF, AS_OF, ("signup", "error"), ("view", "click"))


@plan("d11_engagement_scores", f"WITH {_ENG} SELECT * FROM eng")
def _(t):
    return engagement(t)


@plan("d09_segment_performance", f"""WITH {_CLS}, {_ENG}, o AS (SELECT customer_id, sum(total_amount) AS v, count(*) AS n FROM ord WHERE order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1)
  SELECT rfm_segment, count(*) AS customer_count, round(avg(clv_prediction), 6) AS avg_clv, round(avg(churn_probability), 6) AS avg_churn_risk, round(avg(overall_score), 6) AS avg_engagement,
  count(*) FILTER (churn_probability > 0.7) AS high_risk_customers, count(*) FILTER (churn_probability < 0.3) AS low_risk_customers, coalesce(sum(v)::DOUBLE, 0) AS monthly_revenue,
  sum(v)::DOUBLE / sum(n) AS avg_monthly_order_value FROM cls LEFT JOIN eng USING (customer_id) LEFT JOIN o USING (customer_id) GROUP BY 1""")
def _(t):
    return C.segment_performance(classified(t), engagement(t), t.ord, AS_OF)


@plan("d09_behaviour_analysis", f"""WITH {_CLS}, {_ENG}, o AS (SELECT customer_id, sum(total_amount)::DOUBLE / count(*) AS a, count(*) AS n FROM ord WHERE order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1)
  SELECT behavior_type, count(*) AS customer_count, round(avg(clv_prediction), 6) AS avg_clv, round(avg(overall_score), 6) AS avg_engagement, count(*) FILTER (churn_probability > 0.5) AS churn_risk_count,
  round(avg(a), 6) AS avg_order_value, round(avg(n), 6) AS avg_order_frequency FROM cls LEFT JOIN eng USING (customer_id) LEFT JOIN o USING (customer_id) GROUP BY 1""")
def _(t):
    return C.behaviour_analysis(classified(t), engagement(t), t.ord, AS_OF)


_TIER = f"""to_ AS (SELECT customer_id, sum(total_amount)::DOUBLE AS s, count(*) AS n FROM ord WHERE order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1),
  tz AS (SELECT customer_id, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM cst LEFT JOIN to_ USING (customer_id)),
  tier AS (SELECT customer_id, s AS total_spent, n AS order_count, CASE WHEN s >= 2500000 AND n >= 20 THEN 'diamond' WHEN s >= 1000000 AND n >= 10 THEN 'platinum' WHEN s >= 500000 AND n >= 5 THEN 'gold'
    WHEN s >= 250000 AND n >= 3 THEN 'silver' WHEN s >= 50000 OR n >= 1 THEN 'bronze' ELSE 'new' END AS current_tier, floor(s / 10000)::BIGINT AS tier_points FROM tz)"""


@plan("d12_value_tiers", f"WITH {_TIER} SELECT * FROM tier")
def _(t):
    return C.value_tiers(t.cst, t.ord, AS_OF, 0.05)


@plan("d12_tier_changes", f"""WITH {_TIER}, old AS (SELECT customer_id, ['silver', 'bronze', 'new'][1 + customer_id % 3] AS t, 'new' AS p, 5::BIGINT AS pts FROM cst WHERE customer_id % 4 <> 0)
  SELECT customer_id, CASE WHEN t IS NULL OR t <> current_tier THEN current_tier ELSE t END AS current_tier, CASE WHEN t IS NULL OR t <> current_tier THEN t ELSE p END AS previous_tier,
  CASE WHEN t IS NULL OR t <> current_tier THEN tier_points ELSE pts END AS tier_points, t IS NULL OR t <> current_tier AS changed FROM tier LEFT JOIN old USING (customer_id)""")
def _(t):
    from tillroll.plans.tables import pick
    k = F.col("customer_id")
    old = t.cst.where("customer_id % 4 <> 0").select(k, pick(["silver", "bronze", "new"], k).alias("current_tier"), F.lit("new").alias("previous_tier"),
                                                     F.lit(5).cast("bigint").alias("tier_points"))
    return C.tier_changes(old, C.value_tiers(t.cst, t.ord, AS_OF, 0.05))


@plan("d10_customer_profile", f"""WITH {_CLS}, {_ENG}, {_TIER}, st AS (SELECT DISTINCT ON (customer_id) customer_id, activity_type FROM act ORDER BY customer_id, ts DESC, activity_type DESC),
  o AS (SELECT customer_id, count(*) AS n, sum(total_amount)::DOUBLE AS v, max(order_date) AS l FROM ord GROUP BY 1)
  SELECT cst.customer_id, customer_name, rfm_segment, behavior_type, churn_probability, overall_score, current_tier, tier_points, activity_type AS journey_stage, coalesce(n, 0) AS total_orders,
  v AS total_spent, l AS last_order_date, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(l)) / 86400)::BIGINT AS days_since_last_order
  FROM cst LEFT JOIN cls USING (customer_id) LEFT JOIN eng USING (customer_id) LEFT JOIN tier USING (customer_id) LEFT JOIN st USING (customer_id) LEFT JOIN o USING (customer_id)""")
def _(t):
    stages = t.act.select("customer_id", F.col("activity_type").alias("stage_name"), F.col("ts").alias("entered_at"))
    return C.customer_profile(t.cst, classified(t), engagement(t), C.value_tiers(t.cst, t.ord, AS_OF, 0.05), stages, t.ord, AS_OF)


@plan("d13_high_risk", f"WITH {_CLS} SELECT customer_id, churn_probability, clv_prediction FROM cls WHERE churn_probability >= 0.5 ORDER BY churn_probability DESC, clv_prediction DESC, customer_id LIMIT 100")
def _(t):
    return C.high_risk(classified(t).select("customer_id", "churn_probability", "clv_prediction"), 0.5, 100)


def _sql_list(texts):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + "]"


_ADV = "CASE rfm_segment " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in C.SEGMENT_ACTIONS.items()) + " ELSE [] END"
_ADV2 = "CASE behavior_type " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in C.BEHAVIOUR_ACTIONS.items()) + " ELSE [] END"


@plan("d14_actions", f"""WITH {_CLS} SELECT customer_id, array_to_string(list_concat({_ADV}, {_ADV2}, list_filter([CASE WHEN churn_probability > 0.7 THEN '{C.HIGH_CHURN_ACTION}'
  WHEN churn_probability > 0.4 THEN '{C.MEDIUM_CHURN_ACTION}' END, CASE WHEN clv_prediction > 10000000 THEN '{C.HIGH_VALUE_ACTION}' END], lambda x: x IS NOT NULL))[1:5], '|') AS actions FROM cls""")
def _(t):
    c = classified(t)
    return c.select("customer_id", F.array_join(C.actions(F.col("rfm_segment"), F.col("behavior_type"), F.col("churn_probability"), F.col("clv_prediction")), "|").alias("actions"))


@plan("d46_activity_status", f"""SELECT customer_id, max(order_date) AS last_order, CASE WHEN max(order_date) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'Active'
  WHEN max(order_date) >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY THEN 'Recent' ELSE 'Inactive' END AS status FROM ord GROUP BY 1""")
def _(t):
    return C.activity_status(t.ord, AS_OF)
