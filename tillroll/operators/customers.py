"""Customer analytics: RFM scoring, behaviour, lifetime value, churn, engagement, value tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import whole_days
from tillroll.functions.numbers import davg, dsum, ratio
from tillroll.session import pin
from tillroll.operators.ordering import ntile, number_rows, quantiles
from tillroll.operators.windows import rank_quintile, value_bins


def since(ts: str, as_of: str, days: int) -> Column:
    return F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY")


def customer_metrics(orders: DataFrame, customers: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """D-01: figures per customer over the last ``days`` and the new-customer flag (registered <= 90 days)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    # Folded per order, then per month: an order lies in one month, so both distinct counts are row counts.
    per_order = orders.where(since("order_date", as_of, days)).groupBy("customer_id", "order_id").agg(
        F.max("order_date").alias("_b"), F.min("order_date").alias("_a"), F.sum("total_amount").alias("_m"))
    per_month = per_order.groupBy("customer_id", F.trunc("_b", "month").alias("_month")).agg(F.max("_b").alias("_b"), F.min("_a").alias("_a"), F.count("*").alias("_n"), F.sum("_m").alias("_m"))
    g = per_month.groupBy("customer_id").agg(
        F.max("_b").alias("last_order_date"), F.min("_a").alias("first_order_date"), F.sum("_n").alias("order_frequency"), F.sum("_m").alias("_m"),
        F.count("*").alias("active_months"))
    out = g.join(customers.select("customer_id", "customer_segment", "registration_date"), "customer_id", "left")
    age = whole_days(F.col("registration_date"), now)
    return out.select(
        "customer_id", F.col("customer_segment").alias("current_segment"), "first_order_date", "last_order_date", "order_frequency",
        "active_months", F.col("_m").cast("double").alias("total_monetary"), ratio(F.col("_m"), F.col("order_frequency")).alias("avg_order_value"),
        whole_days(F.col("last_order_date"), now).alias("recency_days"), F.coalesce(age <= 90, F.lit(False)).alias("is_new_customer"))


def rfm_scores(metrics: DataFrame, best_is_high: bool = True) -> DataFrame:
    """D-01: NTILE(5) scores. ``best_is_high=False`` keeps the source order in which 1 is best (G-01)."""
    up, down = (F.desc, F.asc) if best_is_high else (F.asc, F.desc)
    out = metrics = pin(metrics)  # read four times below; only (key, value) is sorted and written for a rank
    for name, value, way in (("recency_score", "recency_days", up), ("frequency_score", "order_frequency", down),
                             ("monetary_score", "total_monetary", down)):
        places = number_rows(metrics.select("customer_id", value), [way(value), F.col("customer_id")], (), "_rn", "_n")
        out = out.join(places.select("customer_id", ntile(F.col("_rn"), F.col("_n"), 5).alias(name)), "customer_id")
    return out.withColumn("total_rfm_score", F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score"))


def rfm_segment(r: Column, f: Column, m: Column, is_new: Column) -> Column:
    """D-02: eleven segments; the first rule that holds wins."""
    return (F.when(is_new & (f >= 4) & (m >= 4), "promising").when(is_new, "new_customer")
            .when((r >= 4) & (f >= 4) & (m >= 4), "champion").when((r >= 3) & (f >= 3) & (m >= 3), "loyal")
            .when((r >= 3) & (f <= 2) & (m >= 4), "cannot_lose").when((r >= 4) & (f <= 2) & (m >= 3), "potential_loyalist")
            .when((r >= 3) & (f >= 3) & (m <= 2), "need_attention").when((r <= 2) & (f >= 3) & (m >= 3), "at_risk")
            .when((r <= 2) & (f >= 2) & (m >= 2), "about_to_sleep").when((r <= 2) & (f <= 2) & (m >= 3), "hibernating")
            .otherwise("lost"))


def recency_profile(orders: DataFrame, as_of: str | None = None) -> DataFrame:
    """Recency, frequency, monetary per customer against ``as_of`` or the newest order."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else orders.agg(F.max("order_date").alias("m")).scalar()
    g = orders.groupBy("customer_id").agg(F.max("order_date").alias("_l"), F.countDistinct("order_id").alias("frequency"),
                                          dsum("total_amount").alias("monetary"))
    return g.select("customer_id", whole_days(F.col("_l"), now).alias("recency"), "frequency", "monetary")


def rfm_composite(profile: DataFrame) -> DataFrame:
    """D-03: recency by value quintiles, frequency and monetary by rank quintiles, score thresholds."""
    out = value_bins(profile, "recency", "recency_score", [5, 4, 3, 2, 1])
    out = rank_quintile(out, "frequency", "customer_id", "frequency_score")
    out = rank_quintile(out, "monetary", "customer_id", "monetary_score")
    s = F.col("recency_score") * 100 + F.col("frequency_score") * 10 + F.col("monetary_score")
    name = (F.when(s >= 444, "Champions").when(s >= 334, "Loyal Customers").when(s >= 313, "Potential Loyalists")
            .when(s >= 155, "At Risk").otherwise("Lost"))
    return out.withColumn("rfm_score", s).withColumn("customer_segment_rfm", name)


# Score codes per segment; 'Cannot Lose Them' has only codes that an earlier list already took.
RFM_CODES = {
    "Champions": ["555", "554", "544", "545", "454", "455", "445"],
    "Loyal Customers": ["543", "444", "435", "355", "354", "345", "344", "335"],
    "New Customers": ["512", "511", "422", "421", "412", "411", "311"],
    "Potential Loyalists": ["533", "532", "531", "523", "522", "521", "515", "514"],
    "At Risk": ["155", "154", "144", "214", "215", "115", "114"],
    "Cannot Lose Them": ["155", "154", "144", "214", "215", "115"],
}


def rfm_codes(profile: DataFrame) -> DataFrame:
    """D-04: segments from lists of score codes."""
    out = value_bins(profile, "recency", "r_score", [5, 4, 3, 2, 1])
    out = rank_quintile(out, "frequency", "customer_id", "f_score")
    out = value_bins(out, "monetary", "m_score", [1, 2, 3, 4, 5])
    code = F.concat("r_score", "f_score", "m_score")
    name = F.when(F.lit(False), "")
    for segment, codes in RFM_CODES.items():
        name = name.when(code.isin(codes), segment)
    return out.withColumn("rfm_code", code).withColumn("segment", name.otherwise("Others"))


def rfm_combinations(scored: DataFrame, r: str, f: str, m: str) -> DataFrame:
    """A-25."""
    return scored.groupBy(r, f, m).agg(F.count("*").alias("customers"))


def order_count_segments(orders: DataFrame) -> DataFrame:
    """D-05: customers and revenue by number of orders."""
    g = orders.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("total_amount").alias("v"))
    name = F.when(F.col("n") >= 10, "VIP").when(F.col("n") >= 5, "Loyal").when(F.col("n") >= 2, "Regular").otherwise("New")
    return g.groupBy(name.alias("segment")).agg(F.count("*").alias("customers"), dsum("v").alias("revenue"),
                                                ratio(F.sum("v"), F.sum("n")).alias("avg_order_value"))


def revenue_segments(orders: DataFrame, steps: Sequence[tuple[float, str]] = (
        (5000000, "VIP"), (2000000, "Premium"), (500000, "Standard")), lowest: str = "Basic") -> DataFrame:
    """D-05: customers by revenue."""
    g = orders.groupBy("customer_id").agg(F.sum("total_amount").alias("v"))
    name = F.when(F.lit(False), "")
    for edge, label in steps:
        name = name.when(F.col("v") >= edge, label)
    return g.groupBy(name.otherwise(lowest).alias("segment")).agg(
        F.count("*").alias("customers"), dsum("v").alias("revenue"), davg("v").alias("avg_revenue"))


def behaviour_metrics(orders: DataFrame, items: DataFrame, products: DataFrame, sessions: DataFrame) -> DataFrame:
    """D-06: conversion, decision minutes, discount share and brands per customer.

    Sessions, orders and items are aggregated apart and joined, so counts and means are not multiplied (G-10).
    ``sessions`` has customer_id, session_id, decision_minutes.
    """
    lines = items.groupBy("order_id").agg(F.max(F.col("discount") > 0).alias("_d"))
    o = orders.join(lines, "order_id", "left").groupBy("customer_id").agg(
        F.count("*").alias("total_orders"), F.count_if(F.coalesce("_d", F.lit(False))).alias("discounted_orders"),
        davg("total_amount").alias("avg_order_value"))
    b = (items.select("order_id", "product_id").join(orders.select("order_id", "customer_id"), "order_id")
         .join(products.select("product_id", "brand"), "product_id").groupBy("customer_id")
         .agg(F.countDistinct("brand").alias("unique_brands")))
    s = sessions.groupBy("customer_id").agg(F.countDistinct("session_id").alias("total_sessions"),
                                            davg("decision_minutes").alias("avg_decision_minutes"))
    out = o.join(b, "customer_id", "left").join(s, "customer_id", "left")
    return out.select(
        "customer_id", "total_orders", "discounted_orders", "avg_order_value", F.coalesce("unique_brands", F.lit(0)).alias("unique_brands"),
        F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"), "avg_decision_minutes",
        ratio(F.col("total_orders"), F.col("total_sessions"), 0).alias("conversion_rate"))


def behaviour_type(df: DataFrame) -> DataFrame:
    """D-06: six behaviour types; the first rule that holds wins."""
    share = F.col("discounted_orders") / F.greatest(F.col("total_orders"), F.lit(1))
    name = (F.when(F.col("conversion_rate") > 0.3, "converter").when(F.coalesce("avg_decision_minutes", F.lit(0.0)) < 10, "impulse_buyer")
            .when(share > 0.7, "bargain_hunter").when(F.col("unique_brands") <= 2, "loyalist")
            .when((F.col("total_orders") > 0) & (F.col("total_orders") <= 3), "occasional").otherwise("browser"))
    return df.withColumn("behavior_type", name)


def lifetime_value(aov: Column, frequency: Column, months: Column, segment: Column) -> Column:
    """D-07: AOV x monthly frequency x 12 x segment multiplier."""
    times = F.when(segment == "VIP", 1.5).when(segment == "Premium", 1.3).when(segment == "Basic", 0.8).otherwise(1.0)
    return aov * (frequency / F.greatest(months, F.lit(1))) * 12 * times


def churn_probability(recency: Column, frequency: Column, monetary: Column) -> Column:
    """D-08: recency tier, scaled by activity, at most 1."""
    base = F.when(recency > 180, 0.8).when(recency > 90, 0.6).when(recency > 30, 0.3).otherwise(0.1)
    scale = F.when((frequency > 10) & (monetary > 5000000), 0.5).when(frequency > 5, 0.7).when(frequency <= 1, 1.3).otherwise(1.0)
    return F.least(base * scale, F.lit(1.0))


def classify(orders: DataFrame, customers: DataFrame, behaviour: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """D-01..D-08 together: one classification row per customer."""
    scored = rfm_scores(customer_metrics(orders, customers, as_of, days)).join(
        behaviour.select("customer_id", "behavior_type"), "customer_id", "left")
    return scored.withColumns({
        "rfm_segment": rfm_segment(F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score"), F.col("is_new_customer")),
        "clv_prediction": lifetime_value(F.col("avg_order_value"), F.col("order_frequency"), F.col("active_months"), F.col("current_segment")),
        "churn_probability": churn_probability(F.col("recency_days"), F.col("order_frequency"), F.col("total_monetary"))})


def segment_analytics(classified: DataFrame) -> DataFrame:
    """D-09: size, share and means per segment."""
    g = classified.groupBy("rfm_segment").agg(
        F.count("*").alias("customer_count"), F.round(F.avg("clv_prediction"), 6).alias("avg_clv"),
        F.round(F.avg("churn_probability"), 6).alias("avg_churn"), F.round(F.avg("recency_days"), 6).alias("avg_recency"))
    total = classified.agg(F.count("*").alias("n")).scalar()
    return g.withColumn("percentage", F.col("customer_count") * 100.0 / total)


def segment_performance(classified: DataFrame, engagement: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """D-09: churn bands, engagement and last month's revenue per segment; orders folded per customer first (G-10)."""
    o = orders.where(since("order_date", as_of, 30)).groupBy("customer_id").agg(F.sum("total_amount").alias("_v"), F.count("*").alias("_n"))
    rows = classified.join(engagement.select("customer_id", "overall_score"), "customer_id", "left").join(o, "customer_id", "left")
    return rows.groupBy("rfm_segment").agg(
        F.count("*").alias("customer_count"), F.round(F.avg("clv_prediction"), 6).alias("avg_clv"),
        F.round(F.avg("churn_probability"), 6).alias("avg_churn_risk"), F.round(F.avg("overall_score"), 6).alias("avg_engagement"),
        F.count_if(F.col("churn_probability") > 0.7).alias("high_risk_customers"),
        F.count_if(F.col("churn_probability") < 0.3).alias("low_risk_customers"),
        F.coalesce(dsum("_v"), F.lit(0.0)).alias("monthly_revenue"), ratio(F.sum("_v"), F.sum("_n")).alias("avg_monthly_order_value"))


def behaviour_analysis(classified: DataFrame, engagement: DataFrame, orders: DataFrame, as_of: str) -> DataFrame:
    """D-09: per behaviour type."""
    o = orders.where(since("order_date", as_of, 365)).groupBy("customer_id").agg(
        davg("total_amount").alias("_aov"), F.count("*").alias("_n"))
    rows = classified.join(engagement.select("customer_id", "overall_score"), "customer_id", "left").join(o, "customer_id", "left")
    return rows.groupBy("behavior_type").agg(
        F.count("*").alias("customer_count"), F.round(F.avg("clv_prediction"), 6).alias("avg_clv"),
        F.round(F.avg("overall_score"), 6).alias("avg_engagement"), F.count_if(F.col("churn_probability") > 0.5).alias("churn_risk_count"),
        F.round(F.avg("_aov"), 6).alias("avg_order_value"), F.round(F.avg("_n"), 6).alias("avg_order_frequency"))


def customer_profile(customers: DataFrame, classified: DataFrame, engagement: DataFrame, tiers: DataFrame, stages: DataFrame,
                     orders: DataFrame, as_of: str) -> DataFrame:
    """D-10: one wide row per customer with the latest journey stage (max_by, no window)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    stage = stages.groupBy("customer_id").agg(F.max_by("stage_name", F.struct("entered_at", "stage_name")).alias("journey_stage"))
    o = orders.groupBy("customer_id").agg(F.count("*").alias("total_orders"), dsum("total_amount").alias("total_spent"),
                                          F.max("order_date").alias("last_order_date"))
    out = customers.select("customer_id", "customer_name")
    for side in (classified.select("customer_id", "rfm_segment", "behavior_type", "churn_probability"),
                 engagement.select("customer_id", "overall_score"), tiers.select("customer_id", "current_tier", "tier_points"), stage, o):
        out = out.join(side, "customer_id", "left")
    return out.withColumn("total_orders", F.coalesce("total_orders", F.lit(0))).withColumn(
        "days_since_last_order", whole_days(F.col("last_order_date"), now))


def engagement_scores(customers: DataFrame, activity: DataFrame, orders: DataFrame, as_of: str, orders_as_of: str | None = None,
                      email: Sequence[str] = ("email_open", "email_click"),
                      site: Sequence[str] = ("page_view", "product_view", "search")) -> DataFrame:
    """D-11: email / 10, sessions / 20, purchases / 5, each at most 1, weighted 0.3 / 0.3 / 0.4."""
    recent = activity.where(since("ts", as_of, 30)).groupBy("customer_id").agg(
        F.count_if(F.col("activity_type").isin(list(email))).alias("_e"),
        F.countDistinct(F.when(F.col("activity_type").isin(list(site)), F.col("session_id"))).alias("_s"))
    bought = orders.where(since("order_date", orders_as_of or as_of, 90)).groupBy("customer_id").agg(F.count("*").alias("_p"))
    out = customers.select("customer_id").join(recent, "customer_id", "left").join(bought, "customer_id", "left")
    part = lambda c, n: F.least(F.coalesce(F.col(c), F.lit(0)) / float(n), F.lit(1.0))
    out = out.select("customer_id", part("_e", 10).alias("email_score"), part("_s", 20).alias("website_score"), part("_p", 5).alias("purchase_score"))
    total = F.col("email_score") * 0.3 + F.col("website_score") * 0.3 + F.col("purchase_score") * 0.4
    return out.withColumn("overall_score", total)


# Fixed values: (tier, spend, orders); all but the last two need both.
TIERS = [("diamond", 50000000, 20), ("platinum", 20000000, 10), ("gold", 10000000, 5), ("silver", 5000000, 3)]
BRONZE = (1000000, 1)


def value_tiers(customers: DataFrame, orders: DataFrame, as_of: str, scale: float = 1.0) -> DataFrame:
    """D-12: tier of the last 365 days and points; ``scale`` adapts the spend limits to the currency."""
    o = orders.where(since("order_date", as_of, 365)).groupBy("customer_id").agg(F.sum("total_amount").alias("_s"), F.count("*").alias("_n"))
    spent, n = F.coalesce(F.col("_s").cast("double"), F.lit(0.0)), F.coalesce(F.col("_n"), F.lit(0))
    tier = F.when(F.lit(False), "")
    for name, money, count in TIERS:
        tier = tier.when((spent >= money * scale) & (n >= count), name)
    tier = tier.when((spent >= BRONZE[0] * scale) | (n >= BRONZE[1]), "bronze").otherwise("new")
    return customers.select("customer_id").join(o, "customer_id", "left").select(
        "customer_id", spent.alias("total_spent"), n.alias("order_count"), tier.alias("current_tier"),
        F.floor(spent / 10000).cast("bigint").alias("tier_points"))


def tier_changes(current: DataFrame, computed: DataFrame) -> DataFrame:
    """D-12: new contents of the tier table; unchanged tiers keep their row."""
    old = current.select("customer_id", F.col("current_tier").alias("_tier"), F.col("previous_tier").alias("_prev"), F.col("tier_points").alias("_points"))
    both = old.join(computed.select("customer_id", "current_tier", "tier_points"), "customer_id", "full_outer")
    moved = F.col("current_tier").isNotNull() & (F.col("_tier").isNull() | (F.col("_tier") != F.col("current_tier")))
    return both.select("customer_id", F.when(moved, F.col("current_tier")).otherwise(F.col("_tier")).alias("current_tier"),
                       F.when(moved, F.col("_tier")).otherwise(F.col("_prev")).alias("previous_tier"),
                       F.when(moved, F.col("tier_points")).otherwise(F.col("_points")).alias("tier_points"), moved.alias("changed"))


def high_risk(classified: DataFrame, threshold: float, limit: int) -> DataFrame:
    """D-13: highest churn first; the limit is the list length asked for."""
    return classified.where(F.col("churn_probability") >= threshold).orderBy(
        F.desc("churn_probability"), F.desc("clv_prediction"), "customer_id").limit(limit)


# Advice per segment, behaviour, risk and value, in order of priority.
SEGMENT_ACTIONS = {
    "champion": ["Offer exclusive VIP experiences and early access to new products", "Create loyalty program with premium benefits",
                 "Request reviews and referrals from these valuable customers"],
    "loyal": ["Maintain engagement with personalized offers", "Cross-sell complementary products", "Invite to beta test new features"],
    "potential_loyalist": ["Send targeted promotions to increase purchase frequency", "Offer membership or subscription programs",
                           "Provide excellent customer service to build loyalty"],
    "new_customer": ["Send welcome series with product education", "Offer first-purchase incentives", "Monitor engagement closely in first 90 days"],
    "need_attention": ["Send re-engagement campaigns", "Offer limited-time discounts to reactivate", "Survey for feedback on service improvement"],
    "at_risk": ["Immediate intervention with personalized offers", "Reach out via phone or email for feedback", "Provide special incentives to prevent churn"],
    "cannot_lose": ["High-priority retention campaign", "Assign dedicated customer success manager", "Offer exclusive deals and premium support"],
    "lost": ["Win-back campaign with significant incentives", "Survey to understand reasons for leaving",
             "Consider if customer is worth re-acquisition cost"],
}
BEHAVIOUR_ACTIONS = {
    "bargain_hunter": ["Send notifications about sales and discounts", "Offer price-match guarantees", "Create bundle deals for better value"],
    "impulse_buyer": ["Use urgency tactics in marketing (limited time offers)", "Show related products prominently", "Send flash sale notifications"],
    "loyalist": ["Reward brand loyalty with exclusive benefits", "Introduce new products from preferred brands", "Create brand ambassador opportunities"],
}
HIGH_CHURN_ACTION = "🚨 High churn risk - immediate retention action needed"
MEDIUM_CHURN_ACTION = "⚠️ Medium churn risk - monitor closely and engage proactively"
HIGH_VALUE_ACTION = "💎 High-value customer - provide white-glove service"


def _advice(c: Column, table: Mapping[str, Sequence[str]]) -> Column:
    none = F.array().cast("array<string>")
    out = F.when(F.lit(False), none)
    for key, texts in table.items():
        out = out.when(c == key, F.array(*[F.lit(x) for x in texts]))
    return out.otherwise(none)


def actions(segment: Column, behaviour: Column, churn: Column, clv: Column, first: int = 5) -> Column:
    """D-14: the first five pieces of advice."""
    risk = F.when(churn > 0.7, HIGH_CHURN_ACTION).when(churn > 0.4, MEDIUM_CHURN_ACTION)
    rest = F.array_compact(F.array(risk, F.when(clv > 10000000, HIGH_VALUE_ACTION)))
    return F.slice(F.concat(_advice(segment, SEGMENT_ACTIONS), _advice(behaviour, BEHAVIOUR_ACTIONS), rest), 1, first)


def activity_status(orders: DataFrame, as_of: str) -> DataFrame:
    """D-46: Active within 30 days, Recent within 90, else Inactive."""
    g = orders.groupBy("customer_id").agg(F.max("order_date").alias("last_order"))
    return g.withColumn("status", F.when(since("last_order", as_of, 30), "Active").when(since("last_order", as_of, 90), "Recent").otherwise("Inactive"))


def spend_tier_edges(df: DataFrame, column: str) -> DataFrame:
    """Quartile edges of a column as one row."""
    return quantiles(df, [column], [0.25, 0.5, 0.75]).select("q0", "q1", "q2")
