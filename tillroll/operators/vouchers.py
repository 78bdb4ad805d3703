"""Vouchers: validity with reason, discount, recommendation, status changes and statistics. All set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import davg, dsum, pct
from tillroll.operators.joins import validity_join

FREE_SHIPPING = 30000  # fixed value: assumed shipping cost


def usage_counts(usage: DataFrame) -> DataFrame:
    return usage.groupBy("voucher_id").agg(F.count("*").alias("uses"), dsum("discount_applied").alias("total_discount"))


def customer_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("voucher_id", "customer_id").agg(F.count("*").alias("customer_uses"))


def discount(kind: Column, value: Column, cap: Column, amount: Column) -> Column:
    """D-27: percentage with cap, fixed amount or free shipping; never above the order (G-17)."""
    percent = amount * (value / 100)
    raw = (F.when(kind == "percentage", F.when(F.coalesce(cap, F.lit(0.0)) > 0, F.least(percent, cap)).otherwise(percent))
           .when(kind == "fixed_amount", value).when(kind == "free_shipping", F.lit(float(FREE_SHIPPING))).otherwise(F.lit(0.0)))
    return F.least(raw, amount)


def _discount_of(amount: str) -> Column:
    return discount(F.col("voucher_type"), F.col("discount_value").cast("double"), F.col("max_discount_amount").cast("double"), F.col(amount).cast("double"))


def targeted(city: str = "city_id") -> Column:
    """Whether the customer is in the voucher's target group."""
    return (F.when(F.col("target_type") == "customer_segment", F.coalesce(F.array_contains("target_segments", F.col("customer_segment")), F.lit(False)))
            .when(F.col("target_type") == "specific_customers", F.coalesce(F.col("target_city_id") == F.col(city), F.lit(False))).otherwise(F.lit(True)))


def validate(requests: DataFrame, vouchers: DataFrame, usage: DataFrame, customers: DataFrame, ts: str) -> DataFrame:
    """D-26: outcome and first failing reason for every (voucher, customer, order) request."""
    rows = (requests.join(vouchers, "voucher_id", "left").join(usage_counts(usage), "voucher_id", "left")
            .join(customer_usage(usage), ["voucher_id", "customer_id"], "left")
            .join(customers.select("customer_id", "customer_segment", "city_id"), "customer_id", "left"))
    uses, mine = F.coalesce("uses", F.lit(0)), F.coalesce("customer_uses", F.lit(0))
    live = F.coalesce((F.col("status") == "active") & F.col(ts).between(F.col("start_date"), F.col("end_date")), F.lit(False))
    reason = (F.when(~live, "not_found_or_expired").when(F.col("order_amount") < F.col("min_order_amount"), "below_minimum")
              .when(F.col("usage_limit") <= uses, "used_up").when(F.col("usage_limit_per_customer") <= mine, "customer_limit")
              .when(~targeted(), F.when(F.col("target_type") == "customer_segment", "segment_mismatch").otherwise("customer_mismatch")))
    return rows.select("order_id", "voucher_id", "customer_id", reason.isNull().alias("valid"), reason.alias("reason"),
                       F.when(reason.isNull(), _discount_of("order_amount")).alias("discount_amount"))


def recommend(orders: DataFrame, vouchers: DataFrame, usage: DataFrame, customers: DataFrame, ts: str) -> DataFrame:
    """D-28: vouchers usable for each order, with the estimated discount and savings.

    Orders meet vouchers in slices of time (``validity_join``), refined by dates, limits and target.
    """
    open_ = vouchers.join(usage_counts(usage), "voucher_id", "left").where(
        (F.col("status") == "active") & (F.col("usage_limit").isNull() | (F.coalesce("uses", F.lit(0)) < F.col("usage_limit")))).drop("uses", "total_discount")
    pairs = validity_join(orders, ts, open_, "start_date", "end_date").where(F.col("min_order_amount") <= F.col("total_amount"))
    pairs = pairs.join(customers.select("customer_id", "customer_segment", "city_id"), "customer_id").where(targeted())
    pairs = pairs.join(customer_usage(usage), ["voucher_id", "customer_id"], "left").where(
        F.coalesce("customer_uses", F.lit(0)) < F.col("usage_limit_per_customer"))
    d = _discount_of("total_amount")
    return pairs.select("order_id", "customer_id", "voucher_id", "code", d.alias("estimated_discount"), pct(d, F.col("total_amount"), 0).alias("savings_percentage"))


def _status(as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp_ntz")
    uses = F.coalesce("uses", F.lit(0))
    return (F.when(now > F.col("end_date"), "expired").when(F.col("usage_limit").isNotNull() & (uses >= F.col("usage_limit")), "used_up")
            .when(now < F.col("start_date"), "not_started").otherwise("active"))


def stats(vouchers: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """D-29: usage and current status per active voucher."""
    rows = vouchers.where("status = 'active'").join(usage_counts(usage), "voucher_id", "left")
    uses = F.coalesce("uses", F.lit(0))
    return rows.select("voucher_id", "code", "voucher_type", uses.alias("current_usage"), F.coalesce("total_discount", F.lit(0.0)).alias("total_discount_given"),
                       F.when(F.col("usage_limit").isNull(), 100.0).otherwise(F.coalesce(F.try_divide(uses.cast("double"), F.col("usage_limit")) * 100, F.lit(0.0))).alias("usage_percentage"),
                       _status(as_of).alias("current_status"))


def daily_usage(usage: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """D-29: usage per day."""
    return usage.where(F.col("used_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY")).groupBy(F.to_date("used_at").alias("usage_date")).agg(
        F.count("*").alias("total_usage"), F.countDistinct("customer_id").alias("unique_customers"), dsum("discount_applied").alias("total_discount_given"),
        davg("order_amount").alias("avg_order_value"), F.countDistinct("voucher_id").alias("vouchers_used"))


def customer_patterns(usage: DataFrame, vouchers: DataFrame, at_least: int = 2) -> DataFrame:
    """D-29: customers with several uses. The list of voucher types has as many entries as there are types."""
    rows = usage.join(vouchers.select("voucher_id", "voucher_type"), "voucher_id")
    per = rows.groupBy("customer_id", "voucher_type").agg(F.count("*").alias("n"), F.sum("discount_applied").alias("d"), F.sum("order_amount").alias("a"),
                                                          F.min("used_at").alias("f"), F.max("used_at").alias("l"))
    return per.groupBy("customer_id").agg(
        F.sum("n").alias("total_vouchers_used"), dsum("d").alias("total_savings"), F.try_divide(dsum("a"), F.sum("n")).alias("avg_order_value"),
        F.min("f").alias("first_voucher_usage"), F.max("l").alias("last_voucher_usage"), F.count("*").alias("voucher_types_used"),
        F.array_join(F.sort_array(F.collect_list("voucher_type")), ",").alias("preferred_voucher_types")).where(F.col("total_vouchers_used") >= at_least)


def monthly_summary(vouchers: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """D-29: live vouchers, usage and discount of the month as one row."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = vouchers.agg(F.count_if((F.col("status") == "active") & now.between(F.col("start_date"), F.col("end_date"))).alias("n")).scalar()
    month = usage.where(F.col("used_at") >= F.date_trunc("month", now).cast("timestamp_ntz"))
    return month.agg(F.count("*").alias("monthly_usage"), F.coalesce(dsum("discount_applied"), F.lit(0.0)).alias("monthly_discount")).withColumn("active_vouchers", live)


def top_vouchers(vouchers: DataFrame, usage: DataFrame, as_of: str, days: int = 30, k: int = 10) -> DataFrame:
    """D-29: most used vouchers of the last days."""
    g = usage.where(F.col("used_at") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY")).groupBy("voucher_id").agg(
        F.count("*").alias("usage_count"), dsum("discount_applied").alias("total_discount"))
    return g.join(vouchers.select("voucher_id", "code", "name", "voucher_type"), "voucher_id").orderBy(F.desc("usage_count"), "voucher_id").limit(k)


def status_changes(vouchers: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """D-30: new status of every voucher: expired, used up or unchanged."""
    rows = vouchers.join(usage_counts(usage), "voucher_id", "left")
    now = F.lit(as_of).cast("timestamp_ntz")
    active = F.col("status") == "active"
    new = (F.when(active & (F.col("end_date") < now), "expired")
           .when(active & F.col("usage_limit").isNotNull() & (F.col("uses") >= F.col("usage_limit")), "used_up").otherwise(F.col("status")))
    return rows.select("voucher_id", F.col("status").alias("old_status"), new.alias("status"))
