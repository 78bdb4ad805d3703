"""The given Parquet tables under retail names, in Spark and as SQL text for the oracle.

orders -> ord, lineitem -> itm, part -> prd, customer -> cst (with nation and region), events -> act,
documents -> fbk (feedback), nation -> vch (vouchers), orders -> vus (voucher usage).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


AS_OF = "2001-08-01 00:00:00"          # newest order date
EVENTS_AS_OF = "2024-01-31 00:00:00"   # just after the newest event
FEEDBACK_FROM = "2024-01-01 00:00:00"

SQL_VIEWS = {
    "ord": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
        o_totalprice::DECIMAL(18,2) AS total_amount, o_orderdate AS order_date,
        o_orderpriority AS payment_method FROM orders""",
    "itm": """SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id,
        l_suppkey AS seller_id, l_quantity::DECIMAL(18,2) AS quantity,
        l_extendedprice::DECIMAL(18,2) AS item_total, l_discount::DECIMAL(4,2) AS discount,
        l_tax::DECIMAL(4,2) AS tax, l_returnflag AS return_flag, l_linestatus AS line_status,
        l_shipdate AS ship_date FROM lineitem""",
    "prd": """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
        p_retailprice::DECIMAL(18,2) AS price, p_size AS stock_quantity FROM part""",
    "cst": """SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS customer_segment,
        c_acctbal::DECIMAL(18,2) AS balance, n_name AS city, r_name AS region, c_nationkey AS city_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "act": """SELECT event_id, ts, user_id AS customer_id, event_type AS activity_type,
        value::DECIMAL(18,2) AS value, props,
        CASE user_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' WHEN 2 THEN 'android' ELSE 'pos' END AS platform
        FROM events""",
    "fbk": """SELECT doc_id AS feedback_id, text, lang, source, doc_id % 97 AS product_id,
        doc_id % 53 AS customer_id,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id * 7 % 720)::INTEGER) AS created_at
        FROM documents""",
    "vch": """SELECT 'V' || n_nationkey AS voucher_id, 'CODE' || n_nationkey AS code, n_name AS name,
        CASE n_nationkey % 4 WHEN 0 THEN 'percentage' WHEN 1 THEN 'fixed_amount'
             WHEN 2 THEN 'free_shipping' ELSE 'percentage' END AS voucher_type,
        CASE n_nationkey % 4 WHEN 0 THEN 10 + n_nationkey WHEN 1 THEN 20000 WHEN 2 THEN 1
             ELSE 5 END::DECIMAL(18,2) AS discount_value,
        CASE WHEN n_nationkey % 4 = 0 THEN 30000 END::DECIMAL(18,2) AS max_discount_amount,
        (n_nationkey * 4000)::DECIMAL(18,2) AS min_order_amount,
        CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey * 40)::BIGINT END AS usage_limit,
        (1 + n_nationkey % 3)::BIGINT AS usage_limit_per_customer,
        CASE WHEN n_nationkey % 6 = 1 THEN 'customer_segment' WHEN n_nationkey % 6 = 2
             THEN 'specific_customers' ELSE 'all_customers' END AS target_type,
        CASE WHEN n_nationkey % 2 = 0 THEN ['BUILDING', 'MACHINERY'] ELSE ['AUTOMOBILE'] END AS target_segments,
        n_nationkey AS target_city_id,
        TIMESTAMP '1999-01-01' + to_days(n_nationkey * 30) AS start_date,
        TIMESTAMP '2001-03-01' + to_days(n_nationkey * 20) AS end_date, 'active' AS status
        FROM nation""",
    "vus": """SELECT o_orderkey AS usage_id, 'V' || (o_orderkey * 7 + o_custkey) % 25 AS voucher_id,
        o_custkey AS customer_id, o_orderkey AS order_id, o_totalprice::DECIMAL(18,2) AS order_amount,
        (o_totalprice::DECIMAL(18,2) * 0.05::DECIMAL(4,2))::DECIMAL(18,4) AS discount_applied,
        o_orderdate AS used_at FROM orders""",
}


PLATFORMS = ["Lazada", "Shopee", "Tiki", "Sendo", "FPTShop", "CellphoneS", "Other"]
PAYMENTS = ["COD", "MoMo", "ZaloPay", "VNPay", "Banking", "Card"]
SHIPPING = ["Standard", "Express", "Same_Day", "Drone"]
STATUSES = ["Pending", "Confirmed", "Shipped", "Delivered", "Cancelled", "Lost"]


def _sql_pick(values, number):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + ({number}) % {len(values)}]"


SQL_VIEWS["sev"] = f"""SELECT order_id * 10 + line_number AS event_id, order_id, customer_id, product_id,
    {_sql_pick(PLATFORMS, 'seller_id')} AS platform, quantity::INTEGER AS quantity,
    floor(item_total::DOUBLE / quantity::DOUBLE)::BIGINT AS unit_price_vnd,
    floor(item_total::DOUBLE / quantity::DOUBLE) / 24000 AS unit_price_usd, floor(item_total)::BIGINT AS total_amount_vnd,
    floor(item_total)::BIGINT / 24000.0::DOUBLE AS total_amount_usd, floor(item_total * discount)::BIGINT AS discount_amount_vnd,
    floor(item_total * tax)::BIGINT AS tax_amount_vnd, (CASE WHEN line_number % 3 = 0 THEN 0 ELSE 30000 END)::BIGINT AS shipping_fee_vnd,
    {_sql_pick(PAYMENTS, 'order_id')} AS payment_method, {_sql_pick(SHIPPING, 'line_number')} AS shipping_method,
    {_sql_pick(STATUSES, 'order_id // 6')} AS order_status, order_id % 6 = 0 AS is_cod,
    (month(order_date) * 100 + day(order_date)) BETWEEN 120 AND 220 AS is_tet_order,
    (month(order_date) * 100 + day(order_date)) IN (909, 1010, 1111, 1212) AS is_festival_order, city AS shipping_province,
    region AS shipping_region, ship_date AS event_timestamp, order_date AS order_timestamp
    FROM itm JOIN ord USING (order_id) JOIN cst USING (customer_id)"""


def pick(values, number) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def money(column) -> F.Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


class Tables:
    """Lazily read stand-ins; only the columns a query touches reach the Parquet scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ord(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"), money("o_totalprice").alias("total_amount"),
            F.col("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("payment_method"))

    @cached_property
    def itm(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
            money("l_quantity").alias("quantity"), money("l_extendedprice").alias("item_total"),
            F.col("l_discount").cast("decimal(4,2)").alias("discount"),
            F.col("l_tax").cast("decimal(4,2)").alias("tax"), F.col("l_returnflag").alias("return_flag"),
            F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("ship_date"))

    @cached_property
    def prd(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
            money("p_retailprice").alias("price"), F.col("p_size").alias("stock_quantity"))

    @cached_property
    def cst(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"),
                                           F.col("n_regionkey").alias("_region"))
        region = self.raw("region").select(F.col("r_regionkey").alias("_region"), F.col("r_name").alias("region"))
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"), money("c_acctbal").alias("balance"),
            F.col("c_nationkey").alias("city_id")).join(nation.join(region, "_region").drop("_region"), "city_id")

    @cached_property
    def act(self) -> DataFrame:
        platform = F.element_at(F.array(*[F.lit(p) for p in ("web", "ios", "android", "pos")]),
                                (F.col("user_id") % 4 + 1).cast("int"))
        return self.raw("events").select(
            "event_id", "ts", F.col("user_id").alias("customer_id"), F.col("event_type").alias("activity_type"),
            money("value").alias("value"), "props", platform.alias("platform"))

    @cached_property
    def fbk(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("feedback_id"), "text", "lang", "source",
            (F.col("doc_id") % 97).alias("product_id"), (F.col("doc_id") % 53).alias("customer_id"),
            F.expr(f"TIMESTAMP_NTZ '{FEEDBACK_FROM}' + make_dt_interval(0, cast(doc_id * 7 % 720 as int))")
            .alias("created_at"))

    @cached_property
    def vch(self) -> DataFrame:
        k = F.col("n_nationkey")
        kind = F.when(k % 4 == 1, "fixed_amount").when(k % 4 == 2, "free_shipping").otherwise("percentage")
        worth = F.when(k % 4 == 0, 10 + k).when(k % 4 == 1, 20000).when(k % 4 == 2, 1).otherwise(5)
        target = (F.when(k % 6 == 1, "customer_segment").when(k % 6 == 2, "specific_customers")
                  .otherwise("all_customers"))
        segments = F.when(k % 2 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(
            F.array(F.lit("AUTOMOBILE")))
        return self.raw("nation").select(
            F.concat(F.lit("V"), k).alias("voucher_id"), F.concat(F.lit("CODE"), k).alias("code"),
            F.col("n_name").alias("name"), kind.alias("voucher_type"), money(worth).alias("discount_value"),
            money(F.when(k % 4 == 0, 30000)).alias("max_discount_amount"),
            money(k * 4000).alias("min_order_amount"),
            F.when(k % 5 != 0, k * 40).cast("bigint").alias("usage_limit"),
            (1 + k % 3).cast("bigint").alias("usage_limit_per_customer"), target.alias("target_type"),
            segments.alias("target_segments"), k.alias("target_city_id"),
            F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00' + make_dt_interval(n_nationkey * 30)").alias("start_date"),
            F.expr("TIMESTAMP_NTZ '2001-03-01 00:00:00' + make_dt_interval(n_nationkey * 20)").alias("end_date"),
            F.lit("active").alias("status"))

    @cached_property
    def vus(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("usage_id"),
            F.concat(F.lit("V"), (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 25).alias("voucher_id"),
            F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"),
            money("o_totalprice").alias("order_amount"),
            (money("o_totalprice") * F.lit("0.05").cast("decimal(4,2)")).cast("decimal(18,4)").alias("discount_applied"),
            F.col("o_orderdate").alias("used_at"))

    @cached_property
    def sales(self) -> DataFrame:
        """Order lines with their order's customer, date and status."""
        return self.itm.join(self.ord, "order_id")

    @cached_property
    def sev(self) -> DataFrame:
        """Sales events, one per order line."""
        md = F.month("order_date") * 100 + F.dayofmonth("order_date")
        unit = F.floor(F.col("item_total").cast("double") / F.col("quantity").cast("double"))
        total = F.floor("item_total").cast("bigint")
        rows = self.sales.join(self.cst.select("customer_id", "city", "region"), "customer_id")
        return rows.select(
            (F.col("order_id") * 10 + F.col("line_number")).alias("event_id"), "order_id", "customer_id", "product_id",
            pick(PLATFORMS, F.col("seller_id")).alias("platform"), F.col("quantity").cast("int").alias("quantity"),
            unit.alias("unit_price_vnd"), (unit.cast("double") / 24000).alias("unit_price_usd"), total.alias("total_amount_vnd"),
            (total.cast("double") / 24000).alias("total_amount_usd"),
            F.floor(F.col("item_total") * F.col("discount")).cast("bigint").alias("discount_amount_vnd"),
            F.floor(F.col("item_total") * F.col("tax")).cast("bigint").alias("tax_amount_vnd"),
            F.when(F.col("line_number") % 3 == 0, 0).otherwise(30000).cast("bigint").alias("shipping_fee_vnd"),
            pick(PAYMENTS, F.col("order_id")).alias("payment_method"), pick(SHIPPING, F.col("line_number")).alias("shipping_method"),
            pick(STATUSES, F.floor(F.col("order_id") / 6)).alias("order_status"), (F.col("order_id") % 6 == 0).alias("is_cod"),
            md.between(120, 220).alias("is_tet_order"), md.isin(909, 1010, 1111, 1212).alias("is_festival_order"),
            F.col("city").alias("shipping_province"), F.col("region").alias("shipping_region"),
            F.col("ship_date").alias("event_timestamp"), F.col("order_date").alias("order_timestamp"))
