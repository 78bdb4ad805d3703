"""Queries for joins and load patterns (J-01..J-18, SNK-08..12, SRC-09, ST-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import joins as J
from tillroll.operators import load as L
from tillroll.operators import sales as S
from tillroll.plans.registry import plan
from tillroll.plans.tables import AS_OF

# Surrogate keys for the lookups: natural key + 1000, only for customers with a positive balance.
_DIMS = """dc AS (SELECT customer_id, customer_id + 1000 AS k FROM cst WHERE balance > 0),
  dp AS (SELECT product_id, product_id + 1000 AS k FROM prd)"""


def _dims(t):
    dc = t.cst.select("customer_id", (F.col("customer_id") + 1000).alias("k"), (F.col("balance") > 0).alias("is_current"))
    dp = t.prd.select("product_id", (F.col("product_id") + 1000).alias("k"))
    return {"customer_id": (dc, "k", "customer_key"), "product_id": (dp, "k", "product_key")}


_FACT = "SELECT order_id, line_number, {c} AS customer_key, dp.k AS product_key, item_total::DOUBLE AS item_total FROM itm JOIN ord USING (order_id) {j} JOIN dc USING (customer_id) {j} JOIN dp USING (product_id)"


def _facts(t):
    return t.sales.select("order_id", "line_number", "customer_id", "product_id",
                          F.col("item_total").cast("double").alias("item_total"))


@plan("j01_lookup_keys", f"WITH {_DIMS} " + _FACT.format(c="dc.k", j="LEFT"))
def _(t):
    return J.lookup_keys(_facts(t), _dims(t))


@plan("j02_lookup_keys_inner", f"WITH {_DIMS} " + _FACT.format(c="dc.k", j="INNER"))
def _(t):
    return J.lookup_keys(_facts(t), _dims(t), how="inner")


@plan("j03_lookup_keys_default", f"WITH {_DIMS} " + _FACT.format(c="coalesce(dc.k, -1)", j="LEFT"))
def _(t):
    return J.lookup_keys(_facts(t), _dims(t), default=-1)


@plan("j04_wide_orders", """SELECT customer_segment, category, count(*) AS n, sum(item_total)::DOUBLE AS item_total,
  sum(total_amount)::DOUBLE AS total_amount, count(line_number) AS lines FROM ord LEFT JOIN cst USING (customer_id)
  LEFT JOIN itm USING (order_id) LEFT JOIN prd USING (product_id) GROUP BY 1, 2""")
def _(t):
    wide = J.wide_orders(t.ord, t.cst, t.itm, t.prd)
    return wide.groupBy("customer_segment", "category").agg(
        F.count("*").alias("n"), F.sum("item_total").cast("double").alias("item_total"),
        F.sum("total_amount").cast("double").alias("total_amount"), F.count("line_number").alias("lines"))


@plan("j04_growth_report", """SELECT (SELECT count(*) FROM ord) AS rows_before, count(*) AS rows_after,
  count(*)::DOUBLE / (SELECT count(*) FROM ord) AS growth FROM ord LEFT JOIN cst USING (customer_id) LEFT JOIN itm USING (order_id)
  LEFT JOIN prd USING (product_id)""")
def _(t):
    return J.growth_report(t.ord, J.wide_orders(t.ord, t.cst, t.itm, t.prd))


_STAR = """WITH p AS (SELECT order_id, sum(quantity) AS q, sum(item_total * (1 - discount)) AS v FROM itm GROUP BY 1),
  g AS (SELECT {place}, date_trunc('month', order_date)::DATE AS month, count(*) AS orders, sum(q)::DOUBLE AS quantity, sum(v) AS v,
    count(*) FILTER (order_status = 'F') * 100.0::DOUBLE / count(*) AS finished_pct
    FROM p JOIN ord USING (order_id) {how} JOIN {side} USING (customer_id) GROUP BY 1, 2)
  SELECT {place}, month, orders, quantity, v::DOUBLE AS net_revenue, v::DOUBLE / orders AS avg_order_value, finished_pct,
  v::DOUBLE * 100 / sum(v) OVER (PARTITION BY month)::DOUBLE AS share_of_month_pct FROM g"""


@plan("j05_star_summary", _STAR.format(place="region", how="", side="cst"))
def _(t):
    return J.star_summary(t.itm, t.ord, t.cst)


@plan("j06_star_summary_current", "WITH cur AS (SELECT * FROM cst WHERE balance > 0), " + _STAR.format(
    place="customer_segment", how="LEFT", side="cur")[5:])
def _(t):
    cur = J.current(t.cst.withColumn("is_current", F.col("balance") > 0))
    return J.star_summary(t.itm, t.ord, cur, "customer_segment", "left")


def _daily_units(t):
    return t.sales.groupBy(F.to_date("order_date").alias("day"), "product_id").agg(
        F.sum("quantity").cast("double").alias("units"))


_UNITS = """u AS (SELECT order_date::DATE AS day, product_id, sum(quantity)::DOUBLE AS units FROM itm JOIN ord USING (order_id) GROUP BY 1, 2)"""


@plan("j07_previous_day", f"""WITH {_UNITS} SELECT u.*, p.units AS prev_units FROM u LEFT JOIN u p
  ON p.product_id = u.product_id AND p.day = u.day - 1""")
def _(t):
    return J.previous_day(_daily_units(t), ["product_id"], "day", ["units"])


@plan("j08_share_of_total", """SELECT category, sum(item_total)::DOUBLE AS value,
  sum(item_total)::DOUBLE * 100 / (SELECT sum(item_total) FROM itm JOIN prd USING (product_id))::DOUBLE AS share_pct
  FROM itm JOIN prd USING (product_id) GROUP BY 1""")
def _(t):
    return J.share_of_total(t.itm.join(t.prd, "product_id"), "category", "item_total")


@plan("j09_with_partner", """SELECT customer_id, customer_segment FROM cst WHERE EXISTS (SELECT 1 FROM ord
  WHERE ord.customer_id = cst.customer_id AND total_amount > 450000) AND list_contains(['BUILDING', 'MACHINERY'], customer_segment)""")
def _(t):
    wanted = F.array_contains(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("customer_segment"))
    return J.with_partner(t.cst.where(wanted).select("customer_id", "customer_segment"),
                          t.ord.where("total_amount > 450000"), "customer_id")


@plan("j10_without_partner", """SELECT product_id, category FROM prd WHERE NOT EXISTS (SELECT 1 FROM itm
  WHERE itm.product_id = prd.product_id AND quantity > 45)""")
def _(t):
    return J.without_partner(t.prd.select("product_id", "category"), t.itm.where("quantity > 45"), "product_id")


@plan("j10_orphan_counts", """SELECT 'items_orders' AS rule, count(*) AS orphans, count(DISTINCT order_id) AS orphan_keys FROM itm
    WHERE order_id NOT IN (SELECT order_id FROM ord WHERE order_status <> 'P')
  UNION ALL SELECT 'orders_customers', count(*), count(DISTINCT customer_id) FROM ord
    WHERE customer_id NOT IN (SELECT customer_id FROM cst WHERE balance > 0)""")
def _(t):
    return J.orphan_counts({"items_orders": (t.itm, t.ord.where("order_status <> 'P'"), "order_id"),
                            "orders_customers": (t.ord, t.cst.where("balance > 0"), "customer_id")})


@plan("j11_validity_join", """SELECT voucher_id, count(*) AS orders, sum(total_amount)::DOUBLE AS amount
  FROM ord JOIN vch ON order_date BETWEEN start_date AND end_date AND total_amount >= min_order_amount GROUP BY 1""")
def _(t):
    pairs = J.validity_join(t.ord, "order_date", t.vch, "start_date", "end_date").where("total_amount >= min_order_amount")
    return pairs.groupBy("voucher_id").agg(F.count("*").alias("orders"), F.sum("total_amount").cast("double").alias("amount"))


def _dimension(t):
    """Day-1 dimension: every third customer is closed history plus a current row; a tenth is unseen."""
    base = t.cst.where("customer_id % 10 <> 0").select("customer_id", "customer_segment", "city")
    live = base.select("*", F.lit("2000-01-01").cast("date").alias("effective_date"),
                       F.lit(None).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"))
    old = base.where("customer_id % 3 = 0").select(
        "customer_id", F.lit("OLD").alias("customer_segment"), "city", F.lit("1998-01-01").cast("date").alias("effective_date"),
        F.lit("1999-12-31").cast("date").alias("expiry_date"), F.lit(False).alias("is_current"))
    return live.unionByName(old)


def _snapshot(t):
    """Day-2 snapshot: every seventh customer changes segment, every eleventh loses the city, some are missing."""
    return t.cst.where("customer_id % 13 <> 5").select(
        "customer_id", F.when(F.col("customer_id") % 7 == 0, "MOVED").otherwise(F.col("customer_segment")).alias("customer_segment"),
        F.when(F.col("customer_id") % 11 == 0, F.lit(None)).otherwise(F.col("city")).alias("city"))


_DIM = """base AS (SELECT customer_id, customer_segment, city FROM cst WHERE customer_id % 10 <> 0),
  dim AS (SELECT *, DATE '2000-01-01' AS effective_date, NULL::DATE AS expiry_date, TRUE AS is_current FROM base
    UNION ALL SELECT customer_id, 'OLD', city, DATE '1998-01-01', DATE '1999-12-31', FALSE FROM base WHERE customer_id % 3 = 0),
  snp AS (SELECT customer_id, CASE WHEN customer_id % 7 = 0 THEN 'MOVED' ELSE customer_segment END AS customer_segment,
    CASE WHEN customer_id % 11 <> 0 THEN city END AS city FROM cst WHERE customer_id % 13 <> 5),
  chg AS (SELECT s.* FROM snp s JOIN dim d USING (customer_id) WHERE d.is_current
    AND (s.customer_segment IS DISTINCT FROM d.customer_segment OR s.city IS DISTINCT FROM d.city)),
  merged AS (SELECT customer_id, customer_segment, city, effective_date,
      CASE WHEN is_current AND customer_id IN (SELECT customer_id FROM chg) THEN DATE '2000-06-30' ELSE expiry_date END AS expiry_date,
      is_current AND customer_id NOT IN (SELECT customer_id FROM chg) AS is_current FROM dim
    UNION ALL SELECT *, DATE '2000-07-01', NULL, TRUE FROM chg
    UNION ALL SELECT *, DATE '2000-07-01', NULL, TRUE FROM snp WHERE customer_id NOT IN (SELECT customer_id FROM dim))"""


@plan("j12_scd2_merge", f"WITH {_DIM} SELECT * FROM merged")
def _(t):
    return L.scd2_merge(_dimension(t), _snapshot(t), "customer_id", ["customer_segment", "city"], "2000-07-01")


@plan("j13_as_of_version", f"""WITH {_DIM} SELECT order_id, o.customer_id, m.customer_segment, m.city, m.effective_date
  FROM ord o LEFT JOIN merged m ON m.customer_id = o.customer_id AND effective_date <= order_date::DATE
  AND (expiry_date IS NULL OR order_date::DATE <= expiry_date)""")
def _(t):
    dim = L.scd2_merge(_dimension(t), _snapshot(t), "customer_id", ["customer_segment", "city"], "2000-07-01")
    return J.as_of_version(t.ord.select("order_id", "customer_id", "order_date"), dim, "customer_id", "order_date").select(
        "order_id", "customer_id", "customer_segment", "city", "effective_date")


@plan("j14_share_of_customers", """SELECT customer_segment, count(*) AS n, (SELECT count(*) FROM ord) AS orders_in_all,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cst) AS share_pct FROM cst GROUP BY 1""")
def _(t):
    return S.distribution(t.cst, "customer_segment").withColumn(
        "orders_in_all", t.ord.agg(F.count("*").alias("n")).scalar())


@plan("j15_used_up_vouchers", """SELECT voucher_id, usage_limit, (SELECT count(*) FROM vus WHERE vus.voucher_id = vch.voucher_id) AS uses
  FROM vch WHERE usage_limit IS NOT NULL AND (SELECT count(*) FROM vus WHERE vus.voucher_id = vch.voucher_id) >= usage_limit""")
def _(t):
    return J.decorrelated_count(t.vch, t.vus, "voucher_id").where("uses >= usage_limit").select(
        "voucher_id", "usage_limit", "uses")


@plan("j16_customer_totals", """WITH n AS (SELECT customer_id, count(*) AS total_orders, sum(total_amount)::DOUBLE AS total_spent FROM ord GROUP BY 1),
  c AS (SELECT customer_id, balance FROM cst UNION ALL SELECT -customer_id, balance FROM cst)
  SELECT c.customer_id, coalesce(n.total_orders, 0) AS total_orders, coalesce(n.total_spent, balance::DOUBLE) AS total_spent FROM c LEFT JOIN n USING (customer_id)""")
def _(t):
    """Every customer has a twin without orders, which keeps its old figures."""
    people = t.cst.select("customer_id", "balance")
    people = people.unionByName(people.withColumn("customer_id", -F.col("customer_id")))
    old = people.select("customer_id", F.lit(0).cast("bigint").alias("total_orders"), F.col("balance").cast("double").alias("total_spent"))
    new = t.ord.groupBy("customer_id").agg(F.count("*").alias("total_orders"), F.sum("total_amount").cast("double").alias("total_spent"))
    return S.sum_back(old, new, "customer_id", ["total_orders", "total_spent"])


@plan("j18_group_stats_back", """WITH g AS (SELECT category, sum(price)::DOUBLE / count(*) AS m, count(price) AS n,
  round(stddev_samp(price::DOUBLE), 4) AS s, quantile_cont(price::DOUBLE, 0.5) AS d FROM prd GROUP BY 1)
  SELECT product_id, category, price::DOUBLE AS price, m AS price_mean, n AS price_count, s AS price_std, round(d, 6) AS price_median,
  price::DOUBLE / m AS price_vs_mean, round(price::DOUBLE / d, 6) AS price_vs_median, price::DOUBLE - m AS price_minus_mean
  FROM prd JOIN g USING (category)""")
def _(t):
    out = J.group_stats_back(t.prd.select("product_id", "category", F.col("price").cast("decimal(18,2)").alias("price")),
                             "category", "price")
    return out.withColumn("price", F.col("price").cast("double")).withColumn(
        "price_median", F.round("price_median", 6)).withColumn("price_vs_median", F.round("price_vs_median", 6))


# ---- load patterns ----------------------------------------------------------------------------------

@plan("src09_newer_than", """SELECT order_id, order_date FROM ord WHERE order_date >
  (SELECT max(order_date) FROM ord WHERE order_status = 'F' AND order_date < '2001-06-01')""")
def _(t):
    loaded = t.ord.where("order_status = 'F' AND order_date < '2001-06-01'").agg(F.max("order_date").alias("m")).scalar()
    return L.newer_than(t.ord.select("order_id", "order_date"), "order_date", loaded)


@plan("src09_first_load", "SELECT order_id, order_date FROM ord WHERE order_date > '1900-01-01'")
def _(t):
    return L.newer_than(t.ord.select("order_id", "order_date"), "order_date", None)


@plan("snk08_export_rows", """SELECT order_id, order_date, total_amount::DOUBLE AS total_amount FROM ord
  WHERE order_date BETWEEN '2000-01-01' AND '2000-12-31' ORDER BY order_date DESC, order_id DESC LIMIT 1000""")
def _(t):
    rows = t.ord.select("order_id", "order_date", F.col("total_amount").cast("double").alias("total_amount"))
    return L.export_rows(rows, "order_date", "2000-01-01 00:00:00", "2000-12-31 00:00:00", 1000, "order_id")


_TARGET = """tgt AS (SELECT customer_id, customer_name, balance::DOUBLE AS balance FROM cst WHERE customer_id % 3 <> 0)"""


def _target(t):
    return t.cst.where("customer_id % 3 <> 0").select("customer_id", "customer_name", F.col("balance").cast("double").alias("balance"))


def _arrivals(t):
    return t.ord.select("customer_id", F.concat(F.lit("from order "), F.col("order_id")).alias("customer_name"),
                        F.col("total_amount").cast("double").alias("balance"), "order_date", "order_id")


@plan("snk09_insert_absent", f"""WITH {_TARGET} SELECT DISTINCT ON (customer_id) customer_id, 'from order ' || order_id AS customer_name,
  total_amount::DOUBLE AS balance FROM ord WHERE customer_id NOT IN (SELECT customer_id FROM tgt) ORDER BY customer_id, customer_name, balance""")
def _(t):
    return L.insert_absent(_target(t), _arrivals(t).select("customer_id", "customer_name", "balance"), ["customer_id"])


@plan("snk10_upsert", f"""WITH {_TARGET}, a AS (SELECT DISTINCT ON (customer_id) customer_id, 'from order ' || order_id AS customer_name,
    total_amount::DOUBLE AS balance FROM ord WHERE order_date >= '2000-06-01' ORDER BY customer_id, order_date DESC, order_id DESC)
  SELECT coalesce(a.customer_id, tgt.customer_id) AS customer_id, coalesce(a.customer_name, tgt.customer_name) AS customer_name,
  coalesce(a.balance, tgt.balance) AS balance, (CASE WHEN a.customer_id IS NOT NULL AND tgt.customer_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS update_count
  FROM tgt FULL JOIN a ON a.customer_id = tgt.customer_id""")
def _(t):
    target = _target(t).withColumn("update_count", F.lit(0).cast("bigint"))
    rows = _arrivals(t).where("order_date >= '2000-06-01'")
    return L.upsert(target, rows, ["customer_id"], ["order_date", "order_id"], "update_count")


@plan("snk11_replace_partition", """WITH r AS (SELECT order_date::DATE AS day, payment_method, count(*) AS n FROM ord GROUP BY 1, 2)
  SELECT day, payment_method, CASE WHEN day = DATE '2001-07-31' THEN n * 2 ELSE n END::BIGINT AS n FROM r""")
def _(t):
    table = t.ord.groupBy(F.to_date("order_date").alias("day"), "payment_method").agg(F.count("*").alias("n"))
    again = table.withColumn("n", F.col("n") * 2)
    return L.replace_partition(table, again, "day", [F.lit("2001-07-31").cast("date")])


@plan("snk12_retain", f"SELECT order_id, order_date FROM ord WHERE order_date >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY")
def _(t):
    return L.retain(t.ord.select("order_id", "order_date"), "order_date", AS_OF, 90)


@plan("st16_apply_changes", """WITH c AS (SELECT DISTINCT ON (customer_id) customer_id, order_status, total_amount::DOUBLE AS amount, order_id AS lsn
    FROM ord WHERE customer_id % 2 = 0 ORDER BY customer_id, order_id DESC),
  s AS (SELECT customer_id, 'base' AS order_status, balance::DOUBLE AS amount FROM cst)
  SELECT * FROM s WHERE customer_id NOT IN (SELECT customer_id FROM c)
  UNION ALL SELECT customer_id, order_status, amount FROM c WHERE lsn % 5 <> 0""")
def _(t):
    target = t.cst.select("customer_id", F.lit("base").alias("order_status"), F.col("balance").cast("double").alias("amount"))
    changes = t.ord.where("customer_id % 2 = 0").select(
        "customer_id", "order_status", F.col("total_amount").cast("double").alias("amount"), F.col("order_id").alias("lsn"),
        F.when(F.col("order_id") % 5 == 0, "D").when(F.col("order_id") % 5 == 1, "I").otherwise("U").alias("op"))
    return L.apply_changes(target, changes, ["customer_id"])
