"""Queries for cleaning and shaping (P-01..P-35). Dirt is derived from the given rows, the same in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions import text as X
from tillroll.operators import clean as C
from tillroll.plans.functions import sql_fold, sql_title
from tillroll.plans.registry import plan
from tillroll.plans.tables import AS_OF, pick

def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def today():
    return F.lit(AS_OF[:10]).cast("date")


def _case(value, table, default):
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


@plan("p01_sales_fact", f"""SELECT order_id, customer_id, product_id, platform, quantity AS quantity_ordered, 0 AS quantity_shipped, 0 AS quantity_returned,
  0 AS quantity_cancelled, unit_price_vnd, total_amount_vnd AS gross_sales_amount_vnd, discount_amount_vnd,
  total_amount_vnd - discount_amount_vnd AS net_sales_amount_vnd, tax_amount_vnd, shipping_fee_vnd, unit_price_usd,
  total_amount_usd AS net_sales_amount_usd, 24000.0::DOUBLE AS exchange_rate_vnd_usd, payment_method AS payment_method_english,
  {_case('payment_method', C.PAYMENT_VI, "'Thẻ tín dụng'")} AS payment_method_vietnamese, is_cod AS is_cod_order, FALSE AS is_installment_order,
  shipping_method AS shipping_method_english, {_case('shipping_method', C.SHIPPING_VI, "'Giao hàng tiêu chuẩn'")} AS shipping_method_vietnamese,
  order_status AS order_status_english, {_case('order_status', C.STATUS_VI, "'Đang xử lý'")} AS order_status_vietnamese, is_tet_order, is_festival_order,
  FALSE AS applied_vietnam_promotion, shipping_province, shipping_region, order_timestamp, event_timestamp AS created_at, TIMESTAMP '{AS_OF}' AS updated_at FROM sev""")
def _(t):
    return C.sales_fact(t.sev, now())


def _customer_events(t):
    k = F.col("customer_id")
    return t.cst.select(
        "customer_id", F.col("customer_name").alias("full_name"), F.concat(F.lit("c"), k, F.lit("@mail.vn")).alias("email"),
        F.concat(F.lit("09"), k).alias("phone"), (18 + k % 60).cast("int").alias("age"), pick(["F", "M"], k).alias("gender"),
        F.col("city").alias("province"), "region", pick(["Regular", "High_Value", "Premium", "Odd"], k).alias("customer_segment"),
        pick(["Low", "Middle", "High", "None"], k).alias("income_level"), pick(["Lazada", "Tiki"], k).alias("preferred_platform"),
        pick(["COD", "MoMo"], k).alias("preferred_payment"), pick(["web", "ios"], k).alias("preferred_device"),
        F.lit("1999-05-01 10:00:00").cast("timestamp_ntz").alias("created_at"))


@plan("p02_customer_row", f"""SELECT customer_id, customer_name AS full_name_vietnamese, 'c' || customer_id || '@mail.vn' AS email, '09' || customer_id AS phone_number,
  (18 + customer_id % 60)::INTEGER AS age, ['F', 'M'][1 + customer_id % 2] AS gender, city AS province, region,
  ['Regular', 'High_Value', 'Premium', 'Odd'][1 + customer_id % 4] AS customer_segment_english,
  ['Khách hàng thường', 'Khách hàng VIP', 'Khách hàng cao cấp', 'Khách hàng thường'][1 + customer_id % 4] AS customer_segment_vietnamese,
  ['Low', 'Middle', 'High', 'None'][1 + customer_id % 4] AS income_level_english,
  ['Thu nhập thấp', 'Thu nhập trung bình', 'Thu nhập cao', 'Thu nhập trung bình'][1 + customer_id % 4] AS income_level_vietnamese,
  ['Lazada', 'Tiki'][1 + customer_id % 2] AS preferred_platform, ['COD', 'MoMo'][1 + customer_id % 2] AS preferred_payment_method,
  ['web', 'ios'][1 + customer_id % 2] AS preferred_device, DATE '{AS_OF[:10]}' AS effective_date, NULL::DATE AS expiry_date, TRUE AS is_current,
  TIMESTAMP '1999-05-01 10:00:00' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at FROM cst""")
def _(t):
    return C.customer_row(_customer_events(t), today(), now())


def _product_events(t):
    return t.prd.select(
        "product_id", F.col("product_name").alias("product_name_vn"), F.upper("product_name").alias("product_name_en"), "brand",
        F.col("category").alias("category_l1"), F.lower("category").alias("category_l2"), F.floor("price").cast("bigint").alias("price_vnd"),
        (F.col("price").cast("double") / 24000).alias("price_usd"), ((F.col("stock_quantity") % 11) / F.lit(2.0)).alias("rating"),
        F.col("stock_quantity").alias("review_count"), F.array(F.lit("Tiki"), F.col("brand")).alias("available_platforms"),
        (F.col("product_id") % 3 == 0).alias("made_in_vietnam"), F.lit("1999-05-01 10:00:00").cast("timestamp_ntz").alias("created_at"))


@plan("p03_product_row", f"""SELECT product_id, product_name AS product_name_vietnamese, upper(product_name) AS product_name_english, brand AS brand_vietnamese,
  brand AS brand_english, category AS category_level_1_vietnamese, category AS category_level_1_english, lower(category) AS category_level_2_vietnamese,
  lower(category) AS category_level_2_english, floor(price)::BIGINT AS price_vnd, price::DOUBLE / 24000 AS price_usd, (stock_quantity % 11) / 2.0::DOUBLE AS rating,
  stock_quantity AS review_count, product_id % 3 = 0 AS made_in_vietnam, 'Tiki,' || brand AS platform_availability, DATE '{AS_OF[:10]}' AS effective_date,
  NULL::DATE AS expiry_date, TRUE AS is_current, 'kafka_streaming' AS data_source, TIMESTAMP '1999-05-01 10:00:00' AS created_at,
  TIMESTAMP '{AS_OF}' AS updated_at FROM prd""")
def _(t):
    return C.product_row(_product_events(t), today(), now()).withColumn("platform_availability", F.array_join("platform_availability", ","))


@plan("p04_sale_pricing", """SELECT event_id, (CASE WHEN q > 0 THEN unit_price_vnd - floor(discount_amount_vnd / q)::BIGINT ELSE unit_price_vnd END) AS final_price_vnd,
  coalesce(tot, unit_price_vnd * q) AS total_amount_vnd, (CASE WHEN is_cod THEN 5000 ELSE 0 END) AS cod_fee_vnd
  FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN 0 ELSE quantity END::INTEGER AS q, CASE WHEN event_id % 7 <> 0 THEN total_amount_vnd END AS tot FROM sev)""")
def _(t):
    ev = t.sev.withColumn("quantity", F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.col("quantity"))).withColumn(
        "total_amount_vnd", F.when(F.col("event_id") % 7 != 0, F.col("total_amount_vnd")))
    return C.sale_pricing(ev).select("event_id", "final_price_vnd", "total_amount_vnd", "cod_fee_vnd")


_RATE = "CASE platform " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.COMMISSION.items()) + " ELSE 0.06 END::DOUBLE"


@plan("p05_local_currency", f"""SELECT event_id, total_amount_usd * 24000 AS total_amount_vnd, unit_price_usd * 24000 AS unit_price_vnd,
  total_amount_usd * 24000 * 0.1::DOUBLE AS vat_amount_vnd, total_amount_usd * {_RATE} AS platform_commission FROM sev""")
def _(t):
    return C.to_local_currency(t.sev.withColumn("subtotal_usd", F.col("total_amount_usd"))).select(
        "event_id", "total_amount_vnd", "unit_price_vnd", "vat_amount_vnd", "platform_commission")


_METHODS = ["MoMo", "ZALOPAY", "vnpay", "Cash_On_Delivery", "credit_card", "Barter"]
_INCOMES = [" Low", "TRUNG BÌNH", "cao ", "unknown"]


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@plan("p06_codes", f"""WITH a AS (SELECT order_id, {_list(_METHODS)}[1 + order_id % 6] AS m, {_list(_INCOMES)}[1 + order_id % 4] AS i, total_amount::DOUBLE * 30 AS v FROM ord)
  SELECT order_id, {_case('lower(m)', C.PAYMENT_CODES, 'm')} AS method, {_case('lower(trim(i))', C.INCOME_CODES, 'i')} AS income,
  CASE WHEN v >= 12000000 THEN 'Premium' WHEN v >= 4800000 THEN 'High_Value' ELSE 'Regular' END AS segment FROM a""")
def _(t):
    k = F.col("order_id")
    return t.ord.select(k, C.payment_code(pick(_METHODS, k)).alias("method"), C.income_code(pick(_INCOMES, k)).alias("income"),
                        C.spending_segment(F.col("total_amount").cast("double") * 30).alias("segment"))


_CITIES = ["SG", " ha noi", "DA NANG", "hue", "quang ngai", "o'neil town", "hp", "Can Tho"]
_STATES = ["SP", "MG", "PR", "DF", "BA", "AC", "XX"]
_CITY = _case("lower(trim(a.raw))", C.CITIES, sql_title("a.raw"))


@plan("p07_places", f"""WITH a AS (SELECT customer_id, CASE WHEN customer_id % 17 = 0 THEN NULL ELSE {_list(_CITIES)}[1 + customer_id % 8] END AS raw,
    {_list(_STATES)}[1 + customer_id % 7] AS st FROM cst), b AS (SELECT customer_id, st, CASE WHEN raw IS NOT NULL THEN {_CITY} END AS city FROM a)
  SELECT customer_id, city, CASE WHEN city IS NULL THEN NULL ELSE {_case('city', C._invert(C.CITY_REGIONS), "'Unknown'")} END AS region,
  {_case('st', C._invert(C.STATE_REGIONS), "'other'")} AS state_region, {_case('st', C._invert(C.STATE_SEGMENTS), "'Other'")} AS state_segment FROM b""")
def _(t):
    k = F.col("customer_id")
    city = C.city_name(F.when(k % 17 != 0, pick(_CITIES, k)))
    return t.cst.select(k, city.alias("city"), C.city_region(city).alias("region"), C.state_region(pick(_STATES, k)).alias("state_region"),
                        C.state_segment(pick(_STATES, k)).alias("state_segment"))


@plan("p08_phones", f"""WITH a AS (SELECT customer_id, ['84-90 ', '09 0', '(7) 12'][1 + customer_id % 3] || (1000000 + customer_id * 7919) AS raw, (100000 + customer_id % 13 * 99999)::VARCHAR AS postal FROM cst),
  b AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM a),
  c AS (SELECT *, CASE WHEN starts_with(d, '84') THEN '+' || d WHEN starts_with(d, '0') THEN '+84' || substr(d, 2) ELSE '+84' || d END AS phone FROM b)
  SELECT customer_id, phone, regexp_matches(phone, '{X.LOCAL_PHONE}') AS phone_valid, regexp_matches(postal, '{X.POSTAL}') AS postal_valid FROM c""")
def _(t):
    k = F.col("customer_id")
    phone = X.phone_number(F.concat(pick(["84-90 ", "09 0", "(7) 12"], k), 1000000 + k * 7919))
    return t.cst.select(k, phone.alias("phone"), X.matches(phone, X.LOCAL_PHONE).alias("phone_valid"),
                        X.matches((100000 + k % 13 * 99999).cast("string"), X.POSTAL).alias("postal_valid"))


@plan("p09_names", f"""WITH a AS (SELECT product_id, '  ' || replace(product_name, ' ', '   ') || '-o''neil ' AS raw FROM prd)
  SELECT product_id, {sql_title(sql_fold('raw'))} AS name FROM a""")
def _(t):
    raw = F.concat(F.lit("  "), F.regexp_replace("product_name", " ", "   "), F.lit("-o'neil "))
    return t.prd.select("product_id", X.name_case(raw).alias("name"))


@plan("p10_zip", """SELECT customer_id, CASE WHEN length(z) >= 5 THEN z ELSE lpad(z, 5, '0') END AS zip FROM (SELECT customer_id, (customer_id * 37)::VARCHAR AS z FROM cst)""")
def _(t):
    return t.cst.select("customer_id", X.zero_pad(F.col("customer_id") * 37, 5).alias("zip"))


def _raw_products(t):
    k = F.col("product_id")
    name = F.when(k % 23 != 0, F.concat(F.lit("_"), F.col("category"), F.lit(" & "), F.col("brand")))
    m = lambda mod, off, ev: F.when(k % ev != 0, (k * 13 % mod + off).cast("double"))
    return t.prd.select(
        k, name.alias("product_category_name"), m(7000, -300, 19).alias("product_weight_g"), m(60, 0, 11).alias("product_length_cm"),
        m(40, 1, 13).alias("product_height_cm"), m(30, 1, 17).alias("product_width_cm"), (k % 7).alias("product_photos_qty"),
        (k * 31 % 3000).alias("product_description_length"), F.length("product_name").alias("product_name_length"))


_RAWP = """rawp AS (SELECT product_id, CASE WHEN product_id % 23 <> 0 THEN '_' || category || ' & ' || brand END AS product_category_name,
  CASE WHEN product_id % 19 <> 0 THEN (product_id * 13 % 7000 - 300)::DOUBLE END AS product_weight_g,
  CASE WHEN product_id % 11 <> 0 THEN (product_id * 13 % 60)::DOUBLE END AS product_length_cm,
  CASE WHEN product_id % 13 <> 0 THEN (product_id * 13 % 40 + 1)::DOUBLE END AS product_height_cm,
  CASE WHEN product_id % 17 <> 0 THEN (product_id * 13 % 30 + 1)::DOUBLE END AS product_width_cm, product_id % 7 AS product_photos_qty,
  product_id * 31 % 3000 AS product_description_length, length(product_name) AS product_name_length FROM prd)"""


@plan("p11_slug", f"""WITH {_RAWP} SELECT product_id, regexp_replace(regexp_replace(lower(coalesce(product_category_name, 'unknown')), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM rawp""")
def _(t):
    return _raw_products(t).select("product_id", X.slug("product_category_name").alias("slug"))


@plan("p12_clean_products", f"""WITH {_RAWP}, c AS (SELECT product_id, CASE WHEN product_weight_g >= 0 THEN product_weight_g END AS product_weight_g,
  regexp_replace(product_category_name, '[^a-zA-Z0-9_]', '', 'g') AS product_category_name FROM rawp) SELECT * FROM c WHERE product_category_name <> ''""")
def _(t):
    return C.clean_products(_raw_products(t)).select("product_id", "product_weight_g", "product_category_name")


@plan("p13_clean_customers", """WITH a AS (SELECT customer_id, regexp_replace((customer_id * 97)::VARCHAR || ['', '-', 'a'][1 + customer_id % 3], '[^0-9]', '', 'g') AS customer_zip_code_prefix,
  city AS customer_city, region AS customer_state FROM cst) SELECT * FROM a WHERE regexp_matches(customer_zip_code_prefix, '^[0-9]{5}$')""")
def _(t):
    k = F.col("customer_id")
    rows = t.cst.select(k, F.concat((k * 97).cast("string"), pick(["", "-", "a"], k)).alias("customer_zip_code_prefix"),
                        F.concat(F.lit(" "), "city").alias("customer_city"), F.concat("region", F.lit("  ")).alias("customer_state"))
    return C.clean_customers(rows)


_ST = ["delivered", "shipped ", "lost", " approved", "unknown"]


def _raw_orders(t):
    k = F.col("order_id")
    return t.ord.select(k, F.when(k % 29 != 0, F.col("customer_id")).alias("customer_id"), pick(_ST, k).alias("order_status"),
                        F.when(k % 31 != 0, F.col("order_date")).alias("order_purchase_timestamp"))


@plan("p14_clean_orders", f"""SELECT order_id, customer_id, trim({_list(_ST)}[1 + order_id % 5]) AS order_status, order_date AS order_purchase_timestamp
  FROM ord WHERE order_id % 29 <> 0 AND order_id % 31 <> 0 AND order_id % 5 IN (0, 1, 3)""")
def _(t):
    return C.clean_orders(_raw_orders(t))


@plan("p15_product_measures", f"""WITH {_RAWP}, z AS (SELECT *, coalesce(product_weight_g, 0) AS w FROM rawp) SELECT product_id,
  coalesce(product_length_cm, 0) * coalesce(product_height_cm, 0) * coalesce(product_width_cm, 0) AS product_volume_cm3,
  CASE WHEN w <= 0 THEN NULL WHEN w <= 100 THEN 'Very Light' WHEN w <= 500 THEN 'Light' WHEN w <= 1000 THEN 'Medium' WHEN w <= 5000 THEN 'Heavy' ELSE 'Very Heavy' END AS weight_category,
  (product_photos_qty * 30000 + product_description_length * 40 + product_name_length * 300 + 500) // 1000 / 100.0::DOUBLE AS product_quality_score FROM z""")
def _(t):
    return C.product_measures(_raw_products(t)).select("product_id", "product_volume_cm3", "weight_category", "product_quality_score")


@plan("p16_delivery_days", """SELECT order_id, line_number, floor((epoch(ship_date) - epoch(order_date)) / 86400)::BIGINT AS delivery_days FROM itm JOIN ord USING (order_id)""")
def _(t):
    return C.delivery_days(t.sales, "order_date", "ship_date").select("order_id", "line_number", "delivery_days")


@plan("p17_standard_columns", """SELECT customer_id AS "customer_id", customer_name AS full_name, customer_segment AS market_segment FROM cst""")
def _(t):
    rows = t.cst.select(F.col("customer_id").alias("Customer ID"), F.col("customer_name").alias("FULL-NAME"),
                        F.col("customer_segment").alias("Market Segment"))
    return C.standard_columns(rows)


@plan("p18_required_unique", """SELECT DISTINCT ON (product_name, brand) product_name, brand, product_id, price::DOUBLE AS price FROM prd
  WHERE product_id % 19 <> 0 ORDER BY product_name, brand, product_id""")
def _(t):
    rows = t.prd.select("product_name", "brand", "product_id", F.when(F.col("product_id") % 19 != 0, F.col("price").cast("double")).alias("price"))
    return C.required_unique(rows, ["product_name", "price"], ["product_name", "brand"], ["product_id"])


def _reviews(t):
    k = F.col("order_id")
    return t.ord.select(F.when(k % 37 != 0, k).alias("review_id"), k, (k % 8 - 1).alias("review_score"))


@plan("p19_apply_rules", """SELECT order_id AS review_id, order_id, order_id % 8 - 1 AS review_score FROM ord WHERE order_id % 37 <> 0 AND order_id % 8 - 1 BETWEEN 1 AND 5""")
def _(t):
    return C.apply_rules(_reviews(t), C.DATASETS["reviews"])


@plan("p21_repair_types", """SELECT order_id, total_amount::DOUBLE AS unit_price, order_date AS bought_at, 'n' || order_id AS note,
  CASE WHEN order_id % 40 <> 0 THEN (order_id % 9)::DOUBLE END AS rating FROM ord""")
def _(t):
    k = F.col("order_id")
    rows = t.ord.select(k, F.concat(F.lit("$"), F.call_function("format_number", F.col("total_amount"), F.lit(2))).alias("unit_price"),
                        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("bought_at"), F.concat(F.lit("n"), k).alias("note"),
                        F.when(k % 40 == 0, "n/a").otherwise((k % 9).cast("string")).alias("rating"))
    out = C.repair_types(rows)
    return out.withColumn("bought_at", F.col("bought_at").cast("timestamp_ntz"))


_HOLES = """h AS (SELECT product_id, CASE WHEN product_id % 7 <> 0 THEN price::DOUBLE END AS price, CASE WHEN product_id % 9 <> 0 THEN brand END AS brand,
  CASE WHEN product_id % 5 <> 0 THEN TIMESTAMP '2000-01-01' + to_days(product_id::INTEGER) END AS seen FROM prd)"""


def _holes(t):
    k = F.col("product_id")
    return t.prd.select(k, F.when(k % 7 != 0, F.col("price").cast("double")).alias("price"), F.when(k % 9 != 0, F.col("brand")).alias("brand"),
                        F.when(k % 5 != 0, F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00' + make_dt_interval(cast(product_id as int))")).alias("seen"))


@plan("p22_fill_missing", f"""WITH {_HOLES}, m AS (SELECT quantile_cont(price, 0.5) AS p, make_timestamp(floor(quantile_cont(epoch_us(seen)::DOUBLE, 0.5))::BIGINT) AS s FROM h),
  b AS (SELECT brand FROM h WHERE brand IS NOT NULL GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 1)
  SELECT product_id, round(coalesce(price, p), 6) AS price, coalesce(h.brand, (SELECT brand FROM b)) AS brand, coalesce(seen, s) AS seen FROM h, m""")
def _(t):
    return C.fill_missing(_holes(t)).withColumn("price", F.round("price", 6))


@plan("p22_fill_constant", f"""WITH {_HOLES} SELECT product_id, coalesce(price, 0) AS price, coalesce(brand, 'Unknown') AS brand FROM h""")
def _(t):
    return C.fill_constant(_holes(t).drop("seen"))


_BOUNDS = "SELECT q[1] - (q[2] - q[1]) * 1.5 AS lo, q[2] + (q[2] - q[1]) * 1.5 AS hi FROM (SELECT quantile_cont({c}::DOUBLE, [0.25, 0.75]) AS q FROM {t})"


def _spiked(t):
    big = F.when(F.col("order_id") % 50 == 0, F.col("total_amount") * 9).otherwise(F.col("total_amount"))
    return t.ord.select("order_id", big.cast("double").alias("amount"), (F.col("order_id") % 90).cast("double").alias("score"))


_SPIKED = """s AS (SELECT order_id, (CASE WHEN order_id % 50 = 0 THEN total_amount * 9 ELSE total_amount END)::DOUBLE AS amount, (order_id % 90)::DOUBLE AS score FROM ord)"""


@plan("p23_winsorise", f"""WITH {_SPIKED}, b AS ({_BOUNDS.format(c='amount', t='s')}) SELECT order_id, round(least(greatest(amount, lo), hi), 4) AS amount, score FROM s, b""")
def _(t):
    return C.winsorise(_spiked(t)).withColumn("amount", F.round("amount", 4))


@plan("p24_drop_outliers", f"""WITH {_SPIKED}, b AS ({_BOUNDS.format(c='amount', t='s')}), s2 AS (SELECT s.* FROM s, b WHERE amount BETWEEN lo AND hi),
  b2 AS ({_BOUNDS.format(c='score', t='s2')}) SELECT s2.* FROM s2, b2 WHERE score BETWEEN lo AND hi""")
def _(t):
    return C.drop_outliers(_spiked(t), ["amount", "score"])


@plan("p25_three_sigma", f"""WITH {_SPIKED}, m AS (SELECT avg(amount) AS a, stddev_samp(amount) AS d FROM s) SELECT s.* FROM s, m WHERE abs(amount - a) <= 3 * d""")
def _(t):
    return C.three_sigma(_spiked(t), "amount")


@plan("p26_clip", f"""WITH {_SPIKED} SELECT order_id, greatest(1000, least(amount, 200000))::DOUBLE AS amount FROM s""")
def _(t):
    return _spiked(t).select("order_id", C.clip(F.col("amount"), 1000.0, 200000.0).alias("amount"))


@plan("p27_repair_rules", """SELECT product_id, p AS price, CASE WHEN r BETWEEN 0 AND 5 THEN r END AS rating FROM (SELECT product_id,
  (CASE WHEN product_id % 8 = 0 THEN -price WHEN product_id % 13 = 0 THEN NULL ELSE price END)::DOUBLE AS p, (stock_quantity % 9 - 1)::DOUBLE AS r FROM prd) WHERE p > 0""")
def _(t):
    k = F.col("product_id")
    rows = t.prd.select(k, F.when(k % 8 == 0, -F.col("price")).when(k % 13 != 0, F.col("price")).cast("double").alias("price"),
                        (F.col("stock_quantity") % 9 - 1).cast("double").alias("rating"))
    return C.repair_rules(rows)


def _catalogue(t):
    """Messy catalogue: order lines as sightings of a product, with text prices, bad ratings and gaps."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    part = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_retailprice")
    rows = t.raw("lineitem").join(part, "l_partkey")
    price = F.when(k % 33 != 0, F.concat(F.when(k % 5 == 0, "$").otherwise(""), F.round(F.col("p_retailprice"), 2).cast("decimal(18,2)").cast("string")))
    return rows.select(
        F.col("l_partkey").alias("product_id"), F.concat(F.lit(" "), "p_name", F.lit("  x")).alias("name"),
        F.when(k % 41 != 0, F.lower("p_type")).alias("category"), price.alias("price"),
        F.when(k % 21 != 0, (k % 14 - 4).cast("double")).alias("rating"), F.col("l_shipdate").alias("scraped_date"),
        k.alias("sighting"))


_CAT = """raw AS (SELECT l_partkey AS product_id, ' ' || p_name || '  x' AS name, CASE WHEN k % 41 <> 0 THEN lower(p_type) END AS category,
    CASE WHEN k % 33 <> 0 THEN p_retailprice::DECIMAL(18,2)::DOUBLE END AS price, CASE WHEN k % 21 <> 0 THEN (k % 14 - 4)::DOUBLE END AS rating,
    l_shipdate AS scraped_date, k AS sighting, p_retailprice, CASE WHEN k % 33 <> 0 THEN CASE WHEN k % 5 = 0 THEN '$' ELSE '' END || p_retailprice::DECIMAL(18,2)::VARCHAR END AS price_text
    FROM (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem) JOIN part ON p_partkey = l_partkey),
  u AS (SELECT DISTINCT ON (product_id) * FROM (SELECT DISTINCT * FROM raw) ORDER BY product_id, scraped_date DESC, name DESC,
    category DESC NULLS LAST, price_text DESC NULLS LAST, rating DESC NULLS LAST, sighting DESC),
  x AS (SELECT product_id, {title_name} AS name, {title_cat} AS category, price, rating, scraped_date, sighting FROM u),
  md AS (SELECT quantile_cont(price, 0.5) AS p, quantile_cont(rating, 0.5) AS r FROM x),
  mc AS (SELECT category AS c FROM x WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  f AS (SELECT product_id, name, coalesce(category, (SELECT c FROM mc)) AS category, coalesce(price, p) AS price, coalesce(rating, r) AS rating, scraped_date, sighting FROM x, md),
  bp AS ({bp}), br AS ({br}), bs AS ({bs}),
  w AS (SELECT product_id, name, category, least(greatest(price, bp.lo), bp.hi) AS price, least(greatest(rating, br.lo), br.hi) AS rating, scraped_date,
    least(greatest(sighting::DOUBLE, bs.lo), bs.hi) AS sighting FROM f, bp, br, bs),
  clean AS (SELECT product_id, name, category, round(price, 4) AS price, round(CASE WHEN rating BETWEEN 0 AND 5 THEN rating END, 4) AS rating, scraped_date,
    round(sighting, 4) AS sighting FROM w WHERE price > 0)""".format(
    title_name=sql_title(sql_fold("name")), title_cat=f"CASE WHEN category IS NOT NULL THEN {sql_title(sql_fold('category'))} END",
    bp=_BOUNDS.format(c="price", t="f"), br=_BOUNDS.format(c="rating", t="f"), bs=_BOUNDS.format(c="sighting", t="f"))


@plan("p28_clean_catalogue", f"WITH {_CAT} SELECT * FROM clean")
def _(t):
    out = C.clean_catalogue(_catalogue(t))
    return out.withColumns({c: F.round(c, 4) for c in ("price", "rating", "sighting")})


@plan("p28_cleaning_report", f"""WITH {_CAT} SELECT (SELECT count(*) FROM raw) AS original_rows, (SELECT count(*) FROM clean) AS final_rows,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM u) AS duplicates_removed,
  (SELECT count(*) FILTER (price IS NULL) + count(*) FILTER (rating IS NULL) + count(*) FILTER (category IS NULL) FROM u) AS missing_values_filled,
  (SELECT count(*) FILTER (price NOT BETWEEN bp.lo AND bp.hi) + count(*) FILTER (rating NOT BETWEEN br.lo AND br.hi)
    + count(*) FILTER (sighting NOT BETWEEN bs.lo AND bs.hi) FROM f, bp, br, bs) AS outliers_capped,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS rows_removed,
  ((SELECT count(*) FROM raw) - (SELECT count(*) FROM clean)) * 100.0::DOUBLE / (SELECT count(*) FROM raw) AS removal_percentage""")
def _(t):
    return C.cleaning_report(C.cleaning_steps(_catalogue(t)))


@plan("p30_completeness_score", """WITH a AS (SELECT product_id, CASE product_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE product_name END AS name, product_id % 5 - 1 AS price_vnd,
    CASE product_id % 3 WHEN 0 THEN 'Unknown' ELSE brand END AS brand, CASE product_id % 7 WHEN 0 THEN NULL ELSE category END AS subcategory, stock_quantity % 3 AS rating,
    stock_quantity % 2 AS review_count, product_id % 2 AS nf, repeat('d', (product_id % 40)::INTEGER) AS description, category FROM prd)
  SELECT product_id, (CASE WHEN length(name) > 10 THEN 20 WHEN length(name) > 0 THEN 10 ELSE 0 END + CASE WHEN price_vnd > 0 THEN 20 ELSE 0 END
    + CASE WHEN brand <> 'Unknown' THEN 15 ELSE 0 END + CASE WHEN subcategory IS NOT NULL THEN 15 ELSE 0 END
    + CASE WHEN rating > 0 AND review_count > 0 THEN 10 ELSE 0 END + CASE WHEN nf > 0 THEN 10 ELSE 0 END + CASE WHEN length(description) > 20 THEN 10 ELSE 0 END)::INTEGER AS data_quality_score FROM a""")
def _(t):
    k = F.col("product_id")
    rows = t.prd.select(
        k, F.when(k % 4 == 1, "").when(k % 4 > 1, F.col("product_name")).alias("name"), (k % 5 - 1).alias("price_vnd"),
        F.when(k % 3 == 0, "Unknown").otherwise(F.col("brand")).alias("brand"), "category", F.when(k % 7 != 0, F.col("category")).alias("subcategory"),
        (F.col("stock_quantity") % 3).alias("rating"), (F.col("stock_quantity") % 2).alias("review_count"),
        F.when(k % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("features"),
        F.expr("repeat('d', cast(product_id % 40 as int))").alias("description"))
    return C.completeness_score(rows).select("product_id", "data_quality_score")


@plan("p31_warehouse_rows", """SELECT product_id, product_name AS name, brand, coalesce(TRY_CAST(CASE WHEN product_id % 6 = 0 THEN 'call us' ELSE price::VARCHAR END AS DOUBLE), 0) AS price_vnd,
  coalesce(TRY_CAST(NULLIF(stock_quantity, 7) AS DOUBLE), 0) AS stock_quantity, brand || ', ' || category AS features, DATE '2001-08-01' AS execution_date FROM prd""")
def _(t):
    k = F.col("product_id")
    rows = t.prd.select(F.array("brand", "category").alias("features"), F.when(F.col("stock_quantity") != 7, F.col("stock_quantity")).alias("stock_quantity"),
                        F.when(k % 6 == 0, "call us").otherwise(F.col("price").cast("string")).alias("price_vnd"), "brand",
                        F.col("product_name").alias("name"), k, F.lit(1).alias("scratch"))
    return C.warehouse_rows(rows, "2001-08-01")


@plan("p32_unify_catalogues", """SELECT product_id::VARCHAR AS product_id, product_name AS name, price::DOUBLE AS price, category, 'store' AS platform, brand, 4.0::DOUBLE AS rating FROM prd
  UNION ALL SELECT seller_id || '-' || product_id, 'Unknown', item_total::DOUBLE, 'general', 'market', 'Unknown', line_number::DOUBLE FROM itm""")
def _(t):
    store = t.prd.select("product_id", "product_name", F.col("price").alias("current_price"), "category", "brand")
    market = t.itm.select(F.concat_ws("-", "seller_id", "product_id").alias("_id"), F.col("item_total").alias("price"), F.col("line_number").alias("avg_rating"))
    return C.unify_catalogues({"store": store, "market": market})


@plan("p33_shape_messages", f"""SELECT 'sales_event' AS type, event_id, order_id, customer_id, product_id, platform, total_amount_vnd, coalesce(total_amount_usd, 0) AS total_amount_usd,
  payment_method, shipping_region, shipping_province, is_cod, is_tet_order, is_festival_order, NULL::VARCHAR AS device_type,
  CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '{AS_OF}' ELSE event_timestamp END AS timestamp FROM sev""")
def _(t):
    ev = t.sev.withColumn("event_timestamp", F.when(F.col("event_id") % 9 != 0, F.col("event_timestamp")))
    return C.shape_message(ev, "sales", now()).withColumn("device_type", F.col("device_type").cast("string"))


@plan("p34_message_filter", """SELECT event_id, platform, payment_method FROM sev WHERE platform IN ('Tiki', 'Shopee') AND is_cod""")
def _(t):
    return C.message_filter(t.sev, {"platform": ["Tiki", "Shopee"], "is_cod": True, "absent": 1}).select("event_id", "platform", "payment_method")


@plan("p35_churn_factors", """WITH s AS (SELECT customer_id, count(*) AS n, date_diff('day', max(order_date), TIMESTAMP '2001-08-01') AS d, date_diff('day', min(order_date), max(order_date)) AS a FROM ord GROUP BY 1),
  f AS (SELECT customer_id, list_filter([CASE WHEN d > 90 THEN 'Long time since last purchase' END, CASE WHEN customer_id % 6 < 3 THEN 'Low satisfaction scores' END,
    CASE WHEN n / (a + 1)::DOUBLE < 0.004 THEN 'Low purchase frequency' END, CASE WHEN n < 2 THEN 'Limited purchase history' END], lambda x: x IS NOT NULL) AS f FROM s)
  SELECT customer_id, CASE WHEN len(f) > 0 THEN array_to_string(f, '|') ELSE 'No significant risk factors identified' END AS factors FROM f""")
def _(t):
    g = t.ord.groupBy("customer_id").agg(F.count("*").alias("n"), F.max("order_date").alias("l"), F.min("order_date").alias("f"))
    days = F.datediff(F.lit("2001-08-01").cast("date"), "l")
    freq = F.col("n") / (F.datediff("l", "f") + 1).cast("double") * 25
    return g.select("customer_id", F.array_join(C.churn_factors(days, F.col("customer_id") % 6, freq, F.col("n")), "|").alias("factors"))


@plan("p29_run_stats", """SELECT count(*) AS original_rows, count(*) FILTER (order_id % 37 <> 0 AND order_id % 8 - 1 BETWEEN 1 AND 5) AS final_rows,
  count(*) FILTER (order_id % 37 <> 0 AND order_id % 8 - 1 BETWEEN 1 AND 5) * 100.0::DOUBLE / count(*) AS efficiency_pct FROM ord""")
def _(t):
    rows = _reviews(t)
    kept = C.apply_rules(rows, C.DATASETS["reviews"]).agg(F.count("*").alias("n")).scalar()
    return rows.agg(F.count("*").alias("original_rows")).withColumn("final_rows", kept).withColumn(
        "efficiency_pct", F.col("final_rows") * 100.0 / F.col("original_rows"))


