"""Cleaning, enrichment and shaping of rows. Everything is a projection or filter unless it says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions import dates as D
from tillroll.functions import text as X
from tillroll.functions.numbers import pct
from tillroll.operators.load import newest_per_key
from tillroll.operators.ordering import quantiles
from tillroll.operators.windows import fixed_bins
from tillroll.session import pin

# Code tables of the source system.
PAYMENT_VI = {"COD": "Thanh toán khi nhận hàng", "MoMo": "Ví MoMo", "ZaloPay": "Ví ZaloPay", "VNPay": "Ví VNPay",
              "Banking": "Chuyển khoản ngân hàng"}
SHIPPING_VI = {"Standard": "Giao hàng tiêu chuẩn", "Express": "Giao hàng nhanh", "Same_Day": "Giao hàng trong ngày"}
STATUS_VI = {"Pending": "Đang xử lý", "Confirmed": "Đã xác nhận", "Shipped": "Đang giao hàng", "Delivered": "Đã giao",
             "Cancelled": "Đã hủy"}
SEGMENT_VI = {"Regular": "Khách hàng thường", "High_Value": "Khách hàng VIP", "Premium": "Khách hàng cao cấp"}
INCOME_VI = {"Low": "Thu nhập thấp", "Middle": "Thu nhập trung bình", "High": "Thu nhập cao"}
INCOME_CODES = {"low": "Low", "middle": "Middle", "high": "High", "thấp": "Low", "trung bình": "Middle", "cao": "High"}
PAYMENT_CODES = {"momo": "E_Wallet_MoMo", "zalopay": "E_Wallet_ZaloPay", "vnpay": "E_Wallet_VNPay", "cod": "COD",
                 "cash_on_delivery": "COD", "bank_transfer": "Bank_Transfer", "credit_card": "Credit_Card",
                 "debit_card": "Debit_Card"}
COMMISSION = {"Lazada": 0.06, "Shopee": 0.055, "Tiki": 0.08, "Sendo": 0.05, "FPTShop": 0.04, "CellphoneS": 0.035}
CITIES = {"hcm": "Ho Chi Minh City", "tp hcm": "Ho Chi Minh City", "saigon": "Ho Chi Minh City", "sg": "Ho Chi Minh City",
          "hn": "Hanoi", "ha noi": "Hanoi", "dn": "Da Nang", "da nang": "Da Nang", "hp": "Hai Phong", "hai phong": "Hai Phong"}
CITY_REGIONS = {
    "North": ["Hanoi", "Hai Phong", "Quang Ninh", "Lang Son", "Cao Bang"],
    "Central": ["Da Nang", "Hue", "Quang Nam", "Quang Ngai", "Binh Dinh"],
    "South": ["Ho Chi Minh City", "Can Tho", "Dong Nai", "Binh Duong", "Ba Ria-Vung Tau"],
}
STATE_REGIONS = {
    "southeast": ["SP", "RJ", "MG", "ES"], "south": ["PR", "RS", "SC"], "center_west": ["GO", "MT", "MS", "DF"],
    "northeast": ["BA", "PE", "CE", "MA"], "north": ["AM", "PA", "RO", "AC"],
}
STATE_SEGMENTS = {"Metropolitan": ["SP", "RJ"], "Southeast": ["MG"], "South": ["PR", "RS", "SC"]}
ORDER_STATUSES = ["delivered", "shipped", "processing", "invoiced", "canceled", "unavailable", "approved"]
WEIGHT_EDGES = [0.0, 100.0, 500.0, 1000.0, 5000.0, float("inf")]
WEIGHT_LABELS = ["Very Light", "Light", "Medium", "Heavy", "Very Heavy"]
EXCHANGE_RATE, VAT_RATE, COD_FEE = 24000, 0.1, 5000


def _labelled(c: str, table: Mapping[str, str], default: str) -> Column:
    return X.map_code(F.col(c), table, F.lit(default))


def sales_fact(df: DataFrame, loaded_at: Column) -> DataFrame:
    """P-01: sales event to fact row."""
    zero = F.lit(0)
    return df.select(
        "order_id", "customer_id", "product_id", "platform", F.col("quantity").alias("quantity_ordered"),
        zero.alias("quantity_shipped"), zero.alias("quantity_returned"), zero.alias("quantity_cancelled"), "unit_price_vnd",
        F.col("total_amount_vnd").alias("gross_sales_amount_vnd"), "discount_amount_vnd",
        (F.col("total_amount_vnd") - F.col("discount_amount_vnd")).alias("net_sales_amount_vnd"),
        "tax_amount_vnd", "shipping_fee_vnd", "unit_price_usd", F.col("total_amount_usd").alias("net_sales_amount_usd"),
        F.lit(float(EXCHANGE_RATE)).alias("exchange_rate_vnd_usd"), F.col("payment_method").alias("payment_method_english"),
        _labelled("payment_method", PAYMENT_VI, "Thẻ tín dụng").alias("payment_method_vietnamese"),
        F.col("is_cod").alias("is_cod_order"), F.lit(False).alias("is_installment_order"),
        F.col("shipping_method").alias("shipping_method_english"),
        _labelled("shipping_method", SHIPPING_VI, "Giao hàng tiêu chuẩn").alias("shipping_method_vietnamese"),
        F.col("order_status").alias("order_status_english"),
        _labelled("order_status", STATUS_VI, "Đang xử lý").alias("order_status_vietnamese"), "is_tet_order",
        "is_festival_order", F.lit(False).alias("applied_vietnam_promotion"), "shipping_province", "shipping_region",
        "order_timestamp", F.col("event_timestamp").alias("created_at"), loaded_at.alias("updated_at"))


def _versioned(day: Column) -> list[Column]:
    return [day.alias("effective_date"), F.lit(None).cast("date").alias("expiry_date"), F.lit(True).alias("is_current")]


def customer_row(df: DataFrame, day: Column, loaded_at: Column) -> DataFrame:
    """P-02: customer event to dimension row."""
    return df.select(
        "customer_id", F.col("full_name").alias("full_name_vietnamese"), "email", F.col("phone").alias("phone_number"), "age",
        "gender", "province", "region", F.col("customer_segment").alias("customer_segment_english"),
        _labelled("customer_segment", SEGMENT_VI, "Khách hàng thường").alias("customer_segment_vietnamese"),
        F.col("income_level").alias("income_level_english"),
        _labelled("income_level", INCOME_VI, "Thu nhập trung bình").alias("income_level_vietnamese"), "preferred_platform",
        F.col("preferred_payment").alias("preferred_payment_method"), "preferred_device", *_versioned(day), "created_at",
        loaded_at.alias("updated_at"))


def product_row(df: DataFrame, day: Column, loaded_at: Column) -> DataFrame:
    """P-03: product event to dimension row."""
    both = lambda c, name: [F.col(c).alias(f"{name}_vietnamese"), F.col(c).alias(f"{name}_english")]
    return df.select(
        "product_id", F.col("product_name_vn").alias("product_name_vietnamese"), F.col("product_name_en").alias("product_name_english"),
        *both("brand", "brand"), *both("category_l1", "category_level_1"), *both("category_l2", "category_level_2"), "price_vnd",
        "price_usd", "rating", "review_count", "made_in_vietnam", F.col("available_platforms").alias("platform_availability"),
        *_versioned(day), F.lit("kafka_streaming").alias("data_source"), "created_at", loaded_at.alias("updated_at"))


def sale_pricing(df: DataFrame) -> DataFrame:
    """P-04: final unit price, total default and cash-on-delivery fee."""
    per_unit = F.floor(F.try_divide(F.col("discount_amount_vnd").cast("double"), F.col("quantity"))).cast("bigint")
    price, total = F.col("unit_price_vnd"), F.coalesce("total_amount_vnd", F.col("unit_price_vnd") * F.col("quantity"))
    return df.withColumns({
        "final_price_vnd": F.when(F.col("quantity") > 0, price - per_unit).otherwise(price), "total_amount_vnd": total,
        "cod_fee_vnd": F.when(F.col("is_cod"), COD_FEE).otherwise(0)})


def to_local_currency(df: DataFrame, rate: int = EXCHANGE_RATE, vat: float = VAT_RATE) -> DataFrame:
    """P-05: VND amounts, VAT and the platform commission (6 % where the platform is unknown)."""
    share = F.create_map(*[F.lit(x) for kv in COMMISSION.items() for x in kv])
    return df.withColumns({
        "total_amount_vnd": F.col("total_amount_usd") * rate, "unit_price_vnd": F.col("unit_price_usd") * rate,
        "vat_amount_vnd": F.col("subtotal_usd") * rate * F.lit(vat),
        "platform_commission": F.col("total_amount_usd") * F.coalesce(F.try_element_at(share, F.col("platform")), F.lit(0.06))})


def payment_code(c: Column) -> Column:
    """P-06: unknown methods stay as they are."""
    return X.map_code(F.lower(c), PAYMENT_CODES, c)


def income_code(c: Column) -> Column:
    """P-06."""
    return X.map_code(F.lower(F.trim(c)), INCOME_CODES, c)


def spending_segment(monthly_vnd: Column) -> Column:
    """P-06."""
    return F.when(monthly_vnd >= 12000000, "Premium").when(monthly_vnd >= 4800000, "High_Value").otherwise("Regular")


def city_name(c: Column) -> Column:
    """P-07: alias to canonical name, others in title case."""
    return X.map_code(F.trim(F.lower(c)), CITIES, X.title_case(c))


def _invert(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    return {member: name for name, members in groups.items() for member in members}


def city_region(city: Column) -> Column:
    """P-07: region of a canonical city; null for null, Unknown for others."""
    return F.when(city.isNotNull(), X.map_code(city, _invert(CITY_REGIONS), F.lit("Unknown")))


def state_region(state: Column) -> Column:
    return X.map_code(state, _invert(STATE_REGIONS), F.lit("other"))


def state_segment(state: Column) -> Column:
    return X.map_code(state, _invert(STATE_SEGMENTS), F.lit("Other"))


def clean_products(df: DataFrame) -> DataFrame:
    """P-12."""
    w = F.col("product_weight_g")
    out = df.where(F.col("product_id").isNotNull()).withColumn("product_weight_g", F.when(w < 0, None).otherwise(w))
    out = out.withColumn("product_category_name", F.trim(F.regexp_replace("product_category_name", "[^a-zA-Z0-9_]", "")))
    return out.where(F.col("product_category_name") != "")


def clean_customers(df: DataFrame) -> DataFrame:
    """P-13."""
    zip_code = F.regexp_replace("customer_zip_code_prefix", "[^0-9]", "")
    return df.where(F.col("customer_id").isNotNull()).withColumn("customer_zip_code_prefix", zip_code).where(
        F.col("customer_zip_code_prefix").rlike("^[0-9]{5}$")).withColumns(
        {c: F.trim(c) for c in ("customer_city", "customer_state")})


def clean_orders(df: DataFrame, statuses: Sequence[str] = tuple(ORDER_STATUSES)) -> DataFrame:
    """P-14."""
    out = df.dropna(subset=["order_id", "customer_id", "order_purchase_timestamp"])
    return out.withColumn("order_status", F.trim("order_status")).where(F.col("order_status").isin(list(statuses)))


def product_measures(df: DataFrame) -> DataFrame:
    """P-15, P-11: volume, weight bucket, quality score and category slug."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,4)") * F.lit(w).cast("decimal(6,4)")
    score = part("product_photos_qty", "0.3") + part("product_description_length", "0.0004") + part("product_name_length", "0.003")
    return df.withColumns({
        "product_volume_cm3": z("product_length_cm") * z("product_height_cm") * z("product_width_cm"),
        "weight_category": fixed_bins(z("product_weight_g"), WEIGHT_EDGES, WEIGHT_LABELS),
        "product_quality_score": F.round(score, 2).cast("double"), "product_category_clean": X.slug("product_category_name")})


def delivery_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """P-16."""
    return df.withColumn("delivery_days", D.whole_days(F.col(start), F.col(end)))


def standard_columns(df: DataFrame) -> DataFrame:
    """P-17."""
    return df.toDF(*[c.lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def required_unique(df: DataFrame, required: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """P-18: rows with all required fields, the first per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.dropna(subset=list(required))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


@dataclass(frozen=True)
class DatasetSpec:
    """P-20: what a dataset must look like."""

    keys: tuple[str, ...]
    expected: tuple[str, ...]
    types: Mapping[str, str] = field(default_factory=dict)
    rules: Mapping[str, str] = field(default_factory=dict)


# The six marketplace datasets.
DATASETS = {
    "customers": DatasetSpec(("customer_id",), ("customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"),
                             {"customer_zip_code_prefix": "numeric"}, {"customer_id": "not_null", "customer_state": "not_null"}),
    "orders": DatasetSpec(("order_id",), ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at"),
                          {c: "datetime" for c in ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")},
                          {"order_id": "not_null", "customer_id": "not_null"}),
    "order_items": DatasetSpec(("order_id", "order_item_id"), ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
                               {"price": "numeric", "freight_value": "numeric"}, {"order_id": "not_null", "product_id": "not_null", "price": "positive"}),
    "products": DatasetSpec(("product_id",), ("product_id", "product_category_name", "product_name_lenght", "product_description_lenght"),
                            {c: "numeric" for c in ("product_name_lenght", "product_description_lenght", "product_photos_qty")}, {"product_id": "not_null"}),
    "payments": DatasetSpec(("order_id", "payment_sequential"), ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"),
                            {c: "numeric" for c in ("payment_sequential", "payment_installments", "payment_value")}, {"order_id": "not_null", "payment_value": "positive"}),
    "reviews": DatasetSpec(("review_id",), ("review_id", "order_id", "review_score", "review_comment_title", "review_comment_message"),
                           {"review_score": "numeric", "review_creation_date": "datetime", "review_answer_timestamp": "datetime"},
                           {"review_id": "not_null", "order_id": "not_null", "review_score": "range_1_5"}),
}


def rule_predicate(column: str, rule: str, numeric: bool = True) -> Column:
    """One spec rule as a predicate; numeric rules pass on columns that are not numbers."""
    c = F.col(column)
    if rule == "not_null":
        return c.isNotNull()
    if rule not in ("positive", "range_1_5"):
        raise ValueError(f"unknown rule {rule}")
    if not numeric:
        return F.lit(True)
    return F.coalesce(c > 0 if rule == "positive" else c.between(1, 5), F.lit(False))


def apply_rules(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """P-19: rows that keep every rule of the spec."""
    out = df
    for column, rule in spec.rules.items():
        if column in df.columns:
            numeric = isinstance(df.schema[column].dataType, T.NumericType)
            out = out.where(rule_predicate(column, rule, numeric))
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _stripped(c: str) -> Column:
    signs = r"[$,£€¥]" if "price" in c.lower() else ","
    return F.regexp_replace(c, signs, "")


def repair_types(df: DataFrame, share: float = 0.9) -> DataFrame:
    """P-21: string columns of which at least ``share`` reads as a number or a timestamp get that type.

    One aggregate over all rows and columns decides, in place of a sample of the first rows. The test
    removes ``$`` and ``,``; the conversion also other currency signs where the name has "price".
    Unreadable values become null.
    """
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    aggs = []
    for c in strings:
        number = F.regexp_replace(c, r"[$,]", "").try_cast("double")
        aggs += [F.count(c).alias(f"{c}|n"), F.count(F.when(F.col(c).isNotNull(), number)).alias(f"{c}|num"),
                 F.count(F.try_to_timestamp(F.col(c))).alias(f"{c}|ts")]
    seen = df.agg(*aggs).first()
    out = {}
    for c in strings:
        if seen[f"{c}|n"] and seen[f"{c}|num"] >= share * seen[f"{c}|n"]:
            out[c] = _stripped(c).try_cast("double")
        elif seen[f"{c}|n"] and seen[f"{c}|ts"] >= share * seen[f"{c}|n"]:
            out[c] = F.try_to_timestamp(F.col(c))
    return df.withColumns(out) if out else df


def clean_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P-28 text step: collapse blanks; names, titles and categories in title case."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    titled = lambda c: any(k in c.lower() for k in ("name", "title", "category"))
    return df.withColumns({c: X.name_case(c) if titled(c) else X.collapse(c) for c in columns})


def fill_missing(df: DataFrame) -> DataFrame:
    """P-22: numbers and timestamps take the median, strings the mode (lowest on ties) or ``Unknown``."""
    numbers = numeric_columns(df)
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    out, fills = df, {}
    if numbers or times:
        rows = df.select(*numbers, *[F.unix_micros(F.col(c).cast("timestamp")).cast("double").alias(c) for c in times])
        q = quantiles(rows, numbers + times, [0.5])
        pick = q.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "q0"))).alias("m")).scalar()
        out = out.withColumn("_median", pick)
        for c in numbers:
            fills[c] = F.coalesce(F.col(c), F.try_element_at("_median", F.lit(c)).cast(df.schema[c].dataType))
        for c in times:
            when = F.timestamp_micros(F.try_element_at("_median", F.lit(c)).cast("bigint"))
            fills[c] = F.coalesce(F.col(c), when.cast(df.schema[c].dataType))
    if strings:  # the modes of all columns from one count of (column, value)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in strings]))
        counts = df.select(pairs.alias("_p")).select("_p.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
        modes = counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        out = out.withColumn("_mode", modes.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "mode"))).alias("m")).scalar())
        for c in strings:
            fills[c] = F.coalesce(F.col(c), F.try_element_at("_mode", F.lit(c)), F.lit("Unknown"))
    return out.withColumns(fills).select(*df.columns)


def fill_constant(df: DataFrame, text: str = "Unknown", number: float = 0) -> DataFrame:
    """P-22 simple form."""
    return df.fillna(text).fillna(number)


def iqr_bounds(df: DataFrame, columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """Q1 - w*IQR and Q3 + w*IQR per column, one row each."""
    q = quantiles(df, columns, [0.25, 0.75])
    iqr = F.col("q1") - F.col("q0")
    return q.select("column_name", (F.col("q0") - iqr * width).alias("low"), (F.col("q1") + iqr * width).alias("high"))


def _with_bounds(df: DataFrame, columns: Sequence[str], width: float) -> DataFrame:
    b = iqr_bounds(df, columns, width).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("low", "high")))).alias("m")).scalar()
    return df.withColumn("_b", b)


def winsorise(df: DataFrame, columns: Sequence[str] | None = None, width: float = 1.5) -> DataFrame:
    """P-23: cap at the IQR bounds; columns whose name contains ``id`` are left alone."""
    columns = list(columns) if columns else [c for c in numeric_columns(df) if "id" not in c.lower()]
    if not columns:
        return df
    out = {}
    for c in columns:
        b = F.try_element_at("_b", F.lit(c))
        x = F.col(c).cast("double")
        out[c] = F.when(x.isNotNull(), F.least(F.greatest(x, b["low"]), b["high"]))
    return _with_bounds(df, columns, width).withColumns(out).drop("_b")


def drop_outliers(df: DataFrame, columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """P-24: rows inside the IQR bounds of every column, one column after the other as in the source."""
    out = df
    for c in columns:
        b = F.try_element_at("_b", F.lit(c))
        out = _with_bounds(out, [c], width).where(F.col(c).cast("double").between(b["low"], b["high"])).drop("_b")
    return out


def three_sigma(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """P-25: rows within k sample standard deviations of the mean."""
    x = F.col(column).cast("double")
    s = df.agg(F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias("v")).scalar()
    return df.withColumn("_s", s).where(F.abs(x - F.col("_s.m")) <= F.lit(k) * F.col("_s.s")).drop("_s")


def clip(c: Column, low: float, high: float) -> Column:
    """P-26: null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(c, F.lit(high))))


def repair_rules(df: DataFrame) -> DataFrame:
    """P-27: rows without a positive price go; ratings outside 0..5 become null."""
    out = df.where(F.col("price") > 0) if "price" in df.columns else df
    if "rating" in df.columns:
        r = F.col("rating")
        out = out.withColumn("rating", F.when(r.between(0, 5), r))
    return out


def cleaning_steps(df: DataFrame, key: str = "product_id", date: str = "scraped_date") -> dict[str, DataFrame]:
    """P-28: the chain, step by step: duplicates, types, text, missing values, outliers, rules."""
    if key in df.columns and date in df.columns:  # the newest row per key also drops exact copies
        unique = newest_per_key(df, [key], [date, *[c for c in df.columns if c not in (key, date)]])
    else:
        unique = df.dropDuplicates()
    unique = pin(unique)  # four later steps read it; without this each would repeat the scan and the dedupe
    typed = repair_types(unique)
    texted = clean_strings(typed)
    filled = fill_missing(texted)
    capped = winsorise(filled)
    return {"raw": df, "unique": unique, "typed": typed, "text": texted, "filled": filled, "capped": capped, "clean": repair_rules(capped)}


def clean_catalogue(df: DataFrame, key: str = "product_id", date: str = "scraped_date") -> DataFrame:
    """P-28."""
    return cleaning_steps(df, key, date)["clean"]


def cleaning_report(steps: Mapping[str, DataFrame]) -> DataFrame:
    """P-28, P-29: one row: rows in and out, duplicates, missing cells, outliers, removed share."""
    raw, unique, typed, filled = (steps[k] for k in ("raw", "unique", "typed", "filled"))
    nulls = lambda df: sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    caps = [c for c in numeric_columns(filled) if "id" not in c.lower()]
    changed = _with_bounds(filled, caps, 1.5).agg(sum((F.count_if(
        ~F.col(c).cast("double").between(F.try_element_at("_b", F.lit(c))["low"], F.try_element_at("_b", F.lit(c))["high"]))
        for c in caps), F.lit(0)).alias("n")).scalar()
    out = raw.agg(F.count("*").alias("original_rows"))
    out = out.withColumn("final_rows", steps["clean"].agg(F.count("*").alias("n")).scalar())
    out = out.withColumn("_u", unique.agg(F.count("*").alias("n")).scalar())
    out = out.withColumn("missing_values_filled", typed.agg(nulls(typed).alias("n")).scalar())
    out = out.withColumn("outliers_capped", changed)
    return out.select("original_rows", "final_rows", (F.col("original_rows") - F.col("_u")).alias("duplicates_removed"),
                      "missing_values_filled", "outliers_capped", (F.col("original_rows") - F.col("final_rows")).alias("rows_removed"),
                      pct(F.col("original_rows") - F.col("final_rows"), F.col("original_rows"), 0).alias("removal_percentage"))


def completeness_score(df: DataFrame) -> DataFrame:
    """P-30: 0..100 by presence rules."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    more = lambda c, v: F.coalesce(F.col(c) > v, F.lit(False))
    add = lambda test, points: F.when(test, points).otherwise(0)
    name = F.when(F.coalesce(F.length("name") > 10, F.lit(False)), 20).when(has("name"), 10).otherwise(0)
    score = (name + add(more("price_vnd", 0), 20) + add(has("brand") & (F.col("brand") != "Unknown"), 15)
             + add(has("category") & has("subcategory"), 15) + add(more("rating", 0) & more("review_count", 0), 10)
             + add(F.coalesce(F.size("features") > 0, F.lit(False)), 10)
             + add(F.coalesce(F.length("description") > 20, F.lit(False)), 10))
    return df.withColumn("data_quality_score", F.least(score, F.lit(100)))


# Warehouse columns in order, and those that must be numbers.
WAREHOUSE_COLUMNS = ["product_id", "name", "brand", "category", "subcategory", "platform", "platform_display", "price_vnd",
                     "original_price_vnd", "discount_percentage", "rating", "review_count", "stock_quantity", "warranty_months",
                     "features", "availability", "data_quality_score", "collected_at", "processed_at", "execution_date", "processing_pipeline"]
WAREHOUSE_NUMBERS = ["price_vnd", "original_price_vnd", "rating", "review_count", "stock_quantity", "warranty_months", "data_quality_score"]


def warehouse_rows(df: DataFrame, day: str) -> DataFrame:
    """P-31: lists to text, numbers coerced with 0 for failures, known columns in order."""
    out = {"execution_date": F.lit(day).cast("date")}
    if "features" in df.columns and isinstance(df.schema["features"].dataType, T.ArrayType):
        out["features"] = F.array_join("features", ", ")
    for c in WAREHOUSE_NUMBERS:
        if c in df.columns:
            out[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    ready = df.withColumns(out)
    return ready.select(*[c for c in WAREHOUSE_COLUMNS if c in ready.columns])


def unify_catalogues(sources: Mapping[str, DataFrame]) -> DataFrame:
    """P-32: one product schema from several sources, with the usual aliases and defaults."""
    def one(platform: str, df: DataFrame) -> DataFrame:
        def first(names: Sequence[str], default: object, kind: str) -> Column:
            have = [F.col(n).try_cast(kind) for n in names if n in df.columns]
            return F.coalesce(*have, F.lit(default).cast(kind))
        return df.select(
            F.col("product_id" if "product_id" in df.columns else "_id").cast("string").alias("product_id"),
            first(["name", "product_name", "title"], "Unknown", "string").alias("name"),
            first(["price", "current_price"], 0.0, "double").alias("price"),
            first(["category", "category_name"], "general", "string").alias("category"), F.lit(platform).alias("platform"),
            first(["brand"], "Unknown", "string").alias("brand"), first(["rating", "avg_rating"], 4.0, "double").alias("rating"))
    out = None
    for platform, df in sources.items():
        part = one(platform, df)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# P-33: message type and output fields per topic as output name -> (input name, default).
MESSAGES = {
    "sales": ("sales_event", {c: (c, None) for c in ("event_id", "order_id", "customer_id", "product_id", "platform")}
              | {"total_amount_vnd": ("total_amount_vnd", 0), "total_amount_usd": ("total_amount_usd", 0)}
              | {c: (c, None) for c in ("payment_method", "shipping_region", "shipping_province")}
              | {c: (c, False) for c in ("is_cod", "is_tet_order", "is_festival_order")}
              | {"device_type": ("device_type", None), "timestamp": ("event_timestamp", None)}),
    "customers": ("customer_update", {c: (c, None) for c in ("customer_id", "region", "province", "customer_segment", "preferred_platform",
                                                            "preferred_payment")} | {"timestamp": ("created_at", None)}),
    "products": ("product_update", {"product_id": ("product_id", None), "product_name": ("product_name_vn", None), "brand": ("brand", None),
                                    "category": ("category_l1", None), "price_vnd": ("price_vnd", 0), "rating": ("rating", 0),
                                    "available_platforms": ("available_platforms", None), "made_in_vietnam": ("made_in_vietnam", False),
                                    "timestamp": ("created_at", None)}),
    "activities": ("user_activity", {c: (c, None) for c in ("activity_id", "customer_id", "activity_type", "platform", "device_type")}
                   | {"duration_seconds": ("duration_seconds", 0), "timestamp": ("timestamp", None)}),
}


def shape_message(df: DataFrame, topic: str, now: Column) -> DataFrame:
    """P-33: rows of a topic as outgoing messages; missing fields take their default, a missing time ``now``."""
    kind, fields = MESSAGES[topic]
    out = [F.lit(kind).alias("type")]
    for name, (source, default) in fields.items():
        c = F.col(source) if source in df.columns else F.lit(None)
        if name == "timestamp":
            c = F.coalesce(c.cast("timestamp_ntz"), now)
        elif name == "available_platforms":
            c = F.coalesce(c, F.array().cast("array<string>"))
        elif default is not None:
            c = F.coalesce(c, F.lit(default))
        out.append(c.alias(name))
    return df.select(*out)


def message_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """P-34: all keys must match, a list means membership, a key the rows do not have passes."""
    out = df
    for key, want in filters.items():
        if key in df.columns:
            c = F.col(key)
            test = c.isin(list(want)) if isinstance(want, (list, tuple)) else c == F.lit(want)
            out = out.where(F.coalesce(test, F.lit(False)))
    return out


def churn_factors(days: Column, review: Column, frequency: Column, orders: Column) -> Column:
    """P-35: texts of the thresholds that are crossed."""
    zero = lambda c, d: F.coalesce(c, F.lit(d))
    found = F.filter(F.array(
        F.when(zero(days, 0) > 90, "Long time since last purchase"), F.when(zero(review, 5) < 3, "Low satisfaction scores"),
        F.when(zero(frequency, 0) < 0.1, "Low purchase frequency"), F.when(zero(orders, 0) < 2, "Limited purchase history")),
        lambda f: f.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No significant risk factors identified")))
