"""Explicit schemas of the topics as DDL text, which every reader and ``from_json`` accept."""

from __future__ import annotations


# Field names and types of the topics.
SALES = (
    "event_id STRING, order_id STRING, customer_id STRING, product_id STRING, platform STRING, quantity INT, unit_price_vnd BIGINT, unit_price_usd DOUBLE, "
    "total_amount_vnd BIGINT, total_amount_usd DOUBLE, discount_amount_vnd BIGINT, tax_amount_vnd BIGINT, shipping_fee_vnd BIGINT, payment_method STRING, "
    "shipping_method STRING, order_status STRING, is_cod BOOLEAN, is_tet_order BOOLEAN, is_festival_order BOOLEAN, order_source STRING, device_type STRING, "
    "shipping_province STRING, shipping_region STRING, event_timestamp TIMESTAMP, order_timestamp TIMESTAMP")
CUSTOMERS = (
    "customer_id STRING, full_name STRING, email STRING, phone STRING, age INT, gender STRING, province STRING, region STRING, customer_segment STRING, "
    "income_level STRING, preferred_platform STRING, preferred_payment STRING, preferred_device STRING, created_at TIMESTAMP")
PRODUCTS = (
    "product_id STRING, product_name_vn STRING, product_name_en STRING, brand STRING, category_l1 STRING, category_l2 STRING, price_vnd BIGINT, price_usd DOUBLE, "
    "rating DOUBLE, review_count INT, available_platforms ARRAY<STRING>, made_in_vietnam BOOLEAN, created_at TIMESTAMP")
ACTIVITIES = (
    "activity_id STRING, customer_id STRING, activity_type STRING, platform STRING, device_type STRING, duration_seconds INT, timestamp TIMESTAMP")
SHOP_PRODUCTS = (
    "product_id STRING, product_category_name STRING, product_name_length INT, product_description_length INT, product_photos_qty INT, product_weight_g FLOAT, "
    "product_length_cm FLOAT, product_height_cm FLOAT, product_width_cm FLOAT, timestamp TIMESTAMP, source STRING")
SHOP_CUSTOMERS = (
    "customer_id STRING, customer_unique_id STRING, customer_zip_code_prefix STRING, customer_city STRING, customer_state STRING, timestamp TIMESTAMP, source STRING")
SHOP_ORDERS = (
    "order_id STRING, customer_id STRING, order_status STRING, order_purchase_timestamp TIMESTAMP, order_approved_at TIMESTAMP, order_delivered_carrier_date TIMESTAMP, "
    "order_delivered_customer_date TIMESTAMP, order_estimated_delivery_date TIMESTAMP, timestamp TIMESTAMP, source STRING")
SHOP_ORDER_ITEMS = (
    "order_id STRING, order_item_id INT, product_id STRING, seller_id STRING, shipping_limit_date TIMESTAMP, price DECIMAL(10,2), freight_value DECIMAL(10,2), "
    "timestamp TIMESTAMP, source STRING")

TOPICS = {"sales": SALES, "customers": CUSTOMERS, "products": PRODUCTS, "activities": ACTIVITIES, "shop_products": SHOP_PRODUCTS,
          "shop_customers": SHOP_CUSTOMERS, "shop_orders": SHOP_ORDERS, "shop_order_items": SHOP_ORDER_ITEMS}
EVENTS = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
