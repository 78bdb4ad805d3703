"""Queries that run real streams over the event file until it is drained (ST-01..ST-11), and sessions in batch.

Output and checkpoint go to a fresh directory of the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll.operators import sessions as N
from tillroll.plans.registry import plan
from tillroll.schemas import EVENTS
from tillroll.session import shared_folder
from tillroll.streaming import jobs as J


def stream(t):
    """The event file as a stream with the names of the activity topic."""
    k = F.col("user_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    raw = t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "100").parquet(f"{t.folder}/event[s].parquet")
    return J.event_time(raw, "ts").select(
        F.col("event_id"), F.col("ts").alias("timestamp"), k.alias("customer_id"), F.col("event_type").alias("activity_type"), F.col("value").cast("decimal(18,2)").alias("value"),
        pick(["web", "ios", "android", "pos"]).alias("platform"), pick(["phone", "desk"]).alias("device_type"), F.get_json_object("props", "$.k").cast("int").alias("duration_seconds"))


def drain(t, df, name):
    folder = f"{shared_folder(t.spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"
    J.start_batches(df, f"{name}_{uuid.uuid4().hex[:8]}", J.table_sink(f"{folder}/out"), f"{folder}/checkpoint", once=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch_id")


_CLOSED = "WHERE window_end <= (SELECT max(ts) FROM act) - INTERVAL 10 MINUTE"
_EV = "ev AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS w, ['phone', 'desk'][1 + customer_id % 2] AS device_type, (props->>'$.k')::BIGINT AS k FROM act)"
_SL = "sl AS (SELECT act.*, (props->>'$.k')::BIGINT AS k, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(i::INTEGER) AS w FROM act, range(5) r(i))"


@plan("st01_activity_windows", f"""WITH {_EV}, g AS (SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, customer_id, platform, device_type, count(*) AS total_activities,
    count(DISTINCT activity_type) AS distinct_activities, sum(k)::BIGINT AS total_duration, array_to_string(list_sort(list(DISTINCT activity_type)), ',') AS activity_types FROM ev GROUP BY ALL) SELECT * FROM g {_CLOSED}""")
def _(t):
    return drain(t, J.activity_windows(stream(t)), "st01").withColumn("activity_types", F.array_join("activity_types", ","))


@plan("st02_order_windows", f"""WITH {_SL}, g AS (SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, activity_type AS order_status, hour(ts)::INTEGER AS hour, count(*) AS order_count,
    count(customer_id) AS unique_customers FROM sl GROUP BY ALL) SELECT * FROM g {_CLOSED}""")
def _(t):
    return drain(t, J.order_windows(stream(t).withColumnRenamed("activity_type", "order_status")), "st02")


@plan("st03_product_windows", f"""WITH {_SL}, g AS (SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, platform AS product_category_name, count(*) AS product_count, sum(value)::DOUBLE / count(*) AS avg_weight,
    max(value)::DOUBLE AS max_weight FROM sl GROUP BY ALL) SELECT * FROM g {_CLOSED}""")
def _(t):
    return drain(t, J.product_windows(stream(t).withColumnsRenamed({"platform": "product_category_name", "value": "product_weight_g"})), "st03")


@plan("st04_customer_windows", f"""WITH {_SL}, g AS (SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, platform AS customer_state, count(*) AS customer_count FROM sl GROUP BY ALL) SELECT * FROM g {_CLOSED}""")
def _(t):
    return drain(t, J.customer_windows(stream(t).withColumnRenamed("platform", "customer_state")), "st04")


@plan("st05_quality_windows", """WITH ev AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, event_id % 10 <> 0 AS v, event_id % 7 <> 0 AS o, ts FROM act),
  g AS (SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, count(*) AS total_rows, count(*) FILTER (v) AS valid_timestamps, count(*) FILTER (o)::BIGINT AS valid_order_dates,
    count(*) FILTER (v)::DOUBLE / count(*) AS timestamp_validity_rate, count(*) FILTER (o)::DOUBLE / count(*) AS order_date_validity_rate FROM ev GROUP BY ALL)
  SELECT * FROM g WHERE window_end <= (SELECT max(ts) FROM act) - INTERVAL 5 MINUTE""")
def _(t):
    k = F.col("event_id")
    rows = stream(t).select(F.col("timestamp").alias("ingested"), F.when(k % 10 != 0, F.col("timestamp")).alias("timestamp"), F.lit(2).alias("bought"), F.when(k % 7 == 0, 1).otherwise(3).alias("delivered"))
    return drain(t, J.quality_windows(rows, "ingested", "timestamp", "bought", "delivered"), "st05")


@plan("st06_platform_windows", f"""WITH {_EV}, g AS (SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, platform, device_type AS shipping_region, count(*) AS orders, sum(k)::BIGINT AS revenue_vnd FROM ev GROUP BY ALL) SELECT * FROM g {_CLOSED}""")
def _(t):
    rows = stream(t).withColumnsRenamed({"device_type": "shipping_region", "duration_seconds": "total_amount_vnd"})
    return drain(t, J.platform_windows(rows, "timestamp"), "st06").drop("customers_approx")


_PAY = "CASE lower(payment_method) WHEN 'cod' THEN 'COD' WHEN 'momo' THEN 'E_Wallet_MoMo' WHEN 'zalopay' THEN 'E_Wallet_ZaloPay' WHEN 'vnpay' THEN 'E_Wallet_VNPay' ELSE payment_method END"


@plan("st07_enrich_sales", f"""SELECT event_id, total_amount_usd * 24000 AS total_amount_vnd, {_PAY} AS payment_method_local, 'Unknown' AS region,
  (month(order_timestamp) * 100 + day(order_timestamp)) BETWEEN 121 AND 220 AS is_tet_season FROM sev""")
def _(t):
    return J.enrich_sales(t.sev).select("event_id", "total_amount_vnd", "payment_method_local", "region", "is_tet_season")


@plan("st08_late_data", f"""WITH {_EV}, b AS (SELECT max(ts) - INTERVAL 10 MINUTE AS first_mark FROM ev WHERE event_id % 10 <> 0), e AS (SELECT max(ts) - INTERVAL 10 MINUTE AS last_mark FROM ev)
  SELECT w AS window_start, w + INTERVAL 5 MINUTE AS window_end, activity_type, count(*) AS n FROM ev, b, e
  WHERE (event_id % 10 <> 0 OR w + INTERVAL 5 MINUTE > first_mark) AND w + INTERVAL 5 MINUTE <= last_mark GROUP BY ALL""")
def _(t):
    """A tenth of the events arrives after the others: what lies behind the watermark by then is dropped."""
    folder = f"{shared_folder(t.spark)}/streams/st08-{uuid.uuid4().hex[:12]}"
    late = F.col("event_id") % 10 == 0
    for part, rows in (("first", t.raw("events").where(~late)), ("late", t.raw("events").where(late))):
        rows.write.parquet(f"{folder}/in/part={part}")
        arrived = J.event_time(t.spark.readStream.schema(EVENTS).parquet(f"{folder}/in/part=*"), "ts").select("event_id", "ts", F.col("event_type").alias("activity_type"))
        windows = J.sliding(arrived, "ts", ["activity_type"], [F.count("*").alias("n")], slide=None)
        J.start_batches(windows, "st08", J.table_sink(f"{folder}/out"), f"{folder}/checkpoint", once=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch_id")


@plan("st09_unique_events", "SELECT event_id, ts, customer_id FROM act")
def _(t):
    rows = stream(t).select("event_id", "timestamp", "customer_id")
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out = drain(t, J.unique_events(twice, "event_id", "timestamp"), "st09")
    return out.select("event_id", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "customer_id")


_SESS = """sv AS (SELECT *, sum(n) OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS session_no FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM act)),
  sg AS (SELECT customer_id, session_no::BIGINT AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events, count(*) FILTER (activity_type = 'view') AS page_views,
    count(*) FILTER (activity_type = 'click') AS added_to_cart, count(*) FILTER (activity_type = 'purchase') AS purchases, sum(value)::DOUBLE AS value FROM sv GROUP BY 1, 2),
  sf AS (SELECT *, (epoch(date_trunc('second', session_end)) - epoch(date_trunc('second', session_start)))::BIGINT AS duration_seconds, events = 1 AS is_bounce, purchases > 0 AS is_conversion,
    added_to_cart > 0 AND purchases = 0 AS is_cart_abandoned FROM sg)"""


@plan("st11_sessions_stream", f"WITH {_SESS} SELECT session_start AS window_start, session_end + INTERVAL 30 MINUTE AS window_end, customer_id, events, value FROM sf WHERE session_end + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM act) - INTERVAL 10 MINUTE")
def _(t):
    return drain(t, J.sessions(stream(t), "customer_id", "timestamp"), "st11")


@plan("st11_sessionize", f"WITH {_SESS} SELECT event_id, customer_id, ts, session_no::BIGINT AS session_no FROM sv")
def _(t):
    return N.sessionize(t.act.select("event_id", "customer_id", "ts"), "customer_id", "ts", "event_id")


@plan("a36_session_fact", f"WITH {_SESS} SELECT * FROM sf")
def _(t):
    return N.session_fact(N.sessionize(t.act, "customer_id", "ts", "event_id"))


@plan("a36_session_rates", f"""WITH {_SESS} SELECT count(*) AS sessions, count(*) FILTER (is_bounce)::DOUBLE / count(*) AS bounce_rate, count(*) FILTER (is_conversion)::DOUBLE / count(*) AS conversion_rate,
  count(*) FILTER (is_cart_abandoned)::DOUBLE / count(*) FILTER (added_to_cart > 0) AS abandonment_rate FROM sf""")
def _(t):
    return N.session_rates(N.session_fact(N.sessionize(t.act, "customer_id", "ts", "event_id")))
