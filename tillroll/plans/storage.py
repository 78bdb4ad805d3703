"""Queries that write tables, files and streams and read them back (SRC-*, SNK-*, ST-10, ST-12, ST-13, ST-14, ST-15, J-17, P-20, Q-01, U-03, U-04, M-21).

Every query writes to a fresh directory of the shared folder; what it returns is what was stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll.ml import models as M
from tillroll.operators import clean as C
from tillroll.operators import joins as JN
from tillroll.operators import quality as Q
from tillroll.plans.registry import plan
from tillroll.plans.streaming import stream
from tillroll.session import shared_folder
from tillroll.sources import readers as R
from tillroll.sources import writers as W
from tillroll.streaming import jobs as J

PEOPLE = "customer_id BIGINT, customer_name STRING, customer_segment STRING, balance DECIMAL(18,2)"
_PEOPLE = "SELECT customer_id, customer_name, customer_segment, balance::DOUBLE AS balance FROM cst"
_EVENTS = "SELECT event_id, customer_id, activity_type, value::DOUBLE AS value FROM act"


def fresh(t, name):
    return f"{shared_folder(t.spark)}/storage/{name}-{uuid.uuid4().hex[:12]}"


def people(t):
    return t.cst.select("customer_id", "customer_name", "customer_segment", "balance")


def plain(df):
    return df.withColumn("balance", F.col("balance").cast("double"))


def events(t):
    return stream(t).select("event_id", "timestamp", "customer_id", "activity_type", F.col("value").cast("double").alias("value"))


def run(df, folder, sink, name="q"):
    J.start_batches(df, f"{name}_{uuid.uuid4().hex[:8]}", sink, f"{folder}/checkpoint", once=True).awaitTermination()


@plan("src02_csv", _PEOPLE)
def _(t):
    folder = fresh(t, "src02")
    W.export_report(people(t), folder)
    return plain(R.read_csv(t.spark, folder, PEOPLE))


@plan("src03_rows_per_file", "SELECT customer_segment AS kind, count(*) AS n FROM cst GROUP BY 1")
def _(t):
    folder = fresh(t, "src03")
    W.export_by_category(people(t).withColumn("kind", F.col("customer_segment")), folder, "kind")
    files = R.rows_per_file(R.read_csv(t.spark, folder))
    return files.groupBy(F.regexp_extract("file_path", "kind=([^/]*)/", 1).alias("kind")).agg(F.sum("n").alias("n"))


@plan("src04_latest_file", _PEOPLE + " WHERE customer_segment = 'MACHINERY'")
def _(t):
    folder = fresh(t, "src04")
    for name, segment in (("1-old", "BUILDING"), ("2-new", "MACHINERY")):
        people(t).where(F.col("customer_segment") == segment).coalesce(1).write.option("header", True).csv(f"{folder}/{name}")
    return plain(R.latest_file(R.read_csv(t.spark, [f"{folder}/1-old", f"{folder}/2-new"], PEOPLE)))


@plan("src05_json_arrays", _PEOPLE)
def _(t):
    folder = fresh(t, "src05")
    rows = people(t).groupBy(F.floor(F.col("customer_id") / 500).alias("file")).agg(F.collect_list(F.struct(*people(t).columns)).alias("rows"))  # 500 rows each
    rows.select(F.to_json("rows").alias("value"), "file").write.partitionBy("file").text(folder)
    return plain(R.read_json_array(t.spark, folder, PEOPLE)).select("customer_id", "customer_name", "customer_segment", "balance")


@plan("src08_documents", _PEOPLE + " WHERE customer_segment = 'BUILDING'")
def _(t):
    folder = fresh(t, "src08")
    people(t).withColumn("_id", F.concat(F.lit("id"), "customer_id")).write.json(folder)
    return plain(R.read_documents(t.spark, folder, f"{PEOPLE}, _id STRING", match={"customer_segment": "BUILDING"}))


@plan("src10_tagged", "SELECT customer_id, TIMESTAMP '2024-01-01 00:00:00' AS extracted_at, 'store' AS data_source FROM cst")
def _(t):
    return R.tag_source(t.cst.select("customer_id"), "store", "2024-01-01 00:00:00")


@plan("snk01_stream_to_table", _EVENTS)
def _(t):
    folder = fresh(t, "snk01")
    run(events(t), folder, J.table_sink(f"{folder}/out"))
    return t.spark.read.parquet(f"{folder}/out").drop("batch_id", "timestamp")


@plan("st13_progress_rows", "SELECT 'st13' AS name, count(*)::BIGINT AS input_rows FROM act")
def _(t):
    folder = fresh(t, "st13")
    table = J.ProgressTable(t.spark, f"{folder}/progress")
    t.spark.streams.addListener(table)
    try:
        query = J.start_batches(events(t), "st13", J.table_sink(f"{folder}/out"), f"{folder}/check", once=True)
        query.awaitTermination()
        if not table.wait(query):
            raise TimeoutError("the last progress event has not arrived")
    finally:
        t.spark.streams.removeListener(table)
    return t.spark.read.schema(J.ProgressTable.SCHEMA).json(f"{folder}/progress").groupBy("name").agg(F.sum("input_rows").alias("input_rows"))


@plan("snk02_stream_to_documents", _EVENTS)
def _(t):
    folder = fresh(t, "snk02")
    run(events(t).drop("timestamp"), folder, J.document_sink(f"{folder}/out"))
    return R.read_documents(t.spark, f"{folder}/out", "event_id BIGINT, customer_id BIGINT, activity_type STRING, value DOUBLE").drop("batch_id")


@plan("snk03_dual_sink", "SELECT activity_type, count(*) AS n, count(*) AS raw_rows FROM act GROUP BY 1")
def _(t):
    folder = fresh(t, "snk03")
    run(events(t), folder, J.dual_sink(f"{folder}/raw", f"{folder}/sums", lambda b: b.groupBy("activity_type").agg(F.count("*").alias("n"))))
    raw = t.spark.read.parquet(f"{folder}/raw").groupBy("activity_type").agg(F.count("*").alias("raw_rows"))
    return t.spark.read.parquet(f"{folder}/sums").groupBy("activity_type").agg(F.sum("n").alias("n")).join(raw, "activity_type")


@plan("snk04_messages", "SELECT customer_id::VARCHAR AS key, customer_id, customer_segment, balance::DOUBLE AS balance FROM cst")
def _(t):
    sent = W.as_messages(plain(people(t)).drop("customer_name"), "customer_id")
    return sent.select("key", F.from_json("value", "customer_id BIGINT, customer_segment STRING, balance DOUBLE").alias("v")).select("key", "v.*")


@plan("snk05_append_replace", "SELECT customer_id, 2::BIGINT AS copies, 1::BIGINT AS after_replace FROM cst")
def _(t):
    folder, rows = fresh(t, "snk05"), people(t).select("customer_id")
    for path, modes in (("twice", ("append", "append")), ("once", ("append", "overwrite"))):
        for mode in modes:
            W.write_table(rows, f"{folder}/{path}", mode)
    count = lambda path, name: t.spark.read.parquet(f"{folder}/{path}").groupBy("customer_id").agg(F.count("*").alias(name))
    return count("twice", "copies").join(count("once", "after_replace"), "customer_id")


@plan("snk06_export_json", _PEOPLE)
def _(t):
    folder = fresh(t, "snk06")
    W.export_report(people(t), folder, "json")
    return plain(t.spark.read.schema(PEOPLE).json(folder))


@plan("snk07_by_category", "SELECT category, count(*) AS products, sum(price)::DOUBLE AS value FROM prd GROUP BY 1")
def _(t):
    folder = fresh(t, "snk07")
    W.export_by_category(t.prd.select("category", "product_id", "price"), folder)
    rows = R.read_csv(t.spark, folder, "product_id BIGINT, price DECIMAL(18,2), category STRING")
    return rows.groupBy("category").agg(F.count("*").alias("products"), F.sum("price").cast("double").alias("value"))


@plan("snk13_backup", "SELECT 'customers' AS table_name, count(*) AS n, count(*) AS stored FROM cst UNION ALL SELECT 'products', count(*), count(*) FROM prd")
def _(t):
    folder = fresh(t, "snk13")
    tables = {"customers": people(t), "products": t.prd}
    noted = W.backup(tables, folder).drop("path")
    stored = None
    for name in tables:
        part = t.spark.read.parquet(f"{folder}/{name}").agg(F.count("*").alias("stored")).withColumn("table_name", F.lit(name))
        stored = part if stored is None else stored.unionByName(part)
    return noted.join(stored, "table_name")


@plan("snk14_load_statistics", """SELECT 'people' AS table_name, TIMESTAMP '2024-03-01 00:00:00' AS loaded_at, count(*) AS attempted, count(*) FILTER (balance >= 0) AS loaded,
  count(*) FILTER (balance >= 0) * 100.0::DOUBLE / count(*) AS success_pct, count(*) FILTER (balance >= 0) AS stored FROM cst""")
def _(t):
    folder = fresh(t, "snk14")
    noted = W.write_with_stats(people(t).withColumn("balance", F.when(F.col("balance") >= 0, F.col("balance"))), folder, "people", "2024-03-01 00:00:00", required=["balance"])
    return noted.withColumn("stored", t.spark.read.parquet(folder).agg(F.count("*").alias("n")).scalar())


@plan("st10_keyed_state", "SELECT DISTINCT ON (customer_id) customer_id, event_id, activity_type, 0::BIGINT AS update_count FROM act ORDER BY customer_id, ts DESC, event_id DESC")
def _(t):
    folder = fresh(t, "st10")
    run(events(t).drop("value"), folder, J.upsert_sink(f"{folder}/state", ["customer_id"], ["timestamp", "event_id"], "update_count"))
    return J.read_latest(t.spark, f"{folder}/state").drop("timestamp")


@plan("st12_restart", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM act")
def _(t):
    folder = fresh(t, "st12")
    for _ in range(2):  # the second run finds nothing new behind the checkpoint
        J.start_batches(events(t), "st12", J.table_sink(f"{folder}/out"), f"{folder}/checkpoint", once=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


def messages(t):
    """Events as topic records; some are cut off, some lack a field."""
    e = events(t)
    body = F.to_json(F.struct("event_id", F.when(F.col("event_id") % 10 != 1, F.col("customer_id")).alias("customer_id"), "value"))
    value = F.when(F.col("event_id") % 10 == 0, F.substring(body, 1, 9)).otherwise(body)
    return e.select(F.when(F.col("customer_id") % 2 == 0, "even").otherwise("odd").alias("topic"), value.alias("value"))


@plan("st14_dead_letters", """SELECT coalesce(CASE event_id % 10 WHEN 0 THEN 'malformed record' WHEN 1 THEN 'missing: customer_id' END, 'none') AS error, count(*) AS n FROM act GROUP BY 1""")
def _(t):
    folder = fresh(t, "st14")
    parsed = R.parse_topic(messages(t), "event_id BIGINT, customer_id BIGINT, value DOUBLE", keep_bad=True)

    def write(batch, batch_id):
        good, bad = J.split_bad(batch, ["customer_id"])
        good.select(F.lit("none").alias("error")).unionByName(bad.select(F.col("processing_error").alias("error"))).write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    run(parsed, folder, write)
    return t.spark.read.parquet(f"{folder}/out").groupBy("error").agg(F.count("*").alias("n"))


@plan("st15_topic_routing", """SELECT CASE WHEN customer_id % 2 = 0 THEN 'even' ELSE 'odd' END AS topic, count(*) AS n,
  (sum(value) FILTER (event_id % 10 <> 0 AND customer_id % 2 = 0))::DOUBLE AS value FROM act GROUP BY 1""")
def _(t):
    folder = fresh(t, "st15")
    run(messages(t), folder, J.route_sink(f"{folder}/out", {"even": "event_id BIGINT, value DECIMAL(18,2)", "odd": "event_id BIGINT"}))
    even = t.spark.read.parquet(f"{folder}/out/even").select(F.lit("even").alias("topic"), F.col("value"))
    odd = t.spark.read.parquet(f"{folder}/out/odd").select(F.lit("odd").alias("topic"), F.lit(None).cast("decimal(18,2)").alias("value"))
    return even.unionByName(odd).groupBy("topic").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


@plan("j17_stream_static", "SELECT event_id, customer_segment FROM act LEFT JOIN cst USING (customer_id)")
def _(t):
    folder = fresh(t, "j17")
    dim = people(t).select("customer_id", "customer_segment", F.lit(True).alias("is_current"))
    run(JN.enrich_stream(events(t).select("event_id", "customer_id"), {"customer_id": dim}), folder, J.table_sink(f"{folder}/out"))
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "customer_segment")


@plan("u03_batch_function", "SELECT event_id, value::DOUBLE * 2 AS doubled FROM act")
def _(t):
    folder = fresh(t, "u03")
    run(events(t), folder, lambda batch, i: batch.select("event_id", (F.col("value") * 2).alias("doubled")).write.mode("overwrite").parquet(f"{folder}/out/batch_id={i}"))
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "doubled")


Q.register_check("negative_balance")(lambda df: df.agg(F.count_if(F.col("balance") < 0).alias("failed")))
Q.register_check("no_segment")(lambda df: df.agg(F.count_if(F.col("customer_segment").isNull()).alias("failed")))


@plan("u04_custom_checks", "SELECT 'negative_balance' AS check_name, count(*) FILTER (balance < 0) AS failed FROM cst UNION ALL SELECT 'no_segment', count(*) FILTER (customer_segment IS NULL) FROM cst")
def _(t):
    return Q.run_checks(people(t), ["negative_balance", "no_segment"])


@plan("q01_schema_issues", """SELECT issue, column_name, (SELECT count(*) FROM ord) AS rows_checked FROM (VALUES ('missing_column', 'order_purchase_timestamp'), ('missing_column', 'order_approved_at'),
  ('extra_column', 'total_amount'), ('extra_column', 'order_date'), ('extra_column', 'payment_method'), ('wrong_type', 'order_delivered_carrier_date')) v(issue, column_name)
  UNION ALL SELECT 'extra_column', 'order_delivered_carrier_date', (SELECT count(*) FROM ord)""")
def _(t):
    orders = t.ord.withColumn("order_delivered_carrier_date", F.lit("2024-01-01"))
    return Q.schema_issues(orders, C.DATASETS["orders"]).drop("detail").withColumn("rows_checked", t.ord.agg(F.count("*").alias("n")).scalar())


@plan("p20_dataset_keys", """SELECT 'customers' AS dataset, count(*) AS n, count(DISTINCT customer_id) AS keys FROM cst UNION ALL SELECT 'orders', count(*), count(DISTINCT order_id) FROM ord
  UNION ALL SELECT 'order_items', count(*), count(DISTINCT (order_id, line_number)) FROM itm""")
def _(t):
    tables = {"customers": t.cst, "orders": t.ord, "order_items": t.itm.withColumnRenamed("line_number", "order_item_id")}
    out = None
    for name, df in tables.items():
        per_key = df.groupBy(*C.DATASETS[name].keys).agg(F.count("*").alias("c"))
        part = per_key.agg(F.sum("c").alias("n"), F.count("*").alias("keys")).select(F.lit(name).alias("dataset"), "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out


@plan("m21_saved_model", "SELECT count(*) AS scored, 0::BIGINT AS changed, 'balance' AS feature FROM cst")
def _(t):
    folder = fresh(t, "m21")
    rows = people(t).select("customer_id", F.col("balance").cast("double").alias("balance"), (F.col("balance") > 0).cast("double").alias("label"))
    model = M.fit_classifier(rows, "label", M.preparation(["balance"], scale=False), trees=3, depth=3)
    M.save(model, folder, {"feature": "balance"}, t.spark)
    again, noted = M.load(folder, t.spark)
    W.write_table(model.transform(rows).select("customer_id", F.col("prediction").alias("p")), f"{folder}/scored")
    both = again.transform(rows).select("customer_id", "prediction").join(t.spark.read.parquet(f"{folder}/scored"), "customer_id")
    return both.agg(F.count("*").alias("scored"), F.count_if(F.col("p") != F.col("prediction")).alias("changed")).withColumn("feature", F.lit(noted["feature"]))
