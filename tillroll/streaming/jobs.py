"""Structured Streaming: windowed aggregates, dedupe, sessions, keyed state, routing and sinks.

The transformations take and return DataFrames and run unchanged in batch, where they are compared with
SQL. Timestamps must be TIMESTAMP (a watermark rejects TIMESTAMP_NTZ): see :func:`event_time`.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tillroll.functions.dates import TET_JAN21_FEB20, in_season
from tillroll.functions.numbers import dsum, ratio
from tillroll.operators import clean
from tillroll.operators.load import apply_changes, newest_per_key, upsert

WATERMARK, WINDOW, SLIDE, TRIGGER = "10 minutes", "5 minutes", "1 minute", "30 seconds"


def event_time(df: DataFrame, column: str) -> DataFrame:
    """The column as TIMESTAMP in the session time zone (UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _marked(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withWatermark(ts, delay) if delay and df.isStreaming else df


def _bounds(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"), *rest)


def activity_windows(df: DataFrame, ts: str = "timestamp", delay: str = WATERMARK, width: str = WINDOW) -> DataFrame:
    """ST-01: tumbling counts, kinds and duration per customer, platform and device."""
    g = _marked(df, ts, delay).groupBy(F.window(ts, width), "customer_id", "platform", "device_type").agg(
        F.count("*").alias("total_activities"), F.sort_array(F.collect_set("activity_type")).alias("activity_types"),
        F.sum("duration_seconds").alias("total_duration"))
    return _bounds(g.withColumn("distinct_activities", F.size("activity_types").cast("bigint")))


def sliding(df: DataFrame, ts: str, by: Sequence[str], aggs: Sequence[F.Column], delay: str = WATERMARK, width: str = WINDOW, slide: str | None = SLIDE) -> DataFrame:
    """Sliding or tumbling window aggregate over ``by``."""
    return _bounds(_marked(df, ts, delay).groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by).agg(*aggs))


def order_windows(df: DataFrame, ts: str = "timestamp", delay: str = WATERMARK) -> DataFrame:
    """ST-02: orders per status and hour; ``unique_customers`` counts rows with a customer, as in the source (G-13)."""
    rows = _marked(df, ts, delay).withColumn("hour", F.hour(ts))
    return _bounds(rows.groupBy(F.window(ts, WINDOW, SLIDE), "order_status", "hour").agg(
        F.count("*").alias("order_count"), F.count("customer_id").alias("unique_customers")))


def product_windows(df: DataFrame, ts: str = "timestamp", delay: str = WATERMARK) -> DataFrame:
    """ST-03: products per category with mean and largest weight."""
    w = F.col("product_weight_g").cast("double")
    return sliding(df, ts, ["product_category_name"], [F.count("*").alias("product_count"), ratio(F.sum(w.cast("decimal(18,2)")), F.count(w)).alias("avg_weight"), F.max(w).alias("max_weight")], delay)


def customer_windows(df: DataFrame, ts: str = "timestamp", delay: str = WATERMARK) -> DataFrame:
    """ST-04: customers per state."""
    return sliding(df, ts, ["customer_state"], [F.count("*").alias("customer_count")], delay)


def quality_windows(df: DataFrame, ingested: str, ts: str, start: str, end: str, delay: str = "5 minutes") -> DataFrame:
    """ST-05: valid timestamps and date order per window of the ingestion time (a column, never the clock; G-21)."""
    good = F.when(F.col(start) > F.col(end), 0).otherwise(1)
    g = _marked(df, ingested, delay).groupBy(F.window(ingested, WINDOW)).agg(
        F.count("*").alias("total_rows"), F.count(ts).alias("valid_timestamps"), F.sum(good).alias("valid_order_dates"))
    return _bounds(g.withColumns({"timestamp_validity_rate": ratio(F.col("valid_timestamps"), F.col("total_rows")),
                                  "order_date_validity_rate": ratio(F.col("valid_order_dates"), F.col("total_rows"))}))


def platform_windows(df: DataFrame, ts: str = "event_timestamp", delay: str = WATERMARK) -> DataFrame:
    """ST-06: orders and revenue per platform and region; the watermark bounds the state."""
    return sliding(df, ts, ["platform", "shipping_region"], [F.count("*").alias("orders"), F.sum("total_amount_vnd").alias("revenue_vnd"), F.approx_count_distinct("customer_id").alias("customers_approx")], delay, slide=None)


def enrich_sales(df: DataFrame) -> DataFrame:
    """ST-07: currency, payment and Tet flag; stateless, so it streams as it is."""
    return df.withColumns({"total_amount_vnd": F.col("total_amount_usd") * clean.EXCHANGE_RATE, "payment_method_local": clean.payment_code(F.col("payment_method")),
                           "region": clean.city_region(clean.city_name(F.col("shipping_province"))), "is_tet_season": in_season(F.col("order_timestamp"), TET_JAN21_FEB20)})


def unique_events(df: DataFrame, key: str, ts: str, delay: str = WATERMARK) -> DataFrame:
    """ST-09: one row per event id; on a stream the state is dropped behind the watermark."""
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = WATERMARK) -> DataFrame:
    """ST-11 on a stream: session windows per user; the watermark closes a session and frees its state.

    In batch use :func:`tillroll.operators.sessions.sessionize`, which splits a hot user over many tasks.
    """
    g = _marked(df, ts, delay).groupBy(F.session_window(ts, gap).alias("window"), key).agg(F.count("*").alias("events"), dsum("value").alias("value"))
    return _bounds(g)


def split_bad(parsed: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """ST-14: good rows, and dead letters with ``processing_error``."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in parsed.columns else F.lit(False)
    error = F.when(corrupt, "malformed record").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    rows = parsed.withColumn("processing_error", error)
    return rows.where("processing_error IS NULL").drop("processing_error", "_corrupt_record"), rows.where("processing_error IS NOT NULL")


def route(records: DataFrame, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """ST-15: one frame per topic, parsed with that topic's schema."""
    from tillroll.sources.readers import parse_topic
    return {topic: parse_topic(records.where(F.col("topic") == topic), schema) for topic, schema in schemas.items()}


def route_sink(folder: str, schemas: Mapping[str, str]) -> Callable[[DataFrame, int], None]:
    """ST-15: one read of the batch for all topics; each topic's rows, parsed with its schema, go to its own directory."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for topic, rows in route(batch, schemas).items():
                rows.write.mode("overwrite").parquet(f"{folder}/{topic}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return write


# ---- sinks and lifecycle ----------------------------------------------------------------------------

def start_batches(df: DataFrame, name: str, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, mode: str = "append",
                  every: str = TRIGGER) -> StreamingQuery:
    """SNK-01, U-03, ST-12: run ``write(batch, id)`` per micro-batch.

    ``once`` drains what is there and stops. The checkpoint makes the query restart where it ended. The
    batch is neither counted nor tested for emptiness: that would run a stateful plan twice.
    """
    writer = df.writeStream.queryName(name).outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """SNK-01: one directory per batch, so a batch that is replayed after a failure replaces itself."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def document_sink(path: str) -> Callable[[DataFrame, int], None]:
    """SNK-02: JSON lines, one directory per batch."""
    return lambda batch, batch_id: batch.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def dual_sink(raw_path: str, aggregate_path: str, aggregate: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """SNK-03: the raw rows and an aggregate of the same micro-batch, read once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{raw_path}/batch_id={batch_id}")
            aggregate(batch).write.mode("overwrite").parquet(f"{aggregate_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return write


# ---- keyed state ------------------------------------------------------------------------------------

BUCKETS = 64


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _history(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """Complete versions of every bucket, the oldest first: from the names and the small notes of the versions, no data."""
    fs, path = _files(spark, folder)
    if not fs.exists(path(folder)):
        return {}
    out: dict[int, list[int]] = {}
    for version in sorted(s.getPath().getName() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("version=")):
        note = path(f"{folder}/{version}/_BUCKETS")
        if fs.exists(note):
            stream = fs.open(note)
            text = stream.readUTF()
            stream.close()
            for b in filter(None, text.split(",")):
                out.setdefault(int(b), []).append(int(version.split("=")[1]))
    return out


def _bucket_path(folder: str, version: int, bucket: int) -> str:
    return f"{folder}/version={version:06d}/_bucket={bucket}"


def _read_buckets(spark: SparkSession, folder: str, newest: Mapping[int, int]) -> DataFrame | None:
    fs, path = _files(spark, folder)
    there = [p for p in (_bucket_path(folder, v, b) for b, v in sorted(newest.items())) if fs.exists(path(p))]  # an emptied bucket has no directory
    return spark.read.parquet(*there) if there else None


def read_latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table kept by :func:`upsert_sink` or :func:`changes_sink`: the newest version of every bucket; None before the first row."""
    return _read_buckets(spark, folder, {b: v[-1] for b, v in _history(spark, folder).items()})


def _bucketed_sink(folder: str, keys: Sequence[str], change: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int) -> Callable[[DataFrame, int], None]:
    """Batch n rewrites the buckets that its keys fall into, from their newest version below n; the others are not touched.

    A replayed batch reads the same earlier versions and replaces its own. Of a rewritten bucket the version it was made from stays for that, older ones go.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            touched = sorted(r["b"] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most ``buckets`` numbers
            history = _history(spark, folder)
            before = {b: [v for v in history.get(b, []) if v < batch_id] for b in touched}
            old = _read_buckets(spark, folder, {b: v[-1] for b, v in before.items() if v})
            target = f"{folder}/version={batch_id:06d}"
            change(old, batch).withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(target)
            fs, path = _files(spark, folder)
            stream = fs.create(path(f"{target}/_BUCKETS"), True)
            stream.writeUTF(",".join(map(str, touched)))
            stream.close()
            for b, versions in before.items():
                for v in versions[:-1]:
                    fs.delete(path(_bucket_path(folder, v, b)), True)
        finally:
            batch.unpersist()
    return write


def upsert_sink(folder: str, keys: Sequence[str], order: Sequence[str], counter: str | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """ST-10: keep the latest state per key; counters do not grow twice when a batch is replayed."""
    def change(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch.withColumn(counter, F.lit(0).cast("bigint")) if counter else batch
        return newest_per_key(rows, keys, order) if old is None else upsert(old, rows, keys, order, counter)
    return _bucketed_sink(folder, keys, change, buckets)


def changes_sink(folder: str, keys: Sequence[str], columns: Sequence[str], op: str = "op", order: str = "lsn", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """ST-16: apply insert / update / delete envelopes."""
    def change(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return apply_changes(old if old is not None else batch.select(*columns).limit(0), batch, keys, op, order)
    return _bucketed_sink(folder, keys, change, buckets)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """SNK-04: rows as JSON messages. Needs the Kafka connector on the class path."""
    from tillroll.sources.writers import as_messages
    return (as_messages(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())


def progress(queries: Sequence[StreamingQuery]) -> list[dict[str, object]]:
    """ST-13: rates, batch id and state size of each query."""
    out = []
    for q in queries:
        p = q.lastProgress or {}
        out.append({"id": str(q.id), "name": q.name, "timestamp": p.get("timestamp"), "batch_id": p.get("batchId"),
                    "input_rows_per_second": p.get("inputRowsPerSecond"), "processed_rows_per_second": p.get("processedRowsPerSecond"),
                    "state_rows": sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", []))})
    return out


class ProgressTable(StreamingQueryListener):
    """ST-13: progress of all queries of a session as rows of a table, one small file per batch; a batch that is reported again replaces its row.

    Add it with ``spark.streams.addListener``. Events arrive after the batch; ``wait`` returns once a stopped query's last one is written.
    """

    SCHEMA = "name string, timestamp string, input_rows bigint, input_rows_per_second double, processed_rows_per_second double, state_rows bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._ended = spark, path, defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (p.name, p.timestamp, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond, sum(o.numRowsTotal for o in p.stateOperators))
        self.spark.createDataFrame([row], self.SCHEMA).write.mode("overwrite").json(f"{self.path}/run_id={p.runId}/batch_id={p.batchId}")

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        return self._ended[str(query.runId)].wait(seconds)


def stop_all(spark: SparkSession) -> int:
    """ST-12: stop every running query."""
    running = spark.streams.active
    for q in running:
        q.stop()
    return len(running)
