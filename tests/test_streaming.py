"""Streams drained from files: watermark, dedupe, state, change feed, routing, dead letters, restart."""

import json

from pyspark.sql import functions as F

from tillroll import schemas
from tillroll.sources import readers, writers
from tillroll.streaming import jobs as J

ACT = "event_id STRING, customer_id STRING, activity_type STRING, platform STRING, device_type STRING, duration_seconds INT, timestamp TIMESTAMP, value DOUBLE"


def event(i, ts, kind="page_view", customer="c1", value=1.0):
    return {"event_id": f"e{i}", "customer_id": customer, "activity_type": kind, "platform": "web", "device_type": "phone", "duration_seconds": 10, "timestamp": ts, "value": value}


def write_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows))


def run(df, tmp, name, sink=None):
    q = J.start_batches(df, name, sink or J.table_sink(f"{tmp}/{name}"), f"{tmp}/checkpoint", once=True)
    q.awaitTermination()
    return q


def source(spark, folder, schema=ACT):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_late_rows_are_dropped_and_only_closed_windows_appear(spark, tmp_path):
    src = tmp_path / "in"
    write_file(src, "1.json", [event(1, "2024-01-01 10:01:00"), event(2, "2024-01-01 10:20:00", "search")])
    df = J.activity_windows(source(spark, src))
    run(df, tmp_path, "windows")
    # Watermark is now 10:10. 10:11 is 9 minutes late and kept; 10:09 is 11 minutes late, its window is closed.
    write_file(src, "2.json", [event(3, "2024-01-01 10:11:00"), event(4, "2024-01-01 10:04:00"), event(5, "2024-01-01 11:00:00")])
    run(df, tmp_path, "windows")
    rows = {str(r["window_start"]): r["total_activities"] for r in spark.read.parquet(f"{tmp_path}/windows").collect()}
    assert rows == {"2024-01-01 10:00:00": 1, "2024-01-01 10:10:00": 1, "2024-01-01 10:20:00": 1}


def test_duplicates_within_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    write_file(src, "1.json", [event(1, "2024-01-01 10:00:00"), event(1, "2024-01-01 10:01:00"), event(2, "2024-01-01 10:02:00")])
    df = J.unique_events(source(spark, src), "event_id", "timestamp")
    run(df, tmp_path, "unique")
    write_file(src, "2.json", [event(2, "2024-01-01 10:03:00"), event(3, "2024-01-01 10:04:00")])
    run(df, tmp_path, "unique")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/unique").collect()) == ["e1", "e2", "e3"]


def test_sessions_close_after_the_gap(spark, tmp_path):
    src = tmp_path / "in"
    write_file(src, "1.json", [event(1, "2024-01-01 10:00:00"), event(2, "2024-01-01 10:20:00"), event(3, "2024-01-01 12:00:00"), event(4, "2024-01-01 15:00:00")])
    run(J.sessions(source(spark, src), "customer_id", "timestamp"), tmp_path, "sessions")
    rows = sorted((str(r["window_start"]), r["events"]) for r in spark.read.parquet(f"{tmp_path}/sessions").collect())
    assert rows == [("2024-01-01 10:00:00", 2), ("2024-01-01 12:00:00", 1)]


def test_keyed_state_counts_updates_and_survives_replay(spark, tmp_path):
    src, state = tmp_path / "in", f"{tmp_path}/state"
    schema = "product_id STRING, price DOUBLE, t INT"
    sink = J.upsert_sink(state, ["product_id"], ["t"], "update_count")
    write_file(src, "1.json", [{"product_id": "a", "price": 1.0, "t": 1}, {"product_id": "b", "price": 2.0, "t": 1}])
    run(source(spark, src, schema), tmp_path, "state_q", sink)
    write_file(src, "2.json", [{"product_id": "a", "price": 3.0, "t": 2}])
    run(source(spark, src, schema), tmp_path, "state_q", sink)
    rows = {r["product_id"]: (r["price"], r["update_count"]) for r in J.read_latest(spark, state).collect()}
    assert rows == {"a": (3.0, 1), "b": (2.0, 0)}
    sink(spark.createDataFrame([("a", 3.0, 2)], schema), 1)  # the same batch again
    assert {r["product_id"]: r["update_count"] for r in J.read_latest(spark, state).collect()} == {"a": 1, "b": 0}


def test_change_feed(spark, tmp_path):
    src, state = tmp_path / "in", f"{tmp_path}/cdc"
    schema = "k INT, v STRING, op STRING, lsn INT"
    sink = J.changes_sink(state, ["k"], ["k", "v"])
    write_file(src, "1.json", [{"k": 1, "v": "a", "op": "I", "lsn": 1}, {"k": 2, "v": "b", "op": "I", "lsn": 2}])
    run(source(spark, src, schema), tmp_path, "cdc_q", sink)
    write_file(src, "2.json", [{"k": 1, "v": "z", "op": "U", "lsn": 3}, {"k": 2, "v": None, "op": "D", "lsn": 4}])
    run(source(spark, src, schema), tmp_path, "cdc_q", sink)
    assert [tuple(r) for r in J.read_latest(spark, state).collect()] == [(1, "z")]


def test_dual_sink_and_document_sink(spark, tmp_path):
    src = tmp_path / "in"
    write_file(src, "1.json", [event(1, "2024-01-01 10:00:00"), event(2, "2024-01-01 10:00:01", "search")])
    count = lambda b: b.groupBy("activity_type").agg(F.count("*").alias("n"))
    run(source(spark, src), tmp_path, "dual", J.dual_sink(f"{tmp_path}/raw", f"{tmp_path}/agg", count))
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 2 and spark.read.parquet(f"{tmp_path}/agg").count() == 2
    q = run(source(spark, src), tmp_path, "docs", J.document_sink(f"{tmp_path}/documents"))
    assert readers.read_documents(spark, f"{tmp_path}/documents").count() == 2
    assert J.progress([q])[0]["batch_id"] is not None and J.stop_all(spark) == 0


def records(spark):
    rows = [("sales", '{"order_id":"o1","customer_id":"c1","quantity":2,"order_timestamp":"2024-01-01T10:00:00Z"}', 0, 5), ("sales", '{"order_id":', 0, 6),
            ("sales", '{"customer_id":"c2"}', 1, 7), ("activities", '{"activity_id":"a1","customer_id":"c1"}', 0, 1)]
    return spark.createDataFrame(rows, "topic string, value string, partition int, offset bigint").withColumn("timestamp", F.lit("2024-01-01 10:00:05").cast("timestamp"))


def test_topic_parsing_envelope_dead_letters_and_routing(spark):
    sales = readers.parse_topic(records(spark).where("topic = 'sales'"), schemas.SALES, keep_bad=True)
    good, bad = J.split_bad(sales, ["order_id"])
    row = good.first()
    assert (row["order_id"], row["quantity"], row["kafka_offset"], str(row["order_timestamp"])) == ("o1", 2, 5, "2024-01-01 10:00:00")
    assert sorted(r["processing_error"] for r in bad.collect()) == ["malformed record", "missing: order_id"]
    routed = J.route(records(spark), {"sales": schemas.SALES, "activities": schemas.ACTIVITIES})
    assert routed["activities"].first()["activity_id"] == "a1" and routed["sales"].count() == 3


def test_messages_round_trip(spark):
    df = spark.createDataFrame([("o1", 2.5)], "order_id string, amount double")
    msg = writers.as_messages(df, "order_id").first()
    assert msg["key"] == "o1" and json.loads(msg["value"]) == {"order_id": "o1", "amount": 2.5}


def test_static_side_joins_a_stream(spark, tmp_path):
    from tillroll.operators.joins import enrich_stream
    src = tmp_path / "in"
    write_file(src, "1.json", [event(1, "2024-01-01 10:00:00"), event(2, "2024-01-01 10:01:00", customer="zz")])
    dim = spark.createDataFrame([("c1", "VIP", True), ("c1", "old", False)], "customer_id string, segment string, is_current boolean")
    run(enrich_stream(source(spark, src), {"customer_id": dim}), tmp_path, "enriched")
    assert {r["event_id"]: r["segment"] for r in spark.read.parquet(f"{tmp_path}/enriched").collect()} == {"e1": "VIP", "e2": None}


def test_a_batch_rewrites_only_its_buckets_and_old_versions_go(spark, tmp_path):
    folder = f"{tmp_path}/state"
    sink = J.upsert_sink(folder, ["k"], ["t"], buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, t int")
    sink(frame([(k, "a", 1) for k in range(100)]), 0)
    for n in (1, 2):
        sink(frame([(7, f"v{n}", 1 + n)]), n)
    dirs = {v.name: sorted(b.name for b in v.iterdir() if b.name.startswith("_bucket=")) for v in (tmp_path / "state").iterdir()}
    assert len(dirs["version=000000"]) == 7 and len(dirs["version=000001"]) == len(dirs["version=000002"]) == 1
    got = {r["k"]: r["v"] for r in J.read_latest(spark, folder).collect()}
    assert len(got) == 100 and got[7] == "v2" and set(got.values()) == {"a", "v2"}


def test_an_emptied_bucket_stays_empty(spark, tmp_path):
    folder = f"{tmp_path}/cdc"
    sink = J.changes_sink(folder, ["k"], ["k", "v"], buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, op string, lsn int")
    sink(frame([(k, "a", "I", 1) for k in range(6)]), 0)
    sink(frame([(k, None, "D", 2) for k in range(6)]), 1)
    assert J.read_latest(spark, folder) is None
    sink(frame([(1, "b", "I", 3)]), 2)
    assert [tuple(r) for r in J.read_latest(spark, folder).collect()] == [(1, "b")]
