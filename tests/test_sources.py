"""Readers and writers on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tillroll.sources import readers as R
from tillroll.sources import writers as W


@pytest.fixture()
def sales(spark):
    return spark.createDataFrame([(1, "a", "2024-01-05", 10.0), (2, "b", "2024-02-05", 20.0), (3, "a", "2024-02-06", 30.0)], "id int, category string, d string, v double").withColumn(
        "d", F.col("d").cast("timestamp_ntz"))


def test_csv_many_files_counts_and_latest(spark, tmp_path):
    for i, rows in enumerate((["1,x", "2,y"], ["3,\"a, b\""])):
        path = tmp_path / f"f{i}.csv"
        path.write_text("\n".join(["id,name", *rows]))
        os.utime(path, (1700000000 + i * 100, 1700000000 + i * 100))
    df = R.read_csv(spark, [str(tmp_path / "f0.csv"), str(tmp_path / "f1.csv")])
    assert sorted(r["n"] for r in R.rows_per_file(df).collect()) == [1, 2]
    assert [r["name"] for r in R.latest_file(df).collect()] == ["a, b"]
    assert dict(R.read_csv(spark, str(tmp_path / "f0.csv"), "id INT, name STRING").dtypes)["id"] == "int"


def test_json_array_and_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "tags": ["x", "y"]}, {"id": 2, "tags": []}], indent=1))
    assert R.read_json_array(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "docs.json").write_text('{"_id": 5, "kind": "raw", "v": 1}\n{"_id": 6, "kind": "new", "v": 2}')
    docs = R.read_documents(spark, str(tmp_path / "docs.json"), match={"kind": "new"})
    assert docs.columns == ["kind", "v"] and docs.first()["v"] == 2
    assert R.read_documents(spark, str(tmp_path / "docs.json"), keep_id=True).first()["_id"] == "5"


def test_jdbc_options():
    o = R.jdbc_options("jdbc:x", "SELECT * FROM t", "driver", ("id", 0, 100, 4), user="u")
    assert o["dbtable"] == "(SELECT * FROM t) AS q" and o["numPartitions"] == "4" and o["user"] == "u"
    assert R.jdbc_options("jdbc:x", "dim_customer", "driver")["dbtable"] == "dim_customer"


def test_tagging_and_sampling(spark):
    df = spark.range(1000)
    out = R.tag_source(df, "store", "2024-01-01 00:00:00")
    assert out.count() == 1000 and out.first()["data_source"] == "store"
    assert R.tag_source(df, "s", "2024-01-01 00:00:00", sample=0.3).count() == R.tag_source(df, "s", "2024-01-01 00:00:00", sample=0.3).count() < 500


def test_writes_exports_and_partitions(spark, sales, tmp_path):
    p = str(tmp_path)
    W.write_table(sales, f"{p}/t")
    W.write_table(sales, f"{p}/t")
    assert spark.read.parquet(f"{p}/t").count() == 6
    W.write_table(sales, f"{p}/t", "overwrite")
    assert spark.read.parquet(f"{p}/t").count() == 3
    W.export_report(sales, f"{p}/csv")
    W.export_report(sales, f"{p}/json", "json")
    assert R.read_csv(spark, f"{p}/csv").count() == spark.read.json(f"{p}/json").count() == 3
    with pytest.raises(ValueError):
        W.export_report(sales, f"{p}/x", "xlsx")
    W.export_by_category(sales, f"{p}/cat")
    assert sorted(d for d in os.listdir(f"{p}/cat") if d.startswith("category=")) == ["category=a", "category=b"]
    W.write_month_table(sales, f"{p}/months", "d")
    plan = spark.read.parquet(f"{p}/months").where("order_month = '2024-02'")
    assert plan.count() == 2 and "PartitionFilters: [isnotnull(order_month" in plan._jdf.queryExecution().toString()


def test_dynamic_overwrite_touches_only_its_partitions(spark, sales, tmp_path):
    path = f"{tmp_path}/ranks"
    day = sales.withColumn("day", F.date_format("d", "yyyy-MM-dd"))
    W.overwrite_partitions(day, path, ["day"])
    again = day.where("id = 3").withColumn("v", F.lit(99.0))
    for _ in range(2):
        W.overwrite_partitions(again, path, ["day"])
    assert {r["id"]: r["v"] for r in spark.read.parquet(path).collect()} == {1: 10.0, 2: 20.0, 3: 99.0}


def test_append_absent_is_idempotent(spark, sales, tmp_path):
    path = f"{tmp_path}/t"
    W.write_table(sales.where("id < 3"), path)
    for _ in range(2):
        W.append_absent(sales, path, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_backup_and_load_statistics(spark, sales, tmp_path):
    counts = {r["table_name"]: r["n"] for r in W.backup({"sales": sales, "few": sales.where("id = 1")}, f"{tmp_path}/b").collect()}
    assert counts == {"sales": 3, "few": 1}
    holes = sales.withColumn("v", F.when(F.col("id") != 2, F.col("v")))
    row = W.write_with_stats(holes, f"{tmp_path}/l", "sales", "2024-03-01 00:00:00", required=["v"]).first()
    assert (row["attempted"], row["loaded"], round(row["success_pct"], 2)) == (3, 2, 66.67)
    assert W.write_snapshot(sales, f"{tmp_path}/s", 3).endswith("version=000003")
