"""Sinks: tables, exports, partition overwrite, retention, backup and load statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillroll.functions.numbers import pct
from tillroll.operators import load


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """SNK-05: append to or replace a Parquet table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_month_table(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Fact table partitioned by month, so date filters prune directories."""
    df.withColumn("order_month", F.date_format(ts, "yyyy-MM")).write.mode(mode).partitionBy("order_month").parquet(path)


def export_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """SNK-06."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown report format {kind}")


def export_by_category(df: DataFrame, path: str, category: str = "category") -> None:
    """SNK-07: one directory per category. A large category is written by several tasks, one file each."""
    df.write.mode("overwrite").option("header", True).partitionBy(category).csv(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """SNK-11: replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_absent(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """SNK-09: append the rows whose key the table does not hold."""
    target = rows.sparkSession.read.parquet(path)
    load.insert_absent(target, rows, keys).write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """SNK-10: a new version of a table in its own directory, so the version being read stays intact."""
    path = f"{folder}/version={version:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def backup(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """SNK-13: copy named tables; rows per table are observed while writing, not counted again."""
    counts = []
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
        counts.append((name, seen.get["n"], f"{folder}/{name}"))
    return spark.createDataFrame(counts, "table_name string, n bigint, path string")


def write_with_stats(df: DataFrame, path: str, table: str, loaded_at: str, mode: str = "append", required: Sequence[str] = ()) -> DataFrame:
    """SNK-14: write the rows with all required fields and return the load statistics row."""
    spark = df.sparkSession
    seen, kept = Observation(), Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    good = rows.dropna(subset=list(required)) if required else rows
    good.observe(kept, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    row = spark.createDataFrame([(table, loaded_at, seen.get["n"], kept.get["n"])], "table_name string, loaded_at string, attempted bigint, loaded bigint")
    return row.withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz")).withColumn("success_pct", pct(F.col("loaded"), F.col("attempted"), 0))


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """SNK-04: rows as topic messages: ``key`` and the whole row as JSON ``value``."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)
