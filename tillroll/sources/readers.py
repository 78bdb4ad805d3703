"""Sources: topics, CSV, JSON, Parquet, JDBC, document directories, incremental reads and tagging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Options of the topic reader: the whole backlog, no cap on a batch, lost records stop the job. Callers pass others.
KAFKA_OPTIONS = {"startingOffsets": "earliest", "failOnDataLoss": "true"}


def kafka_raw(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """SRC-01: the topic's records. Needs the Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.options(**{**KAFKA_OPTIONS, **options}).load()


def parse_topic(records: DataFrame, schema: str, keep_bad: bool = False) -> DataFrame:
    """SRC-01: typed rows with the envelope (topic, partition, offset, timestamp).

    ``records`` has ``value`` and the envelope columns, from the topic or from any other source. A record
    that is no valid JSON gives nulls and, with ``keep_bad``, its text in ``_corrupt_record`` (ST-14).
    """
    target = schema
    options = {"mode": "PERMISSIVE"}
    if keep_bad:
        target = f"{schema}, _corrupt_record STRING"
        options["columnNameOfCorruptRecord"] = "_corrupt_record"
    data = F.from_json(F.col("value").cast("string"), target, options)
    envelope = [F.col(c).alias(f"kafka_{c}") for c in ("topic", "partition", "offset", "timestamp") if c in records.columns]
    return records.select(data.alias("_d"), *envelope).select("_d.*", *[F.col(f"kafka_{c}") for c in ("topic", "partition", "offset", "timestamp") if c in records.columns])


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None, **options: str) -> DataFrame:
    """SRC-02, SRC-03: one or many CSV files; without a schema every column is a string, repaired later by P-21."""
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"').options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(list(paths) if not isinstance(paths, str) else paths)


def rows_per_file(df: DataFrame) -> DataFrame:
    """SRC-03: rows per input file."""
    return df.select(F.col("_metadata.file_path").alias("file_path")).groupBy("file_path").agg(F.count("*").alias("n"))


def latest_file(df: DataFrame) -> DataFrame:
    """SRC-04: rows of the newest file (by modification time, then by path) among those read.

    The times come from the file listing, not from the rows; the filter on a constant path leaves one file to read.
    """
    spark = df.sparkSession
    newest = None
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        at = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
        newest = max(newest or (at, name), (at, name))
    if newest is None:
        return df
    spellings = {newest[1], newest[1].replace("file:///", "file:/", 1), newest[1].replace("file:/", "file:///", 1) if not newest[1].startswith("file:///") else newest[1]}
    return df.where(F.col("_metadata.file_path").isin(*spellings))


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """SRC-05: files that hold one JSON array each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(list(paths) if not isinstance(paths, str) else paths)


def read_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC-06."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def jdbc_options(url: str, table_or_query: str, driver: str, split: tuple[str, int, int, int] | None = None, **properties: str) -> dict[str, str]:
    """SRC-07: options of a JDBC read; ``split`` is (column, lower, upper, partitions) for a parallel read."""
    text = table_or_query.strip()
    out = {"url": url, "driver": driver, "fetchsize": "10000", **properties}
    out["dbtable"] = f"({text}) AS q" if text.lower().startswith(("select", "with")) else text
    if split:
        column, low, high, parts = split
        out.update(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return out


def read_jdbc(spark: SparkSession, **options: str) -> DataFrame:
    """SRC-07: read with the options of :func:`jdbc_options`; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(**options).load()


def read_documents(spark: SparkSession, path: str, schema: StructType | str | None = None, keep_id: bool = False, match: Mapping[str, object] | None = None) -> DataFrame:
    """SRC-08: a document collection stored as JSON lines; ``_id`` is dropped or turned to text."""
    reader = spark.read
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    for key, value in (match or {}).items():
        df = df.where(F.col(key) == F.lit(value))
    if "_id" in df.columns:
        df = df.withColumn("_id", F.col("_id").cast("string")) if keep_id else df.drop("_id")
    return df


def tag_source(df: DataFrame, source: str, extracted_at: str | Column, sample: float | None = None, seed: int = 42) -> DataFrame:
    """SRC-10: adds ``extracted_at`` and ``data_source``; ``sample`` is a sampling operator, off by default."""
    when = F.lit(extracted_at).cast("timestamp_ntz") if isinstance(extracted_at, str) else extracted_at
    out = df.sample(fraction=sample, seed=seed) if sample is not None else df
    return out.withColumn("extracted_at", when).withColumn("data_source", F.lit(source))
