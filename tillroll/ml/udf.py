"""User functions: vectorised scorers, partition functions, SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_scorer(spark: SparkSession, name: str, fn: Callable[[pd.Series], pd.Series], return_type: str = "double"):
    """U-01: register a vectorised scorer for SQL and return it for columns."""
    def scorer(values: pd.Series) -> pd.Series:
        return fn(values)
    udf = F.pandas_udf(scorer, return_type)
    spark.udf.register(name, udf)
    return udf


def by_partition(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """U-02: apply a chunk function to Arrow batches; the input splits are the chunks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def register_sql_functions(spark: SparkSession) -> None:
    """U-07: get_time_key(date) and is_tet_season(date) for SQL text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION get_time_key(d DATE) RETURNS INT RETURN year(d) * 10000 + month(d) * 100 + day(d)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_tet_season(d DATE) RETURNS BOOLEAN RETURN (month(d) = 1 AND day(d) >= 20) OR (month(d) = 2 AND day(d) <= 20)")
