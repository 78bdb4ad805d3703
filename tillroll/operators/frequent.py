"""The most frequent items, exactly, without moving all items: counters that add up, then a recount of what they leave open.

A first pass counts rows in ``buckets`` counters, chosen by a hash of the item. Counters of tasks add up, so at most ``buckets`` rows leave a task, whatever the number
of items. A counter is an upper bound for every item that falls into it. A second pass counts the items of the largest counters one by one; the k-th of these
counts is a lower bound for the k-th of all. If a counter that was left out reaches it, a third pass counts the items of all counters that do. No item is lost, also
where few counters hold many items: then more items are recounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import pin


def counters(df: DataFrame, item: str, buckets: int) -> DataFrame:
    """bucket, rows: the counters of the items that are not null."""
    return df.where(F.col(item).isNotNull()).groupBy(_bucket(item, buckets).alias("bucket")).agg(F.count("*").alias("rows"))


def most_frequent(df: DataFrame, item: str, k: int, name: str = "n", buckets: int = 1 << 18, first: int = 32) -> DataFrame:
    """T-05, D-36: the ``k`` most frequent values of ``item`` with their counts, ties by the smaller value; nulls don't count.

    ``df`` is read two or three times and must give the same rows each time. ``first * k`` counters are recounted in the second pass.
    """
    sizes = pin(counters(df, item, buckets))
    head = sizes.orderBy(F.desc("rows"), "bucket").limit(first * k + 1).collect()
    rows = df.where(F.col(item).isNotNull())
    best = pin(_count(rows.where(_bucket(item, buckets).isin([r["bucket"] for r in head[: first * k]])), item, k, name))
    if len(head) <= first * k:
        return best.orderBy(F.desc(name), item)
    kth = best.agg(F.when(F.count("*") == k, F.min(name)).otherwise(0)).first()[0]
    if head[-1]["rows"] < kth:
        return best.orderBy(F.desc(name), item)
    # At most ``buckets`` numbers: eight bytes each.
    open_ = sizes.where(F.col("rows") >= kth).select(F.col("bucket").alias("_bucket"))
    return _count(rows.join(F.broadcast(open_), _bucket(item, buckets) == F.col("_bucket"), "left_semi"), item, k, name)


def _bucket(item: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(buckets))


def _count(rows: DataFrame, item: str, k: int, name: str) -> DataFrame:
    return rows.groupBy(item).agg(F.count("*").alias(name)).orderBy(F.desc(name), item).limit(k)
