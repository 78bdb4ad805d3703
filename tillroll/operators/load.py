"""Load patterns: insert-if-absent, upsert, slowly changing dimension, change feed, retention.

Each returns the new table contents as a DataFrame; ``tillroll.sources.writers`` stores it. Plain Parquet
cannot be overwritten while it is read, so a snapshot goes to a new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """W-05: last row per key by ``order``; ``max_by`` combines on the map side, a window would not."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK-09: rows whose key the target does not hold, one per key."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else rows.distinct()
    return one.select(*rows.columns).join(target.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (),
           counter: str | None = None) -> DataFrame:
    """SNK-10: new snapshot after ON CONFLICT DO UPDATE; ``counter`` grows by one on each update.

    With ``order`` a row older than the stored one does not overwrite it (nor count), so late batches do no harm.
    """
    if order:
        rows = newest_per_key(rows, keys, order)
    values = [c for c in target.columns if c not in keys and c != counter]
    new = rows.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in values if c in rows.columns])
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, list(keys), "full_outer")
    known = [c for c in order if c in values and c in rows.columns]
    late = F.lit(False)
    if known:
        late = F.coalesce(F.col("_old") & F.col("_new") & (F.struct(*[F.col(f"_n_{c}") for c in known]) < F.struct(*known)), F.lit(False))
    takes = F.col("_new") & ~late
    out = [F.col(k) for k in keys]
    for c in values:
        out.append((F.when(takes, F.col(f"_n_{c}")).otherwise(F.col(c)) if c in rows.columns
                    else F.col(c)).alias(c))
    if counter:
        bump = F.when(takes & F.col("_old"), 1).otherwise(0)
        out.append((F.coalesce(counter, F.lit(0)) + bump).cast("bigint").alias(counter))
    return both.select(*out)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], op: str = "op",
                  order: str = "lsn") -> DataFrame:
    """ST-16: last change per key decides; ``I``/``U`` writes the row, ``D`` removes it."""
    last = newest_per_key(changes, keys, [order])
    kept = target.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where(F.col(op) != "D").select(*target.columns))


def scd2_merge(dim: DataFrame, snapshot: DataFrame, key: str, tracked: Sequence[str], day: str) -> DataFrame:
    """J-12: close the current row of a changed key the day before, insert its new version and unseen keys.

    A key that changes again on the day its current row began has that row replaced: a version of no day cannot be found by any date.

    ``dim`` has key, tracked columns, effective_date, expiry_date, is_current. Keys missing from the
    snapshot stay current. One full outer join on the key; closed rows are passed through.
    """
    today = F.lit(day).cast("date")
    history = dim.where(~F.col("is_current"))
    live = dim.where("is_current").withColumn("_old", F.lit(True))
    new = snapshot.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in tracked])
    both = live.join(new, key, "full_outer")
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    changed = F.col("_old") & F.col("_new") & ~same
    changed = F.coalesce(changed, F.lit(False))
    open_new = changed | F.col("_old").isNull()
    replaced = changed & (F.col("effective_date") >= today)
    old_row = F.struct(*[F.col(c) for c in tracked], F.col("effective_date"),
                       F.when(changed, F.date_sub(today, 1)).otherwise(F.col("expiry_date")).alias("expiry_date"),
                       (~changed).alias("is_current"))
    new_row = F.struct(*[F.col(f"_n_{c}").alias(c) for c in tracked], today.alias("effective_date"),
                       F.lit(None).cast("date").alias("expiry_date"), F.lit(True).alias("is_current"))
    versions = F.filter(F.array(F.when(F.col("_old") & ~F.coalesce(replaced, F.lit(False)), old_row), F.when(open_new, new_row)), lambda r: r.isNotNull())
    rows = both.select(key, F.explode(versions).alias("_v")).select(key, "_v.*")
    return history.select(*rows.columns).unionByName(rows)


def newer_than(df: DataFrame, ts: str, loaded_until: Column | str | None) -> DataFrame:
    """SRC-09: rows newer than the last loaded timestamp (default 1900-01-01), pushed to the scan."""
    if loaded_until is None:
        loaded_until = "1900-01-01 00:00:00"
    limit = F.lit(loaded_until).cast("timestamp_ntz") if isinstance(loaded_until, str) else loaded_until
    return df.where(F.col(ts) > limit)


def retain(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """SNK-12: rows not older than ``days`` before ``as_of``."""
    return df.where(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAY"))


def replace_partition(table: DataFrame, rows: DataFrame, partition: str, values: Sequence[object]) -> DataFrame:
    """SNK-11: contents after delete-then-insert of the given partitions."""
    return table.where(~F.col(partition).isin(*values)).unionByName(rows.where(F.col(partition).isin(*values)))


def export_rows(df: DataFrame, ts: str, start: str, end: str, limit: int, key: str) -> DataFrame:
    """SNK-08: newest rows of a date range; the limit is the feature."""
    rows = df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) <= F.lit(end).cast("timestamp_ntz")))
    return rows.orderBy(F.desc(ts), F.desc(key)).limit(limit)


