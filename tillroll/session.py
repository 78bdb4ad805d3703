"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Limits of any size on row numbers are taken in each task before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    # Pinned tables are removed once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tillroll", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow exchange."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = _LOCAL_FOLDERS.get(spark.sparkContext.applicationId)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="tillroll-")
        _LOCAL_FOLDERS[spark.sparkContext.applicationId] = folder
    return folder


_LOCAL_FOLDERS: dict[str, str] = {}


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from there.

    Used where later steps read the same rows more than once and must see the same physical
    order (range slices), and between rounds of an iteration. Survives the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Spark removes shuffle files of finished plans when the driver's garbage is collected; asked for between phases so that they don't pile up."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
