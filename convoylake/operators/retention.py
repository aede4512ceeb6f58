"""Event history in hourly partitions, and the job that deletes what is older than a day.

Whole hours before the boundary go as folders, without a row being read but for their count, which Parquet
footers have. Only the boundary's own hour is rewritten: what stays of it is staged first and then put in
its place by a dynamic partition overwrite, so no other hour is touched and a run that stops on the way can
be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.operators.projections import DAY_MS
from convoylake.sources.stored import folders, new_folder, remove

HOUR_MS = 3_600_000


def write_history(history: DataFrame, path: str, mode: str = "append") -> None:
    """Adds history rows to a folder by hour of their event time; rows without a time have a partition of their own.

    Rows are dealt by hour and a hash of the event, so that an hour with very many events is several files.
    """
    hour = F.floor(F.col("occurred_at") / HOUR_MS).cast("bigint")
    history.withColumn("hour", hour).hint("rebalance", "hour").write.mode(mode).partitionBy("hour").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The history's rows; none if nothing was written yet. ``schema``: its columns without the hour."""
    if not folders(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, hour bigint").parquet(path).drop("hour")


def expire(spark: SparkSession, path: str, as_of_ms: int, enabled: bool = True, keep_ms: int = DAY_MS) -> int:
    """Deletes the rows with ``occurred_at < as_of - keep`` and returns their number; nothing when switched off.

    Rows at the boundary and rows without a time stay.
    """
    hours = {int(name.removeprefix("hour=")) for name in folders(spark, path) if name.removeprefix("hour=").lstrip("-").isdigit()}
    if not enabled or not hours:
        return 0
    cutoff = as_of_ms - keep_ms
    edge = cutoff // HOUR_MS
    rows = spark.read.option("basePath", path)
    old = sorted(h for h in hours if h < edge)
    deleted = rows.parquet(*[f"{path}/hour={h}" for h in old]).count() if old else 0
    if edge in hours:
        hour = rows.parquet(f"{path}/hour={edge}")
        gone = hour.where(F.col("occurred_at") < cutoff).count()
        left = hour.where(F.col("occurred_at") >= cutoff)
        if gone and left.isEmpty():
            old.append(edge)
        elif gone:
            staged = new_folder(spark, "retention")
            left.write.parquet(staged)
            again = spark.read.schema(left.schema).parquet(staged)
            again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(path)
            remove(spark, staged)
        deleted += gone
    for h in old:
        remove(spark, f"{path}/hour={h}")
    return deleted


def retention_job(spark: SparkSession, path: str, checkpoint: str, enabled: bool = True, every: str = "1 hour", done=None):
    """A running query that expires the history when it starts and then every hour; ``done`` is called with each number of deleted rows."""

    def once(batch: DataFrame, number: int) -> None:
        now = batch.sparkSession.range(1).select(F.unix_millis(F.current_timestamp())).first()[0]
        n = expire(batch.sparkSession, path, now, enabled)
        if done is not None:
            done(n)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
