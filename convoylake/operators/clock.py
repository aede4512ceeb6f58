"""Stream clocks over stored logs, and the windows that they open and close.

A running value over a whole partition or region would put each of those few keys into one task. Rows
are therefore cut into buckets of the order column: windows run inside (key, bucket), and what earlier
buckets contribute is a prefix over one small row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in units of the order column.
BUCKET = 200_000
MINUTE_MS, GRACE_MS = 60_000, 30_000


def _bucketed(df: DataFrame, key: str, order: str, total: Column, prefix: Column, width: int) -> tuple[DataFrame, DataFrame]:
    df = df.withColumn("_bucket", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, "_bucket").agg(total.alias("_total")).select(key, "_bucket", prefix.over(earlier).alias("_before"))
    return df, sums


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = BUCKET) -> DataFrame:
    """Adds ``name``: the row's number from 0 within its key by the order column."""
    df, sums = _bucketed(df, key, order, F.count("*"), F.sum("_total"), width)
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order)) - 1
    return df.withColumn("_inside", inside).join(sums, [key, "_bucket"]).withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_bucket", "_inside", "_before")


def event_clock(df: DataFrame, key: str, order: str, time: str = "occurred_at", width: int = BUCKET, final: str | None = None) -> DataFrame:
    """Adds ``clock``: the largest event time so far in the key's arrival order, the row's own included; and, as ``final`` if named, the key's last clock."""
    df = df.withColumn("_bucket", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = [] if final is None else [F.max("_total").over(Window.partitionBy(key)).alias(final)]
    # a small row a bucket, so the prefix over a key is short and Spark can broadcast it
    sums = df.groupBy(key, "_bucket").agg(F.max(time).alias("_total")).select(key, "_bucket", F.max("_total").over(earlier).alias("_before"), *last)
    inside = F.max(time).over(Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_inside", inside).join(sums, [key, "_bucket"]).withColumn("clock", F.greatest("_inside", "_before")).drop("_bucket", "_inside", "_before")


def hopping_starts(time: str, size_ms: int, hop_ms: int) -> Column:
    """Starts of the windows [start, start + size) that hold the event time."""
    last = F.floor(F.col(time) / hop_ms) * hop_ms
    return F.array(*[(last - k * hop_ms).cast("bigint") for k in range(size_ms // hop_ms)])


def open_windows(df: DataFrame, size_ms: int, hop_ms: int, grace_ms: int = GRACE_MS) -> DataFrame:
    """A row for each event and window that still takes it: window end after the clock less the grace; needs ``clock``."""
    starts = hopping_starts("occurred_at", size_ms, hop_ms)
    out = df.withColumn("window_start", F.explode(starts) if size_ms > hop_ms else starts[0]).withColumn("window_end", F.col("window_start") + size_ms)
    return out.where(F.col("window_end") > F.col("clock") - grace_ms)


def closed_windows(windows: DataFrame, events: DataFrame, key: str, grace_ms: int = GRACE_MS) -> DataFrame:
    """The windows that the key's final clock has closed: end plus grace not after it."""
    final = events.groupBy(key).agg(F.max("occurred_at").alias("_final"))
    return windows.join(final, key).where(F.col("window_end") + grace_ms <= F.col("_final")).drop("_final")
