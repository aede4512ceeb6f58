"""The two windowed jobs over a stored log: speed anomalies and regional rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoylake.functions.scalars import anomaly_id
from convoylake.operators.clock import GRACE_MS, MINUTE_MS, event_clock, open_windows

SPEED_LIMIT = 120.0


def violates(speed: Column) -> Column:
    """Strictly above the limit; NaN does not violate."""
    return (speed > SPEED_LIMIT) & ~F.isnan(speed)


def anomaly_windows(windowed: DataFrame, arrival: str) -> DataFrame:
    """Aggregates of (vehicle, window) rows: violations, their largest speed and the region of the last to arrive."""
    v = violates(F.col("speed_kph"))
    return windowed.groupBy("part", "vehicle_id", "window_start", "window_end").agg(
        F.count_if(v).alias("violations"), F.max(F.when(v, F.col("speed_kph"))).alias("value"), F.max(F.when(v, F.struct(arrival, "region"))).getField("region").alias("region")
    )


def anomalies_of(windows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Anomaly rows of windows with at least one violation, and the windows' columns to keep."""
    return windows.where("violations >= 1").select(anomaly_id(F.col("vehicle_id"), F.col("window_start")).alias("anomaly_id"), "vehicle_id", "region", F.lit("SPEED_THRESHOLD").alias("kind"), "value", F.lit(1).alias("detector_version"), "window_start", "window_end", *keep)


def speed_anomalies(events: DataFrame, arrival: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """Closed five-minute windows by one minute, by vehicle, with a speed above the limit; clocks by log partition.

    Every event moves the clock, but only violations show in the result, so only they are dealt to
    windows; the last clock of a partition comes with the clock itself. The log is read twice: for the
    clock's buckets and for its rows. An id names a vehicle and a window: where vehicles of two partitions
    have one name, only ``part`` (which may be kept) tells their anomalies apart.
    """
    clocked = event_clock(events.where("occurred_at is not null"), "part", arrival, final="final")
    windowed = open_windows(clocked.where(violates(F.col("speed_kph"))), 5 * MINUTE_MS, MINUTE_MS)
    shut = windowed.where(F.col("window_end") + GRACE_MS <= F.col("final"))
    return anomalies_of(anomaly_windows(shut, arrival), keep)


def rollup_windows(windowed: DataFrame, arrival: str = "seq") -> DataFrame:
    """Aggregates of (region, window) rows; repeated events count as often as they arrive.

    Speeds are added in the order of arrival, as the live job does: sums of doubles depend on the order in their
    last digits, and means that are a half in the last digit shown would differ from run to run. The running sum is
    made over sorted rows, so a window is never held as a whole.
    """
    active = F.col("status") == "ACTIVE"
    so_far = Window.partitionBy("region", "window_start", "window_end").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    summed = windowed.withColumns({"_sum": F.sum(F.when(active, F.col("speed_kph"))).over(so_far), "_at": F.count("*").over(so_far)})
    total, n = F.max_by("_sum", "_at"), F.count(F.when(active, F.col("speed_kph")))
    return summed.groupBy("region", "window_start", "window_end").agg(
        F.count("*").alias("event_count"), F.count_distinct(F.when(active, F.col("vehicle_id"))).cast("int").alias("active_vehicles"), F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("avg_speed_kph")
    )


def region_rollups(events: DataFrame) -> DataFrame:
    """Closed one-minute windows by region; clocks by region in live arrival order."""
    clocked = event_clock(events.where("occurred_at is not null"), "region", "seq", final="final")
    windowed = open_windows(clocked, MINUTE_MS, MINUTE_MS).where(F.col("window_end") + GRACE_MS <= F.col("final"))
    return rollup_windows(windowed)
