"""Read-model tables as folds of the log: which arrival wins is part of each table's meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def vehicles_current(events: DataFrame) -> DataFrame:
    """Region and status of the latest event (of equal times the later arrival), and the largest time."""
    best = F.max_by(F.struct("region", "status"), F.struct("occurred_at", "seq"))
    return events.groupBy("vehicle_id").agg(best.alias("b"), F.max("occurred_at").alias("last_seen")).select(F.col("vehicle_id").alias("id"), "b.region", "b.status", "last_seen")


def positions_current(events: DataFrame, swap_coordinates: bool = False) -> DataFrame:
    """The position of the latest event (of equal times the earlier arrival), a null battery included."""
    lat, lon = ("lon", "lat") if swap_coordinates else ("lat", "lon")
    payload = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"), "speed_kph", "heading_deg", F.col("occurred_at").alias("updated_at"), "battery_pct")
    return events.groupBy("vehicle_id").agg(F.max_by(payload, F.struct("occurred_at", -F.col("seq"))).alias("b")).select("vehicle_id", "b.*")


def vehicle_states(events: DataFrame) -> DataFrame:
    """Vehicles with their positions in one fold: what ``vehicles_current`` and ``positions_current`` give, joined by vehicle."""
    seen = F.max_by(F.struct("region", "status"), F.struct("occurred_at", "seq"))
    place = F.max_by(F.struct("lat", "lon", "speed_kph", "heading_deg", F.col("occurred_at").alias("updated_at"), "battery_pct"), F.struct("occurred_at", -F.col("seq")))
    rows = events.groupBy(F.col("vehicle_id").alias("id")).agg(seen.alias("v"), F.max("occurred_at").alias("last_seen"), place.alias("p"))
    return rows.select("id", "v.*", "last_seen", "p.*")


def event_history(events: DataFrame, arrival: str = "seq", swap_coordinates: bool = False) -> DataFrame:
    """The first arrival of each event id."""
    lat, lon = ("lon", "lat") if swap_coordinates else ("lat", "lon")
    payload = F.struct("vehicle_id", F.col(lat).alias("lat"), F.col(lon).alias("lon"), "speed_kph", "occurred_at")
    return events.groupBy("event_id").agg(F.min_by(payload, F.struct(arrival)).alias("b")).select("event_id", "b.*")


def last_arrival(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The last arrival of each key, every other column overwritten."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("b")).select(*keys, *[f"b.{c}" for c in rest if c != arrival])


def offsets_current(events: DataFrame) -> DataFrame:
    return events.groupBy("part").agg(F.max("off").alias("last_offset"))


def retained(history: DataFrame, as_of_ms: int) -> DataFrame:
    """History without what is more than 24 hours older than ``as_of``."""
    return history.where(F.col("occurred_at") >= as_of_ms - DAY_MS)
