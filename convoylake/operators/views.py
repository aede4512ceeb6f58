"""Client-side view operators: merging feeds, latest values, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIVE_MINUTES_MS = 300_000
VISIBLE = 200


def patch_movements(vehicles: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """Vehicles moved by the latest event of each (later input wins ties), if it is not older than their position; unknown vehicles are ignored."""
    latest = events.groupBy(F.col("vehicle_id").alias("id")).agg(F.max_by(F.struct("lat", "lon", "speed_kph", F.col("occurred_at").alias("at")), F.struct("occurred_at", order)).alias("e"))
    newer = F.col("e.at") >= F.col("updated_at")
    moved = {c: F.when(newer, F.col(f"e.{s}")).otherwise(F.col(c)) for c, s in (("lat", "lat"), ("lon", "lon"), ("speed_kph", "speed_kph"), ("updated_at", "at"))}
    return vehicles.join(latest, "id", "left").withColumns(moved).drop("e")


def merge_refresh(current: DataFrame, refreshed: DataFrame) -> DataFrame:
    """The refreshed vehicles; a strictly newer local position stays, with the refreshed battery."""
    local = current.select("id", F.struct("lat", "lon", "speed_kph", "heading_deg", "updated_at").alias("p"))
    newer = F.col("p.updated_at") > F.col("updated_at")
    return refreshed.join(local, "id", "left").withColumns({c: F.when(newer, F.col(f"p.{c}")).otherwise(F.col(c)) for c in ("lat", "lon", "speed_kph", "heading_deg", "updated_at")}).drop("p")


def merge_anomalies(current: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("anomaly_id",)) -> DataFrame:
    """Both lists by id, incoming rows winning, newest window end first. More ``keys`` where an id alone is not one anomaly."""
    both = current.withColumn("_rank", F.lit(0)).unionByName(incoming.withColumn("_rank", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_rank").alias("b")).select(*[c if c in keys else f"b.{c}" for c in current.columns])
    return merged.orderBy(F.desc("window_end"), *[F.desc(c) for c in keys])


def anomalous_vehicles(anomalies: DataFrame, now_ms: int) -> DataFrame:
    """Vehicles with a window that ended in the last five minutes, both ends included."""
    return anomalies.where(F.col("window_end").between(now_ms - FIVE_MINUTES_MS, now_ms)).select("vehicle_id").distinct()


def visible_anomalies(anomalies: DataFrame, order: str, limit: int = VISIBLE) -> DataFrame:
    """The newest by window end, stable on input order, unknown times last (a top-k report)."""
    return anomalies.orderBy(F.desc_nulls_last("window_end"), order).limit(limit)


def merge_visible(visible: DataFrame, incoming: DataFrame, limit: int = VISIBLE, keys: tuple[str, ...] = ("anomaly_id",)) -> DataFrame:
    """The first ``limit`` rows of ``merge_anomalies``, from a list that was cut to them before.

    That is exact as long as the window end of an id on the list does not go back (an id names its window), as
    only then a row that was cut could be among them again; an incoming row that takes one back is an error.
    The list has at most ``limit`` rows, so it is broadcast.
    """
    held = F.broadcast(visible.select(*keys, F.col("window_end").alias("_held")))
    back = F.col("_held").isNotNull() & (F.col("window_end").isNull() | (F.col("window_end") < F.col("_held")))
    error = F.raise_error(F.concat(F.lit("window end goes back: "), F.col("anomaly_id"))).cast("bigint")
    checked = incoming.join(held, list(keys), "left").withColumn("window_end", F.when(back, error).otherwise(F.col("window_end"))).select(incoming.columns)
    return merge_anomalies(visible, checked, keys).limit(limit)


def latest_rollups(rollups: DataFrame) -> DataFrame:
    """The rollup with the largest window end of each region; of equal ends the first by start."""
    rest = [c for c in rollups.columns if c != "region"]
    return rollups.groupBy("region").agg(F.max_by(F.struct(*rest), F.struct("window_end", -F.col("window_start"))).alias("b")).select("region", *[f"b.{c}" for c in rest])


def dashboard_rollups(rollups: DataFrame, regions: list[str], now_ms: int) -> DataFrame:
    """For each region the latest rollup that started in the last five minutes, or nulls."""
    names = rollups.sparkSession.createDataFrame([(r,) for r in regions], "region string")
    recent = rollups.where(F.col("window_start").between(now_ms - FIVE_MINUTES_MS, now_ms))
    return names.join(latest_rollups(recent), "region", "left")


def geojson_features(vehicles: DataFrame, anomalous: DataFrame) -> DataFrame:
    """Each vehicle as the JSON text of a GeoJSON feature."""
    flagged = vehicles.join(anomalous.select(F.col("vehicle_id").alias("id"), F.lit(True).alias("flag")), "id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    properties = F.struct(F.col("flag").alias("anomalous"), "id", "region", "status")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("lon").cast("decimal(9,3)"), F.col("lat").cast("decimal(9,3)")).alias("coordinates"))
    return flagged.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), "id", point.alias("geometry"), properties.alias("properties"))).alias("feature"))
