"""The query surface over the read model: filters, ranges, lookups, nested results, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_ANOMALIES, RECENT = 500, 20


def _is(column: str, value) -> Column:
    """Equality, or no filter for None; an empty text is a value."""
    return F.lit(True) if value is None else F.col(column) == value


def vehicles_by_region(vehicles: DataFrame, region: str | None = None) -> DataFrame:
    return vehicles.where(_is("region", region)).orderBy("id")


def vehicle_by_id(vehicles: DataFrame, vehicle_id: str) -> DataFrame:
    return vehicles.where(F.col("id") == vehicle_id).limit(1)


def anomalies_since(anomalies: DataFrame, region: str | None = None, since_ms: int | None = None, limit: int = TOP_ANOMALIES) -> DataFrame:
    """Newest first, ``since`` included, at most ``limit`` rows (a top-k report)."""
    rows = anomalies.where(_is("region", region))
    rows = rows if since_ms is None else rows.where(F.col("window_start") >= since_ms)
    return rows.orderBy(F.desc("window_start"), F.desc("anomaly_id")).limit(limit)


def rollups_range(rollups: DataFrame, region: str, from_ms: int, to_ms: int) -> DataFrame:
    """Both ends included, in ascending order."""
    return rollups.where((F.col("region") == region) & F.col("window_start").between(from_ms, to_ms)).orderBy("window_start")


def vehicle_positions_join(vehicles: DataFrame, positions: DataFrame) -> DataFrame:
    """Vehicles with their positions; a vehicle without one is an error."""
    joined = vehicles.join(positions.withColumnRenamed("vehicle_id", "id"), "id", "left")
    return joined.withColumn("updated_at", F.when(F.col("updated_at").isNull(), F.raise_error(F.concat(F.lit("no position for vehicle "), "id")).cast("bigint")).otherwise(F.col("updated_at")))


def recent_events(history: DataFrame, k: int = RECENT) -> DataFrame:
    """The k newest events of each vehicle, ties to larger event ids, with their ``rank``."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k must be a non-negative integer")
    newest = Window.partitionBy("vehicle_id").orderBy(F.desc("occurred_at"), F.desc("event_id"))
    return history.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def requested_events(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Many requests (request_id, vehicle_id, k, since) for newest events, answered in one plan: each request's events with their ``rank``.

    A null k is the usual one, 0 gives no row, a null since is no bound; a negative k fails the query. Requests
    that ask for the same have their answers each, of one scan of the history.
    """
    k = F.coalesce("k", F.lit(RECENT))
    asked = requests.select("request_id", "vehicle_id", F.when(k < 0, F.raise_error(F.lit("k must not be negative")).cast("int")).otherwise(k).alias("k"), "since")
    newest = Window.partitionBy("request_id").orderBy(F.desc("occurred_at"), F.desc("event_id"))
    rows = history.join(asked.where("k > 0"), "vehicle_id").where("since is null or occurred_at >= since")
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= F.col("k")).drop("k", "since")


def vehicle_anomalies(vehicles: DataFrame, anomalies: DataFrame, since_ms: int | None = None) -> DataFrame:
    """All anomalies of each vehicle, newest first, as a list; empty for a vehicle without any."""
    rows = anomalies if since_ms is None else anomalies.where(F.col("window_start") >= since_ms)
    lists = rows.groupBy(F.col("vehicle_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("window_start", "anomaly_id", "value")), asc=False).alias("anomalies"))
    empty = F.expr("cast(array() as array<struct<window_start:bigint,anomaly_id:string,value:double>>)")
    return vehicles.join(lists, "id", "left").withColumn("anomalies", F.coalesce("anomalies", empty))


def vehicles_nested(states: DataFrame, history: DataFrame, anomalies: DataFrame, k: int = RECENT, since_ms: int | None = None) -> DataFrame:
    """Each vehicle (with its position, as ``projections.vehicle_states`` or ``vehicle_positions_join`` give them) with its k newest events and its anomalies."""
    recent = recent_events(history, k).groupBy(F.col("vehicle_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("occurred_at", "event_id", "speed_kph")), asc=False).alias("recent"))
    out = states.join(recent, "id", "left")
    out = out.withColumn("recent", F.coalesce("recent", F.expr("cast(array() as array<struct<occurred_at:bigint,event_id:bigint,speed_kph:double>>)")))
    return vehicle_anomalies(out, anomalies, since_ms)


def align(keys: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """One list of values for each requested key, empty where there are none."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("found"))
    return keys.join(lists, key, "left").withColumn("found", F.coalesce("found", F.array().cast(dict(lists.dtypes)["found"])))
