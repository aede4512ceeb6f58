"""Vehicle-event schemas and the view that binds the ``events`` table to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_V1 = "event_id string, vehicle_id string, region string, lat double, lon double, speed_kph double, heading_deg double, status string, occurred_at bigint"
EVENT_V2 = "event_id string, vehicle_id string, region string, lat double, lon double, speed_kph double, heading_deg double, battery_pct double, status string, occurred_at bigint"
ANOMALY = "anomaly_id string, vehicle_id string, region string, kind string, value double, detector_version int, window_start bigint, window_end bigint"
ROLLUP = "region string, window_start bigint, window_end bigint, event_count bigint, active_vehicles int, avg_speed_kph double"

#: Region boxes (code, smallest and largest latitude, smallest and largest longitude).
REGIONS = (("SEA", 47.5, 47.7, -122.44, -122.24), ("SFO", 37.7, 37.82, -122.52, -122.35), ("NYC", 40.68, 40.88, -74.05, -73.85), ("AUS", 30.2, 30.4, -97.85, -97.65))
STATUSES = ("ACTIVE", "IDLE", "OFFLINE")
PARTITIONS = 6
EPOCH_MS = 1704067200000

#: The same view for DuckDB, as common table expressions.
FLEET_SQL = f"""
raw AS (SELECT *, 0 AS copy FROM events UNION ALL SELECT *, 1 FROM events WHERE event_id % 100 = 3),
timed AS (SELECT *, {EPOCH_MS} + (epoch_us(ts) - {EPOCH_MS}000) // 60000 AS base_ms FROM raw),
fleet AS (
  SELECT event_id, copy, 'veh-' || lpad(CAST(user_id + 1 AS VARCHAR), 4, '0') AS vehicle_id,
    CASE user_id % 4 WHEN 0 THEN 'SEA' WHEN 1 THEN 'SFO' WHEN 2 THEN 'NYC' ELSE 'AUS' END AS region,
    CASE user_id % 4 WHEN 0 THEN 47.5 WHEN 1 THEN 37.7 WHEN 2 THEN 40.68 ELSE 30.2 END::DOUBLE + (event_id % 100)::DOUBLE / 1000 AS lat,
    CASE user_id % 4 WHEN 0 THEN -122.44 WHEN 1 THEN -122.52 WHEN 2 THEN -74.05 ELSE -97.85 END::DOUBLE + (event_id % 97)::DOUBLE / 1000 AS lon,
    value AS speed_kph, CAST((event_id * 37) % 360 AS DOUBLE) AS heading_deg,
    CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS battery_pct,
    CASE event_type WHEN 'signup' THEN 'IDLE' WHEN 'error' THEN 'OFFLINE' ELSE 'ACTIVE' END AS status,
    base_ms - CASE WHEN event_id % 50 = 7 THEN (120 + event_id % 481) * 1000 WHEN event_id % 50 IN (11, 36) THEN (event_id % 25) * 1000 ELSE 0 END AS occurred_at,
    CAST(user_id % {PARTITIONS} AS INTEGER) AS part, event_id * 2 + copy AS seq,
    row_number() OVER (PARTITION BY user_id % {PARTITIONS} ORDER BY event_id, copy) - 1 AS off
  FROM timed)
"""


def per_region(*values: float, key: Column | None = None) -> Column:
    """One value for each region, in their order, by ``user_id`` or a key from 0 to 3."""
    pick = F.col("user_id") % 4 if key is None else key
    out = F.lit(values[3])
    for k in (2, 1, 0):
        out = F.when(pick == k, F.lit(values[k])).otherwise(out)
    return out


def fleet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle events with their log partition (``part``) and their place in live arrival order (``seq``): one scan, no shuffle."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("copy", F.explode(F.when(F.col("event_id") % 100 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    e = F.col("event_id")
    base = F.expr(f"{EPOCH_MS} + (unix_micros(cast(ts as timestamp)) - {EPOCH_MS}000) div 60000")
    late = F.when(e % 50 == 7, (120 + e % 481) * 1000).when((e % 50).isin(11, 36), (e % 25) * 1000).otherwise(0)
    return events.select(
        "event_id", "copy", F.concat(F.lit("veh-"), F.lpad((F.col("user_id") + 1).cast("string"), 4, "0")).alias("vehicle_id"), per_region(*(r[0] for r in REGIONS)).alias("region"),
        (per_region(*(r[1] for r in REGIONS)) + (e % 100).cast("double") / 1000).alias("lat"), (per_region(*(r[3] for r in REGIONS)) + (e % 97).cast("double") / 1000).alias("lon"),
        F.col("value").alias("speed_kph"), ((e * 37) % 360).cast("double").alias("heading_deg"), F.when(e % 3 != 0, F.get_json_object("props", "$.k").cast("double")).alias("battery_pct"),
        F.when(F.col("event_type") == "signup", "IDLE").when(F.col("event_type") == "error", "OFFLINE").otherwise("ACTIVE").alias("status"),
        (base - late).alias("occurred_at"), (F.col("user_id") % PARTITIONS).cast("int").alias("part"), (e * 2 + F.col("copy")).alias("seq"),
    )


def fleet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fleet_rows`` with ``off``, their offset in the log partition. Within a partition offsets and ``seq`` order alike, so only what shows or compares offsets needs it."""
    from convoylake.operators.clock import numbered

    return numbered(fleet_rows(spark, sf_dir), "part", "seq", "off")


def reader_projection(df: DataFrame, version: int) -> DataFrame:
    """Events under a reader's schema version: missing nullable columns are null, columns of later versions are left out."""
    names = [f.strip().split(" ")[0] for f in (EVENT_V1 if version == 1 else EVENT_V2).split(",")]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names])


def fully_compatible(old: dict[str, dict], new: dict[str, dict]) -> list[str]:
    """Why two schema versions (name -> {type, default?}) are not compatible both ways; empty if they are."""
    out = [f"{n}: type differs" for n in old.keys() & new.keys() if old[n]["type"] != new[n]["type"]]
    return sorted(out + [f"{n}: no default" for n in old.keys() ^ new.keys() if "default" not in (old.get(n) or new.get(n))])
