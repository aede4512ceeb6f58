"""Decoding checks of raw records: each gives the row with ``reason``, null where the record is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(checks: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), why).otherwise(out)
    return out


def _number(c: str) -> Column:
    x = F.col(c)
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def coerce_events(raw: DataFrame) -> DataFrame:
    """Vehicle events with text times; a missing battery is fine, one that is not finite is not."""
    battery = F.col("battery_pct").isNotNull() & (F.isnan("battery_pct") | (F.abs("battery_pct") == float("inf")))
    texts = [(F.col(c).isNull(), c) for c in ("vehicle_id", "region", "status")]
    numbers = [(_number(c), c) for c in ("lat", "lon", "speed_kph", "heading_deg")]
    return raw.withColumn("reason", _first([*texts, *numbers, (battery, "battery_pct"), (~F.col("occurred_text").rlike(r"^-?\d+$"), "occurred_at")])).withColumn("occurred_at", F.expr("try_cast(occurred_text as bigint)"))


def coerce_anomalies(raw: DataFrame) -> DataFrame:
    return raw.withColumn("reason", _first([(F.col(c).isNull(), c) for c in ("anomaly_id", "vehicle_id", "region")] + [(~F.col("kind").isin("SPEED_THRESHOLD", "SPEED_ZSCORE"), "kind"), (_number("value"), "value"), (F.col("window_start").isNull(), "window_start")]))


def coerce_rollups(raw: DataFrame) -> DataFrame:
    """Rollups with text counts: whole numbers only."""
    return raw.withColumn("reason", _first([(F.col("region").isNull(), "region"), (~F.col("count_text").rlike(r"^-?\d+$"), "event_count"), (_number("avg_speed_kph"), "avg_speed_kph")])).withColumn("event_count", F.expr("try_cast(case when count_text rlike '^-?[0-9]+$' then count_text end as bigint)"))


INT32 = (-(1 << 31), (1 << 31) - 1)


def api_row_checks(rows: DataFrame, enums: dict[str, tuple[str, ...]], ints: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Rows on their way out of the read model: values of their enums, whole numbers of 32 bits, dates that exist."""
    checks = [(~F.col(c).isin(*values), c) for c, values in enums.items()]
    checks += [(~F.col(c).between(*INT32), c) for c in ints]
    # the range of instants that an ISO date can show
    checks += [(F.abs(F.col(c)) > 8_640_000_000_000_000, c) for c in dates]
    return rows.withColumn("reason", _first(checks))


def api_event_map(raw: DataFrame) -> DataFrame:
    """Live events: non-empty texts; times as whole numbers of milliseconds or ISO-8601 texts."""
    whole = F.col("occurred_text").rlike(r"^-?\d+$")
    ms = F.when(whole, F.expr("try_cast(case when occurred_text rlike '^-?[0-9]+$' then occurred_text end as bigint)")).otherwise(F.unix_millis(F.try_to_timestamp("occurred_text")))
    return raw.withColumn("occurred_at", ms).withColumn("reason", _first([(F.coalesce(F.col("vehicle_id"), F.lit("")) == "", "vehicle_id"), (F.coalesce(F.col("region"), F.lit("")) == "", "region"), (_number("speed_kph"), "speed_kph"), (ms.isNull(), "occurred_at")]))


def event_time(records: DataFrame, order: str = "seq", key: str = "part") -> DataFrame:
    """Adds ``event_time``: the record's own, or for a record without one the key's clock so far, 0 at least."""
    from convoylake.operators.clock import event_clock

    return event_clock(records, key, order).withColumn("event_time", F.coalesce("occurred_at", F.greatest(F.lit(0).cast("bigint"), F.coalesce("clock", F.lit(0).cast("bigint"))))).drop("clock")
