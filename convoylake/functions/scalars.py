"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of anomaly ids.
ANOMALY_NAMESPACE = "a3c9f2e1-8b47-4d6a-bc19-5e2f7d0a1c34"
#: Colours of the statuses, and of any other.
STATUS_COLOURS = {"ACTIVE": "#16a34a", "IDLE": "#6b7280", "OFFLINE": "#dc2626"}
OTHER_COLOUR = "#6b7280"
KM_PER_DEGREE = 111


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID text of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def anomaly_id(vehicle: Column, window_start: Column) -> Column:
    return uuid5(ANOMALY_NAMESPACE, F.concat_ws("|", vehicle, window_start.cast("string"), F.lit("SPEED_THRESHOLD")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def wrap_heading(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def dead_reckon(lat: Column, lon: Column, heading: Column, speed: Column, tick_ms: int) -> tuple[Column, Column]:
    """Position after a tick at constant heading; unchanged without speed."""
    km = speed * (tick_ms / 3_600_000)
    north = lat + F.cos(F.radians(heading)) * km / KM_PER_DEGREE
    east = lon + F.sin(F.radians(heading)) * km / F.greatest(F.cos(F.radians(lat)) * KM_PER_DEGREE, F.lit(1e-12))
    return F.when(speed > 0, north).otherwise(lat), F.when(speed > 0, east).otherwise(lon)


def reflect(x: Column, low: float, high: float) -> tuple[Column, Column]:
    """A coordinate folded back into [low, high] however far it lies outside, and whether an odd number of reflections did it."""
    width = high - low
    phase = F.pmod(x - low, F.lit(2 * width))
    inside = (x >= low) & (x <= high)
    folded = F.when(inside, x).otherwise(F.when(phase <= width, low + phase).otherwise(high - (phase - width)))
    return folded, ~inside & (phase > width)


def reflect_bounds(lat: Column, lon: Column, heading: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column, Column]:
    """Position reflected into (lat min, lat max, lon min, lon max), and the heading after it: 360 - h and 180 - h for an odd number of reflections."""
    y, flip_y = reflect(lat, box[0], box[1])
    x, flip_x = reflect(lon, box[2], box[3])
    h = F.when(flip_y, wrap_heading(360 - heading)).otherwise(heading)
    return y, x, F.when(flip_x, wrap_heading(180 - h)).otherwise(h)


def next_battery(battery: Column, status: Column) -> Column:
    """Charge after a tick: ACTIVE loses 0.05, IDLE gains 0.2, within 0 to 100."""
    return clamp(battery + F.when(status == "ACTIVE", -0.05).when(status == "IDLE", 0.2).otherwise(0.0), 0.0, 100.0)


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, halves up; for numbers of at most six decimals."""
    n = F.floor(F.abs(F.round(x, 6)) * 10**digits + 0.5)
    text = F.concat(F.expr("''"), F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))
    return F.when((x < 0) & (n > 0), F.concat(F.lit("-"), text)).otherwise(text)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def battery_label(x: Column) -> Column:
    return F.when(x.isNull(), "Unknown").otherwise(F.concat(_fixed(x, 1), F.lit("%")))


def anomaly_value_label(x: Column) -> Column:
    return F.when(_finite(x), F.regexp_replace(_fixed(x, 2), r"\.?0+$", "")).otherwise("—")


def avg_speed_label(x: Column) -> Column:
    return F.when(_finite(x), F.concat(_fixed(x, 1), F.lit(" km/h"))).otherwise("—")


def window_end_label(text: Column) -> Column:
    """UTC seconds of an ISO-8601 text; what cannot be read stays as it is."""
    return F.coalesce(F.concat(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), text)


def iso_ms(ms: Column) -> Column:
    """ISO-8601 text with milliseconds and Z of an epoch in milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def status_colour(status: Column) -> Column:
    out = F.lit(OTHER_COLOUR)
    for name, colour in STATUS_COLOURS.items():
        out = F.when(status == name, colour).otherwise(out)
    return out
