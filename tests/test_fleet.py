"""Scripted scenarios of the windowed jobs, the read model and the views."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from convoylake.functions import scalars as fn
from convoylake.operators import clock, merkle, projections, replay, serving, views, windows
from convoylake.plans import registry
from convoylake.sources.fleet import fully_compatible

BASE = 60_000_000
S, M = 1000, 60_000
SCHEMA = "event_id long, vehicle_id string, region string, lat double, lon double, speed_kph double, heading_deg double, battery_pct double, status string, occurred_at long, part int, off long, seq long"


def events(spark, rows):
    """Rows of (speed, time, vehicle, region, status) in order of arrival."""
    full = [(k, v, r, 1.0, 2.0, float(speed), 0.0, None, status, at, 0, k, k) for k, (speed, at, v, r, status) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def spikes(*pairs):
    return [(speed, BASE + at, "v1", "west", "ACTIVE") for speed, at in pairs]


FLUSH = (60, 60 * M)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (spikes((90, 10 * S), (120, 20 * S), (0, 60 * M)), {}),
        (spikes((150, 2 * M), FLUSH), {BASE + k * M: 150.0 for k in range(-2, 3)}),
        (spikes((130, 250 * S), (60, 320 * S), (150, 260 * S), FLUSH), {BASE: 150.0, **{BASE + k * M: 150.0 for k in range(1, 5)}}),
        (spikes((130, 250 * S), (60, 340 * S), (150, 260 * S), FLUSH), {BASE: 130.0, **{BASE + k * M: 150.0 for k in range(1, 5)}}),
        (spikes((150, 10 * S), (155, 11 * S), (160, 12 * S), (60, 91 * S)), {BASE - 4 * M: 160.0}),
    ],
)
def test_anomalies(spark, given, want):
    got = windows.speed_anomalies(events(spark, given)).collect()
    assert {r["window_start"]: r["value"] for r in got} == want
    assert all(r["window_end"] == r["window_start"] + 5 * M and r["anomaly_id"] == str(uuid.uuid5(uuid.UUID(fn.ANOMALY_NAMESPACE), f"v1|{r['window_start']}|SPEED_THRESHOLD")) for r in got)


def test_other_vehicle_closes_the_window(spark):
    rows = [(150, BASE + 10 * S, "v1", "west", "ACTIVE"), (60, BASE + 91 * S, "v2", "east", "ACTIVE")]
    got = windows.speed_anomalies(events(spark, rows)).collect()
    assert [(r["window_start"], r["value"], r["region"]) for r in got] == [(BASE - 4 * M, 150.0, "west")]


ROLLUPS = [
    ([(s, 10 * S + 5 * S * k, f"v{k % 2 + 1}", "ACTIVE") for k, s in enumerate((30, 40, 50, 60, 70, 80))], {0: (6, 2, 55.0)}),
    ([(30, 10 * S, "v1", "ACTIVE"), (50, 11 * S, "v2", "ACTIVE"), (900, 12 * S, "v1", "IDLE"), (700, 13 * S, "v3", "IDLE")], {0: (4, 2, 40.0)}),
    ([(20, 59 * S, "v1", "ACTIVE"), (80, 61 * S, "v1", "ACTIVE")], {0: (1, 1, 20.0), M: (1, 1, 80.0)}),
    ([(5, 10 * S, "v1", "IDLE"), (5, 11 * S, "v2", "OFFLINE")], {0: (2, 0, 0.0)}),
    ([(9, 10 * S, "v1", "ACTIVE")] * 2, {0: (2, 1, 9.0)}),
]


@pytest.mark.parametrize(("given", "want"), ROLLUPS)
def test_rollups(spark, given, want):
    rows = [(s, BASE + at, v, "SEA", status) for s, at, v, status in given] + [(0, BASE + 10 * M, "v9", "SEA", "IDLE")]
    got = windows.region_rollups(events(spark, rows)).collect()
    assert {r["window_start"] - BASE: (r["event_count"], r["active_vehicles"], r["avg_speed_kph"]) for r in got} == want


def test_random_arrivals_equal_a_sequential_fold(spark):
    rng = random.Random(9)
    rows = [(rng.choice([50, 119, 121, 200]), BASE + k * 7 * S - rng.choice([0, 0, 0, 20, 45, 100, 400]) * S, f"v{rng.randrange(4)}", rng.choice(["SEA", "NYC"]), rng.choice(["ACTIVE", "IDLE"])) for k in range(150)]
    open_, done, now = {}, {}, None
    for speed, at, v, r, _ in rows:
        now = at if now is None else max(now, at)
        for k in range(5):
            start = at // M * M - k * M
            if start + 5 * M > now - 30 * S and speed > 120:
                old = open_.get((v, start))
                open_[v, start] = (max(speed, old[0] if old else 0), r)
    done = {k: x for k, x in open_.items() if k[1] + 5 * M + 30 * S <= now}
    got = windows.speed_anomalies(events(spark, rows)).collect()
    assert {(r["vehicle_id"], r["window_start"]): (r["value"], r["region"]) for r in got} == done
    df = clock.event_clock(events(spark, rows), "part", "off", width=8)
    seen = [r["clock"] for r in df.orderBy("off").collect()]
    assert seen == [max(at for _, at, *_ in rows[: k + 1]) for k in range(len(rows))]
    assert [r["n"] for r in clock.numbered(df, "part", "off", "n", 11).orderBy("off").collect()] == list(range(len(rows)))


def test_read_model_ties(spark):
    e = events(spark, [(1, 100, "v", "SEA", "ACTIVE"), (2, 100, "v", "NYC", "IDLE"), (3, 90, "v", "AUS", "OFFLINE")])
    v = projections.vehicles_current(e).first()
    p = projections.positions_current(e).first()
    assert (v["region"], v["status"], v["last_seen"]) == ("NYC", "IDLE", 100) and p["speed_kph"] == 1.0
    twice = e.unionByName(e.withColumns({"seq": F.col("seq") + 100, "speed_kph": F.lit(99.0)}))
    assert {r["speed_kph"] for r in projections.event_history(twice).collect()} == {1.0, 2.0, 3.0}
    battery = e.withColumn("battery_pct", F.when(F.col("seq") == 1, 50.0)).withColumn("occurred_at", F.col("seq"))
    assert projections.positions_current(battery).first()["battery_pct"] is None
    swapped = projections.positions_current(e, True).first()
    assert (swapped["lat"], swapped["lon"]) == (2.0, 1.0)
    assert projections.retained(projections.event_history(e), 86_400_100).count() == 2


def test_serving(spark):
    e = events(spark, [(k, BASE + k, "v", "SEA", "ACTIVE") for k in range(6)])
    history = projections.event_history(e)
    assert [r["event_id"] for r in serving.recent_events(history, 2).orderBy("rank").collect()] == [5, 4]
    assert serving.recent_events(history, 0).count() == 0
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            serving.recent_events(history, bad)
    orphan = spark.createDataFrame([("lost", "SEA", "IDLE", 1)], "id string, region string, status string, last_seen long")
    with pytest.raises(Exception, match="no position"):
        serving.vehicle_positions_join(orphan, projections.positions_current(e)).collect()
    assert serving.vehicles_by_region(projections.vehicles_current(e), "").count() == 0


def test_views(spark):
    a = spark.createDataFrame([("a", "v1", 10), ("b", "v2", 300_010), ("c", "v3", 9), ("d", "v4", 300_011)], "anomaly_id string, vehicle_id string, window_end long")
    assert {r[0] for r in views.anomalous_vehicles(a, 300_010).collect()} == {"v1", "v2"}
    merged = views.merge_anomalies(a, a.where("anomaly_id = 'a'").withColumn("vehicle_id", F.lit("new")))
    assert [(r["anomaly_id"], r["vehicle_id"]) for r in merged.collect()] == [("d", "v4"), ("b", "v2"), ("a", "new"), ("c", "v3")]
    assert views.visible_anomalies(a.union(a), "anomaly_id", 3).count() == 3


def _backwards(spark):
    """Windowed events, the last to arrive first, and the mean of their speeds as added in order of arrival."""
    rng = random.Random(5)
    speeds = [round(rng.random() * 90, 2) for _ in range(128)]
    rows = [("SEA", BASE, BASE + M, f"v{k % 7}", "ACTIVE", v, k) for k, v in enumerate(speeds)]
    total = 0.0
    for v in speeds:  # not sum(), which compensates
        total += v
    return spark.createDataFrame(rows[::-1], "region string, window_start long, window_end long, vehicle_id string, status string, speed_kph double, seq long").coalesce(1), total / len(speeds)


def test_speeds_are_added_in_order_of_arrival(spark):
    rows, mean = _backwards(spark)
    for dealt in (rows, rows.repartition(5)):
        assert [tuple(r) for r in windows.rollup_windows(dealt).collect()] == [("SEA", BASE, BASE + M, 128, 7, mean)]


def test_tree_of_rollups_is_the_same_however_events_are_dealt(spark):
    rows, _ = _backwards(spark)
    roots = {merkle.root(merkle.tree(windows.rollup_windows(dealt), [F.col("region")], [F.hex(F.encode(F.col("avg_speed_kph").cast("string"), "UTF-8"))], 1)).first()["root"] for dealt in (rows, rows.repartition(5), rows.orderBy("seq").coalesce(1))}
    assert len(roots) == 1


def test_one_id_in_two_partitions(spark):
    """Vehicles of two partitions under one name have anomalies under one id; none is lost."""
    rows = [(speed, BASE + at * S, "v1", region, "ACTIVE", part) for part, region in ((0, "SEA"), (1, "NYC")) for speed, at in ((150.0 + part, 10), (0.0, 600))]
    e = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "speed_kph double, occurred_at long, vehicle_id string, region string, status string, part int, seq long")
    a = windows.speed_anomalies(e, keep=("part",))
    changed = a.where("part = 1").withColumn("value", F.lit(1.0))
    want = {("SEA", 150.0, 5), ("NYC", 1.0, 5)}
    assert a.select("anomaly_id").distinct().count() == 5 and windows.speed_anomalies(e).columns == [c for c in a.columns if c != "part"]
    for merged in (views.merge_anomalies(a, changed, ("anomaly_id", "part")), views.merge_visible(a, changed, keys=("anomaly_id", "part"))):
        assert {tuple(r) for r in merged.groupBy("region", "value").count().collect()} == want and merged.columns == a.columns
    newest = views.merge_visible(a, changed, 3, ("anomaly_id", "part")).collect()
    assert [r["part"] for r in newest] == [1, 0, 1] and len({r["anomaly_id"] for r in newest}) == 2


def test_scalars(spark):
    row = spark.range(1).select(
        fn.battery_label(F.lit(None).cast("double")), fn.battery_label(F.lit(61.5)), fn.anomaly_value_label(F.lit(150.0)), fn.anomaly_value_label(F.lit(121.5)), fn.anomaly_value_label(F.lit(float("nan"))), fn.avg_speed_label(F.lit(55.0)),
        fn.window_end_label(F.lit("2026-07-24T12:00:00.000Z")), fn.window_end_label(F.lit("soon")), fn.wrap_heading(F.lit(-10.0)), *fn.reflect_bounds(F.lit(5.0), F.lit(-1.0), F.lit(30.0), (0.0, 2.0, 0.0, 2.0)),
    ).first()
    assert tuple(row) == ("Unknown", "61.5%", "150", "121.5", "—", "55.0 km/h", "2026-07-24 12:00:00 UTC", "soon", 350.0, 1.0, 1.0, 150.0)


def test_watermarks():
    mark = {"version": 1, "captured_at": "2026-07-24T12:00:00Z", "topics": {t: {str(k): 10 for k in range(n)} for t, n in replay.TOPIC_PARTITIONS.items()}, "low_offsets": {t: {str(k): 0 for k in range(n)} for t, n in replay.TOPIC_PARTITIONS.items()}}
    assert replay.validate_watermark(mark) == []
    assert replay.validate_watermark({**mark, "low_offsets": None})
    assert replay.validate_watermark({**mark, "topics": {**mark["topics"], "anomalies": {"0": -2}}})
    assert replay.validate_watermark({**mark, "topics": {**mark["topics"], "anomalies": {str(k): 4 for k in range(6)}}, "low_offsets": {**mark["low_offsets"], "anomalies": {str(k): 5 for k in range(6)}}})
    highs = {t: {str(k): 11 for k in range(n)} for t, n in replay.TOPIC_PARTITIONS.items()}
    assert replay.available(mark, mark["low_offsets"], highs) and not replay.available(mark, highs, highs)


def test_schema_versions():
    old = {"a": {"type": "string"}}
    assert fully_compatible(old, old | {"b": {"type": "double", "default": None}}) == []
    assert fully_compatible(old, old | {"b": {"type": "double"}}) and fully_compatible(old, {"a": {"type": "int"}})


def test_digests_compare(spark):
    df = spark.range(500).selectExpr("id", "cast(null as string) n", "id % 7 v")
    columns = [F.col(c) for c in df.columns]
    a = replay.table_digest(df.repartition(7), columns).select(F.lit("t").alias("name"), "*")
    b = replay.table_digest(df.coalesce(1).orderBy(F.desc("id")), columns).select(F.lit("t").alias("name"), "*")
    c = replay.table_digest(df.where("id <> 3"), columns).select(F.lit("t").alias("name"), "*")
    assert a.first()["rows"] == 500 and a.collect() == b.collect()
    assert replay.unexpected(a, b).count() == 0 and replay.unexpected(a, c).count() == 1
    assert replay.unexpected(a, b, different=True).count() == 1 and replay.unexpected(a, c, different=True).count() == 0
    assert replay.table_digest(df.limit(0), columns).first()["digest"] == "0-0"


def test_watermark_files_and_resuming(spark, tmp_path):
    log = spark.createDataFrame([(0, 4), (0, 9), (2, 7)], "part int, off long")
    mark = replay.watermark_of(replay.capture_watermark(log), "vehicle-events", "2026-01-01T00:00:00Z")
    replay.write_watermark(spark, mark, str(tmp_path / "mark"))
    assert replay.read_watermark(spark, str(tmp_path / "mark")) == mark
    assert mark["topics"]["vehicle-events"] == {"0": 9, "1": -1, "2": 7, "3": -1, "4": -1, "5": -1}
    assert json.loads(replay.starting_offsets(projections.offsets_current(log), "vehicle-events")) == {"vehicle-events": {"0": 10, "1": -2, "2": 8, "3": -2, "4": -2, "5": -2}}


def test_digests_round_as_the_sql(spark):
    """A mean just below a half in the seventh decimal, whose product with a million is a half: the SQL rounds it up."""
    duckdb = pytest.importorskip("duckdb")
    values = [43.754062499999996, 40.785312499999996, 47.260312499999976, 47.0078125, 0.0, -43.754062499999996, 12.3456784, 1e9 / 3]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = [duckdb.execute("SELECT CAST(floor(round(x, 6) * 1000000 + 0.5) AS BIGINT), round(x, 6) FROM (SELECT ?::DOUBLE AS x)", [v]).fetchone() for v in values]
    assert [tuple(r) for r in registry._rounded(df.withColumn("m", registry._micro("x")), "x").select("m", "x").collect()] == want
