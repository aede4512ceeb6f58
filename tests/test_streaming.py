"""Streams of scripted files against the stored-log meaning."""

import json
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_fleet import BASE, FLUSH, M, S, SCHEMA, events, spikes

from convoylake.operators import projections
from convoylake.sources.fleet import EVENT_V2, STATUSES
from convoylake.streaming import exact, jobs
from convoylake.streaming.projector import ReadModel, project

DROPPED = spikes((130, 250 * S), (60, 340 * S), (150, 260 * S), FLUSH)


def as_files(spark, path, rows, batches):
    """One file a batch, in order."""
    df = events(spark, rows).coalesce(1).orderBy("seq")
    for k, (a, b) in enumerate(batches):
        df.where(F.col("seq").between(a, b)).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def run(spark, stream, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


def test_late_row_is_dropped_between_batches(spark, tmp_path):
    path = as_files(spark, tmp_path / "in", DROPPED, [(0, 0), (1, 1), (2, 2), (3, 3)])
    got = run(spark, jobs.anomaly_stream(jobs.file_stream(spark, path, SCHEMA)), tmp_path)
    assert {r["window_start"]: r["value"] for r in got}[BASE] == 130.0


def test_rollups(spark, tmp_path):
    rows = [(30, BASE + 10 * S, "v1", "SEA", "ACTIVE"), (50, BASE + 11 * S, "v2", "SEA", "ACTIVE"), (900, BASE + 12 * S, "v1", "SEA", "IDLE"), (0, BASE + 10 * M, "v9", "SEA", "IDLE")]
    path = as_files(spark, tmp_path / "in", rows, [(0, 2), (3, 3)])
    got = run(spark, jobs.rollup_stream(jobs.file_stream(spark, path, SCHEMA)), tmp_path)
    assert [(r["window_start"], r["event_count"], r["active_vehicles"], r["avg_speed_kph"]) for r in got] == [(BASE, 3, 2, 40.0)]


def test_exact_windows_decide_record_by_record(spark, tmp_path):
    path = as_files(spark, tmp_path / "in", DROPPED, [(0, 3)])  # one batch: a watermark would keep the late row
    job = exact.Anomalies(spark, str(tmp_path / "out"), buckets=2)
    exact.exact_stream(jobs.file_stream(spark, path, SCHEMA), job, str(tmp_path / "c")).awaitTermination(120)
    assert {r["window_start"]: r["value"] for r in job.results().collect()} == {BASE + k * M: 150.0 if k > 0 else 130.0 for k in range(5)}


def test_projector_equals_the_batch_form(spark, tmp_path):
    rows = [(k, BASE + (k * 7 % 5) * S, f"v{k % 3}", "SEA", "ACTIVE" if k % 2 else "IDLE") for k in range(30)]
    path = as_files(spark, tmp_path / "in", rows, [(0, 9), (10, 19), (20, 29)])
    project(jobs.file_stream(spark, path, SCHEMA), "vehicle-events", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    model, e = ReadModel(spark, str(tmp_path / "out")), events(spark, rows)
    whole = {"vehicles": projections.vehicles_current(e), "vehicle_positions": projections.positions_current(e), "vehicle_events": projections.event_history(e)}

    def same():
        return all(sorted(map(str, model.table(n).select(df.columns).collect())) == sorted(map(str, df.collect())) for n, df in whole.items())

    assert same() and model.offsets("vehicle-events").collect()[0]["last_offset"] == 29
    model.append("vehicle-events", e.where("seq >= 20"), 2)  # a batch that is delivered again
    assert same()
    assert model.table("vehicle_events", BASE + projections.DAY_MS + 3 * S).where(F.col("occurred_at") < BASE + 3 * S).isEmpty()


def test_a_failed_batch_is_taken_again(spark, tmp_path):
    rows = [(k, BASE + k * S, f"v{k % 3}", "SEA", "ACTIVE") for k in range(20)]
    path = as_files(spark, tmp_path / "in", rows, [(0, 9), (10, 19)])
    model = ReadModel(spark, str(tmp_path / "out"))
    broken = [True]

    def append(df, i):
        model.append("vehicle-events", df, i)
        if i == 1 and broken[0]:
            raise RuntimeError("after the write")

    def attempt():
        stream = jobs.file_stream(spark, path, SCHEMA)
        return stream.writeStream.foreachBatch(append).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        attempt().awaitTermination(120)
    broken[0] = False
    attempt().awaitTermination(120)
    assert model.arrivals("vehicle-events").count() == 20 and model.table("vehicle_events").count() == 20


def test_anomalies_and_rollups_are_projected(spark, tmp_path):
    model = ReadModel(spark, str(tmp_path))
    anomalies = spark.createDataFrame([("a", "v1", 130.0, 0, 1, 1), ("b", "v2", 140.0, 0, 2, 2)], "anomaly_id string, vehicle_id string, value double, part int, off long, seq long")
    model.append("anomalies", anomalies, 0)
    model.append("anomalies", anomalies.where("anomaly_id = 'a'").withColumns({"value": F.lit(150.0), "off": F.lit(3), "seq": F.lit(3)}), 1)
    assert sorted(map(tuple, model.table("anomalies").collect())) == [("a", "v1", 150.0), ("b", "v2", 140.0)]
    rollups = spark.createDataFrame([("SEA", 0, 5, 0, 1, 1), ("SEA", 0, 6, 0, 2, 2), ("SEA", 60000, 1, 0, 3, 3)], "region string, window_start long, event_count long, part int, off long, seq long")
    model.append("rollups-1m", rollups, 0)
    assert sorted(map(tuple, model.table("region_rollups").collect())) == [("SEA", 0, 6), ("SEA", 60000, 1)]


def test_sinks_and_live_feeds(spark, tmp_path):
    rows = [(k, BASE + k * S, f"v{k % 3}", "SEA" if k % 2 else "NYC", "ACTIVE") for k in range(8)]
    path = as_files(spark, tmp_path / "in", rows, [(0, 3), (4, 7)])
    feed = jobs.live(jobs.file_stream(spark, path, SCHEMA), "SEA", ("event_id", "vehicle_id"))
    assert feed.columns == ["event_id", "vehicle_id"] and len(run(spark, feed, tmp_path / "f")) == 4
    jobs.folder_sink(jobs.file_stream(spark, path, SCHEMA), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("region = 'NYC'").count() == 4
    record = jobs.keyed(events(spark, rows), "vehicle_id").where("key = 'v1'").first()
    assert '"vehicle_id":"v1"' in record["value"] and '"battery_pct":null' in record["value"]


def test_frames_come_off_values(spark):
    rows = [(bytes([0, 0, 0, 1, 2]) + b"body",), (b"no frame",), (None,)]
    got = [(r["schema_id"], r["body"] and bytes(r["body"])) for r in jobs.unframed(spark.createDataFrame(rows, "value binary")).collect()]
    assert got == [(258, b"body"), (None, None), (None, None)]
    schema = json.loads(jobs.avro_schema("VehicleEvent", EVENT_V2, ("battery_pct",), {"status": STATUSES}))
    assert {"name": "battery_pct", "type": ["null", "double"], "default": None} in schema["fields"] and schema["fields"][8]["type"]["symbols"] == list(STATUSES)
