"""Feeds for many subscribers on one stream, and the bounded list of anomalies."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_fleet import BASE, M, S, SCHEMA, events
from test_streaming import as_files

from convoylake.operators import projections, views
from convoylake.sources.fleet import ANOMALY, EVENT_V2, STATUSES
from convoylake.streaming import feeds, jobs

REQUESTS = "subscription string, region string, active boolean, seq long"
SHOWN = "event_id long, vehicle_id string"


def ids(feed, name):
    return sorted(r["event_id"] for r in feed.received(name, SHOWN).collect())


def test_one_stream_serves_all_subscriptions(spark, tmp_path):
    rows = [(k, BASE + k * S, f"v{k % 3}", "SEA" if k % 2 else "NYC", "ACTIVE") for k in range(12)]
    path = as_files(spark, tmp_path / "in", rows, [(0, 5), (6, 11)])
    subscriptions, feed = feeds.Subscriptions(spark, str(tmp_path / "s")), feeds.Feed(spark, str(tmp_path / "out"), slots=4)
    assert ids(feed, "sea") == []
    subscriptions.change(spark.createDataFrame([("sea", "SEA", True, 0), ("nyc", "NYC", True, 1), ("all", None, True, 2), ("gone", "SEA", True, 3), ("gone", "SEA", False, 4)], REQUESTS), 0)
    query = feeds.shared_feed(jobs.file_stream(spark, path, SCHEMA), subscriptions, feed, str(tmp_path / "c"), columns=("event_id", "vehicle_id"))
    query.awaitTermination(120)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 12  # read once, not once a subscriber
    assert ids(feed, "sea") == [1, 3, 5, 7, 9, 11] and ids(feed, "nyc") == [0, 2, 4, 6, 8, 10] and ids(feed, "all") == [*range(12)] and ids(feed, "gone") == []
    # changes hold from the next batch on, and a batch that comes again replaces itself
    subscriptions.change(spark.createDataFrame([("nyc", "NYC", False, 5), ("late", "SEA", True, 6)], REQUESTS), 1)
    subscriptions.change(spark.createDataFrame([("sea", None, True, 7)], REQUESTS), 1)  # a number that is done
    more = events(spark, rows).withColumn("event_id", F.col("event_id") + 100)
    for _ in range(2):
        feed.deliver(more, subscriptions.read(), 2, columns=("event_id", "vehicle_id"))
    assert len(ids(feed, "sea")) == 12 and len(ids(feed, "nyc")) == 6 and ids(feed, "late") == [101 + 2 * k for k in range(6)] and len(ids(feed, "all")) == 24
    plan = feed.received("sea", SHOWN)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan


def test_fan_out_edges(spark):
    rows = spark.createDataFrame([(1, "SEA"), (2, None), (3, "LAX"), (1, "SEA")], "event_id long, region string")
    asked = spark.createDataFrame([("a", "SEA"), ("b", None)], "subscription string, region string")
    got = sorted((r["subscription"], r["event_id"]) for r in feeds.fan_out(rows, asked).collect())
    assert got == [("a", 1), ("a", 1), ("b", 1), ("b", 1), ("b", 2), ("b", 3)]
    assert feeds.fan_out(rows, asked.limit(0)).count() == feeds.fan_out(rows.limit(0), asked).count() == 0
    assert "FileScan" not in feeds.fan_out(rows, asked)._jdf.queryExecution().executedPlan().toString() and "Nested" not in feeds.fan_out(rows, asked)._jdf.queryExecution().executedPlan().toString()


def anomalies(spark, rows):
    full = [(i, "v", "SEA", "SPEED_THRESHOLD", float(value), 1, None if end is None else end - 5 * M, end, k) for k, (i, value, end) in enumerate(rows)]
    return spark.createDataFrame(full, f"{ANOMALY}, seq bigint").repartition(3)


def test_visible_list_equals_the_batch_form_after_each_batch(spark, tmp_path):
    rng = random.Random(5)
    ends = {f"a{k:02d}": None if k == 7 else BASE + rng.randrange(12) * M for k in range(40)}
    rows = [(i, rng.randrange(9), ends[i]) for i in rng.choices([*ends], k=90)]
    whole, board = anomalies(spark, rows), feeds.VisibleAnomalies(spark, str(tmp_path), limit=6)
    assert board.read().isEmpty()
    for number, end in enumerate((10, 10, 45, 90)):
        start = (0, 10, 10, 45)[number]
        for _ in range(2):  # again: no effect
            board.fold(whole.where((F.col("seq") >= start) & (F.col("seq") < end)), number)
        last = projections.last_arrival(whole.where(F.col("seq") < end), ["anomaly_id"], "seq")
        want = views.visible_anomalies(last, F.desc("anomaly_id"), 6)
        assert sorted(map(tuple, board.read().collect())) == sorted(map(tuple, want.select(board.read().columns).collect()))
    assert len(board.done()) == 2


def test_a_window_end_that_goes_back_is_an_error(spark, tmp_path):
    board = feeds.VisibleAnomalies(spark, str(tmp_path), limit=2)
    board.fold(anomalies(spark, [("a", 1, BASE), ("b", 1, BASE + M), ("c", 1, BASE + 2 * M)]), 0)
    board.fold(anomalies(spark, [("a", 5, BASE - M)]), 1)  # not on the list: it cannot come back onto it
    assert [r["anomaly_id"] for r in board.read().collect()] == ["c", "b"]
    for end in (BASE, None):
        with pytest.raises(PySparkException, match="goes back: c"):
            board.fold(anomalies(spark, [("c", 5, end)]), 2)
    board.fold(anomalies(spark, [("b", 5, BASE + 3 * M)]), 2)  # the stopped number is made again
    assert [(r["anomaly_id"], r["value"]) for r in board.read().orderBy(F.desc("window_end")).collect()] == [("b", 5.0), ("c", 1.0)]


def test_frame_and_avro_round_trip(spark):
    records = spark.range(1).select(jobs.frame(F.encode(F.lit("body"), "utf-8"), 258).alias("value"))
    row = jobs.unframed(records).first()
    assert (row["schema_id"], bytes(row["body"])) == (258, b"body")
    rows = anomalies(spark, [("a", 1, BASE), ("b", 2, BASE + M)])
    schema = jobs.avro_schema("Anomaly", ANOMALY)
    try:
        sent = jobs.framed(rows, "vehicle_id", 7, schema).withColumns({"partition": F.lit(0), "offset": F.lit(0)})
    except PySparkException as e:
        if "AVRO_NOT_LOADED" not in str(e):
            raise
        pytest.skip("no spark-avro on the class path")
    assert sorted(r["anomaly_id"] for r in jobs.decoded(sent, {7: schema}, columns=ANOMALY).collect()) == ["a", "b"]
    event = jobs.avro_schema("VehicleEvent", EVENT_V2, ("battery_pct",), {"status": STATUSES})
    given = events(spark, [(1, BASE, "v", "SEA", "IDLE")]).withColumn("event_id", F.col("event_id").cast("string"))
    sent = jobs.framed(given, "vehicle_id", 8, event).withColumns({"partition": F.lit(0), "offset": F.lit(0)})
    assert [r["status"] for r in jobs.decoded(sent, {8: event}).collect()] == ["IDLE"]
