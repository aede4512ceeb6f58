"""Windowed jobs on streams: any batching gives the stored-log result, each window exactly once."""

import random

import pytest
from pyspark.sql import functions as F
from test_fleet import BASE, M, S, events

from convoylake.operators import windows
from convoylake.streaming import exact

ROLLED = [
    # counts, distinct vehicles and mean speed of active ones only; an idle vehicle counts as an event
    [(30, BASE + 10 * S, "v1", "SEA", "ACTIVE"), (50, BASE + 11 * S, "v1", "SEA", "ACTIVE"), (40, BASE + 12 * S, "v2", "SEA", "ACTIVE"), (900, BASE + 12 * S, "v3", "SEA", "IDLE"), (0, BASE + 10 * M, "v9", "SEA", "IDLE")],
    # no active vehicle: a mean of 0
    [(30, BASE + 10 * S, "v1", "SEA", "IDLE"), (0, BASE + 10 * M, "v1", "SEA", "IDLE")],
    # regions have clocks of their own: what closes in one stays open in the other
    [(30, BASE + 10 * S, "v1", "SEA", "ACTIVE"), (30, BASE + 10 * S, "v2", "NYC", "ACTIVE"), (0, BASE + 10 * M, "v1", "SEA", "IDLE")],
    # a row within the grace counts, the same row after it does not
    [(30, BASE + 50 * S, "v1", "SEA", "ACTIVE"), (0, BASE + 85 * S, "v1", "SEA", "IDLE"), (60, BASE + 55 * S, "v2", "SEA", "ACTIVE"), (0, BASE + 90 * S, "v1", "SEA", "IDLE"), (70, BASE + 55 * S, "v3", "SEA", "ACTIVE"), (0, BASE + 10 * M, "v1", "SEA", "IDLE")],
    # the window's bounds: its end belongs to the next one
    [(30, BASE + 60 * S - 1, "v1", "SEA", "ACTIVE"), (40, BASE + 60 * S, "v1", "SEA", "ACTIVE"), (0, BASE + 10 * M, "v1", "SEA", "IDLE")],
]


def values(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def fed(job, rows, cuts):
    bounds = [0, *cuts, 1 << 40]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        job.fold(rows.where((F.col("seq") >= a) & (F.col("seq") < b)), k)
    return job


@pytest.mark.parametrize("case", range(len(ROLLED)))
def test_tumbling_windows_under_any_batching(spark, tmp_path, case):
    rows = events(spark, ROLLED[case]).coalesce(1)
    want = values(windows.region_rollups(rows).select("region", "window_start", "window_end", "event_count", "active_vehicles", "avg_speed_kph"))
    n = len(ROLLED[case])
    for number, cuts in enumerate(([], [n // 2], list(range(1, n)))):
        assert values(fed(exact.Rollups(spark, str(tmp_path / str(number)), buckets=2), rows, cuts).results()) == want and want


def test_anomalies_and_rollups_of_a_long_log(spark, tmp_path):
    rng = random.Random(8)
    log = [(rng.choice([40, 119.5, 120, 121, 150 + rng.random()]), BASE + k * 4 * S - rng.choice([0, 0, 5, 40, 100]) * S, f"v{rng.randrange(6)}", rng.choice(["SEA", "NYC"]), rng.choice(["ACTIVE", "IDLE"])) for k in range(240)]
    rows = events(spark, log)
    for kind, batch in ((exact.Rollups, windows.region_rollups), (exact.Anomalies, windows.speed_anomalies)):
        want = batch(rows)
        job = fed(kind(spark, str(tmp_path / kind.__name__), buckets=2), rows, [37, 38, 150])
        assert values(job.results().select(*want.columns)) == values(want) and not want.isEmpty()
        assert job.committed() == [2, 3]  # older states are gone


def test_a_batch_that_was_stopped_is_taken_once(spark, tmp_path, monkeypatch):
    rows = events(spark, ROLLED[3]).coalesce(1)
    want = values(windows.region_rollups(rows).select("region", "window_start", "window_end", "event_count", "active_vehicles", "avg_speed_kph"))
    job = exact.Rollups(spark, str(tmp_path), buckets=2)
    job.fold(rows.where("seq < 3"), 0)
    with monkeypatch.context() as stopped:
        stopped.setattr(exact.WindowedJob, "commit", lambda self, number: (_ for _ in ()).throw(RuntimeError("killed between write and commit")))
        with pytest.raises(RuntimeError):
            job.fold(rows.where("seq >= 3"), 1)
    assert job.results().isEmpty() and job.committed() == [0]  # results are written, but not of a batch that is done
    again = exact.Rollups(spark, str(tmp_path), buckets=2)
    again.fold(rows.where("seq >= 3"), 1)
    assert values(again.results()) == want
    again.fold(rows.where("seq >= 3"), 1)  # delivered again after the commit
    assert values(again.results()) == want


def test_open_windows_are_not_exchanged(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = events(spark, ROLLED[0])
        job = exact.Rollups(spark, str(tmp_path), buckets=2)
        job.fold(rows.where("seq < 3"), 0)
        plan = job.folded(rows.where("seq >= 3"), 1)[1]._jdf.queryExecution().executedPlan().toString()
        merge = plan[plan.index("FullOuter") :]
        left = merge[: merge.index("Bucketed: true")]
        assert "Exchange" not in left
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_stream(spark, tmp_path):
    job = exact.Anomalies(spark, str(tmp_path), buckets=2)
    assert job.results().isEmpty()
    job.fold(events(spark, ROLLED[0]).limit(0), 0)
    assert job.results().isEmpty() and job.committed() == [0]
