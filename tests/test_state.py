"""State that running jobs keep: progress, retention and folds, against their batch forms."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from test_fleet import BASE, SCHEMA, S, events

from convoylake.operators import merkle, projections, retention, serving
from convoylake.sources import log
from convoylake.streaming import jobs
from convoylake.streaming.folds import History, Vehicles, fold_stream
from convoylake.streaming.projector import ReadModel, project
from convoylake.streaming.progress import Progress, batch_progress, completed, positions, reached, resume_offsets

HISTORY = "event_id bigint, vehicle_id string, occurred_at bigint"


def rows_of(df):
    return sorted(map(str, df.collect()))


def arrivals(spark, n=120, seed=4):
    rng = random.Random(seed)
    rows = [(k, BASE + rng.randrange(40) * S, f"v{rng.randrange(9)}", "SEA", rng.choice(["ACTIVE", "IDLE"])) for k in range(n)]
    return events(spark, rows)


# progress


def gap_source():
    """A log of one topic whose records stand at some offsets only; read in steps of ten offsets."""

    class Gaps(DataSource):
        @classmethod
        def name(cls):
            return "gaps"

        def schema(self):
            return "part int, off bigint"

        def streamReader(self, schema):  # noqa: N802
            start, end, holes = int(self.options.get("start", 0)), int(self.options["end"]), json.loads(self.options["holes"])

            class Reader(DataSourceStreamReader):
                at = start

                def initialOffset(self):  # noqa: N802
                    return {"vehicle-events": {"0": start}}

                def latestOffset(self):  # noqa: N802
                    self.at = min(self.at + 10, end)
                    return {"vehicle-events": {"0": self.at}}

                def partitions(self, a, b):
                    return [InputPartition((a["vehicle-events"]["0"], b["vehicle-events"]["0"]))]

                def read(self, partition):
                    a, b = partition.value
                    yield from ((0, k) for k in range(a, b) if k not in holes)

            return Reader()

    return Gaps


def run_gaps(spark, tmp_path, name, start, end, holes, until):
    got = []
    stream = spark.readStream.format("gaps").option("start", start).option("end", end).option("holes", json.dumps(holes)).load()
    query = stream.writeStream.foreachBatch(lambda df, i: got.extend(r["off"] for r in df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(300):
            last = {r["part"]: r["last"] for r in reached(spark, str(tmp_path / "progress")).collect()}
            if last.get(0, -1) >= until or query.exception():
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert query.exception() is None
    return got


def test_progress_goes_past_gaps_and_a_replay_resumes_after_them(spark, tmp_path):
    spark.dataSource.register(gap_source())
    marks = []
    listener = Progress(spark, str(tmp_path / "progress"), every=10, marked=marks.append)
    spark.streams.addListener(listener)
    try:
        holes = [*range(7, 12), *range(23, 30), *range(55, 60)]
        target = spark.createDataFrame([(0, 59), (1, -1)], "part int, target bigint")
        first = run_gaps(spark, tmp_path, "a", 0, 30, holes, 29)
        assert first == [k for k in range(30) if k not in holes]
        done = reached(spark, str(tmp_path / "progress"))
        # the records alone end at 22, what was read ends at 29
        assert [tuple(r) for r in done.collect()] == [(0, 29)] and not completed(done, target)
        start = json.loads(resume_offsets(done))["vehicle-events"]
        assert start["0"] == 30 and start["1"] == -2
        second = run_gaps(spark, tmp_path, "b", start["0"], 60, holes, 59)
        assert second == [k for k in range(30, 60) if k not in holes]
        done = reached(spark, str(tmp_path / "progress"))
        assert completed(done, target)
        records = spark.createDataFrame([(0, 54)], "part int, last_offset bigint")
        assert not completed(records.select("part", F.col("last_offset").alias("last")), target)
        assert completed(reached(spark, str(tmp_path / "progress"), records), target)
        assert marks[:1] == [10] and all(m % 10 == 0 for m in marks)
    finally:
        spark.streams.removeListener(listener)


def test_records_count_where_no_progress_was_kept(spark, tmp_path):
    records = spark.createDataFrame([(2, 5)], "part int, last_offset bigint")
    done = reached(spark, str(tmp_path / "none"), records)
    assert [tuple(r) for r in done.collect()] == [(2, 5)] and json.loads(resume_offsets(done))["vehicle-events"]["2"] == 6
    assert reached(spark, str(tmp_path / "none")).isEmpty()
    assert positions('{"logOffset": 3}') == [] and positions(None) == [] and positions("7") == []
    assert positions('{"t": {"1": 4, "0": 2}}') == [("t", 0, 2), ("t", 1, 4)]


def test_batches_without_records_are_reported(spark):
    log = spark.createDataFrame([(0, k) for k in (0, 1, 25, 26)], "part int, off bigint")
    ends = spark.createDataFrame([(0, 38)], "part int, next_offset bigint")
    got = [tuple(r) for r in batch_progress(log, ends, 10).orderBy("batch").collect()]
    assert got == [(0, 0, 10, 2, 1), (0, 1, 20, 0, 1), (0, 2, 30, 2, 26), (0, 3, 38, 0, 26)]


# retention


def test_retention_deletes_hours_and_rewrites_one(spark, tmp_path):
    hour, now = retention.HOUR_MS, 100 * retention.HOUR_MS + 1_800_000
    cutoff = now - projections.DAY_MS
    rows = [(k, "v", k * hour // 4) for k in range(400)] + [(1000, "v", cutoff), (1001, "v", cutoff - 1), (1002, "v", None), (1003, "v", -5 * hour)]
    df, path = spark.createDataFrame(rows, HISTORY), str(tmp_path / "h")
    retention.write_history(df, path)
    assert rows_of(retention.read_history(spark, path, HISTORY)) == rows_of(df)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "h").glob("hour=*/part-*")}
    assert retention.expire(spark, path, now, enabled=False) == 0
    want = df.where(f"occurred_at is null or occurred_at >= {cutoff}")
    assert retention.expire(spark, path, now) == df.count() - want.count()
    assert rows_of(retention.read_history(spark, path, HISTORY)) == rows_of(want)
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "h").glob("hour=*/part-*")}
    edge = f"hour={cutoff // hour}"
    assert all(before[p] == t for p, t in left.items() if edge not in str(p)) and not any(f"hour={h}/" in str(p) for p in left for h in range(70))
    assert retention.expire(spark, path, now) == 0  # again: nothing left to delete
    assert retention.expire(spark, path, now + 500 * hour) == want.count() - 1
    assert [r["event_id"] for r in retention.read_history(spark, path, HISTORY).collect()] == [1002]
    assert retention.read_history(spark, str(tmp_path / "none"), HISTORY).isEmpty() and retention.expire(spark, str(tmp_path / "none"), now) == 0


def test_retention_runs_when_it_starts(spark, tmp_path):
    now = int(time.time() * 1000)
    retention.write_history(spark.createDataFrame([(1, "v", now), (2, "v", now - 2 * projections.DAY_MS)], HISTORY), str(tmp_path / "h"))
    counts = []
    query = retention.retention_job(spark, str(tmp_path / "h"), str(tmp_path / "c"), done=counts.append)
    try:
        for _ in range(200):
            if counts or query.exception():
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert counts[0] == 1 and [r["event_id"] for r in retention.read_history(spark, str(tmp_path / "h"), HISTORY).collect()] == [1]


# folds


def test_folds_equal_the_batch_form_in_any_order(spark, tmp_path):
    whole = arrivals(spark)
    vehicles, history = Vehicles(spark, str(tmp_path)), History(spark, str(tmp_path), "bigint")
    parts = [whole.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k) for k in range(4)]
    for batch in (parts[2], parts[0], parts[2], parts[3], parts[1].unionAll(parts[0]), whole.limit(0)):  # out of order, repeated, empty
        vehicles.fold(batch)
        history.fold(batch)
    columns = vehicles.vehicles().columns, vehicles.positions().columns, history.events().columns
    assert rows_of(vehicles.vehicles()) == rows_of(projections.vehicles_current(whole).select(*columns[0]))
    assert rows_of(vehicles.positions()) == rows_of(projections.positions_current(whole).select(*columns[1]))
    assert rows_of(history.events()) == rows_of(projections.event_history(whole).select(*columns[2]))
    assert len([p for p in (tmp_path / "vehicles").iterdir() if p.is_dir()]) <= 3


def test_state_is_not_exchanged(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = arrivals(spark)
        vehicles, history = Vehicles(spark, str(tmp_path)), History(spark, str(tmp_path), "bigint")
        vehicles.fold(whole.where("seq < 60"))
        history.fold(whole.where("seq < 60"))
        for df in (vehicles.folded(whole), history.added(whole)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # of the batch
        assert "Exchange" not in history.events()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_folds_go_on_after_a_stopped_version(spark, tmp_path):
    whole = arrivals(spark)
    vehicles = Vehicles(spark, str(tmp_path))
    vehicles.fold(whole.where("seq < 60"))
    (tmp_path / "vehicles" / "v000000000001").mkdir()  # a run stopped before Spark marked it done
    again = Vehicles(spark, str(tmp_path))  # as after a restart
    assert again.state().count() == vehicles.state().count()
    again.fold(whole)
    assert rows_of(again.positions()) == rows_of(projections.positions_current(whole))


def test_stream_of_folds(spark, tmp_path):
    whole = arrivals(spark)
    for k in range(3):
        whole.where(f"seq div 40 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fold_stream(jobs.file_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "c"), "bigint").awaitTermination(180)
    history = History(spark, str(tmp_path / "out"), "bigint")
    assert rows_of(history.events()) == rows_of(projections.event_history(whole)) and history.state().count() == 120


# read model: records without an order of their own, runs, versions, reset


def test_topics_without_seq_runs_and_versions(spark, tmp_path):
    whole = arrivals(spark).withColumns({"part": F.lit(0), "off": F.col("seq")})
    model = ReadModel(spark, str(tmp_path / "model"))
    assert all(model.table(n).isEmpty() for n in ("vehicles", "vehicle_positions", "vehicle_events", "anomalies", "region_rollups"))
    assert model.offsets("anomalies").isEmpty()
    raw = whole.drop("seq")  # as ``jobs.decoded`` gives them
    old, new = raw.where("off < 50").drop("battery_pct"), raw.where("off >= 50")
    for first, second in ((old, new), (new, old)):  # versions in either order, two runs that both begin with batch 0
        model.append("vehicle-events", first, 0, "a")
        model.append("vehicle-events", second, 0, "b")
        want = whole.withColumn("battery_pct", F.when(F.col("off") >= 50, F.col("battery_pct")))
        for name, fold in (("vehicles", projections.vehicles_current), ("vehicle_positions", projections.positions_current), ("vehicle_events", projections.event_history)):
            assert rows_of(model.table(name)) == rows_of(fold(want).select(*model.table(name).columns))
    model = ReadModel(spark, str(tmp_path / "old"))
    model.append("vehicle-events", old, 0)
    assert [r[0] for r in model.table("vehicle_positions").select("battery_pct").distinct().collect()] == [None]


def test_a_new_run_replaces_nothing(spark, tmp_path):
    whole = arrivals(spark)
    for k, rows in enumerate((whole.where("seq < 60"), whole.where("seq >= 60"))):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        project(jobs.file_stream(spark, str(tmp_path / f"in{k}"), SCHEMA), "vehicle-events", str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination(120)
    assert ReadModel(spark, str(tmp_path / "out")).arrivals("vehicle-events").count() == 120


def test_reset_empties_and_seeds(spark, tmp_path):
    root = str(tmp_path / "model")
    model = ReadModel(spark, root)
    model.append("vehicle-events", arrivals(spark), 0)
    seeds = {"vehicle-events": spark.createDataFrame([(0, 41), (1, -1)], "part int, seed bigint")}
    for wrong in (lambda: model.reset("yes", seeds), lambda: model.reset(root, {"other": seeds["vehicle-events"]})):
        with pytest.raises(ValueError):
            wrong()
    (tmp_path / "model" / "precious").mkdir()
    with pytest.raises(ValueError):
        model.reset(root, seeds)
    assert model.table("vehicle_events").count() == 120  # nothing was removed
    (tmp_path / "model" / "precious").rmdir()
    model.reset(root, seeds)
    assert all(model.table(n).isEmpty() for n in ("vehicles", "vehicle_events", "anomalies"))
    assert sorted(map(tuple, model.offsets("vehicle-events").collect())) == [(0, 41), (1, -1)]
    start = json.loads(resume_offsets(model.offsets("vehicle-events").withColumnRenamed("last_offset", "last")))["vehicle-events"]
    assert start["0"] == 42 and start["1"] == 0 and start["2"] == -2
    model.append("vehicle-events", arrivals(spark).withColumn("off", F.col("seq")).where("off > 41"), 0)
    assert model.table("vehicle_events").count() == 78 and model.offsets("vehicle-events").where("part = 0").first()["last_offset"] == 119
    model.reset(root)
    assert model.offsets("vehicle-events").isEmpty()


# stored log, digests


def test_bounds_reach_the_scan_of_a_stored_log(spark, tmp_path):
    rows = arrivals(spark, 400).withColumn("part", F.pmod(F.col("seq"), F.lit(3)).cast("int")).drop("off")
    log.write_log(rows, str(tmp_path / "log"), files=6)
    bounds = spark.createDataFrame([(0, 10, 40), (1, None, 5), (2, 100, None)], "part int, persisted bigint, target bigint")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = log.replay(spark, str(tmp_path / "log"), bounds)
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    assert "GreaterThan(off,10)" in pushed and "EqualTo(part,0)" in pushed and "LessThanOrEqual(off,5)" in pushed
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Window" not in plan
    assert sorted((r["part"], r["off"]) for r in got.collect()) == [(0, k) for k in range(11, 41)] + [(1, k) for k in range(6)] + [(2, k) for k in range(101, 133)]
    assert sorted(map(tuple, log.ends(spark, str(tmp_path / "log")).collect())) == [(0, 133), (1, 132), (2, 132)]
    whole = log.read_log(spark, str(tmp_path / "log"))
    assert whole.count() == 400 and whole.where("off * 3 + part <> seq").isEmpty()
    assert log.replay(spark, str(tmp_path / "log"), bounds.limit(0)).isEmpty()


def test_trees_find_the_leaf_of_a_change(spark):
    rows = [(k, f"v{k % 7}", None if k % 5 == 0 else k / 3) for k in range(500)]
    df = lambda r: spark.createDataFrame(r, "id bigint, name string, value double")
    nodes = lambda r: merkle.tree(df(r).repartition(3), [F.col("id")], [F.col("name"), F.col("value")], 2)
    whole = nodes(rows)
    assert merkle.root(whole).first() == merkle.root(nodes(rows[::-1])).first() and merkle.root(whole).first()["rows"] == 500
    assert merkle.differing(whole, nodes(rows[::-1]), 2).isEmpty()
    changed = [*rows[:250], (250, "v5", -1.0), *rows[251:]]
    leaves = merkle.differing(whole, nodes(changed), 2)
    assert leaves.count() == 1 and merkle.rows_of_ranges(df(rows), [F.col("id")], leaves, 2).where("id = 250").count() == 1
    for other in (rows[1:], [*rows, (1000, "x", 0.0)], [(k, n, 0.0 if k == 5 else v) for k, n, v in rows]):
        assert merkle.differing(whole, nodes(other), 2).count() == 1
    empty = nodes([])
    assert merkle.root(empty).first()["rows"] == 0 and merkle.differing(whole, empty, 2).count() == whole.where("length(prefix) = 2").count()
    one, two = (spark.createDataFrame([r], "a string, b string").select(merkle.framed([F.col("a"), F.col("b")])).first()[0] for r in (("1:x", None), ("1", ":x-")))
    assert one != two


def test_requests_are_answered_in_one_plan(spark):
    history = projections.event_history(arrivals(spark))
    rows = [(1, "v1", None, None), (2, "v1", 3, None), (3, "v1", 0, None), (4, "v2", 2, BASE + 20 * S), (5, "nobody", 5, None), (6, "v1", 3, None)]
    asked = spark.createDataFrame(rows, "request_id int, vehicle_id string, k int, since bigint")
    got = {}
    for r in serving.requested_events(asked, history).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["event_id"])
    for number, vehicle, k, since in rows:
        one = serving.recent_events(history.where(F.col("vehicle_id") == vehicle).where(F.lit(since).isNull() | (F.col("occurred_at") >= F.lit(since))), 20 if k is None else k)
        assert got.get(number, []) == [r["event_id"] for r in one.orderBy("rank").collect()]
    with pytest.raises(Exception, match="negative"):
        serving.requested_events(asked.withColumn("k", F.lit(-1)), history).collect()
