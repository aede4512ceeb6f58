"""The windowed jobs on streams with the stored-log meaning, however the log is cut into batches.

Spark's watermark is one clock for all partitions and moves between batches; the jobs have a clock for each
partition or region that moves with every record. A job here is a fold: each batch's records get their clock
as running maxima that go on from the clocks so far, count in the windows that are open to them, and are
joined with the open windows of the batches before. Windows that the clocks have passed are written once and
leave the state. All of it is joins and aggregates of Spark; the state, one row a window and vehicle, is
bucketed and not exchanged.

Every batch has a number and makes one version of the state from the one before. Results are written under
the batch's number before its version is marked done, and readers only take results of versions that are.
A batch that was stopped anywhere on the way is made again from the same state and replaces what it wrote,
so each window shows exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.operators.clock import GRACE_MS, MINUTE_MS, event_clock, open_windows
from convoylake.operators.windows import anomalies_of, violates
from convoylake.sources.stored import exists, folders, remove
from convoylake.streaming.folds import BUCKETS, Buckets

CLOCK = "key string, at bigint"
SUMS = "n bigint, active bigint, speed double, violations bigint, value double, last struct<seq:bigint,region:string>"
OPEN = f"slot string, key string, vehicle_id string, window_start bigint, {SUMS}"


class WindowedJob:
    """A windowed job under a folder. ``clock_key``: the column whose values have clocks of their own."""

    #: Columns of a result, and whether only records above the speed limit count in windows.
    columns: str
    violations_only = False

    def __init__(self, spark: SparkSession, root: str, clock_key: str, size_ms: int, hop_ms: int = MINUTE_MS, grace_ms: int = GRACE_MS, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.clock_key, self.buckets = spark, root.rstrip("/"), clock_key, buckets
        self.size, self.hop, self.grace = size_ms, hop_ms, grace_ms

    def committed(self) -> list[int]:
        """Numbers of the batches that are done and whose state is still kept."""
        return [int(v[1:]) for v in folders(self.spark, f"{self.root}/state") if exists(self.spark, f"{self.root}/state/{v}/done/_SUCCESS")]

    def _version(self, number: int) -> str:
        return f"{self.root}/state/v{number:012d}"

    def _open(self, number: int) -> Buckets:
        return Buckets(self.spark, f"{self._version(number)}/open", OPEN, "slot", self.buckets)

    def _before(self, number: int) -> tuple[DataFrame, DataFrame]:
        """Clocks and open windows before a batch."""
        done = [k for k in self.committed() if k < number]
        if not done:
            return self.spark.createDataFrame([], CLOCK), self.spark.createDataFrame([], OPEN)
        return self.spark.read.schema(CLOCK).parquet(f"{self._version(done[-1])}/clocks"), self._open(done[-1]).read()

    def folded(self, batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """The clocks after a batch, and all windows with their clock (``at``)."""
        clocks, state = self._before(number)
        rows = batch.where("occurred_at is not null").withColumn("key", F.col(self.clock_key).cast("string"))
        now = clocks.unionAll(rows.groupBy("key").agg(F.max("occurred_at").alias("at"))).groupBy("key").agg(F.max("at").alias("at"))
        timed = event_clock(rows, "key", "seq").join(clocks, "key", "left").withColumn("clock", F.greatest("clock", "at")).drop("at")
        v, active = violates(F.col("speed_kph")), F.col("status") == "ACTIVE"
        windows = open_windows(timed.where(v) if self.violations_only else timed, self.size, self.hop, self.grace)
        windows = windows.withColumn("slot", F.concat_ws("|", "key", "window_start", "vehicle_id"))
        new = self._open(number).dealt(windows).groupBy("slot").agg(
            *[F.first(c).alias(c) for c in ("key", "vehicle_id", "window_start")], F.count("*").alias("n"), F.count_if(active).alias("active"), F.sum(F.when(active, F.col("speed_kph"))).alias("speed"),
            F.count_if(v).alias("violations"), F.max(F.when(v, F.col("speed_kph"))).alias("value"), F.max(F.when(v, F.struct("seq", "region"))).alias("last"),
        )
        both = state.alias("s").join(new.alias("n"), "slot", "full")
        either = [F.coalesce(f"s.{c}", f"n.{c}").alias(c) for c in ("key", "vehicle_id", "window_start")]
        sums = [(F.coalesce(f"s.{c}", F.lit(0)) + F.coalesce(f"n.{c}", F.lit(0))).alias(c) for c in ("n", "active", "speed", "violations")]
        merged = both.select("slot", *either, *sums, F.greatest("s.value", "n.value").alias("value"), F.greatest("s.last", "n.last").alias("last"))
        return now, merged.join(now, "key")

    def fold(self, batch: DataFrame, number: int) -> None:
        """Takes a batch in, once: a number that is done is left alone."""
        if (done := self.committed()) and number <= done[-1]:
            return
        remove(self.spark, self._version(number))
        now, windows = self.folded(batch, number)
        shut = F.col("window_start") + self.size + self.grace <= F.col("at")
        windows = windows.persist()  # goes to results and to the state
        try:
            closed = windows.where(shut).withColumn("window_end", F.col("window_start") + self.size)
            self.results_of(closed).write.mode("overwrite").parquet(f"{self.root}/results/batch={number}")
            now.write.parquet(f"{self._version(number)}/clocks")
            self._open(number).write(windows.where(~shut).drop("at").select(*[c.split()[0] for c in OPEN.split(", ")]), "append")
        finally:
            windows.unpersist()
        self.commit(number)
        for old in done[:-1]:
            remove(self.spark, self._version(old))

    def commit(self, number: int) -> None:
        self.spark.range(1).write.parquet(f"{self._version(number)}/done")

    def results(self) -> DataFrame:
        """Windows that batches which are done have closed."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], self.columns)
        found = self.spark.read.schema(f"{self.columns}, batch bigint").parquet(f"{self.root}/results")
        return found.where(F.col("batch") <= done[-1]).drop("batch")

    def results_of(self, closed: DataFrame) -> DataFrame:
        raise NotImplementedError


class Rollups(WindowedJob):
    """One-minute rollups by region, distinct vehicles counted."""

    columns = "region string, window_start bigint, window_end bigint, event_count bigint, active_vehicles int, avg_speed_kph double"

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, root, "region", MINUTE_MS, buckets=buckets)

    def results_of(self, closed: DataFrame) -> DataFrame:
        return closed.groupBy(F.col("key").alias("region"), "window_start", "window_end").agg(
            F.sum("n").alias("event_count"), F.count_if(F.col("active") > 0).cast("int").alias("active_vehicles"), F.coalesce(F.try_divide(F.sum("speed"), F.sum("active")), F.lit(0.0)).alias("avg_speed_kph")
        )


class Anomalies(WindowedJob):
    """Five-minute speed anomalies by vehicle, clocks by log partition."""

    columns = "anomaly_id string, vehicle_id string, region string, kind string, value double, detector_version int, window_start bigint, window_end bigint"
    violations_only = True

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, root, "part", 5 * MINUTE_MS, buckets=buckets)

    def results_of(self, closed: DataFrame) -> DataFrame:
        return anomalies_of(closed.withColumn("region", F.col("last.region")))


def exact_stream(stream: DataFrame, job: WindowedJob, checkpoint: str, **trigger):
    """A running query that takes a stream of arrivals, which have ``seq``, into a job."""
    out = stream.writeStream.foreachBatch(lambda batch, number: job.fold(batch, number)).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
