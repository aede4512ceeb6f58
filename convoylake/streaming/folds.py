"""Read-model tables kept up batch by batch, without folding earlier arrivals again.

The state of a fold is a table of one row a key, in Parquet bucketed and sorted by the key. A batch is
folded by itself, dealt to as many partitions as the state has buckets and joined with it bucket by bucket,
so the state is never exchanged. Vehicles and positions, which have a row a vehicle, are written as a new
version that counts once Spark has marked it done. History, which has a row an event, only grows: events
that the state lacks, or has from a later arrival, are added to its buckets.

All folds are extremes by order of arrival, so a batch that is delivered again, or after a later one, leaves
the state as it would be anyway.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.sources.stored import exists, folders, remove

#: Buckets of a state table; a table keeps the number that it was made with.
BUCKETS = 8

SEEN = "struct<occurred_at:bigint,seq:bigint,region:string,status:string>"
PLACE = "struct<occurred_at:bigint,earlier:bigint,lat:double,lon:double,speed_kph:double,heading_deg:double,battery_pct:double>"
FIRST = "struct<seq:bigint,vehicle_id:string,lat:double,lon:double,speed_kph:double,occurred_at:bigint>"


class Buckets:
    """Parquet in a folder that Spark reads and writes as a table bucketed by a key."""

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> None:
        self.spark, self.path, self.columns, self.key, self.buckets = spark, path, columns, key, buckets
        self.name = f"convoylake_{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        """The table; its catalogue entry is of this session only, what it is made of stands in the folder."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows as the buckets deal them, so that a join with the table needs no exchange of it."""
        return rows.repartition(self.buckets, self.key)


def seen(order: Column) -> Column:
    """What decides a vehicle's region and status: the latest time, then the later arrival."""
    return F.max(F.struct("occurred_at", order.alias("seq"), "region", "status").cast(SEEN)).alias("seen")


def place(order: Column) -> Column:
    """What decides a position: the latest time, then the earlier arrival."""
    return F.max(F.struct("occurred_at", (-order).alias("earlier"), "lat", "lon", "speed_kph", "heading_deg", "battery_pct").cast(PLACE)).alias("place")


class Vehicles:
    """State of vehicles and positions under a folder, version by version."""

    columns = f"vehicle_id string, seen {SEEN}, place {PLACE}"

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, f"{root.rstrip('/')}/vehicles", buckets

    def _versions(self) -> list[str]:
        return [v for v in folders(self.spark, self.root) if exists(self.spark, f"{self.root}/{v}/_SUCCESS")]

    def _table(self, version: str) -> Buckets:
        return Buckets(self.spark, f"{self.root}/{version}", self.columns, "vehicle_id", self.buckets)

    def state(self) -> DataFrame:
        done = self._versions()
        return self._table(done[-1]).read() if done else self.spark.createDataFrame([], self.columns)

    def folded(self, batch: DataFrame) -> DataFrame:
        """The state with a batch's arrivals, which have ``seq``."""
        order = F.col("seq")
        new = self._table("none").dealt(batch).groupBy("vehicle_id").agg(seen(order), place(order))
        both = self.state().alias("s").join(new.alias("n"), "vehicle_id", "full")
        return both.select("vehicle_id", *[F.greatest(f"s.{c}", f"n.{c}").alias(c) for c in ("seen", "place")])

    def fold(self, batch: DataFrame) -> None:
        """Takes a batch in. Versions before the last two go."""
        done = self._versions()
        following = f"v{int(done[-1][1:]) + 1 if done else 0:012d}"
        remove(self.spark, f"{self.root}/{following}")  # of a run that stopped on the way
        self._table(following).write(self.folded(batch), "append")
        for old in done[:-1]:
            remove(self.spark, f"{self.root}/{old}")

    def vehicles(self) -> DataFrame:
        return self.state().select(F.col("vehicle_id").alias("id"), "seen.region", "seen.status", F.col("seen.occurred_at").alias("last_seen"))

    def positions(self) -> DataFrame:
        return self.state().select("vehicle_id", "place.lat", "place.lon", "place.speed_kph", "place.heading_deg", F.col("place.occurred_at").alias("updated_at"), "place.battery_pct")


class History:
    """State of the event history under a folder: the first arrival of each event."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", buckets: int = BUCKETS) -> None:
        self.spark, self.buckets, self.id_type = spark, buckets, id_type
        self.columns = f"event_id {id_type}, first {FIRST}"
        self.table = Buckets(spark, f"{root.rstrip('/')}/history", self.columns, "event_id", buckets)

    def state(self) -> DataFrame:
        """Rows that were added, of some events more than one."""
        return self.table.read() if exists(self.spark, self.table.path) else self.spark.createDataFrame([], self.columns)

    def added(self, batch: DataFrame) -> DataFrame:
        """Of a batch the first arrivals that the state lacks or has from later ones."""
        first = F.min(F.struct("seq", "vehicle_id", "lat", "lon", "speed_kph", "occurred_at").cast(FIRST)).alias("first")
        new = self.table.dealt(batch.withColumn("event_id", F.col("event_id").cast(self.id_type))).groupBy("event_id").agg(first)
        known = self.state().select(F.col("event_id").alias("known"), F.col("first.seq").alias("known_seq"))
        return new.join(known, (F.col("event_id") == F.col("known")) & (F.col("known_seq") <= F.col("first.seq")), "left_anti")

    def fold(self, batch: DataFrame) -> None:
        self.table.write(self.added(batch), "append")

    def events(self) -> DataFrame:
        """The history; a fold inside each bucket."""
        return self.state().groupBy("event_id").agg(F.min("first").alias("first")).select("event_id", "first.vehicle_id", "first.lat", "first.lon", "first.speed_kph", "first.occurred_at")


def fold_stream(stream: DataFrame, root: str, checkpoint: str, id_type: str = "string", **trigger):
    """A running query that keeps vehicles, positions and history up with a stream of arrivals that have ``seq``."""
    spark = stream.sparkSession
    vehicles, history = Vehicles(spark, root), History(spark, root, id_type)

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()  # folded twice
        try:
            vehicles.fold(batch)
            history.fold(batch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
