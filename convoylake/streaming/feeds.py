"""Feeds for many subscribers on one stream, and the list of anomalies that a feed shows.

A query for each subscriber would read the topic once a subscriber. Here one query reads it, each batch is joined
with the subscriptions as they stand when it starts, and what is delivered is written in slots by subscription,
so the number of folders does not grow with the subscribers. Subscriptions change while the query runs; a file
source's static side would be listed once only, so the table is read anew for each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.operators import projections, views
from convoylake.sources.fleet import ANOMALY
from convoylake.sources.stored import exists, folders, remove

#: Folders that a batch's deliveries are dealt to; fixed for a feed's lifetime.
SLOTS = 64


class Versions:
    """A table under a folder as numbered versions, each made from the one before; the last two are kept.

    A version counts once Spark has written all of it. A number that is done is left alone, one that was
    stopped on the way is made again from the same version.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _at(self, number: int) -> str:
        return f"{self.root}/v{number:012d}"

    def done(self) -> list[int]:
        return [int(v[1:]) for v in folders(self.spark, self.root) if exists(self.spark, f"{self.root}/{v}/_SUCCESS")]

    def read(self) -> DataFrame:
        """The rows of the last version that is done; none before the first."""
        found = self.done()
        return self.spark.read.schema(self.schema).parquet(self._at(found[-1])) if found else self.spark.createDataFrame([], self.schema)

    def advance(self, number: int, change: Callable[[DataFrame], DataFrame]) -> None:
        found = self.done()
        if found and number <= found[-1]:
            return
        change(self.read()).write.mode("overwrite").parquet(self._at(number))
        for old in found[:-1]:
            remove(self.spark, self._at(old))


class Subscriptions(Versions):
    """Who gets what: a subscription is for one region, or for all where its region is null."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root, "subscription string, region string")

    def change(self, requests: DataFrame, number: int) -> None:
        """Takes requests (subscription, region, active, seq) in: the last one of a subscription counts; not active ends it."""
        last = projections.last_arrival(requests.select("subscription", "region", "active", "seq"), ["subscription"], "seq")

        def changed(now: DataFrame) -> DataFrame:
            return now.join(last, "subscription", "left_anti").unionByName(last.where("active").select("subscription", "region"))

        self.advance(number, changed)


def fan_out(rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each row once for each subscription of its region or of all regions, with ``subscription``.

    Rows without a region go to those of all regions. An equi-join: Spark broadcasts the subscriptions by their
    measured size, and splits the rows of a region in a skewed sort-merge join beyond it.
    """
    asked = subscriptions.select("subscription", F.col("region").isNull().alias("_all"), F.col("region").alias("_wanted"))
    offered = rows.withColumn("_every", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_from", F.when(~F.col("_every"), F.col("region")))
    met = (F.col("_every") == F.col("_all")) & F.col("_from").eqNullSafe(F.col("_wanted"))
    return offered.join(asked, met).select("subscription", *rows.columns)


class Feed:
    """Deliveries under a folder, by the slot of their subscription."""

    def __init__(self, spark: SparkSession, root: str, slots: int = SLOTS) -> None:
        self.spark, self.root, self.slots = spark, root.rstrip("/"), slots

    def _slot(self, subscription: Column) -> Column:
        return F.pmod(F.xxhash64(subscription), F.lit(self.slots)).cast("int")

    def deliver(self, rows: DataFrame, subscriptions: DataFrame, batch: int, run: str = "0", columns: tuple[str, ...] = ()) -> None:
        """Writes a batch's deliveries; the same batch of a run again replaces them. Slots that are large are split among tasks."""
        out = fan_out(rows, subscriptions)
        out = out.select("subscription", *(columns or rows.columns)).withColumn("slot", self._slot(F.col("subscription")))
        out = out.hint("rebalance", "slot").sortWithinPartitions("slot", "subscription")
        out.write.mode("overwrite").partitionBy("slot").parquet(f"{self.root}/run={run}/batch={batch}")

    def received(self, subscription: str, schema: str) -> DataFrame:
        """What a subscription was sent, read from its slot alone. ``schema``: the feed's columns."""
        names = [c.split()[0] for c in schema.split(", ")]
        if not folders(self.spark, self.root):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(f"subscription string, {schema}, run string, batch bigint, slot int").option("basePath", self.root).parquet(self.root)
        return found.where((F.col("slot") == self._slot(F.lit(subscription))) & (F.col("subscription") == subscription)).select(names)


def shared_feed(stream: DataFrame, subscriptions: Subscriptions, feed: Feed, checkpoint: str, run: str = "0", columns: tuple[str, ...] = (), **trigger):
    """A running query that delivers a stream's rows to all subscriptions. A new checkpoint is a new ``run``; start its stream at the latest offsets, as live feeds are not replayed."""
    out = stream.writeStream.foreachBatch(lambda batch, number: feed.deliver(batch, subscriptions.read(), number, run, columns))
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class VisibleAnomalies(Versions):
    """The newest anomalies of a feed, as many as a view shows, kept up by batches (``views.merge_visible``)."""

    def __init__(self, spark: SparkSession, root: str, limit: int = views.VISIBLE) -> None:
        super().__init__(spark, root, ANOMALY)
        self.limit = limit

    def fold(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of arrivals, which have ``seq``, in, once."""
        names = [c.split()[0] for c in ANOMALY.split(", ")]
        last = projections.last_arrival(batch.select(*names, "seq"), ["anomaly_id"], "seq")
        self.advance(number, lambda now: views.merge_visible(now, last, self.limit))
