"""Projection of topics into the read model: arrivals are appended, tables are folds of them.

Each micro-batch of a topic becomes one folder of its arrivals, named by the run and the batch, so a batch
that is delivered again replaces itself, a run with a new checkpoint replaces nothing, and no earlier batch
is rewritten. Batches of several schema versions stand side by side and are read by name. A table of the
read model is the batch fold of its topic's arrivals (``operators.projections``). All files are written and
read by Spark.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.operators import projections
from convoylake.sources.fleet import ANOMALY, EVENT_V2, ROLLUP
from convoylake.sources.stored import folders, remove

#: Topic -> columns of its records; ``seq`` is derived where a topic's records come without it.
TOPICS = {topic: f"{columns}, part int, off bigint" for topic, columns in (("vehicle-events", EVENT_V2), ("anomalies", ANOMALY), ("rollups-1m", ROLLUP))}
#: Columns that a topic's first schema version lacks.
ADDED = {"vehicle-events": {"battery_pct": "double"}}
#: Folder of the offsets that a reset has set.
SEEDS = "_seeds"
#: Partitions of a topic are fewer; the order of arrival of records without ``seq`` is by offset, then partition.
PARTITION_LIMIT = 1024

#: Table -> the topic that it is folded from and the fold.
TABLES = {
    "vehicles": ("vehicle-events", projections.vehicles_current),
    "vehicle_positions": ("vehicle-events", projections.positions_current),
    "vehicle_events": ("vehicle-events", projections.event_history),
    "anomalies": ("anomalies", lambda rows: projections.last_arrival(rows, ["anomaly_id"], "seq")),
    "region_rollups": ("rollups-1m", lambda rows: projections.last_arrival(rows, ["region", "window_start"], "seq")),
}


class ReadModel:
    """Arrivals of the topics under a folder, and the tables that they make. Rows carry ``part`` and ``off`` and may carry ``seq``, their order of arrival."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, topic: str, batch: DataFrame, batch_id: int, run: str = "0") -> None:
        """Takes a batch of a run in; the same batch again has no effect."""
        places = {c: F.col(c).cast(kind) for c, kind in (("part", "int"), ("off", "bigint"), ("seq", "bigint")) if c in batch.columns}
        batch.withColumns(places).write.mode("overwrite").parquet(f"{self.root}/{topic}/run={run}/batch={batch_id}")

    def arrivals(self, topic: str) -> DataFrame:
        """A topic's records, columns that their schema version lacks as nulls; none of a topic without batches.

        Without ``seq`` the order of arrival is that of offsets: folds are by key, and a key is in one partition.
        """
        if folders(self.spark, f"{self.root}/{topic}"):
            rows = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.root}/{topic}").parquet(f"{self.root}/{topic}").drop("run", "batch")
        else:
            rows = self.spark.createDataFrame([], TOPICS[topic])
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in ADDED.get(topic, {}).items() if c not in rows.columns})
        order = F.col("off").cast("bigint") * PARTITION_LIMIT + F.col("part")
        return rows.withColumn("seq", F.coalesce("seq", order) if "seq" in rows.columns else order)

    def table(self, name: str, as_of_ms: int | None = None) -> DataFrame:
        """A table as its topic's arrivals make it; history without what is more than a day older than ``as_of``, where that is given."""
        topic, fold = TABLES[name]
        out = fold(self.arrivals(topic).drop(*([] if topic == "vehicle-events" else ["part", "off"])))
        return projections.retained(out, as_of_ms) if name == "vehicle_events" and as_of_ms is not None else out

    def offsets(self, topic: str) -> DataFrame:
        """The last offset of each partition that was taken in or seeded; a batch that comes late does not lower it."""
        taken = projections.offsets_current(self.arrivals(topic))
        if topic not in folders(self.spark, f"{self.root}/{SEEDS}"):
            return taken
        seeds = self.spark.read.schema("part int, last_offset bigint").parquet(f"{self.root}/{SEEDS}/{topic}")
        return taken.unionByName(seeds).groupBy("part").agg(F.max("last_offset").alias("last_offset"))

    def reset(self, confirm: str, seeds: dict[str, DataFrame] | None = None) -> None:
        """Empties the read model and seeds the offsets (part, seed) from which topics are replayed: records after them come next.

        ``confirm`` must be the model's folder. A folder that holds anything but a read model is refused before
        anything is removed.
        """
        seeds = seeds or {}
        if confirm.rstrip("/") != self.root or self.root.count("/") < 2:
            raise ValueError("confirm the reset with the read model's folder")
        if strange := [f for f in folders(self.spark, self.root) if f not in TOPICS and f != SEEDS]:
            raise ValueError(f"not a read model: it holds {', '.join(strange)}")
        if unknown := seeds.keys() - TOPICS.keys():
            raise ValueError(f"no such topics: {', '.join(sorted(unknown))}")
        staged = {topic: [(r["part"], r["seed"]) for r in df.select("part", "seed").collect()] for topic, df in seeds.items()}  # a row a partition
        for folder in (*TOPICS, SEEDS):
            remove(self.spark, f"{self.root}/{folder}")
        for topic, rows in staged.items():
            self.spark.createDataFrame(rows, "part int, last_offset bigint").coalesce(1).write.parquet(f"{self.root}/{SEEDS}/{topic}")


def project(stream: DataFrame, topic: str, root: str, checkpoint: str, **trigger):
    """A running query that takes a topic's records into the read model, under its own id: a new checkpoint is a new run."""
    model = ReadModel(stream.sparkSession, root)
    run: list[str] = []
    known = threading.Event()

    def take(batch: DataFrame, number: int) -> None:
        if not known.wait(60):
            raise RuntimeError("the query did not start")
        model.append(topic, batch, number, run[0])

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    run.append(query.id)
    known.set()
    return query
