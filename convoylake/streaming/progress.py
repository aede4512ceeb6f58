"""Progress of projections by source position, empty batches included.

A log has offsets without records (markers of transactions, compacted records), so the last record taken in
can stay below a replay's target for ever. What a source has been read up to is in each batch's progress
event. ``Progress`` keeps it: a small table of positions a query, one folder a batch, which a restart joins
with the offsets of the records themselves.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from convoylake.operators.replay import TOPIC_PARTITIONS
from convoylake.sources.stored import exists, folders, remove

POSITIONS = "topic string, part int, next_offset bigint"
#: Messages between two markers, and batches of a query whose positions are kept.
MARKER, KEPT = 10_000, 20


def positions(end_offset: str | dict | None) -> list[tuple[str, int, int]]:
    """(topic, partition, next offset) of a source's end offset {topic: {partition: next}}; sources with other offsets have none."""
    found = json.loads(end_offset) if isinstance(end_offset, str) else end_offset
    if not isinstance(found, dict):
        return []
    return sorted((topic, int(part), int(at)) for topic, parts in found.items() if isinstance(parts, dict) for part, at in parts.items() if str(part).isdigit())


class Progress(StreamingQueryListener):
    """Writes the positions of every batch under ``root``; register it with ``spark.streams.addListener``.

    Readers take a query's last folder with Spark's success mark; folders before the last ``KEPT`` go, which
    leaves readers the time to read one. ``marked`` is called at every ``every`` messages of a run.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = MARKER, marked: Callable[[int], None] | None = None) -> None:
        self.spark, self.root, self.every = spark, root.rstrip("/"), every
        self.marked = marked or (lambda n: logging.getLogger(__name__).info("%d messages", n))
        self.messages: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.messages[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        before = self.messages.get(str(p.runId), 0)
        now = self.messages[str(p.runId)] = before + p.numInputRows
        for n in range(before // self.every + 1, now // self.every + 1):
            self.marked(n * self.every)
        rows = [row for source in p.sources for row in positions(source.endOffset)]
        if not rows:
            return
        mine = f"{self.root}/query={p.id}"
        self.spark.createDataFrame(rows, POSITIONS).coalesce(1).write.mode("overwrite").parquet(f"{mine}/batch={p.batchId:012d}")
        for old in folders(self.spark, mine)[:-KEPT]:
            remove(self.spark, f"{mine}/{old}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.messages.pop(str(event.runId), None)


def reached(spark: SparkSession, root: str, offsets: DataFrame | None = None, topic: str = "vehicle-events") -> DataFrame:
    """The last position that is done of each partition of a topic (part, last): by progress, and by the records taken in (part, last_offset), if given."""
    last = []
    for query in folders(spark, root):
        done = [b for b in folders(spark, f"{root}/{query}") if exists(spark, f"{root}/{query}/{b}/_SUCCESS")]
        last += [f"{root}/{query}/{b}" for b in done[-1:]]
    found = spark.read.schema(POSITIONS).parquet(*last) if last else spark.createDataFrame([], POSITIONS)
    rows = found.where(F.col("topic") == topic).select("part", (F.col("next_offset") - 1).alias("last"))
    if offsets is not None:
        rows = rows.unionByName(offsets.select(F.col("part").cast("int").alias("part"), F.col("last_offset").alias("last")))
    return rows.groupBy("part").agg(F.max("last").alias("last"))


def resume_offsets(done: DataFrame, topic: str = "vehicle-events") -> str:
    """``startingOffsets`` after what is done (part, last), gaps included; from the earliest where nothing is."""
    last = {r["part"]: r["last"] for r in done.collect()}  # a row a partition
    return json.dumps({topic: {str(k): last[k] + 1 if k in last else -2 for k in range(TOPIC_PARTITIONS[topic])}})


def completed(done: DataFrame, bounds: DataFrame) -> bool:
    """Whether every target that is not negative (part, target) is done, be it a record or a gap."""
    left = bounds.where("target >= 0").join(done, "part", "left").where(F.coalesce(F.col("last") < F.col("target"), F.lit(True)))
    return left.isEmpty()


def batch_progress(log: DataFrame, ends: DataFrame, step: int) -> DataFrame:
    """What a replay in batches of ``step`` offsets reports of a stored log: part, batch, next_offset, records, last (its last record so far).

    ``ends`` has the first offset that is not in the log by partition (part, next_offset). Batches without records are
    reported too. Needs ``part`` and ``off``.
    """
    counts = log.groupBy("part", F.floor(F.col("off") / step).cast("bigint").alias("batch")).agg(F.count("*").alias("records"), F.max("off").alias("top"))
    batches = ends.select("part", F.col("next_offset").alias("end"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(next_offset - 1) div {step}"))).alias("batch"))
    rows = batches.join(counts, ["part", "batch"], "left")
    so_far = Window.partitionBy("part").orderBy("batch")
    return rows.select("part", "batch", F.least((F.col("batch") + 1) * step, F.col("end")).alias("next_offset"), F.coalesce("records", F.lit(0)).cast("bigint").alias("records"), F.max("top").over(so_far).alias("last"))
