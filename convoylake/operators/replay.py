"""Bounded replay of a log prefix, watermarks and table digests."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_PARTITIONS = {"vehicle-events": 6, "anomalies": 6, "rollups-1m": 3}


def replay_bounded(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows after the persisted offset, if any, up to the target, if any, of their partition (part, persisted, target)."""
    out = events.join(bounds, "part")
    return out.where("(persisted is null or off > persisted) and (target is null or off <= target)").drop("persisted", "target")


def capture_watermark(events: DataFrame) -> DataFrame:
    """The last offset of each partition."""
    return events.groupBy("part").agg(F.max("off").alias("target"), F.min("off").alias("low"))


def replay_complete(reached: DataFrame, bounds: DataFrame) -> DataFrame:
    """Whether every non-negative target is reached: one row."""
    last = reached.groupBy("part").agg(F.max("off").alias("last"))
    return bounds.join(last, "part", "left").agg(F.coalesce(F.bool_and((F.col("target") < 0) | F.coalesce(F.col("last") >= F.col("target"), F.lit(False))), F.lit(True)).alias("complete"))


def replay_since(events: DataFrame, since_ms: int) -> DataFrame:
    """The offset before the first event at or after a time, by partition."""
    return events.where(F.col("occurred_at") >= since_ms).groupBy("part").agg((F.min("off") - 1).alias("seed"))


def table_digest(table: DataFrame, columns: list[Column]) -> DataFrame:
    """Row count and digest of a table's rows as texts, whatever their order and partitioning.

    A row's text is its values with their lengths; the digest is the sums of both halves (60 bits each)
    of the rows' MD5, so it adds up with partial sums and no task holds more than a row. Equal tables
    have equal digests, a row more or less or otherwise changes it.
    """
    texts = [F.coalesce(c.cast("string"), F.lit("~")) for c in columns]
    h = F.md5(F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]).cast("binary"))
    halves = [F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    sums = [F.coalesce(F.sum(x), F.lit(0).cast("decimal(30,0)")).cast("string") for x in halves]
    return table.agg(F.count("*").alias("rows"), F.concat(sums[0], F.lit("-"), sums[1]).alias("digest"))


def unexpected(found: DataFrame, expected: DataFrame, different: bool = False) -> DataFrame:
    """The tables (name, digest) whose digests are not as expected: not equal, or with ``different`` not different."""
    both = found.select("name", F.col("digest").alias("found")).join(expected.select("name", F.col("digest").alias("expected")), "name", "full")
    same = F.col("found").eqNullSafe(F.col("expected"))
    return both.where(same if different else ~same)


def watermark_of(captured: DataFrame, topic: str, captured_at: str) -> dict:
    """A watermark file's content for one topic from ``capture_watermark`` (a row a partition); partitions without events are empty."""
    rows = {r["part"]: r for r in captured.collect()}
    n = range(TOPIC_PARTITIONS[topic])
    return {
        "version": 1, "captured_at": captured_at,
        "topics": {topic: {str(k): rows[k]["target"] if k in rows else -1 for k in n}},
        "low_offsets": {topic: {str(k): rows[k]["low"] if k in rows else 0 for k in n}},
    }


def write_watermark(spark: SparkSession, mark: dict, path: str) -> None:
    """The watermark as one JSON line in a folder of whatever file system Spark writes to."""
    spark.createDataFrame([(json.dumps(mark),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_watermark(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def starting_offsets(reached: DataFrame, topic: str) -> str:
    """Where a replay goes on, as the Kafka source's ``startingOffsets``: after the last offset of each partition (part, last_offset), from the earliest where there is none."""
    last = {r["part"]: r["last_offset"] for r in reached.collect()}  # a row a partition
    return json.dumps({topic: {str(k): last[k] + 1 if k in last else -2 for k in range(TOPIC_PARTITIONS[topic])}})


def validate_watermark(mark: dict) -> list[str]:
    """What is wrong with a watermark file's content; empty if nothing is."""
    out = [] if mark.get("version") == 1 else ["version is not 1"]
    try:
        if datetime.fromisoformat(str(mark.get("captured_at"))).tzinfo is None:
            out.append("captured_at has no zone")
    except ValueError:
        out.append("captured_at cannot be read")
    for part, least in (("topics", -1), ("low_offsets", 0)):
        found = mark.get(part) or {}
        for topic, n in TOPIC_PARTITIONS.items():
            offsets = found.get(topic) or {}
            if set(offsets) != {str(k) for k in range(n)}:
                out.append(f"{part}: partitions of {topic}")
            out += [f"{part}: {topic} {k}" for k, v in offsets.items() if not isinstance(v, int) or v < least]
    if not out:
        out = [f"target below low: {t} {k}" for t, o in mark["topics"].items() for k, v in o.items() if v != -1 and v < mark["low_offsets"][t][k]]
    return out


def available(mark: dict, lows: dict, highs: dict) -> bool:
    """Whether a log still holds a watermark's prefix: lows unchanged, empty partitions still empty, targets retained."""
    for topic, offsets in mark["topics"].items():
        for k, target in offsets.items():
            low, high = lows[topic][k], highs[topic][k]
            if low != mark["low_offsets"][topic][k] or (target == -1 and high != low) or (target >= 0 and not low <= target < high):
                return False
    return True


def canonical_order(topic_rank: int = 0) -> list:
    """Replay order: topic, then partition, then offset."""
    return [F.lit(topic_rank), F.col("part"), F.col("off")]
