"""A stored log with its offsets.

Offsets are numbered once, when the log is written. Files are cut and sorted by partition and offset, so
what asks for offsets is a filter that reaches the scan: files and row groups outside the bounds are not
read, and no reader numbers or sorts anything again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.operators.clock import numbered


def write_log(rows: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Writes a log's rows (``part``, ``seq``, their order of arrival) with ``off``, their offset in the partition from 0.

    ``files``: about how many; Spark's number of shuffle partitions if not given.
    """
    dealt = ("part", "off") if files is None else (files, "part", "off")
    numbered(rows, "part", "seq", "off").repartitionByRange(*dealt).sortWithinPartitions("part", "off").write.mode(mode).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def between(bounds: list[tuple[int, int | None, int | None]]) -> Column:
    """The filter of a bounded replay: of each partition (part, persisted, target) the offsets after the persisted one, if any, up to the target, if any."""
    parts = []
    for part, persisted, target in bounds:
        one = F.col("part") == part
        if persisted is not None:
            one &= F.col("off") > persisted
        if target is not None:
            one &= F.col("off") <= target
        parts.append(one)
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def replay(spark: SparkSession, path: str, bounds: DataFrame) -> DataFrame:
    """The rows of a stored log in some bounds (part, persisted, target): one scan. The bounds are a row a partition of the log."""
    return read_log(spark, path).where(between([(r["part"], r["persisted"], r["target"]) for r in bounds.select("part", "persisted", "target").collect()]))


def ends(spark: SparkSession, path: str) -> DataFrame:
    """The last offset of each partition (part, last), from two columns of the log."""
    return read_log(spark, path).groupBy("part").agg(F.max("off").alias("last"))
