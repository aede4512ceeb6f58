"""The windowed jobs on Structured Streaming.

``rollup_stream`` and ``anomaly_stream`` use Spark's watermark: one clock for all partitions, and lateness
decided by micro-batch. ``convoylake.streaming.exact`` has the jobs with the stored-log meaning.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.functions.scalars import anomaly_id
from convoylake.operators.clock import GRACE_MS
from convoylake.operators.windows import violates
from convoylake.sources.fleet import EVENT_V2

#: Without this, rows are late by the watermark before last when batches follow each other at once.
ONE_WATERMARK = ("spark.sql.streaming.statefulOperator.allowMultiple", "false")


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A log as a folder of Parquet files, in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """A topic's raw records; needs the package ``spark-sql-kafka-0-10`` of the Spark version on the class path. ``starting`` may be ``replay.starting_offsets``."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()


def unframed(records: DataFrame) -> DataFrame:
    """Records with the registry's frame taken off ``value``: a zero byte, the ``schema_id`` in four bytes, then the Avro ``body``. Other values have a null id and body."""
    framed = (F.octet_length("value") > 5) & (F.hex(F.substring("value", 1, 1)) == "00")
    schema_id = F.conv(F.hex(F.substring("value", 2, 4)), 16, 10).cast("bigint")
    return records.withColumns({"schema_id": F.when(framed, schema_id), "body": F.when(framed, F.expr("substring(value, 6)"))})


def frame(body: Column, schema_id: int) -> Column:
    """A body behind the registry's frame: what ``unframed`` takes off."""
    return F.concat(F.unhex(F.lit(f"00{schema_id:08X}")), body)


def avro_schema(name: str, ddl: str, nullable: tuple[str, ...] = (), enums: dict[str, tuple[str, ...]] | None = None) -> str:
    """An Avro record schema of a Spark schema's columns; nullable ones are a union with null, null by default."""
    kinds = {"string": "string", "double": "double", "bigint": "long", "int": "int"}
    fields = []
    for part in ddl.split(","):
        field, kind = part.split()
        of = {"type": "enum", "name": field.title().replace("_", ""), "symbols": list(enums[field])} if enums and field in enums else kinds[kind]
        fields.append({"name": field, "type": ["null", of], "default": None} if field in nullable else {"name": field, "type": of})
    return json.dumps({"type": "record", "name": name, "fields": fields})


def decoded(records: DataFrame, writers: dict[int, str], topic_columns: tuple[str, ...] = ("partition", "offset"), columns: str = EVENT_V2) -> DataFrame:
    """Rows (vehicle events, or those of other ``columns``) of raw records by the writer schema that each names (id -> Avro schema), with ``part`` and ``off``; needs the package ``spark-avro``. Values of unknown schemas fail, null values (tombstones) are left out."""
    from pyspark.sql.avro.functions import from_avro

    rows = unframed(records.where("value is not null"))
    kinds = dict(f.split() for f in columns.split(", "))
    event = F.raise_error(F.concat(F.lit("no writer schema "), F.coalesce(F.col("schema_id").cast("string"), F.lit("in frame"))))
    event = event.cast(f"struct<{', '.join(f'{n}:{k}' for n, k in kinds.items())}>")
    for number, schema in writers.items():
        v = from_avro("body", schema, {"mode": "FAILFAST"})
        has = {f["name"] for f in json.loads(schema)["fields"]}
        one = F.struct(*[(v[n] if n in has else F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()])
        event = F.when(F.col("schema_id") == number, one).otherwise(event)
    part, off = topic_columns
    return rows.select(event.alias("e"), F.col(part).alias("part"), F.col(off).alias("off")).select("e.*", "part", "off")


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """Records for a topic sink: the key column's text and the row as JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def framed(rows: DataFrame, key: str, schema_id: int, schema: str) -> DataFrame:
    """Records for a topic sink: the key column's text and the row as Avro behind the registry's frame, as ``decoded`` reads it; needs the package ``spark-avro``."""
    from pyspark.sql.avro.functions import to_avro

    fields = [f["name"] for f in json.loads(schema)["fields"]]
    return rows.select(F.col(key).cast("string").alias("key"), frame(to_avro(F.struct(*fields), schema), schema_id).alias("value"))


def topic_sink(stream: DataFrame, key: str, topic: str, servers: str, checkpoint: str, writer: tuple[int, str] | None = None):
    """A running query that sends a job's rows to a topic, keyed (anomalies by vehicle, rollups by region), at least once; needs the Kafka package. ``writer``: the id and Avro schema of framed values, JSON without it."""
    records = framed(stream, key, *writer) if writer else keyed(stream, key)
    return records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def folder_sink(stream: DataFrame, path: str, checkpoint: str):
    """A running query that appends a job's rows to a folder of Parquet files by region, each once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("region").trigger(availableNow=True).start()


def live(stream: DataFrame, region: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """A live feed: the stream's rows of one region (of all for None), with the columns that the feed shows. Start it at the latest offsets and with a checkpoint of its own; it is not resumed."""
    rows = stream if region is None else stream.where(F.col("region") == region)
    return rows.select(*columns) if columns else rows


def _timed(events: DataFrame) -> DataFrame:
    events.sparkSession.conf.set(*ONE_WATERMARK)
    return events.where("occurred_at is not null").withColumn("ts", F.timestamp_millis("occurred_at")).withWatermark("ts", f"{GRACE_MS} milliseconds")


def _bounds(*columns) -> list:
    return [*columns, F.unix_millis("window.start").alias("window_start"), F.unix_millis("window.end").alias("window_end")]


def rollup_stream(events: DataFrame) -> DataFrame:
    """One-minute rollups by region, each once, when its window closes (append mode)."""
    active = F.col("status") == "ACTIVE"
    out = _timed(events).groupBy("region", F.window("ts", "1 minute")).agg(
        F.count("*").alias("event_count"), F.size(F.collect_set(F.when(active, F.col("vehicle_id")))).alias("active_vehicles"), F.coalesce(F.avg(F.when(active, F.col("speed_kph"))), F.lit(0.0)).alias("avg_speed_kph")
    )
    return out.select(*_bounds("region"), "event_count", "active_vehicles", "avg_speed_kph")


def anomaly_stream(events: DataFrame) -> DataFrame:
    """Speed anomalies by vehicle, each once, when its window closes (append mode)."""
    v = violates(F.col("speed_kph"))
    out = _timed(events).groupBy("vehicle_id", F.window("ts", "5 minutes", "1 minute")).agg(F.count_if(v).alias("violations"), F.max(F.when(v, F.col("speed_kph"))).alias("value"), F.max(F.when(v, F.struct("off", "region"))).getField("region").alias("region"))
    out = out.where("violations >= 1").select(*_bounds("vehicle_id", "region", "value"))
    return out.withColumn("anomaly_id", anomaly_id(F.col("vehicle_id"), F.col("window_start")))
