"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 4_000_000

#: Setting by which the shuffle files of a query go when it ends, rather than when the driver's garbage collection gets to them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes to bytes: A-Z to a-z, 0-9 a-z and bytes of non-ASCII characters kept, every other byte to a space.
ALNUM = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="convoylake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation.

    Nothing needs the shuffles behind it any more; their files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/convoylake/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files behind a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string or binary column as Python bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return (col if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else col.cast(pa.binary())).to_pylist()


def rows_out(schema: pa.Schema, size: int = 2000) -> Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]:
    """Turns an iterator of tuples into record batches of at most ``size`` rows."""

    def pack(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) >= size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return pack


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column ``name`` has at most about ``limit`` bytes in each; a longer value is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(ends[end - 1])


class Kept:
    """Columns that an operator hands through beside its own, as the Arrow arrays that they came in: names prefixed on the way, so that none clash."""

    def __init__(self, docs: DataFrame, keep: tuple[str, ...]) -> None:
        self.names = tuple(keep)
        self.inner = [f"keep_{c}" for c in self.names]
        self.ddl = "".join(f", `keep_{f.name}` {f.dataType.simpleString()}" for f in (docs.select(*self.names).schema if self.names else []))

    @property
    def columns(self) -> list:
        return [F.col(c).alias(f"keep_{c}") for c in self.names]

    def beside(self, batch: pa.RecordBatch, **own: pa.Array) -> pa.RecordBatch:
        """The operator's own columns of a slice and the kept ones of the same rows."""
        kept = {c: batch.column(batch.schema.get_field_index(c)) for c in self.inner}
        return pa.RecordBatch.from_pydict(own | kept)

    def restore(self, df: DataFrame) -> DataFrame:
        """Kept columns under their names, in place of result columns of the same name."""
        return df.drop(*self.names).withColumnsRenamed({f"keep_{c}": c for c in self.names})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (id, component): the smallest id that each id reaches.

    Each round hooks every root to its smallest neighbour, flattens the trees by pointer jumping
    and contracts the edges; only roots that still have edges stay in play, and at least half of
    them go in every round. Edges are aggregated with map-side combine, so a node with very many
    neighbours costs no more than its edges. Ids without edges are not returned. Every round's
    tables are written to the shared folder.
    """
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionAll(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up = store(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("parent")))
        while True:
            over = up.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            jumped = store(up.join(over, "parent").select("id", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
            still = not jumped.where("moved").isEmpty()
            forget(up)
            up = jumped.select("id", "parent")
            if not still:
                break
        if labels is None:
            labels = up.select("id", F.col("parent").alias("component"))
        else:
            step = up.select(F.col("id").alias("component"), F.col("parent"))
            labels = store(labels.join(step, "component", "left").select("id", F.coalesce("parent", "component").alias("component")))
        a, b = (up.select(F.col("id").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        left = store(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        forget(edges)
        edges = left
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
