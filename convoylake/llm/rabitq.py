"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are assigned to the nearest of some centroids (fitted on a bounded sample) and their residuals
are rotated at random and kept as one bit a dimension with two scalars: the residual's length and the
inner product of its direction with its code. From those an unbiased estimate of the inner product with
a query follows, with an error bound; in each probed cell, only vectors whose lower bound of the distance
is within reach are measured exactly, on the original vectors.

A query is searched twice. First its nearest cells give k distances, so the k-th of them bounds what can still
be among its nearest. Then it goes to those other cells that can hold a vector within that bound - by the
distance of the centroid and the radius of the cell, both exact - and only vectors whose lower bound is
within it are measured. No share of cells is fixed: where vectors cluster, few cells are left, where they do not,
all are. Only the error bounds of codes can lose a neighbour.

A cell is dealt out in blocks by a hash of the id, so a crowded cell is many tasks; blocks grow with the square root
of the table up to ``BLOCK_BYTES``, as queries are sent to each block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoylake.llm.common import rows_out, store, table

#: Values of the sample that centroids are fitted on, at most; rounds of k-means.
SAMPLE_VALUES, ROUNDS = 2_000_000, 8
#: Vectors of a block at least, about, and bytes of vectors in one at most.
BLOCK, BLOCK_BYTES = 2_048, 32_000_000
#: Cells that a query is searched in first, at least, and vectors that they hold for each that is asked for.
FIRST_CELLS, FIRST_VECTORS = 2, 20
#: Width of the error bound; the chance to miss falls as exp(-width**2 / 2).
WIDTH = 3.0


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = cell_order(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def cell_order(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centres of each row."""
    d = (centres * centres).sum(axis=1) - 2 * x @ centres.T
    if probes >= len(centres):
        return np.argsort(d, axis=1, kind="stable")
    part = np.argpartition(d, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def encode(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, residual lengths and correction scalars of the rows of ``v``."""
    r = v - centre
    length = np.sqrt((r * r).sum(axis=1))
    turned = (r / np.where(length > 0, length, 1)[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / math.sqrt(v.shape[1])


def candidates(code: np.ndarray, length: np.ndarray, scalar: np.ndarray, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, reach: np.ndarray) -> np.ndarray:
    """For each query row a mask of the vectors that bounds cannot rule out of the k nearest, nor of those within the query's reach."""
    d = q.shape[1]
    r = q - centre
    far = np.sqrt((r * r).sum(axis=1))
    turned = (r / np.where(far > 0, far, 1)[:, None]) @ turn
    signs = np.unpackbits(code, axis=1, count=d).astype(np.float64) * 2 - 1
    c = np.where(scalar > 0, scalar, 1.0)
    estimate = (turned @ signs.T) / math.sqrt(d) / c
    error = np.sqrt(np.maximum(0, 1 - c * c)) / c * WIDTH / math.sqrt(max(1, d - 1))
    square = length * length + (far * far)[:, None]
    scale = 2 * length * far[:, None]
    low, high = square - scale * (estimate + error), square - scale * (estimate - error)
    most = (reach * reach)[:, None]
    if len(length) > k:
        most = np.minimum(most, np.partition(high, k - 1, axis=1)[:, k - 1 : k])
    return low <= most + 1e-9 * np.where(np.isinf(most), 0, np.abs(most))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries`` by Euclidean distance, as found by the index.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the distance in double
    precision), ties to smaller ids; a query's own id is no candidate. Rows with a null id, and
    vectors that are null, zero, or hold null or non-finite values, or differ in dimension from the
    majority, take no part. Repeated query rows count once (of different vectors under one id, the least by its values), repeated vectors as often as they occur.
    Fewer than k candidates give fewer rows, empty tables an empty result.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))

    schema = "query_id long, rank int, vec_id long, score double"
    everything, asked = valid(vectors), valid(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = everything.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["count"]
    everything, asked = everything.where(F.size("v") == d), asked.where(F.size("v") == d)
    cells = max(1, math.ceil(math.sqrt(n) / 4))
    wanted = min(n, max(cells, SAMPLE_VALUES // d))
    share = min(1.0, 1.2 * wanted / n)
    # the sample is drawn by a hash of the id; its size is bounded
    drawn = everything.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(wanted)
    sample = np.array([r["v"] for r in drawn.select("v").collect()])
    if not len(sample):
        sample = np.array([r["v"] for r in everything.limit(wanted).collect()])
    centres, turn = kmeans(sample, cells), rotation(d)
    sent = spark.sparkContext.broadcast((centres, turn))

    def assign(batches):
        centres, turn = sent.value

        def rows():
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy().reshape(-1, d)
                cell = cell_order(x, centres, 1)[:, 0]
                ids = batch.column(0).to_numpy()
                for c in np.unique(cell).tolist():
                    own = np.flatnonzero(cell == c)
                    for i, code, length, scalar, v in zip(ids[own].tolist(), *encode(x[own], centres[c], turn), x[own], strict=True):
                        yield i, c, code.tobytes(), float(length), float(scalar), v.tobytes()

        return rows_out(pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("code", pa.binary()), ("length", pa.float64()), ("scalar", pa.float64()), ("v", pa.binary())]), 4000)(rows())

    index = store(everything.mapInArrow(assign, "id long, cell int, code binary, length double, scalar double, v binary"))
    per_block = int(max(min(max(BLOCK, 8 * math.sqrt(n)), BLOCK_BYTES // (8 * d)), 1))
    cells_of = store(index.groupBy("cell").agg(F.count("*").alias("n"), F.max("length").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / F.lit(per_block)).cast("int")))
    # a row a centroid, and those are on the driver anyway
    held, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for r in cells_of.collect():
        held[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    sizes_sent = spark.sparkContext.broadcast((held, radius))
    index = index.join(cells_of.select("cell", "blocks"), "cell").select("id", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "code", "length", "scalar", "v")
    parts = cells_of.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def probe(first: bool):
        def run(batches):
            (centres, _), (held, radius) = sent.value, sizes_sent.value

            def rows():
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x = batch.column(1).flatten().to_numpy().reshape(-1, d)
                    order = cell_order(x, centres, len(centres))
                    for i, v, near, reach in zip(batch.column(0).to_pylist(), x, order, batch.column(2).to_pylist(), strict=True):
                        enough = max(FIRST_CELLS, int(np.searchsorted(np.cumsum(held[near]), FIRST_VECTORS * k)) + 1)
                        if first:
                            chosen = near[:enough]
                        else:
                            rest = near[enough:]
                            gap = np.sqrt(((centres[rest] - v) ** 2).sum(axis=1)) - radius[rest]
                            chosen = rest[gap <= reach * (1 + 1e-9)]
                        for c in chosen[held[chosen] > 0].tolist():
                            yield i, c, v.tobytes(), reach

            return rows_out(pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("v", pa.binary()), ("reach", pa.float64())]), 4000)(rows())

        return run

    def search(key, rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        centres, turn = sent.value
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(rows) or not len(qs):
            return none
        centre = centres[key[0]]
        v = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(-1, d)
        code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(v), -1)
        ids, length, scalar = (rows[c].to_numpy() for c in ("id", "length", "scalar"))
        out = []
        at_once = max(1, 4_000_000 // len(v))
        for at in range(0, len(qs), at_once):
            part = qs.iloc[at : at + at_once]
            q, reach = np.frombuffer(b"".join(part["v"]), np.float64).reshape(-1, d), part["reach"].to_numpy()
            # one more than asked for, as the query itself may be among them
            for i, x, far, mask in zip(part["id"].to_numpy(), q, reach, candidates(code, length, scalar, q, centre, turn, k + 1, reach), strict=True):
                pick = np.flatnonzero(mask & (ids != i))
                diff = v[pick] - x
                dist = np.sqrt((diff * diff).sum(axis=1))
                best = np.lexsort((ids[pick], dist))[:k]
                best = best[dist[best] <= far]
                if len(best):
                    out.append(pd.DataFrame({"query_id": i, "vec_id": ids[pick][best], "score": dist[best]}))
        return pd.concat(out) if out else none

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        probing = queries.mapInArrow(probe(first), "id long, cell int, v binary, reach double").join(parts, "cell")
        return index.groupBy("cell", "block").cogroup(probing.groupBy("cell", "block")).applyInPandas(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = store(best(searched(asked.select("id", "v", F.lit(float("inf")).alias("reach")), True)).drop("rank"))
    reach = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.max("score")).alias("reach"))
    again = asked.join(reach, "id", "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    return best(near.unionByName(searched(again, False))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op4_rabitq": op4_rabitq}
ORACLES = {}
