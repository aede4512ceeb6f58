"""Digests that find where tables differ: trees of SHA-256 over ranges of the primary keys' hashes.

A row stands in the leaf that the first ``depth`` hexadecimal digits of its key's MD5 name, so leaves have
about the same size whatever the keys are, and a row that is changed, added or missing changes one leaf. A
leaf's digest is that of its rows' digests in key order; a node's is that of its children; the root is the
table's. Rows are digested where they are, so what is shuffled is a key and 64 characters a row, and a
task's group is a leaf: choose ``depth`` such that ``rows / 16 ** depth`` fits a task easily.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 65,536 leaves; about 15,000 rows a leaf in a table of 10^9.
DEPTH = 4


def framed(columns: list[Column]) -> Column:
    """The columns as one text in which no value can pass for another: each with its length, nulls as a sign without one."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _joined(parts: Column, text: str) -> Column:
    """SHA-256 of the texts of structs in their order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda x: x[text]), ""), 256)


def tree(table: DataFrame, keys: list[Column], columns: list[Column], depth: int = DEPTH) -> DataFrame:
    """The nodes of a table's tree: prefix (hexadecimal digits; the root's is empty), rows, digest. Leaves without rows are left out; an empty table is a root alone."""
    key = framed(keys)
    rows = table.select(key.alias("key"), F.sha2(framed([*keys, *columns]), 256).alias("digest"))
    level = rows.groupBy(F.substring(F.md5(F.col("key").cast("binary")), 1, depth).alias("prefix")).agg(F.count("*").alias("rows"), _joined(F.collect_list(F.struct("key", "digest")), "digest").alias("digest"))
    levels = [level]
    for size in range(depth - 1, -1, -1):
        child = F.struct("prefix", F.concat("prefix", "digest").alias("text"))
        above = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), _joined(F.collect_list(child), "text").alias("digest")]
        level = level.groupBy(F.substring("prefix", 1, size).alias("prefix")).agg(*above) if size else level.agg(*above).select(F.lit("").alias("prefix"), "rows", "digest")
        levels.append(level)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out


def root(nodes: DataFrame) -> DataFrame:
    return nodes.where("prefix = ''").select("rows", F.col("digest").alias("root"))


def differing(found: DataFrame, expected: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The leaves (prefix, found_rows, expected_rows) in which two stored trees of one depth differ, searched from the roots along nodes that differ."""
    f, e = (t.select("prefix", F.col("rows").alias(f"{name}_rows"), F.col("digest").alias(name)) for t, name in ((found, "found"), (expected, "expected")))
    open_nodes = None
    for size in range(depth + 1):
        sides = [t.where(F.length("prefix") == size) for t in (f, e)]
        if open_nodes is not None:
            above = open_nodes.select(F.col("prefix").alias("above"))
            sides = [t.join(above, F.substring("prefix", 1, size - 1) == F.col("above"), "left_semi") for t in sides]
        both = sides[0].join(sides[1], "prefix", "full").where(~F.col("found").eqNullSafe(F.col("expected")))
        open_nodes = both.select("prefix", F.coalesce("found_rows", F.lit(0)).alias("found_rows"), F.coalesce("expected_rows", F.lit(0)).alias("expected_rows"))
    return open_nodes


def rows_of_ranges(table: DataFrame, keys: list[Column], leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows of a table that stand in some leaves (prefix)."""
    prefix = F.substring(F.md5(framed(keys).cast("binary")), 1, depth)
    return table.withColumn("_prefix", prefix).join(leaves.select(F.col("prefix").alias("_prefix")), "_prefix", "left_semi").drop("_prefix")
