"""Suffix-array deduplication with a logarithmic index family.

A byte goes when a string of ``LENGTH`` bytes that covers it starts at another place as well. Every
window of that length has one anchor: its leftmost gram of ``GRAM`` bytes with the smallest hash.
Equal windows have equal anchors at equal offsets, so windows can repeat only among the occurrences of
one anchor, and an occurrence needs no more of the text than its own windows (its context, at most
2 * LENGTH - GRAM bytes). Anchors that occur once are done; where all occurrences of an anchor have
equal contexts, all their windows repeat. The distinct contexts of what is left are dealt to buckets by
anchor, and each bucket takes them in batches into an index family: a batch gets suffix arrays around
the anchors (to the right, and to the left of reversed text) with common-prefix lengths, is
merge-scanned against each existing level for windows that agree, and levels of one size merge, so
their sizes grow geometrically. Documents that come in batches are kept the same way one storey higher
(``RepeatIndex``): a level is a stored table of anchors, a new batch is scanned by itself and joined by
anchor with each level, and levels of one size merge.

Shuffled are anchors (about one in 70 bytes), the distinct contexts and, once, the texts. An anchor
with more than ``MOST`` distinct contexts is not put into one bucket; its windows are counted one by
one instead, with partial sums, so no group has to fit a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import Kept, column_bytes, mix, rows_out, slices, store, table

LENGTH, GRAM = 200, 64
#: Distinct contexts of an anchor that one bucket takes at most.
MOST = 20_000
#: Contexts of a bucket, about, and of a batch.
BUCKET, BATCH = 16_000, 4_000
_TABLES = tuple(mix(np.arange(k + 1, k + 257, dtype=np.uint64)) for k in (0, 1000))
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours."""
    s = 1
    while 2 * s <= width:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: -(width - s)], x[width - s :]) if width > s else x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each anchor: hash, hash of its context, start and size of the context, offset of the anchor in it."""
    n, width = len(text), length - gram + 1
    a = np.frombuffer(text, np.uint8)
    up, down = (p[:n] for p in _powers(n + 1))
    sums = []
    for t in _TABLES:
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(t[a] * up, out=s[1:])
        sums.append(s)
    h = mix((sums[0][gram:] - sums[0][:-gram]) * down[: n - gram + 1])
    least = _slide(h, width, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    pad = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    values, which = np.unique(h[places], return_inverse=True)
    ordered = np.sort(which * np.int64(n + 1) + places)
    row = np.searchsorted(values, least[first]) * np.int64(n + 1)
    parts = []
    while len(first):  # more than once only where equal grams are close together
        at = ordered[np.searchsorted(ordered, row + first)] - row
        end = np.minimum(at, last)
        parts.append((at, first, end))
        more = end < last
        first, last, row = end[more] + 1, last[more], row[more]
    at, lo, hi = (np.concatenate(p) for p in zip(*parts, strict=True))
    hi = hi + length
    context = mix((sums[1][hi] - sums[1][lo]) * down[lo] + (at - lo).astype(np.uint64) * np.uint64(_BASE) + (hi - lo).astype(np.uint64))
    return h[at].view(np.int64), context.view(np.int64), lo, hi - lo, at - lo


def runs(h: np.ndarray, context: np.ndarray, lo: np.ndarray, size: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal contexts of one anchor that overlap or touch, as in a line that repeats itself, as one row: with their number and the distance of the first and the last start."""
    by = np.lexsort((lo, context, h))
    h, context, lo, size, offset = (x[by] for x in (h, context, lo, size, offset))
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (context[1:] != context[:-1]) | (lo[1:] - lo[:-1] > size[1:])]))
    after = np.append(first[1:], len(h))
    return h[first], context[first], lo[first], size[first], offset[first], after - first, lo[after - 1] - lo[first]


class Level:
    """Contexts with suffix arrays around their anchors: orders of the text to the right and of the reversed text to the left, by anchor."""

    def __init__(self, ids: np.ndarray, sides: list[np.ndarray], orders: list[np.ndarray]) -> None:
        self.ids, self.sides, self.orders = ids, sides, orders

    @classmethod
    def of(cls, ids: np.ndarray, sides: list[np.ndarray]) -> Level:
        return cls(ids, sides, [np.argsort(_strings(s), kind="stable") for s in sides])

    def merged(self, other: Level) -> Level:
        """Both levels as one: their sorted orders are merged, not sorted again."""
        sides = [np.concatenate([x, y]) for x, y in zip(self.sides, other.sides, strict=True)]
        orders = []
        for x, y, p, q in zip(self.sides, other.sides, self.orders, other.orders, strict=True):
            at = np.searchsorted(_strings(x)[p], _strings(y)[q], "right")
            orders.append(np.insert(p, at, q + len(p)))
        return Level(np.concatenate([self.ids, other.ids]), sides, orders)


def _strings(rows: np.ndarray) -> np.ndarray:
    return rows.view(f"S{rows.shape[1]}").ravel()


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each string of the order shares with the one before, its anchor's eight included."""
    s = rows[order]
    differs = s[1:] != s[:-1]
    return np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])])


class Family:
    """Index family of a bucket: takes batches of contexts and notes for each the windows that repeat.

    ``least`` and ``most``: the smallest and largest number of bytes left of the anchor in such a
    window; all windows hold the anchor, so what they cover is one span.
    """

    def __init__(self, copies: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> None:
        self.copies, self.low, self.high, self.width = copies, low, high, width
        self.levels: list[Level] = []
        self.least = np.where(copies > 1, low, width)
        self.most = np.where(copies > 1, high, -1)

    def add(self, batch: Level) -> None:
        self.scan(batch)
        for level in self.levels:
            self.scan(batch.merged(level))
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].ids) <= len(self.levels[-1].ids):
            last = self.levels.pop()
            self.levels.append(self.levels.pop().merged(last))

    def scan(self, both: Level) -> None:
        ids, n = both.ids, len(both.ids)
        shared = [_common(s, o) for s, o in zip(both.sides, both.orders, strict=True)]
        low, high, copies = self.low[ids], self.high[ids], self.copies[ids]
        for left in range(int(low.min()), int(high.max()) + 1):
            valid = np.flatnonzero((low <= left) & (left <= high))
            if len(valid) < 2:
                continue
            key = np.zeros(n, np.int64)
            for order, lcp, depth in zip(both.orders, shared, (self.width - left, left), strict=True):
                of = np.empty(n, np.int64)
                of[order] = np.cumsum(lcp < depth + 8)
                key = key * (n + 1) + of
            key = key[valid]
            by = np.argsort(key)
            new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
            group = np.cumsum(new) - 1
            many = np.bincount(group, weights=copies[valid[by]]) > 1
            hit = ids[valid[by][many[group]]]
            self.least[hit] = np.minimum(self.least[hit], left)
            self.most[hit] = np.maximum(self.most[hit], left)


def repeated(anchor: list[int], offset: np.ndarray, texts: list[bytes], copies: np.ndarray, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """First and last covered byte + 1 of each context (0, 0: none), for contexts of whole anchors."""
    n, width = len(texts), length - gram
    size = np.array([len(t) for t in texts])
    sides = [np.zeros((n, width + 8), np.uint8) for _ in range(2)]
    for k, (h, o, t) in enumerate(zip(anchor, offset, texts, strict=True)):
        head = int(h).to_bytes(8, "big", signed=True)
        for side, s in zip(sides, (t[o + gram :], t[:o][::-1]), strict=True):
            side[k, : 8 + len(s)] = np.frombuffer(head + s, np.uint8)
    family = Family(copies, length - size + offset, offset, width)
    for k in range(0, n, batch):
        ids = np.arange(k, min(n, k + batch))
        family.add(Level.of(ids, [np.ascontiguousarray(s[ids]) for s in sides]))
    some = family.most >= 0
    return np.where(some, offset - family.most, 0), np.where(some, offset - family.least + length, 0)


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


#: Stands for a null id where an id tells copies of one text apart.
NO_ID = -(1 << 63)
_KEY = ("k1", "k2")
_OCCURRENCE = ("h", "context", "lo", "shape", "times", "extent")


class Batch:
    """Texts and the anchors in them, as stored; several batches merge into one level."""

    def __init__(self, texts: DataFrame, anchored: DataFrame, size: int) -> None:
        self.texts, self.anchored, self.size = texts, anchored, size

    def occurrences(self) -> DataFrame:
        """One row for each run of equal contexts: anchor, context, key and id of a row with the text, place, shape, number, extent."""
        return self.anchored.select(*_KEY, "id", "copies", F.inline(F.arrays_zip(*_OCCURRENCE))).withColumn("times", F.col("times") * F.col("copies")).drop("copies")


def _anchored(texts: DataFrame) -> DataFrame:
    """Of each text of at least LENGTH bytes (equal ones that a worker meets together are one row): key, least id, copies and, as arrays, its anchors."""

    def find(batches):
        for part in slices(batches, "body"):
            seen: dict[tuple[int, int], list] = {}
            for k1, k2, row, body in zip(*(part.column(k).to_pylist() for k in range(3)), column_bytes(part, "body"), strict=True):
                if len(body) >= LENGTH:
                    one = seen.setdefault((k1, k2), [row, 0, body])
                    one[0], one[1] = min(one[0], row), one[1] + 1
            if not seen:
                continue
            found = [runs(*anchors(body)) for _, _, body in seen.values()]
            ends = pa.array(np.cumsum([0, *(len(h) for h, *_ in found)]).astype(np.int32))
            h, context, lo, size, offset, times, extent = (np.concatenate(c) for c in zip(*found, strict=True))
            columns = {"k1": [k for k, _ in seen], "k2": [k for _, k in seen], "id": [x[0] for x in seen.values()], "copies": [x[1] for x in seen.values()]}
            arrays = {"h": h, "context": context} | {n: x.astype(np.int32) for n, x in (("lo", lo), ("shape", size * 1024 + offset), ("times", times), ("extent", extent))}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in columns.items()} | {n: pa.ListArray.from_arrays(ends, pa.array(x)) for n, x in arrays.items()})

    ddl = "k1 bigint, k2 bigint, id bigint, copies bigint, h array<bigint>, context array<bigint>, lo array<int>, shape array<int>, times array<int>, extent array<int>"
    return texts.select("k1", "k2", "id", "body").mapInArrow(find, ddl)


class RepeatIndex:
    """A family of levels of texts: each batch is scanned by itself and against every level for windows that repeat, and levels of like size merge."""

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> None:
        self.id_col, self.text_col, self.keep = id_col, text_col, keep
        self.levels: list[Batch] = []
        self.spans: DataFrame | None = None
        self.kept: Kept | None = None

    def add(self, docs: DataFrame) -> RepeatIndex:
        """Takes a batch of documents in; later batches have the same columns to keep."""
        self.kept = Kept(docs, self.keep)
        body = F.coalesce(F.col(self.text_col).cast("binary"), F.lit(b""))
        texts = docs.select(F.coalesce(F.col(self.id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(self.id_col).isNull().alias("no_id"), F.col(self.text_col).isNull().alias("no_text"), body.alias("body"), *self.kept.columns)
        # a text is known by 128 bits of it, never by its id
        texts = texts.select(F.xxhash64("body").alias("k1"), F.xxhash64(F.lit("key"), "body").alias("k2"), *texts.columns)
        anchored = store(_anchored(texts))
        batch = Batch(texts, anchored, anchored.count())
        if self.spans is not None:
            self.spans = store(self.spans)
        for level in (None, *self.levels):
            found = _scan(batch, level)
            self.spans = found if self.spans is None else self.spans.unionByName(found)
        self.levels.append(batch)
        while len(self.levels) > 1 and self.levels[-2].size <= self.levels[-1].size:
            x, y = self.levels.pop(), self.levels.pop()
            self.levels.append(Batch(y.texts.unionByName(x.texts), store(y.anchored.unionByName(x.anchored)), x.size + y.size))
        return self

    def remove(self, as_text: bool = False) -> DataFrame:
        """The documents of all batches without the bytes that repeat; see ``remove_repeats``."""
        kept_columns = self.kept
        texts = self.levels[0].texts
        for level in self.levels[1:]:
            texts = texts.unionByName(level.texts)
        spans = self.spans.groupBy(*_KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
        # by key and id, as in the scan: copies under many ids are then no crowded key, and Spark can use one shuffle of the texts for both
        named = texts.select(*_KEY, "id").distinct().join(spans, list(_KEY))

        def remove(batches):
            for part in slices(batches, "body"):
                n, gone, left = [], [], []
                for body, found, no_text in zip(column_bytes(part, "body"), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    runs_ = _merge([(x["s"], x["e"]) for x in found or ()])
                    pieces, at = [], 0
                    for s, e in runs_:
                        pieces.append(body[at:s])
                        at = e
                    rest = b"".join([*pieces, body[at:]]) if runs_ else body
                    n.append(len(body))
                    gone.append(runs_)
                    left.append(None if as_text and no_text else rest.decode("utf-8", "ignore") if as_text else rest)
                own = {"id": part.column(3), "n_bytes": pa.array(n, pa.int64()), "spans": pa.array(gone, pa.list_(pa.list_(pa.int32()))), "kept": pa.array(left, pa.string() if as_text else pa.binary())}
                yield kept_columns.beside(part, **own)

        out = texts.join(named, [*_KEY, "id"], "left").select("body", "spans", "no_text", F.when(~F.col("no_id"), F.col("id")).alias("id"), *kept_columns.inner)
        out = out.mapInArrow(remove, f"id bigint, n_bytes bigint, spans array<array<int>>, kept {'string' if as_text else 'binary'}{kept_columns.ddl}")
        return kept_columns.restore(out.withColumnRenamed("id", self.id_col))


def _scan(batch: Batch, level: Batch | None) -> DataFrame:
    """Spans (k1, k2, s, e) that windows repeat which are in the batch twice, or in the batch and in the level."""
    occurrences, texts = batch.occurrences(), batch.texts
    if level is not None:
        mine = occurrences.select("h").distinct()
        occurrences = occurrences.unionByName(level.occurrences().join(mine, "h", "left_semi"))
        texts = texts.unionByName(level.texts)
    often = occurrences.groupBy("h").agg(F.sum("times").alias("n"), F.min("context").alias("x"), F.max("context").alias("y")).where("n > 1").select("h", F.expr("x <> y").alias("several"))
    again = occurrences.join(often, "h")
    again = store(again.select(F.when(F.col("several"), F.col("h")).alias("h"), F.when(F.col("several"), F.col("context")).alias("context"), *_KEY, "id", "lo", "shape", "times", "extent"))
    open_ = again.where("h is not null")
    distinct = store(open_.groupBy("h", "context").agg(F.sum("times").alias("copies"), F.min(F.struct(*_KEY, "id", "lo", "shape")).alias("at")).select("h", "context", "copies", "at.*"))
    wanted = distinct.groupBy(*_KEY, "id").agg(F.collect_list(F.struct("h", "context", "copies", "lo", "shape")).alias("contexts"))

    def extract(batches):
        def rows():
            for part in slices(batches, "body"):
                for body, contexts in zip(column_bytes(part, "body"), part.column(1), strict=True):
                    for c in contexts.as_py():
                        yield c["h"], c["context"], min(c["copies"], 2), c["shape"] % 1024, body[c["lo"] : c["lo"] + c["shape"] // 1024]

        return rows_out(pa.schema([("h", pa.int64()), ("context", pa.int64()), ("copies", pa.int32()), ("offset", pa.int32()), ("piece", pa.binary())]), 5000)(rows())

    # with all columns of the texts, so that Spark can use their shuffle again where the spans meet them
    pieces = texts.join(wanted, [*_KEY, "id"]).select("body", "contexts", *[c for c in texts.columns if c.startswith(("no_", "keep_"))]).mapInArrow(extract, "h bigint, context bigint, copies int, offset int, piece binary")
    repeated_rows = texts.groupBy(*_KEY, "id").count().where("count > 1")
    if not repeated_rows.isEmpty():  # a row that occurs many times gives its pieces as often
        pieces = pieces.dropDuplicates(["h", "context"])
    buckets = max(1, -(-distinct.count() // BUCKET))
    crowded = distinct.groupBy("h").count().where(F.col("count") > MOST).select("h")
    crowded = store(crowded) if not crowded.isEmpty() else None

    def in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["h", "context"]).sort_values(["h", "context"])
        first, end = repeated(rows["h"].tolist(), rows["offset"].to_numpy(np.int64), [bytes(p) for p in rows["piece"]], rows["copies"].to_numpy(np.int64))
        return pd.DataFrame({"h": rows["h"], "context": rows["context"], "first": first, "end": end})[end > 0]

    few = pieces if crowded is None else pieces.join(crowded, "h", "left_anti")
    results = few.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).applyInPandas(in_bucket, "h bigint, context bigint, first long, end long")
    if crowded is not None:

        def windows(batches):
            def rows():
                for part in batches:
                    for h, context, copies, offset, piece in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        for s in range(len(piece) - LENGTH + 1):
                            yield xxhash.xxh3_128_digest(b"%d %d " % (h, offset - s) + piece[s : s + LENGTH]), h, context, copies, s

            return rows_out(pa.schema([("w", pa.binary()), ("h", pa.int64()), ("context", pa.int64()), ("copies", pa.int32()), ("s", pa.int32())]), 20_000)(rows())

        single = pieces.join(crowded, "h", "left_semi").dropDuplicates(["h", "context"]).mapInArrow(windows, "w binary, h bigint, context bigint, copies int, s int")
        twice = single.groupBy("w").agg(F.sum("copies").alias("n")).where("n > 1").select("w")
        results = results.unionByName(single.join(twice, "w").groupBy("h", "context").agg(F.min("s").cast("long").alias("first"), (F.max("s") + LENGTH).cast("long").alias("end")))
    spans = again.where("h is null").select(*_KEY, F.col("lo").alias("s"), (F.col("lo") + F.col("extent") + F.expr("shape div 1024")).cast("int").alias("e"))
    return spans.unionByName(open_.join(results, ["h", "context"]).select(*_KEY, (F.col("lo") + F.col("first")).cast("int").alias("s"), (F.col("lo") + F.col("extent") + F.col("end")).cast("int").alias("e")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Documents without the bytes that a repeated string of 200 bytes covers.

    Returns one row per input row: the id, ``n_bytes``, ``spans`` (maximal removed runs as arrays
    [start, end) of byte offsets), ``kept`` (the remaining bytes as binary; with ``as_text`` as string,
    without characters that were cut, null for a null text) and the columns to keep. Null texts count as
    empty; texts of fewer than 200 bytes lose nothing. Rows that occur several times repeat each
    other. Null ids and ids with several texts are allowed, other columns are ignored, empty input gives
    an empty result. Documents that come in batches are taken by ``RepeatIndex``, with the same result.
    """
    return RepeatIndex(id_col, text_col, keep).add(docs).remove(as_text)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES = {
    "op5_suffix_dedup": r"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
size AS (SELECT *, length(h) // 2 AS n FROM n),
w AS (SELECT r, p, md5(list_aggregate(list_slice(cuts, p // 100 + 1, p // 100 + 4), 'string_agg', '')[2 * (p % 100) + 1 : 2 * (p % 100) + 400]) AS k
  FROM (SELECT r, cuts, unnest(range(0, n - 199)) AS p FROM (SELECT r, n, list_transform(range(0, n, 100), lambda c: h[2 * c + 1 : 2 * c + 200]) AS cuts FROM size WHERE n >= 200))),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM w JOIN again USING (k)),
runs AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM hit) GROUP BY r, run),
gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS prev FROM runs),
kept AS (SELECT g.r, CAST(sum(e - s) AS BIGINT) AS gone, count(*) AS spans, string_agg(h[2 * prev + 1 : 2 * s], '' ORDER BY s) || any_value(h)[2 * max(e) + 1 :] AS left_hex FROM gaps g JOIN size USING (r) GROUP BY g.r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(left_hex, h))) AS kept_sha256 FROM size LEFT JOIN kept USING (r)"""
}
