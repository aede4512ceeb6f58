"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks that overlap; the chunks are pre-tokenised in parallel, each from its own
first character. A pre-token depends only on what follows its start, so as soon as a boundary of one
chunk is also a boundary of the next, both agree from there on: the pieces are stitched at the first
such boundary in the overlap and then encoded, each by itself. Where an overlap has none, chunks and
overlaps get wider, and in the end the text is encoded as a whole. Short texts are one chunk. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import column_bytes, rows_out, slices, store, table

#: Characters of a chunk and of the overlap with the next.
CHUNK, OVERLAP = 32_768, 1_024
#: Chunks and overlaps grow by this factor where a text has no common boundary in some overlap, up to chunks of so many characters.
WIDER, LONGEST = 8, 4_000_000
#: Pre-tokens at the end of a chunk that what follows it can change: the last one can go on, and a
#: contraction cut after its apostrophe shows as two; one more is left out for safety.
UNSURE = 3
#: Pre-tokens whose ids a worker keeps in either of two generations (about 200 bytes each), and the characters of the longest that it keeps.
CACHE, CACHED_LENGTH = 200_000, 32
#: Bytes of a pre-token up to which a list of its pairs' ranks is faster than a heap of them.
LISTED = 96
#: Bytes of text or ids that a worker takes from a batch at a time.
PART_BYTES = 1_000_000
_LOADED: dict[tuple[str, str], Encoder] = {}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= LISTED:
        return _merge_listed(piece, ranks)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, k, end = heapq.heappop(heap)
        if not alive[k] or ends[k] == n or ends[ends[k]] != end:
            continue  # a part of the pair was merged meanwhile
        alive[ends[k]] = False
        ends[k] = end
        if end < n:
            before[end] = k
            if (r := ranks.get(piece[k : ends[end]])) is not None:
                heapq.heappush(heap, (r, k, ends[end]))
        if (p := before[k]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    return [ranks[piece[k : ends[k]]] for k in range(n) if alive[k]]


def _merge_listed(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, 1 << 62
    starts = list(range(len(piece) + 1))
    pairs = [get(piece[k : k + 2], none) for k in range(len(piece) - 1)]
    while pairs and (lowest := min(pairs)) != none:
        k = pairs.index(lowest)
        del starts[k + 1], pairs[k]
        if k < len(pairs):
            pairs[k] = get(piece[starts[k] : starts[k + 2]], none)
        if k:
            pairs[k - 1] = get(piece[starts[k - 1] : starts[k + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(starts, starts[1:])]


def merge_pairs(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Tokens of one pre-token cut into its smallest parts, by ranks of pairs: the lowest rank, leftmost first, until none is left."""
    n = len(parts)
    parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        if parts[k] != a or after[k] == n or parts[after[k]] != b:
            continue  # a part of the pair was merged meanwhile
        parts[after[k]] = ""
        parts[k] = a + b
        after[k] = end = after[after[k]]
        if end < n:
            before[end] = k
            if (r := ranks.get((parts[k], parts[end]))) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[end]))
        if (p := before[k]) >= 0 and (r := ranks.get((parts[p], parts[k]))) is not None:
            heapq.heappush(heap, (r, p, parts[p], parts[k]))
    return [part for part in parts if part]


class Encoder(dict):
    """Pre-token to little-endian ids, filled as pre-tokens come. A full generation becomes the older one; what is met again moves on to the new one."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            found = merge(piece.encode(), self.ranks)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    @cached_property
    def tokens(self) -> list[bytes]:
        """The bytes of each id; only decoding needs them."""
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            out[rank] = piece
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = Encoder(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """Token ids of each text: the id column, ``ids`` (little-endian unsigned 32-bit, as binary) and ``n_tokens``.

    ``decoded`` adds what ``decode`` adds, in the same pass over the texts: a task then has one Python worker rather than two,
    which matters where workers stay for later stages with what they hold.
    ``path`` is a vocabulary file on every machine. Null texts count as empty and have no tokens.
    Repeated rows and null ids are kept, other columns ignored, empty input gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    long = F.length("body") > chunk
    more = ["decoded"] if decoded else []
    plain = pa.schema([("row", pa.int64()), ("ids", pa.binary()), *[(c, pa.binary()) for c in more]])
    plain_ddl = "row bigint, ids binary" + ", decoded binary" * decoded

    def whole(batches):
        enc = encoder(path, pattern)

        def rows():
            for batch in slices(batches, "body", PART_BYTES):
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text)
                    yield (row, ids, enc.decode(ids)) if decoded else (row, ids)

        return rows_out(plain, 200)(rows())

    def split(batches):
        def rows():
            for batch in slices(batches, "body", PART_BYTES):
                for uid, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for k, s in enumerate(range(0, len(text), chunk)):
                        yield uid, row, k, text[s : s + chunk + overlap], s + chunk >= len(text)

        return rows_out(pa.schema([("uid", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("piece", pa.string()), ("last", pa.bool_())]), 50)(rows())

    def borders(batches):
        enc = encoder(path, pattern)

        def rows():
            for batch in slices(batches, "piece", PART_BYTES):
                for uid, k, piece, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ends = [m.end() for m in enc.pattern.finditer(piece)]
                    sure = ends if last else ends[:-UNSURE]
                    s = k * chunk
                    yield uid, k, [s, *(s + e for e in sure if e <= overlap)], [s + e for e in sure if e >= chunk], last

        return rows_out(pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("last", pa.bool_())]))(rows())

    def finish(batches):
        enc = encoder(path, pattern)

        def rows():
            for batch in slices(batches, "piece", PART_BYTES):
                for uid, row, k, piece, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out, s = [], k * chunk
                    for m in enc.pattern.finditer(piece, start - s):
                        if stop is not None and m.start() + s >= stop:
                            break
                        out.append(enc[m[0]])
                    yield uid, row, k, b"".join(out)

        return rows_out(pa.schema([("uid", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("ids", pa.binary())]), 200)(rows())

    short = docs.where(~long).mapInArrow(whole, plain_ddl)
    pieces = docs.where(long).select(F.monotonically_increasing_id().alias("uid"), "row", "body").mapInArrow(split, "uid bigint, row bigint, k int, piece string, last boolean")
    pieces = store(pieces)
    seams = pieces.select("uid", "k", "piece", "last").repartition("uid", "k").mapInArrow(borders, "uid bigint, k int, head array<bigint>, tail array<bigint>, last boolean")
    after = seams.select("uid", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    seams = store(seams.join(after, ["uid", "k"], "left").select("uid", "k", "last", F.when(F.col("k") == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(F.array_intersect("before", "head"))).alias("start")))
    apart = seams.groupBy("uid").agg(F.max(F.col("start").isNull()).alias("apart"))
    stops = seams.select("uid", (F.col("k") - 1).alias("k"), F.col("start").alias("stop"))
    parts = pieces.select("uid", "row", "k", "piece").join(seams.select("uid", "k", "start"), ["uid", "k"]).join(stops, ["uid", "k"], "left").join(apart.where("not apart").select("uid"), "uid", "left_semi")
    joined = parts.select("uid", "row", "k", "piece", "start", "stop").mapInArrow(finish, "uid bigint, row bigint, k int, ids binary")
    joined = joined.groupBy("uid", "row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = joined.select("row", F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
    out = short.unionByName(decode(joined, path, pattern) if decoded else joined)
    if not seams.where("start is null").isEmpty():
        unsynced = pieces.join(apart.where("apart").select("uid"), "uid", "left_semi").groupBy("uid", "row").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("parts"))
        unsynced = unsynced.select("row", F.array_join(F.transform("parts.piece", lambda x: F.substring(x, 1, chunk)), "").alias("body"))
        if WIDER * chunk <= LONGEST:  # wider overlaps first; a run of one kind of characters as long as those is one pre-token
            again = encode(unsynced, path, pattern, "row", "body", WIDER * chunk, WIDER * overlap, decoded).select("row", "ids", *more)
        else:
            again = unsynced.mapInArrow(whole, plain_ddl)
        out = out.unionByName(again)
    return out.select(F.col("row").alias(id_col), "ids", F.expr("octet_length(ids) div 4").alias("n_tokens"), *more)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the bytes of the tokens in ``ids``, in order; null ids give null."""
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        enc = encoder(path, pattern)
        for batch in slices(batches, "ids", PART_BYTES):
            texts = [None if ids is None else enc.decode(ids) for ids in column_bytes(batch, "ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*kept, "decoded"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in encoded.select(*kept).dtypes)
    return encoded.select(*kept).mapInArrow(run, f"{ddl}, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode(encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES = {}
