"""Words and word pairs of documents in blocks, for models whose counts are summed by shards of code ranges.

Documents are dealt into blocks of bounded size by id. A block numbers its distinct words and word pairs by
sorted 64-bit codes and exchanges arrays with the shards of the code range: rows go only where a block has
codes, so their number is bounded by the distinct codes of the blocks. Codes travel as differences and
numbers byte by byte, which compresses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoylake.llm.common import ALNUM, mix
from convoylake.llm.ngram_jaccard import word_hashes

#: Bytes of text in a block, about.
BLOCK_BYTES = 6_000_000
#: Bits of the bitmap that chooses documents by their ids (a fixed 8 MB).
BITMAP = 1 << 26


class Blocks:
    """Documents (row as text, body, block) and how ids are dealt to the ``n`` blocks."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> None:
        self.id_col = id_col
        docs = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).cast("binary").alias("body"))
        self.docs = docs
        total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        self.n = max(1, -(-total // block_bytes))
        of_null = F.when(F.col("row").isNull(), F.xxhash64("body")).otherwise(F.xxhash64("row"))
        self.dealt = docs.select(F.col("row").cast("string").alias("row"), "body", self._block(of_null))

    def _block(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.n)).alias("block")

    def named(self, ids: DataFrame) -> DataFrame:
        """The blocks of the documents with these ids: row, block."""
        ids = ids.select(F.col(self.id_col).cast("bigint").alias("row")).where("row is not null").distinct()
        return ids.select(F.col("row").cast("string").alias("row"), self._block(F.xxhash64("row")))

    def few(self, ids: DataFrame) -> DataFrame:
        """The documents with these ids and a few others (row as number, body), chosen by a bitmap of hashed ids that has 8 MB, without a shuffle of texts."""
        hashed = F.pmod(F.xxhash64("row"), F.lit(BITMAP))
        at = [F.shiftright(hashed, 15).alias("_at"), hashed.bitwiseAND(32767).alias("_bit")]
        bits = ids.select(F.col(self.id_col).cast("bigint").alias("row")).where("row is not null").select(*at).groupBy("_at").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        byte = F.conv(F.hex(F.expr("substring(_bits, shiftright(_bit, 3) + 1, 1)")), 16, 10).cast("bigint")
        return self.docs.select("*", *at).join(F.broadcast(bits), "_at").where(F.getbit(byte, F.col("_bit").bitwiseAND(7).cast("int")) == 1).select("row", "body")

    def everywhere(self, row: DataFrame) -> DataFrame:
        """One row for each block from a table of one row."""
        return row.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1)).cast("array<bigint>")))


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each code among the sorted distinct ones, and those."""
    at, distinct = pd.factorize(codes)
    order = np.argsort(distinct)
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(len(distinct))
    return place[at], distinct[order]


def words(text: bytes | None) -> list[bytes]:
    """Words in lower case, marks left out."""
    return (text or b"").translate(ALNUM).split()


#: Of each byte: 0 for white space, 1 for a word's, 2 for a mark's; and an odd number that stands for it in hashes.
_KIND = np.array([0 if b in b" \t\n\r\f\v" else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text whose tokens are hashed at a time.
_AT_ONCE = 500_000


def marked_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words as they are written, and runs of marks as words of their own: their number in each text and 64-bit hashes of all of them.

    They are found for many texts at a time, without a Python object for each.
    """
    lengths, found, first = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end] or b"") <= _AT_ONCE):
            size, end = size + len(texts[end] or b""), end + 1
        part = [t or b"" for t in texts[first:end]]
        data, first = np.frombuffer(b"\n".join([*part, b""]), np.uint8), end
        kind = _KIND[data]
        start = np.flatnonzero(np.diff(kind, prepend=np.uint8(3)))
        long = np.diff(start, append=len(data))
        inside = np.arange(len(data)) - np.repeat(start, long)
        power = np.multiply.accumulate(np.full(int(long.max()), _STEP))
        token = kind[start] > 0
        sums = np.add.reduceat(_OF_BYTE[data] * power[inside], start)[token]
        found.append(mix(sums + long[token].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        ends = np.cumsum([len(t) + 1 for t in part])
        lengths.append(np.bincount(np.searchsorted(ends, start[token], "right"), minlength=len(part)).astype(np.int64))
    return np.concatenate(lengths), np.concatenate(found)


class Tokens:
    """Tokens of a block's texts: their documents, words and pairs with the word before (code 0 before the first), as numbers and sorted distinct codes."""

    def __init__(self, texts: list[bytes | None], hashed: Callable[[list[bytes | None]], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        if hashed is None:
            hashes = [word_hashes(words(text)) for text in texts]
            self.length, of = np.array([len(h) for h in hashes], np.int64), np.concatenate([*hashes, np.zeros(0, np.uint64)])
        else:
            self.length, of = hashed(texts)
        self.doc = np.repeat(np.arange(len(texts)), self.length)
        codes = mix(of + np.uint64(1))
        self.first = np.diff(self.doc, prepend=-1) > 0
        before = np.where(self.first, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), codes[:-1]])[: len(codes)])
        numbers, self.vocab = numbered(np.concatenate([np.zeros(1, np.uint64), codes]))
        self.start, self.word = numbers[0], numbers[1:]
        self.before = np.where(self.first, self.start, np.concatenate([numbers[:1], self.word[:-1]])[: len(codes)])
        self.pair, self.pairs = numbered(mix(before * np.uint64(0x9E3779B97F4A7C15) + codes))

    def own(self, numbers: np.ndarray) -> np.ndarray:
        """How often each token's word, pair or other number occurs in its document."""
        if not len(numbers):
            return np.zeros(0, np.int64)
        at, _ = pd.factorize(self.doc * (int(numbers.max()) + 1) + numbers)
        return np.bincount(at)[at]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by document."""
        return np.bincount(self.doc, weights=values, minlength=len(self.length))


def slices_of(distinct: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """Shard, first and end of each part of sorted codes that is not empty."""
    if len(distinct):
        shard = np.minimum(distinct // np.uint64((1 << 64) // shards if shards > 1 else (1 << 64) - 1), np.uint64(shards - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        yield from zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(distinct)], strict=True)


def planes(a: np.ndarray) -> bytes:
    """An array byte by byte, all lowest bytes first, so that the zeros of small numbers are together and compress."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_codes(codes: np.ndarray) -> bytes:
    return planes(np.diff(codes, prepend=np.uint64(0)))


def unpacked_codes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)
