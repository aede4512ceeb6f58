"""Spelling variants by Aho-Corasick halves.

Two words that differ by one edit share a half: of either word cut in two segments, the edit leaves one
whole, and that segment stands at the start or at the end of the other word. Automaton shards hold both
segments of every word; all words are scanned by the shards of their own length and the lengths next to it.
A match counts if the segment stands where its half belongs, and the rest of both words is then compared.

Shards are words of one length dealt by hash into buckets of at most about ``SHARD`` words, and a task gets
one shard and one such bucket of words to scan: its memory is bounded, and frequent beginnings or endings
are no key. Pairs stay in the task; a word leaves it with the number of its near words there and the best
of them. Words in U+00FF and below are one byte a code point, so distances are counted on bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import forget, slices, store, table

#: Latin-1 letters as the contract has them in lower case (only A-Z change), all else to a space.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Words of an automaton shard, about, and of the bucket that it scans.
SHARD = 60_000
#: Words of this length and more share one class of lengths.
LONG = 64
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Candidates compared at a time.
COMPARED = 1_000_000
#: A run is altered if this divides its checksum.
ALTERED = 97


def runs(text: str | None) -> list[bytes]:
    """Runs of letters in lower case; other characters, those beyond U+00FF too, stand between them."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def altered(run: bytes, start: int) -> bytes:
    """The run, or it without one code point; ``start`` is the checksum of what precedes it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % ALTERED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts, after the rule that takes a code point from some runs of a document.

    Null texts have no words; rows without an id are counted, their runs as they are; every repeated row counts.
    """
    docs = docs.select(F.col(id_col).cast("string").alias("row"), F.col(text_col).alias("body"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for part in batched(held.items(), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], schema=schema)
            held.clear()

        for batch in slices(batches, "body"):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(runs(text))
                if row is None:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{row}:".encode())
                for run, n in found.items():
                    held[altered(run, start)] += n
            if len(held) > HELD:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(count, "word string, n bigint").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(words: np.ndarray) -> np.ndarray:
    """Rows of at most eight bytes as numbers, the first byte highest."""
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out = (out << np.uint64(8)) | words[:, k]
    return out


def _lowest(diff: np.ndarray) -> np.ndarray:
    """The lowest byte that is not zero, from the last; 8 if none."""
    return np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.int8) // 8


def _highest(diff: np.ndarray) -> np.ndarray:
    """The highest byte that is not zero; -1 if none."""
    for k in (1, 2, 4, 8, 16, 32):
        diff = diff | (diff >> np.uint64(k))
    return (np.bitwise_count(diff).astype(np.int8) - 1) // 8


def _one_edit(a: np.ndarray, b: np.ndarray, size: int, by: int) -> np.ndarray:
    """Whether packed rests differ by one edit; a has ``size`` bytes, b has ``by`` more (-1, 0 or 1)."""
    if by < 0:
        return _one_edit(b, a, size - 1, 1)
    if by == 0:
        return _lowest(a ^ b) == _highest(a ^ b)
    # what is equal from the end and what is equal from the start leave nothing of the shorter one
    return _lowest(a ^ (b & np.uint64((1 << 8 * size) - 1))) > _highest(a ^ (b >> np.uint64(8)))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced byte."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = int.from_bytes(a), int.from_bytes(b)
    if len(a) == len(b):
        diff = x ^ y
        return ((diff & -diff).bit_length() - 1) // 8 == (diff.bit_length() - 1) // 8
    tail, head = x ^ (y & ((1 << 8 * len(a)) - 1)), x ^ (y >> 8)
    return not tail or ((tail & -tail).bit_length() - 1) // 8 > (head.bit_length() - 1) // 8


def near(holders: list[bytes], scanned: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of each scanned word and each holder that differ by one edit, every such pair once."""
    shard = ahocorasick.Automaton()
    starts: dict[bytes, list[int]] = {}
    ends: dict[bytes, list[int]] = {}
    for k, word in enumerate(holders):
        half = len(word) // 2
        starts.setdefault(word[:half], []).append(k)
        ends.setdefault(word[half:], []).append(k)
    members: list[np.ndarray] = []
    anywhere = -1  # words of one code point have no first half, which stands at the start of every word
    for segment in starts.keys() | ends.keys():
        place = [-1, -1]
        for side, held in enumerate((starts, ends)):
            if segment in held:
                place[side] = len(members)
                members.append(np.array(held[segment], np.int64))
        if segment:
            shard.add_word(segment.decode("latin-1"), (len(segment), *place))
        else:
            anywhere = place[0]
    none = np.zeros(0, np.int64)
    if not members or not scanned:
        return none, none
    hits: tuple[list, list] = ([(k, anywhere) for k in range(len(scanned)) if anywhere >= 0], [])  # (scanned word, members) of matches at the start and at the end
    shard.make_automaton()
    for k, word in enumerate(scanned):
        last = len(word) - 1
        for end, (size, first, second) in shard.iter(word.decode("latin-1")):
            if first >= 0 and end + 1 == size:
                hits[0].append((k, first))
            if second >= 0 and end == last:
                hits[1].append((k, second))
    sizes = {len(w) for w in holders}, {len(w) for w in scanned}
    uniform = len(sizes[0]) == len(sizes[1]) == 1
    counts = np.fromiter(map(len, members), np.int64, len(members))
    offsets, flat = np.cumsum(counts) - counts, np.concatenate(members)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for side, pairs in enumerate(hits):
        if not pairs:
            continue
        words, buckets = np.array(pairs, np.int64).T
        if uniform:
            (size,), (other,) = sizes
            half = size // 2
            cut = (slice(half, None), slice(half, None)) if side == 0 else (slice(0, half), slice(0, max(0, other - (size - half))))
            rests = [np.frombuffer(b"".join(w), np.uint8).reshape(len(w), -1)[:, c].astype(np.uint64) for w, c in zip((holders, scanned), cut, strict=True)]
            length = [r.shape[1] for r in rests]
            packed = [_packed(r) for r in rests] if max(length) <= 8 else None
        else:
            packed = None
        total = np.cumsum(counts[buckets])
        at = 0
        while at < len(words):  # candidates in slices
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARED, "right")))
            n = counts[buckets[at:stop]]
            x = np.repeat(words[at:stop], n)
            h = flat[np.repeat(offsets[buckets[at:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if packed is not None:
                good = _one_edit(packed[0][h], packed[1][x], length[0], length[1] - length[0])
            else:
                good = np.fromiter((one_edit(holders[i], scanned[j]) for i, j in zip(h.tolist(), x.tolist(), strict=True)), bool, len(h))
            found.append((x[good], h[good]))
            at = stop
    if not found:
        return none, none
    codes = np.unique(np.concatenate([x * len(holders) + h for x, h in found]))
    return codes // len(holders), codes % len(holders)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Of ``words`` (word, n): each word that has near ones, with n_near, and the best of them: best_n, best.

    Best is the largest n, then the smallest word. Words are distinct, of letters up to U+00FF.
    """
    words = words.withColumn("size", F.least(F.char_length("word"), F.lit(LONG)))
    buckets = {r["size"]: max(1, -(-r["count"] // shard)) for r in words.groupBy("size").count().collect()}  # LONG rows at most
    if not buckets:
        return words.select("word", F.lit(0).cast("bigint").alias("n_near"), F.lit(0).cast("bigint").alias("best_n"), F.col("word").alias("best"))
    n = F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair])
    own = F.pmod(F.xxhash64("word"), n[F.col("size")]).cast("int").alias("own")
    beside = F.explode(F.filter(F.array(*[F.col("size") + d for d in (-1, 0, 1)]), lambda s: n[s].isNotNull())).alias("beside")
    spread = words.select("word", "n", "size", own, beside).select("*", F.explode(F.sequence(F.lit(0), n[F.col("beside")] - 1)).alias("bucket"))
    # a task: holders of one shard, and the words of one bucket that it scans
    held = spread.select("word", "n", F.lit(True).alias("holds"), "size", "own", "beside", "bucket")
    scanned = spread.select("word", "n", F.lit(False).alias("holds"), F.col("beside").alias("size"), F.col("bucket").alias("own"), F.col("size").alias("beside"), F.col("own").alias("bucket"))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(part: pa.Table) -> pa.Table:
        rows = list(zip(*(part.column(c).to_pylist() for c in ("word", "n", "holds")), strict=True))
        holders = sorted(((-n, w) for w, n, holds in rows if holds))  # the best one first
        scan = [w for w, _, holds in rows if not holds]
        x, h = near([w.encode("latin-1") for _, w in holders], [w.encode("latin-1") for w in scan])
        at, first, count = np.unique(x, return_index=True, return_counts=True)
        best = [holders[k] for k in h[first].tolist()]
        return pa.Table.from_arrays([pa.array([scan[k] for k in at.tolist()], pa.string()), pa.array(count, pa.int64()), pa.array([-n for n, _ in best], pa.int64()), pa.array([w for _, w in best], pa.string())], schema=schema)

    parts = held.unionAll(scanned).groupBy("size", "own", "beside", "bucket").applyInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("best_n"), "best")).alias("top")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("top.best_n")).alias("best_n"), "top.best")


def roots(links: DataFrame) -> DataFrame:
    """Of ``links`` (word, form) without cycles: word and the last word that forms lead to. Paths double in every round."""
    up = store(links)
    while True:
        over = up.select(F.col("word").alias("form"), F.col("form").alias("above"))
        jumped = store(up.join(over, "form", "left").select("word", F.coalesce("above", "form").alias("form"), F.col("above").isNotNull().alias("moved")))
        forget(up)
        up = jumped.select("word", "form")
        if jumped.where("moved").isEmpty():
            return up.withColumnRenamed("form", "root")


def spelling_groups(words: DataFrame, ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """Words (word, n) with their near words' number, the form that replaces each and the root of its group.

    A form has at least ``ratio`` (over 1) times the word's n, so forms never lead in a circle. Words are distinct and not null.
    """
    words = store(words.select("word", "n"))
    found = store(words.join(near_words(words, shard), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= ratio * F.col("n"), F.struct("best", "best_n")).alias("to")))
    forget(words)
    found = found.select("word", "n", "n_near", F.col("to.best").alias("form"), F.col("to.best_n").alias("form_n"))
    return found.join(roots(found.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents")).where("n >= 3 and char_length(word) >= 5")
    return spelling_groups(words).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES = {"op12_spelling": op12_spelling}
#: The checksum bit by bit; near words by equal rests without one code point.
ORACLES = {
    "op12_spelling": """
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
tallied AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hex(encode(doc_id || ':' || run))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i - 1, 2))::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, zero: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h FROM tallied),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
cut AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'n': -n, 'w': other}) AS b FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * w.n THEN b.w END AS form, CASE WHEN -b.n >= 2 * w.n THEN -b.n END AS form_n FROM words w LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT up.word, f.form FROM up JOIN forms f ON up.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n::BIGINT AS form_n, up.root
FROM forms f JOIN up ON f.word = up.word JOIN forms r ON up.root = r.word WHERE r.form IS NULL
"""
}
