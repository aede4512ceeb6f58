"""Ranked lexical search by a threshold-seeded join.

One pass over the texts keeps, of each document, its length and the terms that items ask for (a forward
index); no text is shuffled. A pass over the index finds, for each such term, how many documents hold it and
the ``k`` largest impacts of any document. The stored k-th impact of a term is a score that at least k
documents reach by that term alone, so the best of an item's terms gives a lower bound of its k-th score. An
item's terms are ordered by their largest possible share of a score; the longest run of small ones at the end
whose sum stays under that bound cannot bring a document in by itself and is pruned from the search.

The other terms are joined with the index: each document adds up what it gets for an item, and becomes a
candidate if that, with all that the pruned terms could add, reaches the bound. Candidates are rescored
exactly from the index, the best k of each item stay, and their k-th score raises the task's bound. Items are
taken in blocks of a bounded number of terms; only a block's items and term figures are sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoylake.llm.common import ALNUM, column_bytes, forget, slices, store, table

#: Terms of items in a block, about, each counted once an item.
BLOCK_TERMS = 500_000
#: Additions of one step in a task, and cells of its grid of documents and items.
STEP = 2_000_000
#: Documents of a task's first step; steps double, as the bound rises with what has been seen.
FIRST_STEP = 64
#: Groups in which the tasks' largest impacts of a term are merged before they come together.
MERGED = 64
#: Share of a term's maximum that length cannot change, in hundredths, and the scale of impacts.
FIXED, LENGTH, SCALE = 25, 75, 1_000_000_000

_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return (text or b"").translate(ALNUM).split()


def impacts(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Shares of documents with ``tf`` occurrences among ``n`` terms, before a term's weight."""
    if LENGTH * int(n.max(initial=0)) * total_docs > _LAST:  # more than 64 bits hold
        m = FIXED + np.array([LENGTH * int(x) * total_docs // total_terms for x in n], np.int64)
    else:
        m = FIXED + (LENGTH * n * total_docs) // total_terms
    return (SCALE * tf) // (1000 * tf + 8 * m)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, count of them, for each row."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _ragged(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts of each key below ``size`` in sorted keys."""
    counts = np.bincount(keys, minlength=size)
    return np.cumsum(counts) - counts, counts


class Best:
    """The best ``k`` documents of each item that a task has seen: scores descending, then ids ascending."""

    def __init__(self, items: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.items = items

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        starts, counts = _ragged(item, self.items)
        keep = np.arange(len(item)) - starts[item] < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = np.flatnonzero(counts >= self.k)
        self.floor[full] = np.maximum(self.floor[full], score[starts[full] + self.k - 1])


class Block:
    """A block's items as arrays: the terms that are searched, by term, and all terms, by item."""

    def __init__(self, rows: list, terms: int) -> None:
        """rows: (item, term, repeats, weight, bound, rest, floor, searched), by item."""
        item, self.term, reps, weight, floor, rest = (np.array([r[c] for r in rows], np.int64) for c in ("item", "term", "reps", "weight", "floor", "rest"))
        searched = np.array([r["searched"] for r in rows], bool)
        self.ids, self.item = np.unique(item, return_inverse=True)
        self.items, self.terms = len(self.ids), terms
        self.gain = reps * weight
        self.first, self.count = _ragged(self.item, self.items)
        self.floor, self.rest = floor[self.first], rest[self.first]
        order = np.argsort(self.term[searched], kind="stable")
        self.to, self.to_gain = self.item[searched][order], self.gain[searched][order]
        self.to_first, self.to_count = _ragged(self.term[searched][order], terms)

    def search(self, doc_ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, share: np.ndarray, best: Best) -> None:
        """Adds the documents' candidates to ``best``; ``lengths`` are their numbers of index terms, which ascend in each document."""
        ends = np.cumsum(lengths)
        work = np.cumsum(self.to_count[term])  # additions up to each posting
        work_at = np.concatenate([[0], work])[np.concatenate([[0], ends])]
        row = np.repeat(np.arange(len(lengths)), lengths)
        keys = row * self.terms + term
        at, step = 0, FIRST_STEP
        while at < len(lengths):
            stop = min(at + step, at + max(1, STEP // self.items), int(np.searchsorted(work_at, work_at[at] + STEP, "right")) - 1)
            stop, step = max(at + 1, stop), 2 * step
            a, b = ends[at] - lengths[at], ends[min(stop, len(lengths)) - 1]
            stop = min(stop, len(lengths))
            counts = self.to_count[term[a:b]]
            to = _spread(self.to_first[term[a:b]], counts)
            gains = self.to_gain[to] * np.repeat(share[a:b], counts)
            cell = np.repeat(row[a:b] - at, counts) * self.items + self.to[to]
            got = np.bincount(cell, weights=gains, minlength=(stop - at) * self.items).reshape(-1, self.items)
            # sums of doubles may be off in the last places, so the bound is taken a little lower
            docs, items = np.nonzero((got > 0) & (got + self.rest >= best.floor * (1 - 1e-9)))
            self._rescore(docs + at, items, doc_ids, keys, share, best)
            at = stop

    def _rescore(self, docs: np.ndarray, items: np.ndarray, doc_ids: np.ndarray, keys: np.ndarray, share: np.ndarray, best: Best) -> None:
        total, at = np.cumsum(self.count[items]), 0
        while at < len(docs):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
            counts = self.count[items[at:stop]]
            to = _spread(self.first[items[at:stop]], counts)
            want = np.repeat(docs[at:stop], counts) * self.terms + self.term[to]
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            gains = np.where(keys[place] == want, self.gain[to] * share[place], 0)
            score = np.add.reduceat(gains, np.cumsum(counts) - counts)
            some = score > 0
            best.add(items[at:stop][some], score[some], doc_ids[docs[at:stop]][some])
            at = stop


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct terms of each item row: item (a number for the row), item_id, term, reps. Items without terms have none."""
    items = store(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            for item, text in zip(batch.column(0).to_pylist(), column_bytes(batch, "body"), strict=True):
                found = Counter(terms_of(text))
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(found), pa.int64()), "term": pa.array(list(found), pa.binary()), "reps": pa.array(list(found.values()), pa.int64())})

    return items.select("item", "body").mapInArrow(run, "item bigint, term binary, reps bigint").join(items.select("item", "item_id"), "item")


def forward_index(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Of each document with a term: id, n (its terms), and which of ``terms`` it holds how often, ascending."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in slices(batches, "body"):
            n, sizes, held, times = [], [], [], []
            for text in column_bytes(batch, "body"):
                found = terms_of(text)
                n.append(len(found))
                hits = sorted((known[t], x) for t, x in Counter(found).items() if t in known)
                sizes.append(len(hits))
                held += [k for k, _ in hits]
                times += [x for _, x in hits]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = {c: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for c, v in (("terms", held), ("tfs", times))}
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n": pa.array(n, pa.int64())} | lists)

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>").where("n > 0")


def _postings(batch: pa.RecordBatch, total_docs: int, total_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of terms, terms and shares of a batch of the index."""
    ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
    terms, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
    lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), lengths)
    return ids, lengths, terms, impacts(tfs, n, total_docs, total_terms)


def term_figures(index: DataFrame, k: int, terms: int, total_docs: int, total_terms: int) -> DataFrame:
    """Of each term of the index: df, weight, ``top`` and ``kth``, the largest and the k-th largest share of a document (0 if fewer have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        term, share = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, _, more, shares = _postings(batch, total_docs, total_terms)
            df += np.bincount(more, minlength=terms)
            term, share = np.concatenate([term, more]), np.concatenate([share, shares])
            order = np.lexsort((-share, term))
            term, share = term[order], share[order]
            keep = np.arange(len(term)) - _ragged(term, terms)[0][term] < k
            term, share = term[keep], share[keep]
        some = np.flatnonzero(df)
        ends = np.concatenate([[0], np.cumsum(_ragged(term, terms)[1][some])])
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "df": pa.array(df[some]), "tops": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(share))})

    parts = index.mapInArrow(run, "term bigint, df bigint, tops array<bigint>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    tops = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("tops")))), 1, k).alias("tops")
    merged = parts.groupBy("term", "part").agg(F.sum("df").alias("df"), tops).groupBy("term").agg(F.sum("df").alias("df"), tops)
    weight = F.floor(1000 * F.log((2 * F.lit(total_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).alias("weight")
    return merged.select("term", "df", weight, F.col("tops")[0].alias("top"), F.coalesce(F.get("tops", F.lit(k - 1)), F.lit(0)).alias("kth"))


def seeded(items: DataFrame, figures: DataFrame) -> DataFrame:
    """Items' terms with each item's ``floor`` (its k-th score is no lower), ``searched`` (not pruned) and ``rest`` (what the pruned ones can add)."""
    bound = F.col("reps") * F.col("weight") * F.col("top")
    rows = items.join(figures, "term").withColumn("bound", bound)
    item = Window.partitionBy("item")
    smaller = item.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("floor", F.max(F.col("reps") * F.col("weight") * F.col("kth")).over(item)).withColumn("below", F.sum("bound").over(smaller))
    rows = rows.withColumn("searched", F.col("below") >= F.col("floor"))
    return rows.withColumn("rest", F.coalesce(F.max(F.when(~F.col("searched"), F.col("below"))).over(item), F.lit(0)))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: the item column, rank, the id column, score.

    Ties go to the smaller id, null ids last. Null texts and texts without terms take no part. Repeated rows of
    documents are documents of their own, repeated rows of items are ranked each by itself. Columns beside ids
    and texts are ignored. A block holds at least one item, so an item's terms must fit a task.
    """
    asked = store(item_terms(items, item_col, item_text_col))
    blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    results = []
    for block in range(blocks):
        mine = asked.where(F.col("block") == block)
        terms = sorted(bytes(r["term"]) for r in mine.select("term").distinct().collect())  # at most about block_terms
        index = store(forward_index(docs, terms, id_col, text_col))
        results.append(_search_block(index, mine, terms, k))
        forget(index)
    names = asked.select("item", "item_id").distinct()
    found = results[0]
    for more in results[1:]:
        found = found.unionAll(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))).alias("rank")
    best = found.select("item", rank, "id", "score").where(F.col("rank") <= k)
    return best.join(names, "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(index: DataFrame, asked: DataFrame, terms: list[bytes], k: int) -> DataFrame:
    """Each task's best k documents of each item, stored."""
    spark = index.sparkSession
    empty = spark.createDataFrame([], "item bigint, id bigint, score bigint")
    total_docs, total_terms = index.agg(F.count("*"), F.sum("n")).first()
    if not total_docs or not terms:
        return empty
    numbered = spark.createDataFrame(pa.table({"word": pa.array(terms, pa.binary()), "number": pa.array(range(len(terms)), pa.int64())}))
    figures = store(term_figures(index, k, len(terms), total_docs, total_terms))
    numbers = asked.select("item", F.col("term").alias("word"), "reps").join(numbered, "word").select("item", F.col("number").alias("term"), "reps")
    rows = seeded(numbers, figures).orderBy("item", "term").collect()  # at most about block_terms
    forget(figures)
    if not rows:
        return empty
    sent = spark.sparkContext.broadcast(Block(rows, len(terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = Best(block.items, k, block.floor)
        for batch in batches:
            block.search(*_postings(batch, total_docs, total_terms), best)
        ids = pa.array(best.doc, pa.int64(), mask=best.doc == _LAST)
        yield pa.RecordBatch.from_pydict({"item": pa.array(block.ids[best.item]), "id": ids, "score": pa.array(best.score)})

    return store(index.select("id", "n", "terms", "tfs").mapInArrow(run, "item bigint, id bigint, score bigint"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {
    "op11_ranked_search": """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
lengths AS (SELECT doc_id, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM texts) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, docs),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
}
