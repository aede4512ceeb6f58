"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The items' words form a generalised suffix automaton (one for each shard of bounded size when the items are
many, built in a task and kept as flat arrays); each task streams the documents' words through it and
tracks the length of the longest match that ends at each word. A match of ``window`` words or more marks
its last ``window`` words as hit; items of fewer words mark when they match as a whole. Only automata are
sent to the executors, up to ``SENT_BYTES`` of them at a time; where the items have more, the documents go
through one group of them after another, with their hits so far stored between. Documents are never shuffled.
"""

from __future__ import annotations

import pickle
import re
import uuid
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import ALNUM, Kept, column_bytes, slices, store, table

#: Bytes of item text in one automaton, and of automata that workers hold at a time.
SHARD_BYTES, SENT_BYTES = 1_000_000, 64_000_000
#: States whose transitions a worker keeps as dictionaries.
CACHED_STATES = 20_000
_WORD = re.compile(rb"[^ ]+")
_LOADED: dict[str, list[Flat]] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that each window belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.ids = window, {}
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for name, text in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if seq:
                numbered.append((name, seq))
                last = 0
                for w in seq:
                    last = self._add(last, w)
        self.shortest = min([window, *(len(s) for _, s in numbered)])
        self.long: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, seq in numbered:
            v = 0
            for k, w in enumerate(seq):
                v = self.to[v][w]
                if k + 1 >= window:
                    self.long.setdefault(self._holding(v, window), set()).add(name)
            if len(seq) < window:
                self.short.setdefault(v, {}).setdefault(len(seq), set()).add(name)
        # the nearest state up the links that ends a short item
        self.up = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            parent = self.link[v]
            self.up[v] = parent if parent in self.short else self.up[parent]

    def _add(self, last: int, w: int) -> int:
        to, link, length = self.to, self.link, self.length
        if (q := to[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in to[p]:
            to[p][w] = new
            p = link[p]
        if p >= 0:
            q = to[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        to, link, length = self.to, self.link, self.length
        copy = len(to)
        to.append(dict(to[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and to[p].get(w) == q:
            to[p][w] = copy
            p = link[p]
        return copy

    def _holding(self, v: int, n: int) -> int:
        """The state of the last ``n`` words of what ``v`` ends."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def flat(self) -> Flat:
        return Flat(self)


class Flat:
    """An automaton as arrays: transitions by state, links, lengths, and the items of the states that end a window."""

    def __init__(self, built: Automaton) -> None:
        self.window, self.shortest = built.window, built.shortest
        self.words = b"\n".join(built.ids)
        sizes = np.fromiter(map(len, built.to), np.int32, len(built.to))
        self.first = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
        self.edge_word = np.fromiter(chain.from_iterable(built.to), np.int32, int(sizes.sum()))
        self.edge_to = np.fromiter(chain.from_iterable(d.values() for d in built.to), np.int32, int(sizes.sum()))
        self.link, self.length, self.up = (np.array(x, np.int32) for x in (built.link, built.length, built.up))
        self.names = sorted({n for s in built.long.values() for n in s} | {n for d in built.short.values() for s in d.values() for n in s})
        number = {n: k for k, n in enumerate(self.names)}
        states = sorted(built.long)
        self.long_state = np.array(states, np.int32)
        self.long_first = np.cumsum([0, *(len(built.long[v]) for v in states)], dtype=np.int32)
        self.long_item = np.array([number[n] for v in states for n in built.long[v]], np.int32)
        self.short = built.short
        self.ids: dict[bytes, int] = {}
        self.cache: dict[int, dict[int, int]] = {}

    def ready(self) -> Flat:
        """With the dictionary of words, which is not sent."""
        self.ids = {w: k for k, w in enumerate(self.words.split(b"\n"))} if self.words else {}
        return self

    def _next(self, v: int) -> dict[int, int]:
        if (found := self.cache.get(v)) is None:
            if len(self.cache) >= CACHED_STATES:
                self.cache.clear()
            a, b = self.first[v], self.first[v + 1]
            found = self.cache[v] = dict(zip(self.edge_word[a:b].tolist(), self.edge_to[a:b].tolist(), strict=True))
        return found

    def _items(self, v: int) -> set[str]:
        while self.length[self.link[v]] >= self.window:
            v = int(self.link[v])
        at = int(np.searchsorted(self.long_state, v))
        return {self.names[k] for k in self.long_item[self.long_first[at] : self.long_first[at + 1]].tolist()}

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit runs [first word, end) in order, and the items whose windows occur."""
        runs: list[list[int]] = []
        items: set[str] = set()
        if len(words) < self.shortest or not self.ids:
            return runs, items
        seq = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        # stretches of words that items have; windows lie within those
        edge = np.flatnonzero(np.diff(np.concatenate([[False], seq >= 0, [False]])))
        begins, ends = edge[::2], edge[1::2]
        enough = ends - begins >= self.shortest
        step, link, length, window = self._next, self.link, self.length, self.window
        for begin, end in zip(begins[enough].tolist(), ends[enough].tolist(), strict=True):
            v = n = 0
            for k, w in enumerate(seq[begin:end].tolist(), begin):
                while (to := step(v).get(w)) is None and v:
                    v = int(link[v])
                    n = int(length[v])
                if to is not None:
                    v = to
                    n += 1
                if n >= window:
                    items |= self._items(v)
                    self._mark(runs, k + 1 - window, k + 1)
                elif not self.short:
                    continue
                u = v if v in self.short else int(self.up[v])
                while u > 0:
                    for m, names in self.short[u].items():
                        if m <= n:
                            items |= names
                            self._mark(runs, k + 1 - m, k + 1)
                    u = int(self.up[u])
        return runs, items

    @staticmethod
    def _mark(runs: list[list[int]], first: int, end: int) -> None:
        while runs and runs[-1][0] >= first:
            end = max(end, runs.pop()[1])
        if runs and runs[-1][1] >= first:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])


def _automata(key: str, blobs: list[bytes]) -> list[Flat]:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = [pickle.loads(b).ready() for b in blobs]
    return _LOADED[key]


def cut(text: bytes, runs: list[list[int]]) -> str:
    """The text without the words of the runs and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    out, at = [], 0
    for first, end in runs:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, coverage: float = 0.05, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hit words of each document and whether they reach the coverage limit.

    Returns one row per input row: the id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted
    item ids as strings), ``contaminated`` (hit words at least ``coverage`` of all and above 0) and,
    with ``with_text``, ``text``: the text without its hit spans, and the columns to keep. Null or empty texts have no words.
    Items without words match nothing; a null item id is named by an empty string, and items that
    share an id count once. Repeated rows and null ids are kept, very long texts are read whole. Other columns are ignored. Without
    items nothing is hit; empty documents give an empty result.
    """
    spark = docs.sparkSession
    kept = Kept(docs, keep)
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("body")).where("body is not null")
    shards = max(1, -(-(items.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // SHARD_BYTES))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps(Automaton(sorted(zip(rows["item"], map(bytes, rows["body"]))), window).flat())
        return pd.DataFrame({"blob": [blob], "size": [len(blob)]})

    built = store(items.groupBy(F.expr(f"pmod(xxhash64(item), {shards})").alias("shard")).applyInPandas(build, "blob binary, size long").withColumn("shard", F.monotonically_increasing_id()))
    groups: list[list[int]] = [[]]
    size = 0
    for r in built.select("shard", "size").orderBy("shard").collect():
        if groups[-1] and size + r["size"] > SENT_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(r["shard"])
        size += r["size"]
    none = [F.lit(None).cast("array<array<int>>").alias("runs"), F.lit(None).cast("array<string>").alias("items")]
    state = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).cast("binary").alias("body"), *none, *kept.columns)

    def scan(key, sent, last):
        def run(batches):
            automata = _automata(key, sent.value)
            for part in slices(batches, "body"):
                n, hit, runs_out, items_out, texts = [], [], [], [], []
                for body, old, names in zip(column_bytes(part, "body"), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = words_of(body)
                    runs, found = old or [], set(names or ())
                    for automaton in automata:
                        more, of = automaton.scan(words)
                        if more:
                            merged: list[list[int]] = []
                            for first, end in sorted([*runs, *more]):
                                Flat._mark(merged, first, end)
                            runs, found = merged, found | of
                    n.append(len(words))
                    hit.append(sum(end - first for first, end in runs))
                    runs_out.append(runs)
                    items_out.append(sorted(found))
                    if with_text and last:
                        texts.append(None if body is None else cut(body, runs) if runs else body.decode("utf-8", "replace"))
                own = {"row": part.column(0)}
                if last:
                    own |= {"n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hit, pa.int64())} | ({"text": pa.array(texts, pa.string())} if with_text else {})
                else:
                    own |= {"body": part.column(1), "runs": pa.array(runs_out, pa.list_(pa.list_(pa.int32())))}
                yield kept.beside(part, **own, items=pa.array(items_out, pa.list_(pa.string())))

        return run

    for k, group in enumerate(groups):
        blobs = [bytes(r["blob"]) for r in built.where(F.col("shard").isin(group)).orderBy("shard").select("blob").collect()] if group else []
        last = k == len(groups) - 1
        ddl = "n_words bigint, n_hit bigint" + (", text string" if with_text else "") if last else "body binary, runs array<array<int>>"
        state = state.mapInArrow(scan(uuid.uuid4().hex, spark.sparkContext.broadcast(blobs), last), f"row bigint, {ddl}, items array<string>{kept.ddl}")
        if not last:
            state = store(state)
    out = state.select(F.col("row").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.expr("n_hit > 0") & (F.col("n_hit") >= F.lit(coverage) * F.col("n_words"))).alias("contaminated"), *(["text"] if with_text else []), *kept.inner)
    return kept.restore(out)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
_SPLIT = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_SPLIT.format("text")}, []) AS ws FROM documents),
i AS (SELECT item_id, coalesce({_SPLIT.format("text")}, []) AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, list_slice(ws, k, k + least(13, len(ws)) - 1) AS win FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 11))) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM wins),
found AS (SELECT doc_id, k, w.m, item_id FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM d, sizes WHERE len(ws) >= m) x JOIN wins w ON w.m = x.m AND w.win = list_slice(ws, k, k + x.m - 1)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id"""
}
