"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over words as they are written, runs of marks among them, and pairs of those, of all trusted
documents without pruning. Its counts are summed in
shards of the code range and joined back to the documents' own words and pairs, block by block
(``word_blocks``), so what is gathered grows with the input and no table of the model is ever in one place:

1. Trusted documents are chosen by a bitmap of ids and dealt to blocks, which send their distinct pairs with
   counts; a shard keeps the sums and answers for each pair one of the blocks that have it.
2. That block gives what the pair adds to its context and to its word to the words' shards, which keep the sums:
   of a context its tokens and the pairs seen once, twice and more often, of a word the number of different words
   before it. The different words of all documents are counted in one scan.
3. All documents are scored in up to eight passes: blocks ask the shards for their own pairs and words. What a pass
   shuffles (its texts, codes and answers) goes before the next, so beside the model an eighth of it is on disk at a time.

A trusted document's own counts are left out when it is scored, so trusted documents are judged as any
other, and all of them enter the model and the thresholds. A document is of low quality when its
perplexity exceeds a quantile of the trusted documents' perplexities in its language; the quantile of a
language with few of them leans on the one of all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import forget, mix, store, table
from convoylake.llm.word_blocks import Blocks, Tokens, from_planes, marked_hashes, numbered, packed_codes, planes, slices_of, unpacked_codes

#: Share of the trusted documents of a language that may be called low.
QUANTILE = 0.995
#: Trusted documents of a language that weigh as much as the quantile of all languages.
LEAN = 200
#: Bytes of text in a block, about: scoring holds some twenty numbers a token.
BLOCK_BYTES = 4_000_000
#: Parts of the documents that are scored one after the other, at most: so much less is on disk at a time beside the model.
PASSES = 8
_WORD_STATISTICS = ("tokens", "once", "twice", "often", "before")
_STATISTICS = ", ".join(f"{c} binary" for c in _WORD_STATISTICS)
_OF_WORDS = ("types", "mass", "c1", "c2", "c3", "c4")
#: What a row tells: a shard's pairs or words, a block's counts of pairs, a trusted document's name.
PAIRS, COUNTED, WORDS, NAMES = 0, 1, 2, 3


def discounts(of: list[float]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many things have the counts 1 to 4."""
    n = [0, *of]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) if n[k] else 0.5 * k for k in (1, 2, 3))])


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The id, ``n_words`` and ``perplexity`` (a word; null without words) of each document under the model of the trusted ones, itself left out.

    Totals over the vocabulary and discounts are those of the whole model. Rows of one id are dealt to one
    block; null ids are not trusted.
    """
    blocks = Blocks(docs, id_col, text_col, block_bytes)
    pairs, words, of_pairs, of_words = _model(blocks, trusted, block_bytes)
    model = pairs.unionByName(words, allowMissingColumns=True)
    size, shards = _vocabulary(blocks), of_pairs["shards"]
    d, dc = discounts([of_pairs[f"n{k}"] for k in range(1, 5)]), discounts([of_words[f"c{k}"] for k in range(1, 5)])
    mass = max(of_words["mass"], 1)
    given = dc[1] * of_words["c1"] + dc[2] * of_words["c2"] + dc[3] * (of_words["types"] - of_words["c1"] - of_words["c2"])
    rest = given / mass if of_words["mass"] else 1.0

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        x = Tokens(rows["body"].tolist(), marked_hashes)
        out = [(s, int(rows["block"].iat[0]), kind, packed_codes(of[i:j])) for kind, of in ((PAIRS, x.pairs), (WORDS, x.vocab)) for s, i, j in slices_of(of, shards)]
        return pd.DataFrame(out, columns=["shard", "block", "kind", "codes"])

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, names in ((PAIRS, ("sums",)), (WORDS, _WORD_STATISTICS)):
            of, mine = asked[asked["kind"] == kind], known[known["kind"] == kind]
            if not len(of):
                continue
            codes = [unpacked_codes(c) for c in of["codes"]]
            wanted, ends = np.concatenate(codes), np.cumsum([0, *map(len, codes)])
            values = [np.zeros(len(wanted), np.uint64) for _ in names]
            if len(mine):
                there = unpacked_codes(mine["codes"].iat[0])
                at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
                values = [np.where(there[at] == wanted, from_planes(mine[c].iat[0])[at], np.uint64(0)) for c in names]
            out += [{"block": block, "shard": of["shard"].iat[0], "kind": kind} | {c: planes(v[i:j]) for c, v in zip(names, values, strict=True)} for block, i, j in zip(of["block"], ends, ends[1:])]
        return pd.DataFrame(out, columns=["block", "shard", "kind", "sums", *_WORD_STATISTICS])

    def score(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["row", "n_words", "perplexity"])
        x = Tokens(rows["body"].tolist(), marked_hashes)
        kept = rows["row"].isin(set(told["name"][told["kind"] == NAMES])).to_numpy(bool)
        told = told.sort_values("shard")
        sums = np.concatenate([np.zeros(0, np.uint64), *map(from_planes, told["sums"][told["kind"] == PAIRS])]).astype(np.int64)
        tokens, once, twice, often, before = (np.concatenate([np.zeros(0, np.uint64), *map(from_planes, told[c][told["kind"] == WORDS])]).astype(np.float64) for c in _WORD_STATISTICS)
        # each token's pair without what its document gives to the model, and what the document gives to context and word
        every = x.own(x.pair)
        own = every * kept[x.doc]
        c = sums[x.pair] - own
        each = 1 / every  # so that a document's distinct pairs count once
        lost = d[1] * once + d[2] * twice + d[3] * often
        lost_now = lost[x.before] + _by(x, x.before, (d[np.minimum(c, 3)] - d[np.minimum(c + own, 3)]) * each)
        tokens_now = tokens[x.before] - x.own(x.before) * kept[x.doc]
        before_now = before[x.word] - _by(x, x.word, ((own > 0) & (c == 0)) * each)
        whole = np.rint(before_now)
        single = np.maximum(whole - dc[np.clip(whole, 0, 3).astype(np.int64)], 0) / mass + rest / (size + 1)
        seen = tokens_now > 0
        full = np.maximum(tokens_now, 1)
        prob = np.where(seen, np.maximum(c - d[np.minimum(c, 3)], 0) / full + np.maximum(lost_now, 0) / full * single, single)
        return pd.DataFrame({"row": rows["row"], "n_words": x.length, "perplexity": np.where(x.length > 0, np.exp(x.sums(-np.log(prob)) / np.maximum(x.length, 1)), np.nan)})

    out, passes = None, max(1, min(PASSES, blocks.n // 12))
    for k in range(passes):
        mine = F.col("block") % passes == k
        dealt, named = blocks.dealt.where(mine).groupBy("block"), blocks.named(trusted).where(mine)
        asked = dealt.applyInPandas(ask, "shard long, block long, kind int, codes binary")
        answered = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(answer, f"block long, shard long, kind int, sums binary, {_STATISTICS}")
        told = answered.unionByName(named.select("block", F.lit(NAMES).alias("kind"), F.col("row").alias("name")), allowMissingColumns=True)
        scored = store(dealt.cogroup(told.groupBy("block")).applyInPandas(score, "row string, n_words long, perplexity double"))
        out = scored if out is None else out.unionByName(scored)
    forget(pairs)
    forget(words)
    return out.select(F.col("row").cast("bigint").alias(id_col), "n_words", F.nanvl("perplexity", F.lit(None)).alias("perplexity"))


def _vocabulary(blocks: Blocks) -> int:
    """The number of different words of all documents."""
    shards = blocks.n // 8 + 1

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.unique(mix(marked_hashes(rows["body"].tolist())[1] + np.uint64(1)))
            yield pd.DataFrame([(s, packed_codes(x[i:j])) for s, i, j in slices_of(x, shards)], columns=["shard", "codes"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(np.unique(np.concatenate([unpacked_codes(c) for c in rows["codes"]])))]})

    given = blocks.docs.select("body").mapInPandas(give, "shard long, codes binary")
    found = store(given.groupBy("shard").applyInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    n = found.first()["n"]
    forget(found)
    return n


def _model(blocks: Blocks, trusted: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame, dict[str, int], dict[str, int]]:
    """The model in shards of the code range: sorted pairs with their counts, sorted words with their statistics; and the sums of both over all shards."""
    docs = Blocks(blocks.few(trusted).withColumnRenamed("row", blocks.id_col), blocks.id_col, "body", block_bytes)
    n, named = docs.n, docs.named(trusted)

    def ask(rows: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows[rows["row"].isin(set(names["row"]))], []
        if len(rows):
            x = Tokens(rows["body"].tolist(), marked_hashes)
            t = np.bincount(x.pair, minlength=len(x.pairs)).astype(np.uint32)
            out = [(s, int(rows["block"].iat[0]), packed_codes(x.pairs[i:j]), planes(t[i:j])) for s, i, j in slices_of(x.pairs, n)]
        return pd.DataFrame(out, columns=["shard", "block", "codes", "t"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        codes = [unpacked_codes(c) for c in rows["codes"]]
        at, distinct = numbered(np.concatenate(codes))
        sums = np.bincount(at, weights=np.concatenate([from_planes(t, np.uint32) for t in rows["t"]]), minlength=len(distinct)).astype(np.uint64)
        # one of the blocks with a pair answers for it
        counted = np.where(pd.Series(at).duplicated(), 0, np.minimum(sums, 3)[at]).astype(np.uint8)
        ends, shard = np.cumsum([0, *map(len, codes)]), rows["shard"].iat[0]
        out = [(block, shard, COUNTED, planes(counted[i:j]), None, None, 0, 0, 0, 0) for block, i, j in zip(rows["block"], ends, ends[1:])]
        out.append((-1, shard, PAIRS, None, packed_codes(distinct), planes(sums), *((sums == k).sum() for k in range(1, 5))))
        return pd.DataFrame(out, columns=["block", "shard", "kind", "counted", "codes", "sums", "n1", "n2", "n3", "n4"])

    def share(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows[rows["row"].isin(set(told["name"][told["kind"] == NAMES]))], []
        if len(rows):
            x = Tokens(rows["body"].tolist(), marked_hashes)
            c = np.concatenate([np.zeros(0, np.uint8), *(from_planes(v, np.uint8) for v in told[told["kind"] == COUNTED].sort_values("shard")["counted"])])
            context, word = np.zeros(len(x.pairs), np.int64), np.zeros(len(x.pairs), np.int64)
            context[x.pair], word[x.pair] = x.before, x.word
            of = [np.bincount(x.before, minlength=len(x.vocab)), *(np.bincount(context[c == k], minlength=len(x.vocab)) for k in (1, 2, 3)), np.bincount(word[c > 0], minlength=len(x.vocab))]
            out = [(s, packed_codes(x.vocab[i:j]), *(planes(v[i:j].astype(np.uint32)) for v in of)) for s, i, j in slices_of(x.vocab, n)]
        return pd.DataFrame(out, columns=["shard", "codes", *_WORD_STATISTICS])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        at, distinct = numbered(np.concatenate([unpacked_codes(c) for c in rows["codes"]]))
        of = [np.bincount(at, weights=np.concatenate([from_planes(v, np.uint32) for v in rows[c]]), minlength=len(distinct)).astype(np.uint64) for c in _WORD_STATISTICS]
        before = of[-1]
        one = (rows["shard"].iat[0], WORDS, packed_codes(distinct), *map(planes, of), (before > 0).sum(), before.sum(), *((before == k).sum() for k in range(1, 5)))
        return pd.DataFrame([one], columns=["shard", "kind", "codes", *_WORD_STATISTICS, *_OF_WORDS])

    dealt = docs.dealt.groupBy("block")
    asked = dealt.cogroup(named.groupBy("block")).applyInPandas(ask, "shard long, block long, codes binary, t binary")
    counted = store(asked.groupBy("shard").applyInPandas(count, "block long, shard long, kind int, counted binary, codes binary, sums binary, n1 long, n2 long, n3 long, n4 long"))
    told = counted.where(F.col("kind") == COUNTED).select("block", "shard", "kind", "counted")
    told = told.unionByName(named.select("block", F.lit(NAMES).alias("kind"), F.col("row").alias("name")), allowMissingColumns=True)
    shared = dealt.cogroup(told.groupBy("block")).applyInPandas(share, f"shard long, codes binary, {_STATISTICS}")
    words = store(shared.groupBy("shard").applyInPandas(total, f"shard long, kind int, codes binary, {_STATISTICS}, {', '.join(f'{c} long' for c in _OF_WORDS)}"))
    pairs = counted.where(F.col("kind") == PAIRS)
    of_pairs, of_words = (t.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names]).first().asDict() for t, names in ((pairs, ("n1", "n2", "n3", "n4")), (words, _OF_WORDS)))
    return pairs.select("shard", "kind", "codes", "sums"), words.drop(*_OF_WORDS), of_pairs | {"shards": n}, of_words


def _by(x: Tokens, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each token the sum of the values over the tokens of its document with the same number."""
    if not len(numbers):
        return np.zeros(0)
    at, _ = pd.factorize(x.doc * (int(numbers.max()) + 1) + numbers)
    return np.bincount(at, weights=values)[at]


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Perplexity of each document and whether it is of low quality.

    ``trusted`` has the ids of the rows that the model is learned from and that give the thresholds.
    Returns one row per input row: the id, ``lang``, ``n_words``, ``perplexity``, ``threshold`` (of the
    document's language; of all trusted rows where a language has none) and ``low``. Null texts and texts
    without words have a null perplexity and are low. If nothing is trusted, perplexities are those of a
    uniform model over the words of all documents and one more, thresholds are null and only texts without words
    are low. A null language is ``und``. Rows of one id have the language of its least row by name; repeated
    rows and null ids (which have no language here and are not trusted) are kept, very long texts are read
    whole, other columns ignored, empty input gives an empty result.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    langs = ids.where("id is not null").groupBy("id").agg(F.min("lang").alias("lang"))
    named = trusted.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    found = perplexities(docs, trusted, id_col, text_col, block_bytes).withColumnRenamed(id_col, "id")
    scored = store(found.join(langs, "id", "left").withColumn("lang", F.coalesce("lang", F.lit("und"))))
    good = scored.where("perplexity is not null").join(named, "id", "left_semi")
    overall = good.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    own = good.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"), F.count("*").alias("k"))
    leaning = (F.col("own") * F.col("k") + F.lit(overall).cast("double") * LEAN) / (F.col("k") + LEAN)
    out = scored.join(own.select("lang", leaning.alias("own")), "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    low = F.coalesce(F.col("perplexity") > F.col("threshold"), F.col("perplexity").isNull())
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_words", "perplexity", "threshold", low.alias("low"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of those labelled as of good quality."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


QUERIES = {"op10_kneser_ney": op10_kneser_ney}
ORACLES = {}
