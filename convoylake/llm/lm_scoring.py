"""Cross-entropy difference scoring with matched target and background n-gram models over one vocabulary.

Both models are bigram models interpolated with unigrams and of one make; the vocabulary is the words of all
documents. The target model counts the documents named as target, the background model counts all. A
document's own counts are left out of both models when it is scored, so a target is judged as any other
document, and only what else the corpus holds counts. The background's counts enter on the scale of the target's
number of words, so both are smoothed alike whatever their sizes. No count is pruned.

Documents and the names of targets are dealt into blocks by id (``word_blocks``). A block sends its distinct
word and pair codes with its counts to the shards of the code range; a shard sums them and answers each
block with the counts it asked for; the block then scores its documents. Totals are summed apart and come
as one row a block. Texts are shuffled once, for both passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import table
from convoylake.llm.word_blocks import BLOCK_BYTES, Blocks, Tokens, from_planes, packed_codes, planes, slices_of, unpacked_codes

#: Weight of the pair model, and what is added to every word's count.
PAIR_WEIGHT, ADDED = 0.6, 0.1


def score_documents(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cross-entropy difference of each document, in nats a word: ``score`` = target minus background, lower is closer to the target.

    ``targets`` has the ids of the target documents. Returns one row per input row: the id,
    ``n_tokens``, ``target_entropy``, ``background_entropy``, ``score``. Null texts and texts without
    words have no tokens and null entropies and score. With no target documents the target model is
    uniform over the vocabulary and the background is not scaled. Repeated rows count as often as they
    occur, and each leaves out one of them; rows of one id are dealt to one block. Rows with a null id are kept
    and are no targets, very long texts are read whole, other columns are ignored, empty input gives an empty
    result.
    """
    blocks = Blocks(docs, id_col, text_col, block_bytes)
    n, named = blocks.n, blocks.named(targets)

    def ask(rows: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            x = Tokens(rows["body"].tolist())
            target = rows["row"].isin(set(names["row"])).to_numpy(bool)[x.doc]
            for kind, numbers, distinct in ((0, x.word, x.vocab), (1, x.pair, x.pairs)):
                t, b = (np.bincount(v, minlength=len(distinct)).astype(np.uint32) for v in (numbers[target], numbers))
                out += [(s, int(rows["block"].iat[0]), kind, packed_codes(distinct[i:j]), planes(t[i:j]), planes(b[i:j])) for s, i, j in slices_of(distinct, n)]
        return pd.DataFrame(out, columns=["shard", "block", "kind", "codes", "t", "b"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        out, shard = [], rows["shard"].iat[0]
        for kind, part in rows.groupby("kind"):
            codes = [unpacked_codes(c) for c in part["codes"]]
            at, distinct = pd.factorize(np.concatenate(codes))
            sums = [np.bincount(at, weights=np.concatenate([from_planes(v, np.uint32) for v in part[c]]), minlength=len(distinct)).astype(np.uint64) for c in "tb"]
            ends = np.cumsum([0, *map(len, codes)])
            out += [(block, shard, kind, planes(sums[0][at[i:j]]), planes(sums[1][at[i:j]]), 0, 0.0, 0.0) for block, i, j in zip(part["block"], ends, ends[1:])]
            if kind == 0:
                out.append((-1, shard, 2, None, None, int((distinct > 0).sum()), float(sums[0].sum()), float(sums[1].sum())))
        return pd.DataFrame(out, columns=["block", "shard", "kind", "t", "b", "size", "nt", "nb"])

    def score(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["row", "n_tokens", "t", "b"])
        x = Tokens(rows["body"].tolist())
        target = rows["row"].isin(set(told["name"][told["kind"] == 3])).to_numpy(bool)
        told = told.sort_values("shard")
        total = told[told["kind"] == 2].iloc[0]
        of = {(k, c): np.concatenate([np.zeros(0), *map(from_planes, told[told["kind"] == k][c])]) for k in (0, 1) for c in "tb"}
        own_word, own_pair = x.own(x.word), x.own(x.pair)
        own_before = np.where(x.first, 0, np.concatenate([np.zeros(1, np.int64), own_word[:-1]])[: len(own_word)])
        entropies = []
        for c, words, counted, scale in (("t", total["nt"], target[x.doc], 1.0), ("b", total["nb"], np.ones(len(x.doc), bool), total["nt"] / total["nb"] if total["nt"] else 1.0)):
            one = ((of[0, c][x.word] - own_word * counted) * scale + ADDED) / ((words - x.length[x.doc] * counted) * scale + ADDED * total["size"])
            before = np.where(x.first, 0, of[0, c][x.before] - own_before * counted)
            weight = np.where(before > 0, PAIR_WEIGHT, 0.0)
            prob = weight * (of[1, c][x.pair] - own_pair * counted) / np.maximum(before, 1) + (1 - weight) * one
            entropies.append(np.where(x.length > 0, x.sums(-np.log(prob)) / np.maximum(x.length, 1), np.nan))
        return pd.DataFrame({"row": rows["row"], "n_tokens": x.length, "t": entropies[0], "b": entropies[1]})

    asked = blocks.dealt.groupBy("block").cogroup(named.groupBy("block")).applyInPandas(ask, "shard long, block long, kind int, codes binary, t binary, b binary")
    answers = asked.groupBy("shard").applyInPandas(answer, "block long, shard long, kind int, t binary, b binary, size long, nt double, nb double")
    totals = answers.where("block < 0").agg(*[F.coalesce(F.sum(c), F.lit(0).cast(k)).alias(c) for c, k in (("size", "bigint"), ("nt", "double"), ("nb", "double"))])
    told = answers.where("block >= 0").unionByName(blocks.everywhere(totals).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    told = told.unionByName(named.select("block", F.lit(3).alias("kind"), F.col("row").alias("name")), allowMissingColumns=True)
    out = blocks.dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(score, "row string, n_tokens long, t double, b double")
    t, b = F.nanvl("t", F.lit(None)), F.nanvl("b", F.lit(None))
    return out.select(F.col("row").cast("bigint").alias(id_col), "n_tokens", t.alias("target_entropy"), b.alias("background_entropy"), (t - b).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a target model of those labelled as of good quality and not toxic."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLES = {}
