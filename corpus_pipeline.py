"""Corpus pipeline: language ID, near-duplicate removal, repeated passages, benchmark contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows and
reads them again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm import byte_bpe, decontaminate, language_id, ngram_jaccard, suffix_dedup
from convoylake.llm.common import forget, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language, with it as their ``lang``; those without letters (``und``) go."""
    model = language_id.train(docs.where(~language_id.held_out()).where("doc_id is not null"))
    found = language_id.identify(docs, model, keep=COLUMNS)
    return found.where("lang_pred <> 'und'").select(*[F.col("lang_pred").alias("lang") if c == "lang" else c for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the one with the smallest id.

    A document is an id and a text: rows of one id with different texts are judged each by itself (of such rows
    of one component the one with the smaller digest stays), repeated rows are one. Rows without an id or
    without words stay.
    """
    found = store(ngram_jaccard.similarity_components(docs, width=5, percent=80, keyed=True).where("component is not null"))
    named = found.where("component_id = doc_id")
    several = named.groupBy("component").agg(F.min("text_key").alias("first"), F.max("text_key").alias("last")).where("first <> last")
    second = named.join(several, "component").where("text_key <> first")
    gone = found.where("component_id <> doc_id").select("doc_id", "text_key").unionAll(second.select("doc_id", "text_key"))
    keyed = docs.select(*COLUMNS, F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"))
    out = keyed.join(gone, ["doc_id", "text_key"], "left_anti").select(*COLUMNS)
    # looked for among the ids, as texts cost a shuffle
    twice = docs.groupBy("doc_id").count().where("count > 1")
    return out if twice.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings of 200 bytes cover; documents that lose all of them go."""
    found = suffix_dedup.remove_repeats(docs, keep=tuple(c for c in COLUMNS if c not in ("doc_id", "text")), as_text=True)
    out = found.where("kept is null or kept <> '' or n_bytes = 0").withColumnRenamed("kept", "text")
    return out.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in COLUMNS])


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate, without the spans of items that stand in them."""
    others = tuple(c for c in COLUMNS if c not in ("doc_id", "text"))
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_text=True, keep=others)
    length = F.when(F.col("n_hit") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.where("not contaminated").select(*[length.alias(c) if c == "n_chars" else c for c in COLUMNS])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as a digest and whether they decode to its text."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.encode(docs, path, pattern, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", contamination),
    ("byte_bpe", tokens),
]

#: No stage but the last two could be written in SQL; the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = store(stage(spark, docs, sf_dir))
        if k:
            forget(docs)  # what the stage before has written
        docs = kept
    return docs
