import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from convoylake.llm import token_counts as m

SMALL = "/root/testdata/sf0.01"
PATH = P.path("word_bpe_49k.json")
#: Characters whose case, composition or kind is peculiar, contractions, added tokens and parts of them.
PARTS = ["don't ", "we'LL", "'RE", "'S", "  ", "\n\n", "\t", "\x1c", "\x85", " ", "été", "é", "ß", "ẞ", "ﬁ", "Å", "İ", "ΣΑΣ", "Σ", "ſ", "ǅ", "ẛ̣", "a͏̈", "각", "日本語", "𐐀", "١٢", "²½", "7" * 5, "!!!", "🙂", "🥹", "\x00", "​", "﻿", "A" * 50]
PARTS += ["<|endoftext|>", "<|startoftext|>", "<|endof", "<|ENDOFTEXT|>"]


def test_query_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = m.op13_token_counts(spark, SMALL).collect()
    assert len(got) == len(docs)
    counts = dict(zip(docs, (len(e.ids) for e in library.encode_batch([*docs.values()], add_special_tokens=False)), strict=True))
    for r in got:
        n = counts[r["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 2048)


def test_odd_texts_equal_the_library():
    library, counts, rng = Tokenizer.from_file(PATH), m.counter(PATH), random.Random(6)
    spans = ((0, 0x250), (0, 0x3000), (0, 0xD800), (0xE000, 0x110000))
    for _ in range(6000):
        text = "".join(rng.choice(PARTS) if rng.random() < 0.7 else chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(14)))
        assert counts.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_proof_is_whole_and_right():
    library, counts = Tokenizer.from_file(PATH), m.counter(PATH)
    proved = [*counts][: counts.proved]
    assert len(proved) > 30_000
    for piece in proved[::50]:
        assert counts.merged(piece) == 1 and len(library.encode(piece, add_special_tokens=False).ids) == 1
    # a vocabulary string that no text gives as a single token is none of them
    assert all(counts.merged(w) == 1 for w in ("the", "7", "!")) and counts.merged("qzxjv") > 1


def test_cache_keeps_the_proof(monkeypatch):
    counts = m.Counter(PATH)
    monkeypatch.setattr(m, "CACHE", 10)
    texts = [f"zq{k}xv qzx{k}" for k in range(200)] + ["wlkjq" * k for k in range(30)]
    want = [counts.merged(p) for t in texts for p in counts.plain(t)]
    assert [counts[p] for t in texts for p in counts.plain(t)] == want and len(counts) <= counts.proved + 10


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a cat", 5), (3, "a cat", 5), (3, "a cat", 5), (4, "<|endoftext|>cat" + " cat" * 50_000, 5), (5, "é" * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(PATH)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in m.count_tokens(df, PATH).collect()) == want
    assert m.count_tokens(df.limit(0), PATH).count() == 0
    kept = m.count_tokens(df, PATH, keep=("doc_id", "n_tokens")).collect()
    assert {r["n_tokens"] for r in kept} == {5} and set(kept[0].asDict()) == {"doc_id", "n_bytes", "n_tokens"}


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        m.Counter(P.path("byte_bpe_50k.json"))
