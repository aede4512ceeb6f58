import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from convoylake.llm import byte_bpe as m

SMALL = "/root/testdata/sf0.01"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark):
    enc = library()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = m.op6_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def odd(rng):
    parts = ["don't ", "we'll", "'re", "  ", "\n\n ", "\t", "été", "ß", "١٢", "²½", "日本語", "🙂", " ", " x", "a" * rng.randrange(200), "7" * rng.randrange(9), "!!!", "\x1c", "\x85", "​", "ǅ", "é"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(60)))


def test_small_chunks_are_stitched(spark):
    enc, rng = library(), random.Random(4)
    rows = [(k, odd(rng)) for k in range(150)] + [(200, None), (201, ""), (None, "x " * 300), (203, "a" * 5000), (204, "a" * 5000), (204, "a" * 5000), (205, " " * 700)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = m.decode(m.encode(df, PATH, P.PATTERN, chunk=64, overlap=24), PATH, P.PATTERN).collect()
    want = sorted((str(i), (t or "").encode(), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]), bytes(r["ids"])) for r in got) == want
    assert m.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_decoding_in_the_same_pass(spark):
    rng = random.Random(6)
    rows = [(k, odd(rng)) for k in range(100)] + [(200, None), (201, ""), (None, "x " * 300), (203, "a" * 5000), (204, "a" * 5000), (204, "a" * 5000), (205, " " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk, overlap in ((64, 24), (m.LONGEST, 24)):
        one = m.encode(df, PATH, P.PATTERN, chunk=chunk, overlap=overlap, decoded=True)
        two = m.decode(m.encode(df, PATH, P.PATTERN, chunk=chunk, overlap=overlap), PATH, P.PATTERN)
        assert one.dtypes == two.dtypes
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_each_pattern_has_its_encoder():
    assert m.encoder(PATH, P.PATTERN).encode("ab cd") != m.encoder(PATH, r"[a-z]|\s").encode("ab cd")
    assert m.encoder(PATH, P.PATTERN).encode("ab cd") == np.array(library().encode_ordinary("ab cd"), "<u4").tobytes()


def test_what_follows_changes_few_pre_tokens():
    """Boundaries of a cut text, but for the last ``UNSURE``, are boundaries of the whole one."""
    rng, pattern = random.Random(8), m.encoder(PATH, P.PATTERN).pattern
    for _ in range(60):
        text = odd(rng)
        whole = {x.end() for x in pattern.finditer(text)}
        for cut in range(len(text)):
            assert {x.end() for x in pattern.finditer(text[:cut])} - whole <= {cut, cut - 1}
            assert set([x.end() for x in pattern.finditer(text[:cut])][: -m.UNSURE]) <= whole


def test_short_and_long_pre_tokens_merge_alike(monkeypatch):
    rng, ranks = random.Random(3), m.encoder(PATH, P.PATTERN).ranks
    for _ in range(400):
        piece = bytes(rng.choice(b"aab the\xc3\xa9") for _ in range(rng.randrange(1, 150)))
        monkeypatch.setattr(m, "LISTED", 0)
        by_heap = m.merge(piece, ranks)
        monkeypatch.setattr(m, "LISTED", 1000)
        assert m.merge(piece, ranks) == by_heap


def test_ids_do_not_change_when_the_cache_turns_over(monkeypatch):
    texts = [f"word{k % 37} other{k % 11} {k}" for k in range(200)]
    want = [m.Encoder(PATH, P.PATTERN).encode(t) for t in texts]
    monkeypatch.setattr(m, "CACHE", 5)
    small = m.Encoder(PATH, P.PATTERN)
    assert [small.encode(t) for t in texts] == want and len(small) <= 5 and len(small.older) <= 5
