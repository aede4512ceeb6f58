import random

from brute import jaccard_components

from convoylake.llm import ngram_jaccard
from convoylake.llm.ngram_jaccard import op2_ngram_jaccard, similarity_components

SMALL = "/root/testdata/sf0.01"


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert as_dict(op2_ngram_jaccard(spark, SMALL)) == jaccard_components(docs)


def test_dense_near_copies(spark, monkeypatch):
    monkeypatch.setattr("convoylake.llm.ngram_jaccard.RARE", 2)
    rng = random.Random(3)
    docs = []
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 12, 60, 200, 700]))]
        for _ in range(30):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 40 + 2)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5)}"
            docs.append((len(docs), " ".join(copy[: len(copy) - rng.randrange(3)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_dict(similarity_components(df)) == jaccard_components(docs)


def test_two_large_groups_apart(spark, monkeypatch):
    """Many nodes of two components that never link share signatures: rounds grow with the logarithm of the nodes."""
    rounds = []
    real = ngram_jaccard.store
    monkeypatch.setattr(ngram_jaccard, "store", lambda df: rounds.append(1) or real(df) if "parity" in df.columns else real(df))
    shared, docs = [f"w{k}" for k in range(155)], []
    for group in "ab":
        for k in range(40):
            tail = [f"{group}{j}" for j in range(45)]
            tail[k] = "x"
            docs.append((len(docs), " ".join(shared + tail)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = as_dict(similarity_components(df))
    assert got == jaccard_components(docs) and {c for _, c in got.values()} == {0, 40}
    assert len(rounds) <= 4


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One two", None), (5, "one TWO", "x"), (6, "one two three", "x"), (6, "one two three", "x"), (None, "one two three", "x"), (7, "É a b", "x"), (8, "é a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in similarity_components(df).collect())
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7), (8, 1, 8)]
    assert similarity_components(df.limit(0)).count() == 0


def test_keys_tell_components_of_one_id_apart(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "q r s t"), (7, "q r s t"), (7, None), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = similarity_components(df, keyed=True).collect()
    by = {(r["doc_id"], r["text_key"] and bytes(r["text_key"])): r["component"] for r in got}
    a, q = (bytes.fromhex(__import__("hashlib").md5(t.encode()).hexdigest()) for t in ("a b c d", "q r s t"))
    assert by[1, a] == by[5, a] != by[5, q] == by[7, q] and by[7, None] is None and by[None, a] is None
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (5, 1), (5, 5), (7, 5), (7, 7), (None, None)}
