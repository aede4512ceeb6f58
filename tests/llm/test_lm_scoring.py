import math
from collections import Counter

import pytest
from brute import words

from convoylake.llm import lm_scoring as m

SMALL = "/root/testdata/sf0.001"


def brute(docs):
    """{doc_id: (tokens, target entropy, background entropy)} of [(doc_id, text, target)]: each document by the models of the others."""
    seqs = [(i, words(t), g) for i, t, g in docs]
    one, two = ([Counter(), Counter()] for _ in range(2))
    for _, s, g in seqs:
        for k in ([0, 1] if g else [1]):
            one[k].update(s)
            two[k].update(zip([None, *s], s))
    total, size = [sum(x.values()) for x in one], len(one[1])
    out = {}
    for i, s, g in seqs:
        own_one, own_two = Counter(s), Counter(zip([None, *s], s))
        h = []
        for k in (0, 1):
            mine = 1 if k or g else 0
            scale = total[0] / total[1] if k and total[0] else 1.0
            e = 0.0
            for v, w in zip([None, *s], s):
                before = one[k][v] - mine * own_one[v] if v is not None else 0
                weight = m.PAIR_WEIGHT if before else 0.0
                single = ((one[k][w] - mine * own_one[w]) * scale + m.ADDED) / ((total[k] - mine * len(s)) * scale + m.ADDED * size)
                e -= math.log((weight * (two[k][v, w] - mine * own_two[v, w]) / before if weight else 0.0) + (1 - weight) * single)
            h.append(e / len(s) if s else None)
        out[i] = (len(s), *h)
    return out


def same(rows, want, n):
    assert len(rows) == n
    for r in rows:
        n_tokens, t, b = want[r["doc_id"]]
        assert r["n_tokens"] == n_tokens
        if n_tokens:
            assert (r["target_entropy"], r["background_entropy"], r["score"]) == pytest.approx((t, b, t - b), rel=1e-9, abs=1e-12)


def test_operator_equals_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["doc_id"] % 3 == 0) for r in df.collect()]
    same(m.score_documents(df, df.where("doc_id % 3 = 0"), block_bytes=60_000).collect(), brute(docs), len(docs))


def test_query_equals_brute_force(spark):
    big = "/root/testdata/sf0.01"
    good = {r["doc_id"] for r in spark.read.parquet(f"{big}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    docs = [(r["doc_id"], r["text"], r["doc_id"] in good) for r in spark.read.parquet(f"{big}/documents.parquet").collect()]
    same(m.op7_lm_scoring(spark, big).collect(), brute(docs), len(docs))


def test_query_prefers_good_documents(spark):
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = m.op7_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    mean = {q: [r["score"] for r in rows if good.get(r["doc_id"]) == q] for q in (0, 1)}
    assert sum(mean[1]) / len(mean[1]) < sum(mean[0]) / len(mean[0])


def test_edges(spark):
    df = spark.createDataFrame([(1, None, True), (2, "", None), (None, "a b a", True), (4, "A, b! a", False), (4, "A, b! a", False), (5, "zz", True)], "doc_id long, text string, score boolean")
    got = {r["doc_id"]: r for r in m.score_documents(df, df.where("score")).collect()}
    assert got[1]["score"] is None and got[2]["n_tokens"] == 0
    want = brute([(1, None, True), (None, "a b a", False), (4, "A, b! a", False), (6, "A, b! a", False), (5, "zz", True)])
    assert got[4]["score"] == pytest.approx(want[4][1] - want[4][2]) and got[5]["score"] == pytest.approx(want[5][1] - want[5][2])
    assert m.score_documents(df, df.limit(0)).count() == 6
    assert m.score_documents(df.limit(0), df).count() == 0
