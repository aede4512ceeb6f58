import math
import random
import re
from collections import Counter

import numpy as np

from convoylake.llm import ranked_search as m


def brute(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    low = {c: c + 32 for c in range(65, 91)}
    terms = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    total, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        scores = []
        for i, c in terms:
            part = 25 + 75 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * part)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_equals_brute_force_with_ties_and_edges(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "A1", "the"]
    some = lambda n: " ".join("the" if rng.random() < 0.4 else words[min(rng.randrange(1, 64), rng.randrange(1, 64)) - 1] for _ in range(n))
    docs = [(k, some(rng.randrange(1, 30))) for k in range(200)] + [(300 + k, "w3 w9 the") for k in range(30)] + [(None, "w3 w9 the"), (400, None), (401, ""), (402, "?!"), (403, some(20_000))]
    items = [(k, some(rng.randrange(1, 12))) for k in range(25)] + [(50, None), (51, "absent term"), (52, "w3, W9"), (53, "the the THE")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string").repartition(3)
    i = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    want = brute(docs, items)
    assert rows(m.search(d, i)) == want
    assert rows(m.search(d, i, block_terms=20)) == want
    assert rows(m.search(d, i, k=3)) == brute(docs, items, 3)
    assert m.search(d.limit(0), i).count() == 0 and m.search(d, i.limit(0)).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b c"), (2, "c d")], "doc_id long, text string")
    i = spark.createDataFrame([(7, "a c"), (7, "a c")], "item_id long, text string")
    got = rows(m.search(d, i))
    assert [r[1] for r in got] == sorted(2 * [1, 2, 3, 4]) and sorted({r[2] for r in got}) == [1, 2]


def test_pruned_terms_and_bounds_are_safe(spark):
    """Terms are pruned on real texts, and no document of the result is lost by it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(20)
    got = rows(m.search(docs, items))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    asked = m.item_terms(items, "item_id", "text")
    terms = sorted({bytes(r["term"]) for r in asked.collect()})
    index = m.forward_index(docs, terms, "doc_id", "text")
    n = index.count()
    figures = m.term_figures(index, 10, len(terms), n, index.agg({"n": "sum"}).first()[0])
    numbers = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "word binary, number long")
    found = m.seeded(asked.select("item", asked["term"].alias("word"), "reps").join(numbers, "word").selectExpr("item", "number term", "reps"), figures).collect()
    assert any(not r["searched"] for r in found) and all(r["floor"] > r["rest"] for r in found if not r["searched"])


def test_impacts_beyond_64_bits():
    n = np.array([10**9, 5], np.int64)
    docs, total = 10**12, 10**14
    want = [10**9 * 3 // (3000 + 8 * (25 + 75 * int(x) * docs // total)) for x in n]
    assert m.impacts(np.array([3, 3], np.int64), n, docs, total).tolist() == want
