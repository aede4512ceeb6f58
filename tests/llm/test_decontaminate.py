import hashlib
import random

from brute import contamination

from convoylake.llm import decontaminate as m

SMALL = "/root/testdata/sf0.01"


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {i: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, (n, h, f) in contamination(docs, items).items()}
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in m.op3_decontaminate(spark, SMALL).collect()}
    assert got == want and any(h for _, h, *_ in want.values())


def test_automaton_on_few_words():
    rng = random.Random(5)
    for _ in range(300):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for k in range(rng.randrange(1, 6))]
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60)))
        window = rng.choice([2, 3, 4, 5])
        runs, found = m.Automaton([(str(k), t.encode()) for k, t in items], window).flat().ready().scan(m.words_of(text.encode()))
        assert (sum(b - a for a, b in runs), sorted(found)) == contamination([(0, text)], items, window)[0][1:]


def test_edges_and_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "x A-b c y", 9), (4, "a b c a b c", 9), (4, "a b c a b c", 9)], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, "b c"), (None, "zz")], "item_id long, text string")
    one = sorted(map(str, m.decontaminate(docs, items, with_text=True).collect()))
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["text"]) for r in m.decontaminate(docs, items, with_text=True).collect()}
    assert got == {(1, 0, 0, (), None), (2, 0, 0, (), ""), (None, 5, 3, ("1", "3"), "x  y"), (4, 6, 6, ("1", "3"), "")}
    monkeypatch.setattr(m, "SHARD_BYTES", 3)
    assert sorted(map(str, m.decontaminate(docs, items, with_text=True).collect())) == one
    monkeypatch.setattr(m, "SENT_BYTES", 1)
    assert sorted(map(str, m.decontaminate(docs, items, with_text=True).collect())) == one
    assert sorted(str(r.asDict()) for r in m.decontaminate(docs, items, keep=("n_words",)).select("doc_id", "n_hit", "items").collect()) == sorted(str({k: r[k] for k in ("doc_id", "n_hit", "items")}) for r in m.decontaminate(docs, items).collect())
    assert m.decontaminate(docs.limit(0), items).count() == 0
    assert {r["n_hit"] for r in m.decontaminate(docs, items.limit(0)).collect()} == {0}
