import math
import random
import re
import tempfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from convoylake.llm import kneser_ney as m
from convoylake.llm.word_blocks import marked_hashes

SMALL = "/root/testdata/sf0.01"


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", (text or "").encode())


def model(seqs):
    """Pair counts, tokens of contexts, different words before each word, of lists of words."""
    pairs = Counter(p for s in seqs for p in zip([None, *s], s))
    tokens = Counter()
    for (u, _), c in pairs.items():
        tokens[u] += c
    return pairs, tokens


def brute(docs):
    """{k: (words, perplexity)} of [(text, trusted)] by the textbook formula, each trusted document without its own counts."""
    seqs = [words(t) for t, _ in docs]
    vocabulary = {w for s in seqs for w in s}
    pairs, tokens = model([s for s, (_, g) in zip(seqs, docs, strict=True) if g])
    before, by_context = Counter(v for _, v in pairs), {}
    for (u, _), c in pairs.items():
        by_context.setdefault(u, Counter())[min(c, 3)] += 1

    def cuts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) if n[k] else 0.5 * k for k in (1, 2, 3))]

    d, dc, mass = cuts(pairs), cuts(before), sum(before.values())
    rest = sum(dc[min(c, 3)] for c in before.values()) / mass if mass else 1.0
    out = []
    for s, (_, g) in zip(seqs, docs, strict=True):
        own, own_tokens = model([s] if g else [])
        lost = {u: sum(d[k] * x for k, x in by_context.get(u, {}).items()) for u in {None, *s}}
        less = Counter()
        for (u, v), c in own.items():
            lost[u] += d[min(pairs[u, v] - c, 3)] - d[min(pairs[u, v], 3)]
            less[v] += pairs[u, v] == c
        logs = 0.0
        for u, v in zip([None, *s], s):
            single_count = before[v] - less[v]
            p = max(single_count - dc[min(single_count, 3)], 0) / max(mass, 1) + rest / (len(vocabulary) + 1)
            if (t := tokens[u] - own_tokens[u]) > 0:
                c = pairs[u, v] - own[u, v]
                p = max(c - d[min(c, 3)], 0) / t + max(lost[u], 0) / t * p
            logs += math.log(p)
        out.append((len(s), math.exp(-logs / len(s)) if s else None))
    return out


def test_query_equals_brute_force(spark):
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    want = dict(zip([i for i, *_ in docs], brute([(t, i in good) for i, t, _ in docs]), strict=True))
    rows = m.op10_kneser_ney(spark, SMALL).collect()
    assert len(rows) == len(docs) == 1000
    for r in rows:
        n, p = want[r["doc_id"]]
        assert r["n_words"] == n and r["perplexity"] == (p and pytest.approx(p, rel=1e-6))
    langs = {i: v for i, _, v in docs}

    def quantile(values):
        return sorted(values)[math.ceil(m.QUANTILE * len(values)) - 1]

    overall = quantile([want[i][1] for i in good if want[i][1]])
    for r in rows:
        own = [want[i][1] for i in good if langs[i] == langs[r["doc_id"]] and want[i][1]]
        limit = (quantile(own) * len(own) + overall * m.LEAN) / (len(own) + m.LEAN) if own else overall
        assert r["threshold"] == pytest.approx(limit, rel=1e-6) and r["low"] == (r["perplexity"] is None or r["perplexity"] > r["threshold"])


def test_good_documents_stand_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = m.op10_kneser_ney(spark, SMALL).collect()
    good, bad = ([r for r in rows if labels.get(r["doc_id"]) == q and r["perplexity"]] for q in (1, 0))
    ranks = np.mean([a["perplexity"] < b["perplexity"] for a in good for b in bad])
    print("ranks", ranks, "low good", np.mean([r["low"] for r in good]), "low bad", np.mean([r["low"] for r in bad]))
    assert ranks > 0.95, ranks
    assert np.mean([r["low"] for r in good]) < 0.1 and np.mean([r["low"] for r in bad]) >= 0.8


def test_hashes_of_words_and_marks():
    random.seed(3)
    texts = [None, b"", b" ", b"a", *(bytes(random.choice(b"aab \n\t\x0b\x0c\r\x00\x1c\x85\xe9.,!Z9") for _ in range(random.randint(0, 60))) for _ in range(20_000)), b"x" * 700_000, b"the sea"]
    lengths, found = marked_hashes(texts)
    tokens = [re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", t or b"") for t in texts]
    assert lengths.tolist() == [len(t) for t in tokens]
    pairs = set(zip([t for ts in tokens for t in ts], found.tolist(), strict=True))
    assert len(pairs) == len({t for t, _ in pairs}) == len({h for _, h in pairs})


def shuffled(spark):
    """Bytes of shuffle files on disk."""
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(p.stat().st_size for f in folders for p in Path(f).rglob("shuffle_*.data"))


def test_a_part_of_the_texts_is_on_disk_at_a_time(spark, monkeypatch):
    """Shuffle files of a step go before the next one, and no step shuffles all texts (here of random letters, which do not compress)."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(500)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    path = f"{tempfile.mkdtemp()}/documents"
    df.write.parquet(path)
    df = spark.read.parquet(path)
    held = []

    def store(table):
        # as common.store, but looks at the shuffle files before they go
        folder = f"{tempfile.mkdtemp()}/t"
        before = shuffled(spark)
        table.write.parquet(folder)
        held.append(shuffled(spark) - before)
        return spark.read.schema(table.schema).parquet(folder)

    monkeypatch.setattr(m, "store", store)
    monkeypatch.setattr(m, "forget", lambda table: None, raising=False)
    assert m.classify(df, df.where("doc_id % 3 = 0"), block_bytes=20_000).count() == 500
    assert held and max(held) < 0.7 * sum(map(len, texts)), held


def test_many_blocks_equal_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = ({r["doc_id"]: r["perplexity"] for r in m.perplexities(df, df.where("doc_id % 2 = 0"), block_bytes=b).collect()} for b in (10**9, 20_000))
    assert len(few) == df.count() and all(p == pytest.approx(many[i], rel=1e-6) for i, p in few.items() if p)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 1), (3, "the sea", "en", 1), (None, "the sea", None, 1), (4, "the sea", "xx", 0), (4, "the sea", "xx", 0), (5, "%$#@ zq|", "en", 0), (6, "the " * 50_000, "en", 0)], "doc_id long, text string, lang string, threshold int").repartition(2)
    got = {r["doc_id"]: r for r in m.classify(df, df.where("threshold = 1")).collect()}
    assert got[1]["low"] and got[1]["perplexity"] is None and got[2]["n_words"] == 0 and got[2]["lang"] == "und" and got[6]["n_words"] == 50_000
    want = brute([("the sea", True), ("the sea", False), ("%$#@ zq|", False), ("the", False)])
    assert [got[i]["perplexity"] for i in (3, 4, 5)] == [pytest.approx(p) for _, p in want[:3]]
    none = m.classify(df, df.limit(0)).collect()
    assert len(none) == 8 and all(r["perplexity"] is None or r["perplexity"] == pytest.approx(6) for r in none) and sum(r["low"] for r in none) == 2
    assert m.classify(df.limit(0), df).count() == 0
