import hashlib
import random

import numpy as np
from brute import repeats

from convoylake.llm import suffix_dedup as m

SMALL = "/root/testdata/sf0.01"


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = repeats(docs)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in m.op5_suffix_dedup(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, b in docs:
        left = b"".join(b[s:e] for s, e in zip([0, *(e for _, e in want[i])], [*(s for s, _ in want[i]), len(b)], strict=True))
        assert got[i] == (len(b), len(b) - len(left), len(want[i]), hashlib.sha256(left).hexdigest())


def test_texts_are_known_by_their_bytes(spark):
    """Rows without an id, or with one id, are told apart by their texts; batches give what all rows at once give."""
    rng = random.Random(2)
    letters = "abcdefghijklmnop "
    texts = ["".join(rng.choice(letters) for _ in range(256)) for _ in range(60)]
    rows = [(None, t) for t in texts] + [(1, texts[0]), (1, texts[3] + "x"), (1, "q" * 300), (2, texts[5][:220] + "y" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(rows[k][0]), str(s)) for k, s in repeats([(k, t.encode()) for k, (_, t) in enumerate(rows)]).items())
    assert sorted((str(r["doc_id"]), str(r["spans"])) for r in m.remove_repeats(df).collect()) == want
    index = m.RepeatIndex()
    for part in (rows[:20], rows[20:50], rows[50:62], rows[62:]):
        index.add(spark.createDataFrame(part, "doc_id long, text string"))
    assert len(index.levels) < 4
    assert sorted((str(r["doc_id"]), str(r["spans"])) for r in index.remove().collect()) == want


def messy(rng, n):
    """Texts of few letters with shared, shifted, cut and periodic parts."""
    base = [bytes(rng.choice(b"abcdefgh\x00\xff") for _ in range(rng.randrange(150, 900))) for _ in range(4)]
    docs = []
    for k in range(n):
        b = b""
        for _ in range(rng.randrange(0, 4)):
            x = rng.choice(base)
            s = rng.randrange(len(x))
            b += rng.choice([x[s : s + rng.randrange(400)], x, bytes(rng.choice(b"xyz") for _ in range(rng.randrange(60))), rng.choice([b"ab", b"q", b"Nd, "]) * rng.randrange(120)])
        docs.append((k, b))
    return docs


def test_anchored_windows_find_every_repeat():
    rng = random.Random(7)
    for _ in range(25):
        docs = messy(rng, 24)
        rows = [(h, c, i, lo, size, o) for i, b in docs if len(b) >= 200 for h, c, lo, size, o in zip(*(x.tolist() for x in m.anchors(b)), strict=True)]
        copies = {}
        for h, c, *_ in rows:
            copies[h, c] = copies.get((h, c), 0) + 1
        texts = dict(docs)
        one = {(h, c): (texts[i][lo : lo + size], o) for h, c, i, lo, size, o in rows}
        keys = sorted(one)
        first, end = m.repeated([h for h, _ in keys], np.array([one[k][1] for k in keys], np.int64), [one[k][0] for k in keys], np.array([copies[k] for k in keys]), batch=5) if keys else ([], [])
        at = dict(zip(keys, zip(first, end, strict=True), strict=True))
        spans = {i: [] for i, _ in docs}
        for h, c, i, lo, _, _ in rows:
            if at[h, c][1]:
                spans[i].append((lo + int(at[h, c][0]), lo + int(at[h, c][1])))
        assert {i: m._merge(s) for i, s in spans.items()} == repeats(docs)


def test_crowded_anchors_and_edges(spark, monkeypatch):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(260))
    rows = [(k, "".join(rng.choice("qrstuv") for _ in range(40)) + text[k % 30 : 260 - k % 7] + str(k) * 30) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "short"), (None, text), (104, "é" * 300), (105, text), (105, text)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    want = sorted((str(i), str(s)) for i, s in ((rows[k][0], s) for k, s in repeats([(k, (t or "").encode()) for k, (_, t) in enumerate(rows)]).items()))
    assert sorted((str(r["doc_id"]), str(r["spans"])) for r in m.remove_repeats(df).collect()) == want
    monkeypatch.setattr(m, "MOST", 10)
    assert sorted((str(r["doc_id"]), str(r["spans"])) for r in m.remove_repeats(df).collect()) == want
    assert m.remove_repeats(df.limit(0)).count() == 0
