import numpy as np

from convoylake.llm import rabitq as m

DATA = "/root/testdata/sf0.1"


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
        out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def test_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute(rows, [(i, v) for i, v in rows if i % 100 == 0])
    got = {}
    for r in sorted(m.op4_rabitq(spark, DATA).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    exact = {q: dict(v) for q, v in brute(rows, [(i, v) for i, v in rows if i in got], len(rows)).items()}
    assert all(abs(exact[q][i] - s) < 1e-9 for q, v in got.items() for i, s in v)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.99, recall


def test_bounds_keep_the_nearest():
    rng = np.random.default_rng(3)
    for d in (3, 17, 64):
        v, q, centre, turn = rng.normal(size=(500, d)), rng.normal(size=(40, d)), rng.normal(size=d) * 0.2, m.rotation(d)
        mask = m.candidates(*m.encode(v, centre, turn), q, centre, turn, 10, np.full(len(q), np.inf))
        near = np.argsort(((v[None] - q[:, None]) ** 2).sum(axis=2), axis=1)[:, :10]
        assert np.take_along_axis(mask, near, 1).mean() > 0.98
        if d == 64:
            assert mask.mean() < 0.9


def test_edges(spark):
    one = [1.0, 2.0]
    rows = [(0, one), (0, one), (1, one), (2, [1.0, 2.5]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, one), (100, [5.0, 5.0]), (9, [float("inf"), 0.0]), (8, one)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in m.nearest(df, df.where("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 2), (100, 1, 2), (100, 2, 0), (100, 3, 0)]
    assert got[2][3] == 0.5
    assert m.nearest(df.limit(0), df).count() == 0 and m.nearest(df, df.limit(0)).count() == 0
