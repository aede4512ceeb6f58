import base64
import hashlib

import corpus_pipeline as p
import numpy as np
import public_tokenizers as P
import tiktoken
from brute import contamination, jaccard_components, repeats

SMALL = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}
    first = jaccard_components(list(docs.items()), 5, 80)
    docs = {i: t for i, t in docs.items() if first[i][1] == i}
    for i, runs in repeats([(i, t.encode()) for i, t in docs.items()]).items():
        b, at, left = docs[i].encode(), 0, b""
        for s, e in runs:
            left, at = left + b[at:s], e
        docs[i] = (left + b[at:]).decode("utf-8", "ignore")
    docs = {i: t for i, t in docs.items() if t}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = contamination(list(docs.items()), items)
    docs = {i: t for i, t in docs.items() if not (hit[i][1] > 0 and 20 * hit[i][1] >= hit[i][0])}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(ids := enc.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in p.run(spark, SMALL).collect()} == want


def test_stages_return_the_columns_of_documents(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the sea and the king", "en", "s", 20), (3, "the sea and the king", "en", "s", 20), (None, "the hill of the sea", "en", "s", 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.dtypes == df.dtypes
        assert {r["text"] for r in out.collect()} >= {"the sea and the king"}


def test_stages_take_empty_tables_extra_columns_and_long_texts(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, n int, node long, row string, body string, spans string"
    long = " ".join(f"w{k % 9973}x{k}" for k in range(60_000))
    rows = [(1, long, "en", "s", len(long), 1, 2, "r", "b", "q"), (2, "the sea and the king", "en", "s", 20, None, None, None, None, None)]
    for df in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, df, SMALL)
            assert out.columns == list(p.COLUMNS) and {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in df.collect()}
        assert p.tokens(spark, df, SMALL).count() == df.count()


def test_contamination_removes_items_under_the_limit(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) >= 13)
    far = " ".join(f"q{k}x" for k in range(40 * len(item.split())))
    rows = [(1, f"{far} {item} {far}", "en", "s", 2 * len(far) + len(item) + 2), (2, item, "en", "s", len(item)), (3, far, "en", "s", 7), (4, None, None, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in p.contamination(spark, df, SMALL).collect()}
    assert set(got) == {1, 3, 4} and got[3] == (far, 7) and got[4] == (None, None)
    left = got[1][0]
    assert left.split()[: len(far.split())] == far.split() and item not in left and item.split()[3] not in left.split()
    assert got[1][1] == len(left) < rows[0][4]


def test_texts_of_one_id_are_judged_by_themselves(spark):
    a, b = "one two three four five six seven", "a king and a queen by the sea"
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (8, None), (8, ""), (None, a), (None, a), (9, "x"), (9, "x")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, df, SMALL).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (8, None), (8, ""), (None, a), (9, "x")], key=str)
    # of two near copies under one id one stays
    near = [(3, " ".join(f"w{k}" for k in range(60))), (3, " ".join(f"w{k}" for k in range(59)))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in near], "doc_id long, text string, lang string, source string, n_chars long")
    assert p.near_duplicates(spark, df, SMALL).count() == 1


def workers(node, here=0):
    """Python workers that a task of the plan has at once, at most."""
    name = node.nodeName()
    here = 0 if "Exchange" in name else here + (name == "MapInArrow")
    below = node.children()
    return max([here, *(workers(below.apply(k), here) for k in range(below.size()))])


def test_a_task_has_one_python_worker(spark):
    """Workers stay for the stages after, with all that they hold: a second one to a task costs its memory for the rest of the run."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, stage in p.STAGES:
            assert workers(stage(spark, df, SMALL)._jdf.queryExecution().executedPlan()) <= 1, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
