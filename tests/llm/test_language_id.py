import pytest
import zlib

import numpy as np

from convoylake.llm import language_id as m

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = m.op8_language_id(spark, SMALL).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"] and docs[r["doc_id"]]["lang"]:
            total += 1
            right += r["lang_pred"] == docs[r["doc_id"]]["lang"]
    assert total > 150 and right / total > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(k, "the house of the king and the sea " * 3, "en") for k in range(40)] + [(100 + k, "der hund und die katze von dem berg " * 3, "de") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = df.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'xx' else lang end lang")
    assert {r["lang_pred"] for r in m.identify(df, m.train(wrong.where(~m.held_out()))).collect()} == {"en", "de"}


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 %% \n", "de"), (None, "one", "en"), (5, "Ω", "el"), (5, "Ω", "el"), (6, "​¿", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(2)
    model = m.train(df)
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in m.identify(df, model).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "el"), (5, "el"), (6, "und")]
    assert m.train(df.limit(0)) is None and m.identify(df.limit(0), None).count() == 0
    assert {r["lang_pred"] for r in m.identify(df, None).collect()} == {"und"}


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 2 * x[:, 1] > 0.3, 1.0, -1.0)
    w = m.fit_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_every_label_is_learned(spark):
    """205 languages with few rows each: none is left out, and too many labels are refused."""
    rows = [(10 * k + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{chr(97 + k % 26)}" for _ in range(12)), f"l{k}") for k in range(205) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = m.train(df)
    found = {r["doc_id"]: r["lang_pred"] for r in m.identify(df, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) > 0.95 * len(rows)
    with pytest.raises(ValueError):
        m.train(df, languages=204)
