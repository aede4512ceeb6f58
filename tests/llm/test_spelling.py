import random
import re
import zlib
from collections import Counter

from convoylake.llm import spelling as m


def brute_counts(docs):
    low = {c: c + 32 for c in range(65, 91)}
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    out.pop("", None)
    return out


def edit(a, b):
    row = list(range(len(b) + 1))
    for k, c in enumerate(a, 1):
        left, row = row, [k]
        for j, d in enumerate(b):
            row.append(min(left[j] + (c != d), left[j + 1] + 1, row[j] + 1))
    return row[-1]


def brute_groups(words):
    forms, near = {}, {}
    for w, n in words.items():
        others = [(-words[v], v) for v in words if edit(w, v) == 1]
        near[w] = len(others)
        forms[w] = min(others)[1] if others and -min(others)[0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n, near[w], forms[w], words.get(forms[w]), root))
    return sorted(out)


def rows(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def test_counts(spark):
    rng = random.Random(1)
    docs = [(k, " ".join("".join(rng.choice("aAbÉé÷xyz") for _ in range(rng.randrange(1, 9))) for _ in range(60))) for k in range(40)]
    docs += [(7, "again again"), (7, "again again"), (None, "no id"), (None, None), (90, ""), (91, "1, 2; 日本語ĀΩ"), (92, "ab日cd"), (93, "é" * 70_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int")
    assert {r["word"]: r["n"] for r in m.word_counts(df).collect()} == brute_counts(docs)
    assert m.word_counts(df.limit(0)).count() == 0


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))): 1 for _ in range(250)}
    for size in (17, 30, 63, 64, 65, 66, 400):  # rests of more than eight bytes, and lengths that share a class
        base = "".join(rng.choice("abc") for _ in range(size))
        words |= {base: 1, base[:-1]: 1, "x" + base: 1, base[: size // 2] + "y" + base[size // 2 :]: 1, base[:4] + "z" + base[5:]: 1, base[:-2] + "qq": 1}
    words = {w: rng.choice((1, 2, 3, 5, 9, 40, 90)) for w in words}
    df = spark.createDataFrame([(w, n, None) for w, n in words.items()], "word string, n long, form string").repartition(3)
    want = brute_groups(words)
    assert rows(m.spelling_groups(df)) == want
    assert rows(m.spelling_groups(df, shard=20)) == want  # several shards and buckets for a length
    assert m.spelling_groups(df.limit(0)).count() == 0
    assert rows(m.spelling_groups(df.limit(1)))[0][2:5] == (0, None, None)


def test_one_edit():
    rng = random.Random(9)
    for _ in range(4000):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(7))) for _ in range(2))
        assert m.one_edit(a, b) == (edit(a, b) == 1), (a, b)
