import pytest
from brute import words

from convoylake.llm import license_scan as m

SMALL = "/root/testdata/sf0.01"


def base(text):
    seq = words(text)
    out = []
    for phrase, label in m.PHRASES.items():
        p = phrase.split()
        out += [(k, label) for k in range(len(seq)) if seq[k : k + len(p)] == p]
    return len(seq), out


def test_base_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = m.op9_license_scan(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, found = base(docs[r["doc_id"]])
        labels = ",".join(sorted({v for _, v in found}))
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(found), labels)
        assert (r["first_word"], r["last_word"]) == ((min(k for k, _ in found), max(k for k, _ in found)) if found else (None, None))
        assert set(filter(None, labels.split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert any(r["n_base"] for r in rows) and any("cc-by-nc" in r["labels"] for r in rows)


def test_edits_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "MIT license mit licensee, MIT-License"), (None, "Relesed undr the MIT Licence."), (5, "permission is heraby granted, free of charge to any persn obtaining a copy of this softwarre"), (6, "it is released and permitted"), (6, "it is released and permitted")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in m.license_scan(df).collect()}
    assert [p["word"] for p in got[3]["base"]] == [0, 4]
    assert {s["label"] for s in got[None]["notices"]} == {"mit"} and got[None]["base"] == [] and 0.8 < got[None]["score"] < 1
    span = got[5]["notices"][0]
    assert (span["label"], span["first"], span["end"]) == ("mit", 0, 16) and span["edits"] >= 3
    assert got[6]["notices"] == [] and got[6]["score"] == 0 and got[1]["n_words"] == 0
    assert m.license_scan(df).count() == 7 and m.license_scan(df.limit(0)).count() == 0


def test_pigeonhole_loses_nothing():
    import random

    rng = random.Random(2)
    notice = "licensed under the apache license version 2 0"
    errors = m._errors(notice)
    pattern = m._pattern(notice, errors)
    for _ in range(60):
        s = list(notice)
        for _ in range(rng.randrange(errors + 3)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("abc ")], [s[k], rng.choice("xyz")]])
        text = ("x y " + "".join(s) + " z w").encode()
        assert bool(list(m.fuzzy(text, (notice,)))) == bool(pattern.search(text))


def test_fewest_edits_equals_the_table():
    import random

    rng = random.Random(5)
    for _ in range(200):
        notice, text = ("".join(rng.choice("ab ") for _ in range(n)) for n in (rng.randrange(1, 12), rng.randrange(20)))
        row = list(range(len(notice) + 1))
        best = row[-1]
        for c in text:
            left = row
            row = [0]
            for k, d in enumerate(notice):
                row.append(min(left[k] + (c != d), left[k + 1] + 1, row[k] + 1))
            best = min(best, row[-1])
        assert m.fewest_edits(text.encode(), notice) == best


def test_one_edit_in_eight_letters_is_found():
    def spans(text):
        return [(first, end, label, edits) for first, end, label, edits, _ in m.scan_text(text.encode())[2]]

    # the text of the first version of test_edits_and_edges: four edits and more
    assert spans("permission is heraby granted, free of charge to any persn obtaining a copy of this softwear")[0][:3] == (0, 16, "mit")
    assert spans("Permision is herby grantd, free of chrge to any persn obtainin a copi of this softwar.") == [(0, 16, "mit", 8)]
    assert spans("so: redistributon and uze in sorce and binery forms, with or wthout modificaton, are permited") == [(1, 15, "bsd", 7)]
    assert spans("subjct to the tirms of the mozila publc license")[0][2:] == ("mpl", 4) and spans("subjct to the tirms of the mozila publc licens")[0][2:] == ("mpl", 5)
    assert [v for *_, v, _ in spans("Permision is hereby granted to any person obtaining a copy of this software")] == []  # 16 edits, the bound is 11
    assert spans("Permission is hereby granted to any person obtaining a copy of the software") == []
    assert spans("Permission is hereby granted free to any person obtaining a copy of this software") == [(0, 14, "mit", 10)]
    for notice in m.NOTICES:
        errors = len(notice) // 8
        bad = list(notice)
        for k in range(errors):
            bad[4 + 8 * k - (bad[4 + 8 * k] == " ")] = "#"
        assert [e for *_, e in m.fuzzy(b" x " + "".join(bad).encode() + b" y ", (notice,))] == [errors], notice


def test_own_tables(spark):
    df = spark.createDataFrame([(1, "Use of this is subjekt to the Foo licence; MIT license"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.license_scan(df, phrases={"foo licence": "foo"}, notices={"subject to the foo licence": "foo"}).collect()}
    assert [p["label"] for p in got[1]["base"]] == ["foo"] and [(x["label"], x["edits"]) for x in got[1]["notices"]] == [("foo", 1)]
    assert m.license_scan(df, notices={}).where("doc_id = 1").first()["notices"] == []
    with pytest.raises(ValueError):
        m.license_scan(df, notices={"x" * 2_000_000: "x"})


def test_labels_tell_licenses_apart():
    def labels(text):
        return {v for _, _, v, *_ in m.scan_text(text.encode())[2]}

    for notice, label in m.NOTICES.items():
        assert labels(notice) == {label}, notice
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc"} and labels("Licensed under CC BY-ND 4.0.") == {"cc-by-nd"}
    assert labels("Released under the BSD license") == set() and labels("distributed under the zebra software license") == set()
    assert labels("under the terms of the GNU General Public License as published by the Free Software Foundation") == {"gpl"}
    assert labels("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation") == {"lgpl"}
    assert labels("under the terms of the GNU Affero General Public License") == {"agpl"} and labels("under the terms of the gnu lesser general publik license") == {"lgpl"}
    assert labels("subject to the terms of the eclipse public license") == set() and labels("licensed under a creative commons attribution sharealike 4.0") == {"cc-by-sa"}
    both = "Licensed under the Apache License, Version 2.0. Also released under the MIT license."
    assert labels(both) == {"apache", "mit"} and labels(f"{both} " * 2000) == {"apache", "mit"}
