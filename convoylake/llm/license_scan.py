"""Fuzzy search for short license notices.

Each notice is split into ``errors + 1`` seeds, which one Aho-Corasick pass finds for all notices; a text within that many edits of the notice holds one of
the seeds unchanged (pigeonhole), so only places where a seed stands in the normalised text are looked
at. The fewest edits of the notice in the stretch around one come from a bit-parallel edit distance, whose
cost does not depend on the number of edits; where they are within the bound, the regex library's
bounded-error matching, with that number as its bound, gives the span. A span must have the words that tell
its license from others, and of overlapping spans of different licenses the closest stays. Phrases are searched exactly beside that. Everything happens where the document is; nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import ALNUM, column_bytes, rows_out, slices, table

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices in the wording of public licenses (as normalised words) and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license": "gfdl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "made available under the terms of the eclipse public license": "epl",
    "licensed under the european union public licence": "eupl",
    "distributed under the boost software license": "boost",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "under the terms of the artistic license": "artistic",
    "no rights reserved creative commons zero": "cc0",
    "licensed under a creative commons attribution": "cc-by",
    "creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under the open database license": "odbl",
    "licensed under the sil open font license": "ofl",
    "all rights reserved": "all-rights-reserved",
}
#: Words that tell one license from another where notices are alike: a match must have those of its notice.
TELLING = frozenset("mit apache lesser affero mozilla eclipse european boost artistic zero sharealike noncommercial sa nc nd database sil".split())
#: A telling word of so many letters may differ by one edit in eight letters, rounded up; a shorter one by none.
TELLING_LETTERS = 5
#: A notice may differ by one edit in so many letters; letters of all notices that workers are sent at most.
EDIT_SHARE, NOTICE_LETTERS = 8, 1_000_000


@cache
def _errors(notice: str) -> int:
    return len(notice) // EDIT_SHARE


@cache
def _seeds(notices: tuple[str, ...]) -> ahocorasick.Automaton:
    """The seeds of all notices, each with the notices that it is cut from and where."""
    out = ahocorasick.Automaton()
    for notice in notices:
        cuts = [len(notice) * k // (_errors(notice) + 1) for k in range(_errors(notice) + 2)]
        for a, b in zip(cuts, cuts[1:]):
            seed = notice[a:b]
            out.add_word(seed, [*out.get(seed, []), (notice, a, len(seed))])
    out.make_automaton()
    return out


@cache
def _pattern(notice: str, errors: int) -> regex.Pattern:
    return regex.compile(b"(?:" + regex.escape(notice).encode() + b"){e<=%d}" % errors, regex.BESTMATCH)


@cache
def _letters(notice: str) -> list[int]:
    """For each byte the set of its positions in the notice, as bits."""
    out = [0] * 256
    for k, b in enumerate(notice.encode()):
        out[b] |= 1 << k
    return out


def fewest_edits(stretch: bytes, notice: str) -> int:
    """The least edit distance between the notice and any substring of a stretch (Myers, bit by bit in one integer)."""
    letters, size = _letters(notice), len(notice)
    ones, last = (1 << size) - 1, 1 << size - 1
    up, down = ones, 0
    best = now = size
    for b in stretch:
        equal = letters[b]
        across = ((equal & up) + up) ^ up | equal
        more, less = (down | ~(across | up)) & ones, up & across
        if more & last:
            now += 1
        elif less & last:
            now -= 1
            best = min(best, now)
        more, less, equal = more << 1, less << 1, equal | down
        up, down = (less | ~(equal | more)) & ones, more & equal & ones
    return best


def places(text: bytes, part: bytes) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


@lru_cache(100_000)
def _verified(stretch: bytes, notice: str) -> tuple[int, int, int] | None:
    """The best match of the notice in a stretch of its length and twice the edits: start, end, edits."""
    edits = fewest_edits(stretch, notice)
    m = _pattern(notice, edits).search(stretch) if edits <= _errors(notice) else None
    return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None


def fuzzy(text: bytes, notices: tuple[str, ...]) -> Iterator[tuple[int, int, str, int]]:
    """Spans (start, end, notice, edits) of the notices in normalised text; a span of a notice inside one already found is not looked for."""
    starts: dict[str, set[int]] = {}
    if notices:
        for end, cut_from in _seeds(notices).iter(text.decode("latin-1")):
            for notice, cut, size in cut_from:
                starts.setdefault(notice, set()).add(end + 1 - size - cut)
    for notice, found in starts.items():
        errors, done = _errors(notice), 0
        for p in sorted(found):
            if p + errors < done:
                continue
            at = max(0, p - errors, done)
            if (best := _verified(text[at : p + len(notice) + errors], notice)) is not None:
                yield at + best[0], at + best[1], notice, best[2]
                done = at + best[1]


@cache
def _telling(notice: str) -> tuple[str, ...]:
    return tuple(w for w in notice.split() if w in TELLING)


def _tells(span: bytes, notice: str) -> bool:
    """Whether a match, with the spaces around it, has the telling words of its notice."""
    return all(f" {w} ".encode() in span or len(w) >= TELLING_LETTERS and fewest_edits(span, f" {w} ") <= -(-len(w) // EDIT_SHARE) for w in _telling(notice))


def resolved(text: bytes, spans: list[tuple[int, int, str, int]], labels: dict[str, str]) -> list[tuple[int, int, str, int]]:
    """Of spans (start, end, notice, edits) with all telling words those that no better one of another label overlaps.

    Better has fewer edits for its length, then more telling words, then is longer.
    """
    groups: list[list[tuple[int, int, str, int]]] = []  # of spans that overlap one after another
    end = 0
    for span in sorted(s for s in spans if _tells(text[max(0, s[0] - 1) : s[1] + 1], s[2])):
        if not groups or span[0] >= end:
            groups.append([])
        groups[-1].append(span)
        end = max(end, span[1])
    out = []
    for group in groups:
        kept: list[tuple[int, int, str, int]] = []
        for span in sorted(group, key=lambda s: (s[3] / len(s[2]), -len(_telling(s[2])), -len(s[2]), s)):
            if all(span[1] <= a or b <= span[0] or labels[other] == labels[span[2]] for a, b, other, _ in kept):
                kept.append(span)
        out += kept
    return out


def _word_numbers(text: bytes, positions: list[int]) -> dict[int, int]:
    """Spaces before each position."""
    out, n, last = {}, 0, 0
    for p in sorted(set(positions)):
        n += text.count(b" ", last, p)
        out[p], last = n, p
    return out


def scan_text(body: bytes | None, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> tuple:
    """Number of words, phrase places (first word, label), notice spans (first word, end, label, edits, letters)."""
    words = (body or b"").translate(ALNUM).split()
    text = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in phrases.items() for at in places(text, b" " + phrase.encode() + b" ")]
    found = [(a + 1, b - 1, notices[notice], edits, len(notice)) for a, b, notice, edits in resolved(text, list(fuzzy(text, tuple(notices))), notices)]
    number = _word_numbers(text, [at for at, _ in base] + [p for a, b, *_ in found for p in (a, b)])
    return len(words), sorted((number[at], label) for at, label in base), sorted((max(0, number[a] - 1), number[b], *rest) for a, b, *rest in found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """License phrases and notices of each document.

    ``phrases`` and ``notices`` map normalised words (lower-case letters and digits of ASCII,
    single spaces) to labels; notices have at most ``NOTICE_LETTERS`` letters in all. Returns one row per input row: the id, ``n_words``, ``base`` (array of phrase places: first word,
    label), ``notices`` (array of fuzzy spans: first word, end word, label, edits) and ``score``: 1 with
    a phrase, else 1 - edits / letters of the best notice, else 0. Null texts count as empty and have
    no words. Repeated rows and null ids are kept, other columns ignored, empty input gives an empty
    result.
    """
    if sum(map(len, notices)) > NOTICE_LETTERS or any(not x.isascii() or not x for x in (*phrases, *notices)):
        raise ValueError(f"notices and phrases are non-empty ASCII, notices of {NOTICE_LETTERS} letters in all at most")
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("notices", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))), ("score", pa.float64()),
    ])

    def scan(batches):
        def rows():
            for batch in slices(batches, "body"):
                for row, body in zip(batch.column(0).to_pylist(), column_bytes(batch, "body"), strict=True):
                    n, base, found = scan_text(body, phrases, notices)
                    score = 1.0 if base else max((1 - e / size for *_, e, size in found), default=0.0)
                    yield row, n, [{"word": w, "label": v} for w, v in base], [{"first": a, "end": b, "label": v, "edits": e} for a, b, v, e, _ in found], score

        return rows_out(schema)(rows())

    ddl = "id bigint, n_words bigint, base array<struct<word:bigint,label:string>>, notices array<struct<first:bigint,end:bigint,label:string,edits:int>>, score double"
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body")).mapInArrow(scan, ddl).withColumnRenamed("id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base.label", "notices.label")), ",").alias("labels"), "score",
    )


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES = {}
