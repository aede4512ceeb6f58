"""Token counts by a whole-token shortcut.

Most pre-tokens of a text are one token. Which vocabulary strings encode alone as one token is proved once,
by merging each of them; pre-tokens among those are counted directly, and only the rest are merged. The
proof's table has at most a row for each vocabulary string, so its size is bounded by the vocabulary file.

The library's normaliser and its splitting are repeated with Python's functions for characters on which both
agree; that is checked for every code point, together with the proof. A text with any other character is
normalised and split by the library itself, then counted in the same way.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convoylake.llm.byte_bpe import merge_pairs
from convoylake.llm.common import Kept, slices, table

#: Pre-tokens beside the whole tokens whose number of tokens a worker keeps, and the characters of the longest that it keeps.
CACHE, CACHED_LENGTH = 200_000, 40
#: Bytes of text that a worker takes from a batch at a time.
PART_BYTES = 1_000_000
_LOADED: dict[str, Counter] = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Counter(dict):
    """Pre-token to number of tokens: whole tokens from the proof, others as they come.

    Raises ValueError for files of another make than this reads: byte-level BPE after a split by one pattern.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, steps = made["model"], made["pre_tokenizer"].get("pretokenizers", [])
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: not byte-level BPE after a split by a pattern")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        split = steps[0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(made["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.kept = 0
        self.proved = self.prove()
        self.foreign = self.disagreed()

    def merged(self, piece: str) -> int:
        """Number of tokens of a pre-token, by merging."""
        parts = [self.letters[b] for b in piece.encode()]
        if not parts:
            return 0
        parts[-1] += self.suffix
        return len(merge_pairs(parts, self.ranks))

    def prove(self) -> int:
        """Enters each vocabulary string that stands for whole text and encodes alone as one token; returns their number."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        for token in self.vocab:
            if token.endswith(self.suffix) and (name := token[: len(token) - len(self.suffix)]):
                try:
                    piece = bytes(byte_of[c] for c in name).decode()
                except (KeyError, UnicodeDecodeError):
                    continue  # a part of a character
                if self.merged(piece) == 1:
                    self[piece] = 1
        return len(self)

    def disagreed(self) -> regex.Pattern:
        """Characters for which the library's normalising or splitting may differ from :meth:`plain`.

        Those that Unicode 3.2 lacks are among them: its own are normalised alike by all later versions, in
        combination too. The others are compared one by one, between letters.
        """
        old = unicodedata.ucd_3_2_0
        known = [c for k in range(0x110000) if not 0xD800 <= k < 0xE000 and old.category(c := chr(k)) != "Cn"]
        wrong = set()
        for at in range(0, len(known), 4096):
            part = known[at : at + 4096]
            if [*self.pieces("\n".join(f"q{c}q {c}7" for c in part))] != [*self.plain("\n".join(f"q{c}q {c}7" for c in part))]:
                wrong |= {c for c in part if [*self.pieces(f"q{c}q {c}7")] != [*self.plain(f"q{c}q {c}7")]}
        good = sorted(map(ord, set(known) - wrong))
        spans: list[list[int]] = []
        for k in good:
            if spans and spans[-1][1] == k - 1:
                spans[-1][1] = k
            else:
                spans.append([k, k])
        return regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens by the library: normalised, cut, as text again."""
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return self.split_by_library(normal)

    def split_by_library(self, normal: str) -> list[str]:
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def plain(self, text: str) -> list[str]:
        """Pre-tokens by Python's functions; white space only parts them, so it stays as it is."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # lower() has another letter for one at the end of a word
        return self.split.findall(text.lower())

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= CACHED_LENGTH:
            if self.kept >= CACHE:
                for key in list(self)[self.proved :]:
                    del self[key]
                self.kept = 0
            self.kept += 1
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Number of tokens of a text; strings of added tokens in it are one each."""
        n = 0
        parts = self.added.split(text)
        for part in parts:
            plain = part.isascii() or not self.foreign.search(part)
            n += sum(map(self.__getitem__, self.plain(part) if plain else self.pieces(part)))
        return n + len(parts) - 1


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_bytes`` and ``n_tokens`` of each text, beside the columns ``keep``; ``path`` is a vocabulary file on the driver.

    The proof is made there once and sent to the workers with the vocabulary, by whose file its size is bounded.
    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are kept, other columns ignored,
    an empty table gives an empty result; a text of any length is counted whole.
    """
    kept = Kept(docs, keep)
    docs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body"), *kept.columns)

    proof = docs.sparkSession.sparkContext.broadcast(counter(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = proof.value
        for batch in slices(batches, "body", PART_BYTES):
            texts = batch.column(0)
            n = pa.array([counts.count(text) for text in texts.to_pylist()], pa.int64())
            yield kept.beside(batch, n_bytes=pc.binary_length(texts).cast(pa.int64()), n_tokens=n)

    return kept.restore(docs.mapInArrow(run, "n_bytes bigint, n_tokens bigint" + kept.ddl))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES = {}
