"""Language identification by hierarchical discrimination.

A linear classifier over hashed letter n-grams first predicts the language family; within the family,
one-versus-one linear support vector machines vote for the language. The models are fitted on a bounded
sample of labelled rows (``SAMPLE`` a language, drawn by a hash of the id; the weights' size is fixed),
prediction streams over all whole texts without a shuffle.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoylake.llm.common import Kept, column_bytes, rows_out, slices, table

#: Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
}
#: Labelled rows of a language to learn from, at most (in expectation), and languages beyond which labels are refused rather than left out.
SAMPLE, LANGUAGES = 400, 5_000
#: Hashed features of 1, 2 and 3 bytes.
WIDTH = 1 << 13
#: Letters and bytes of other alphabets keep their value, all else becomes a space.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def has_letter(body: bytes) -> bool:
    letters = body.translate(_LETTERS)
    if not letters.isascii():
        return body.isalpha() or any(map(str.isalpha, body.decode("utf-8", "replace")))
    return not letters.isspace() and bool(letters)


def features(body: bytes) -> np.ndarray:
    """Square roots of hashed n-gram frequencies, of length 1."""
    a = np.frombuffer(b" " + b" ".join(body.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] << np.uint32(8) | a[1:]
    three = two[:-1] << np.uint32(8) | a[2:]
    f = np.zeros(WIDTH)
    for size, g in enumerate((a, two, three)):
        if len(g):
            at = ((g + np.uint32(1)) * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B % (1 << 32))) >> np.uint32(19)
            f += np.bincount(at, minlength=WIDTH) / len(g)
    f = np.sqrt(f)
    return (f / (np.linalg.norm(f) or 1)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine, by dual coordinate descent; y is -1 or 1."""
    rng = np.random.default_rng(seed)
    wide = np.ones((len(x), x.shape[1] + 1))  # the largest array of the training, made once
    wide[:, :-1] = x
    x = wide
    w, alpha, norms = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x)
    share = len(x) / (2 * np.array([(y < 0).sum(), (y > 0).sum()]))
    top = cost * share[(y > 0).astype(int)]
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """Families, their languages and the weights of all decisions."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        lang = np.array(langs)
        of = {v: next((f for f, members in FAMILIES.items() if v in members), v) for v in sorted(set(langs))}
        self.families = sorted(set(of.values()))
        self.members = {f: [v for v in of if of[v] == f] for f in self.families}
        family = np.array([of[v] for v in langs])
        self.family_w = {(a, b): self._pair(x, family, a, b) for a, b in combinations(self.families, 2)}
        self.lang_w = {f: {(a, b): self._pair(x, lang, a, b) for a, b in combinations(m, 2)} for f, m in self.members.items()}

    @staticmethod
    def _pair(x: np.ndarray, names: np.ndarray, a: str, b: str) -> np.ndarray:
        rows = np.flatnonzero((names == a) | (names == b))
        return fit_svm(x if len(rows) == len(x) else x[rows], np.where(names[rows] == a, 1.0, -1.0))

    @staticmethod
    def _vote(f: np.ndarray, names: list[str], weights: dict[tuple[str, str], np.ndarray]) -> tuple[str, float]:
        """The name with most votes (then largest sum of shares) and its mean share."""
        votes, shares = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), w in weights.items():
            p = 1 / (1 + np.exp(-4 * float(np.clip(f @ w[:-1] + w[-1], -50, 50))))
            votes[a if p >= 0.5 else b] += 1
            shares[a] += p
            shares[b] += 1 - p
        best = min(names, key=lambda v: (-votes[v], -shares[v], v))
        return best, shares[best] / (len(names) - 1) if len(names) > 1 else 1.0

    def predict(self, f: np.ndarray) -> tuple[str, float]:
        family, p = self._vote(f, self.families, self.family_w)
        lang, q = self._vote(f, self.members[family], self.lang_w[family])
        return lang, min(1.0, p * q)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """A model of every language, from at most about ``sample`` of its rows with a label and letters; None without such rows. Raises ValueError for more than ``languages`` labels."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("body"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages among the labels")
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, sample / n))])
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "i"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def describe(batches):
        def out():
            for batch in slices(batches, "body"):
                for lang, body in zip(batch.column(0).to_pylist(), column_bytes(batch, "body"), strict=True):
                    if has_letter(body):
                        yield lang, features(body).tobytes()

        return rows_out(pa.schema([("lang", pa.string()), ("f", pa.binary())]), 100)(out())

    found = sorted((r["lang"], bytes(r["f"])) for r in picked.select("lang", "body").mapInArrow(describe, "lang string, f binary").limit(2 * sample * len(counts)).collect())
    if not found:
        return None
    x, langs = np.stack([np.frombuffer(f, np.float32) for _, f in found]), [v for v, _ in found]
    del found
    return Model(x, langs)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of each whole text: the id, ``lang_pred``, ``score`` (0 to 1) and the columns to keep.

    Null texts, texts without a letter and everything without a model get ``und`` and 0. Repeated rows
    and null ids are kept, very long texts are read whole, other columns ignored, empty input gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = Kept(docs, keep)
    # a text that is kept goes to the workers once
    body = f"keep_{text_col}" if text_col in keep else "body"

    def run(batches):
        m = sent.value
        for part in slices(batches, body):
            found = [("und", 0.0) if m is None or text is None or not has_letter(text) else m.predict(features(text)) for text in column_bytes(part, body)]
            langs, scores = zip(*found, strict=True)
            yield kept.beside(part, row=part.column(0), lang_pred=pa.array(langs, pa.string()), score=pa.array(scores, pa.float64()))

    own = [] if text_col in keep else [F.col(text_col).cast("binary").alias("body")]
    out = docs.select(F.col(id_col).cast("bigint").alias("row"), *own, *kept.columns)
    return kept.restore(out.mapInArrow(run, f"row bigint, lang_pred string, score double{kept.ddl}").withColumnRenamed("row", id_col))


def held_out(id_col: str = "doc_id"):
    """Rows kept from training; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).where("doc_id is not null"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES = {}
