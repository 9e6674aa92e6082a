"""Toxicity of texts by a linear classifier that is regularised with counterfactuals.

Features are the hashed words of a text, ASCII or not, in lower case, and their first
4 to 7 letters; a text's score is a bias plus the mean weight of its words. Each
feature is scaled by its log odds between toxic and other labelled texts, so
that logistic regression with a ridge starts from what the labels say of single words.

Mentions of groups should not change a score. In every sentence of the labelled
texts that names one of the identity terms, each term is swapped for others of the
list; where a text names none, a sentence gets one put in. The squared change of the
score from each sentence to its counterfactual is added to the loss: weights that
only tell groups apart cost as much as they change, and what is left must come
from the other words.

The labelled rows that are learned from are at most ``SAMPLE_ROWS``, whole texts
each; workers send their hashed features, not their texts. Everything else covers
all rows.

Defined results: null and empty texts and texts without a word get the score of the
bias alone. Texts of any length are read whole; a score of exactly one half is
toxic. Repeated rows get equal scores and count as often as they occur; an id with
several labels is learned with each of them, null labels and ids with none are not
learned from. Without labels of both kinds every score is one half of nothing
learned: the share of toxic labels, 0 without labels. An empty table gives an empty
table; other columns are never read, whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, bounded_sample, lean, resident, table

#: Labelled rows that are learned from at most, hashed features, texts that a feature must occur in, words to a unit of the score.
SAMPLE_ROWS, DIMS, LEAST, UNIT = 6000, 1 << 18, 4, 40.0
#: Weight of the counterfactual penalty, and swaps of each mention.
FAIR, SWAPS = 10.0, 4
#: Words that name groups of people, in four languages. A caller may give others.
IDENTITY = (
    "women men girls boys gay lesbian transgender straight black white asian african european american muslim christian jewish hindu buddhist atheist immigrant refugee disabled deaf blind elderly young "
    "frauen männer mädchen jungen schwul lesbisch schwarze weiße muslime christen juden einwanderer flüchtlinge behinderte alte "
    "femmes hommes filles garçons homosexuel lesbienne noirs blancs musulmans chrétiens juifs immigrés réfugiés handicapés "
    "mujeres hombres niñas niños homosexuales lesbianas negros blancos musulmanes cristianos judíos inmigrantes refugiados discapacitados"
).split()
_WORD, _SENTENCE = re.compile(r"[^\W_]+"), re.compile(r"[.!?\n]+")


def features(word: str, dims: int = DIMS) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    return [xxhash.xxh3_64_intdigest("w" + word) % dims, *(xxhash.xxh3_64_intdigest("p" + word[:k]) % dims for k in (4, 5, 6, 7) if len(word) > k)]


def hashed(words: list[str], known: Cache) -> tuple[np.ndarray, np.ndarray]:
    """Features of a list of words and their values: occurrences in ``UNIT`` words."""
    got = Counter(words)
    ids = [known[w] for w in got]
    flat = np.fromiter((i for f in ids for i in f), np.int64)
    if not len(flat):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    times = np.repeat(np.fromiter(got.values(), np.float64, len(got)), [len(f) for f in ids])
    own, place = np.unique(flat, return_inverse=True)
    return own.astype(np.int32), (np.bincount(place, weights=times) * UNIT / len(words)).astype(np.float32)


def counterfactuals(text: str, terms: list[str], swaps: int = SWAPS) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs (words of a sentence, words with its identity term swapped) of a lower-case text, whole texts always."""
    among, found = set(terms), False
    first = xxhash.xxh3_64_intdigest(text)
    sentences = [w for w in map(_WORD.findall, _SENTENCE.split(text)) if w]
    for n, words in enumerate(sentences):
        for at, word in enumerate(words):
            if word in among:
                found = True
                for k in range(swaps):
                    other = terms[(first + 31 * n + 7 * at + k * (len(terms) // swaps + 1)) % len(terms)]
                    yield words, [*words[:at], other, *words[at + 1 :]]
    if sentences and terms and not found:  # one term put in against another: equally many words, so nothing else changes
        words = sentences[first % len(sentences)]
        at = first % (len(words) + 1)
        one, other = terms[first % len(terms)], terms[(first // len(terms)) % len(terms)]
        yield [*words[:at], one, *words[at:]], [*words[:at], other, *words[at:]]


def _packed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, bytes, bytes]:
    """Sparse rows as bytes: lengths, features, values."""
    return np.array([len(f) for f, _ in pairs], "<i4").tobytes(), b"".join(f.astype("<i4").tobytes() for f, _ in pairs), b"".join(v.astype("<f4").tobytes() for _, v in pairs)


def samples(text: Column, terms: list[str]) -> Column:
    """Struct of packed sparse rows of a text: its features first, then the change from each sentence to its counterfactual."""

    @F.pandas_udf("n binary, f binary, v binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = resident("toxic-words", lambda: Cache(features))
        for texts in lean(batches, keep=True):
            rows = []
            for t in texts:
                low = t.lower() if isinstance(t, str) else ""
                own = [hashed(_WORD.findall(low), known)]
                for a, b in counterfactuals(low, terms):
                    (fa, va), (fb, vb) = hashed(a, known), hashed(b, known)
                    ids, place = np.unique(np.concatenate([fa, fb]), return_inverse=True)
                    change = np.bincount(place, weights=np.concatenate([-va, vb]), minlength=len(ids)).astype(np.float32)
                    own.append((ids[change != 0], change[change != 0]))
                rows.append(_packed(own))
            yield pd.DataFrame(rows, columns=["n", "f", "v"])

    return pack(text)


class Sparse:
    """Sparse rows (features f, row numbers r, values v), n of them."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.f = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
        self.v = np.concatenate([v for _, v in rows]).astype(float) if rows else np.zeros(0)
        self.r = np.repeat(np.arange(self.n), [len(f) for f, _ in rows]) if rows else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, weights=w[self.f] * self.v, minlength=self.n)

    def back(self, d: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.f, weights=d[self.r] * self.v, minlength=dims)


class Toxicity:
    """score = sigmoid(bias + UNIT * mean weight of the words)."""

    def __init__(self, dims: int = DIMS):
        self.w, self.bias, self.dims = np.zeros(dims, np.float32), -30.0, dims

    def fit(self, texts: Sparse, toxic: np.ndarray, changes: Sparse, fair: float = FAIR, steps: int = 200, rate: float = 0.1, ridge: float = 1e-4, least: int = LEAST) -> None:
        """Logistic regression over features scaled by their log odds; ``fair`` weighs the mean squared change by counterfactuals."""
        yes, no = toxic.sum(), (1 - toxic).sum()
        if not yes or not no:
            self.bias = float(np.clip(np.log((yes + 1e-9) / (no + 1e-9)), -30, 30)) if texts.n else -30.0
            return
        p, q = (np.bincount(texts.f, weights=y[texts.r], minlength=self.dims) for y in (toxic, 1 - toxic))
        odds = np.where(p + q >= least, np.log((p + 1) / (yes + 2)) - np.log((q + 1) / (no + 2)), 0)
        texts.v, changes.v = texts.v * odds[texts.f], changes.v * odds[changes.f]
        share = np.where(toxic > 0.5, 0.5 / yes, 0.5 / no)
        w, m, s = (np.zeros(self.dims + 1) for _ in range(3))
        for i in range(1, steps + 1):
            d = (1 / (1 + np.exp(-np.clip(texts.times(w[:-1]) + w[-1], -60, 60))) - toxic) * share
            g = np.append(texts.back(d, self.dims) + ridge * w[:-1], d.sum())
            if fair and changes.n:
                g[:-1] += 2 * fair / changes.n * changes.back(changes.times(w[:-1]), self.dims)
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
        self.w, self.bias = (w[:-1] * odds).astype(np.float32), float(w[-1])

    def weight(self, word: str) -> float:
        return float(self.w[features(word, self.dims)].sum())

    def score(self, text: str, known: Cache) -> float:
        words = _WORD.findall(text.lower())
        z = self.bias + (UNIT * sum(map(known.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


def trained(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: list[str] | None = None, fair: float = FAIR) -> Toxicity:
    """A model of (doc_id, text) and (doc_id, toxic), learned from at most ``rows`` labels, those whose ids have the smallest hashes."""
    terms = sorted(IDENTITY if terms is None else terms)
    picked = bounded_sample(labels.where("toxic is not null and doc_id is not null"), rows, ["doc_id"], F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = labels.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")  # at most ``rows`` ids
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = bounded_sample(met, rows, ["doc_id", "text"], F.col("toxic").alias("toxic"), samples(F.col("text"), terms).alias("s"))
    texts, changes = [], []
    for r in got:
        ends = np.cumsum(np.frombuffer(r.s.n, "<i4"))[:-1]
        own = list(zip(np.split(np.frombuffer(r.s.f, "<i4").astype(np.int64), ends), np.split(np.frombuffer(r.s.v, "<f4"), ends), strict=True))
        texts.append(own[0])
        changes += own[1:]
    model = Toxicity()
    model.fit(Sparse(texts), np.array([float(r.toxic > 0) for r in got]), Sparse(changes), fair)
    return model


def scored(model: Toxicity, text: Column) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Cache(model.weight)
        for texts in lean(batches):
            yield pd.Series([model.score(t if isinstance(t, str) else "", known) for t in texts], dtype=float)

    return score(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents kept from training: crc32 of the id's text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = trained(docs.where(~held_out()), table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), scored(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
