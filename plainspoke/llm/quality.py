"""Quality of texts by a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each text. Their votes overlap,
and how often each is right is not known: expectation-maximisation estimates it
(and the share of good texts) from the counts of vote patterns over the whole
corpus, of which there are at most 3 to the number of labellers, so the counts
are all that leaves the cluster. The posterior of a text's pattern then is the
soft label of a linear scorer over hashed words and word shapes, fitted on a
bounded sample of whole texts, which scores every whole text.

Defined results: null and empty texts are voted on like texts of no words and
score 0. Very long texts, and very long words, are measured, scored and learned
from whole. Repeated rows count and vote as often as they occur and get equal
results. A text exactly on the border (one half) is good. With an empty table there
is nothing to fit and nothing to return. No column but the text and the id is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, bounded_sample, lean, resident, table

GOOD, BAD, NONE = 0, 1, 2
#: Rows that the scorer is fitted on at most, whole texts, and the scorer's size.
SAMPLE_ROWS, DIMS = 2500, 1 << 15
_PLAIN = {ord(c): None for c in ".,;:?\"'()-+@/"}
_SYMBOLS = [bytes([c]) for c in b"|#{}<>=_~*\\^$%&"]


def plain(word: str) -> int:
    """1 if a word is letters or digits but for common marks, and no long run of capitals."""
    return int(word.translate(_PLAIN).isalnum() and not (word.isupper() and len(word) > 3))


def known_words() -> Cache:
    """``plain`` of words, remembered by the worker up to a bound of bytes."""
    return resident("plain", lambda: Cache(plain))


def measures(text: str, plain: Cache) -> dict[str, float]:
    """What the labellers look at, each read off the whole text."""
    raw, words, lines = text.encode("utf-8", "replace"), text.split(), [x for x in text.split("\n") if x.strip()]
    n, b = max(1, len(words)), np.frombuffer(raw, np.uint8)
    upper, lower = int(((b >= 65) & (b <= 90)).sum()), int(((b >= 97) & (b <= 122)).sum())
    again = sum(map(eq, words, words[1:]))
    return {
        "words": len(words), "letters": upper + lower, "upper": upper / max(1, upper + lower), "symbols": sum(map(raw.count, _SYMBOLS)) / n,
        "cries": raw.count(b"!") / n, "bars": words.count("|") / n, "again": again / n,
        "plain": (sum(map(plain.__getitem__, words)) - (sum(plain[w] for w, x in zip(words, words[1:]) if w == x) if again else 0)) / n,
        "lines": len(lines), "lines_again": 1 - len(set(lines)) / max(1, len(lines)),
    }


#: The labellers: each returns GOOD, BAD or NONE from the measures.
LABELLERS = {
    "plain": lambda m: NONE if not m["words"] else BAD if m["plain"] < 0.7 else GOOD if m["plain"] > 0.85 else NONE,
    "case": lambda m: NONE if m["letters"] < 20 else BAD if m["upper"] > 0.35 else NONE,
    "symbols": lambda m: BAD if m["symbols"] > 0.15 else NONE,
    "cries": lambda m: BAD if m["cries"] > 0.2 else NONE,
    "bars": lambda m: BAD if m["bars"] > 0.1 else NONE,
    "repeats": lambda m: BAD if m["words"] >= 8 and m["again"] > 0.1 else NONE,
    "lines": lambda m: BAD if m["lines"] >= 6 and m["lines_again"] > 0.5 else NONE,
    "empty": lambda m: BAD if not m["letters"] else NONE,
}


def pattern(text: str | None, plain: Cache) -> int:
    """The votes as a number in base 3, the first labeller's lowest."""
    m = measures(text or "", plain)
    return sum(vote(m) * 3**i for i, vote in enumerate(LABELLERS.values()))


def patterns(text: Column) -> Column:
    @F.pandas_udf("int")
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = known_words()
        for texts in lean(batches, keep=True):
            yield pd.Series([pattern(t if isinstance(t, str) else None, words) for t in texts], dtype="int32")

    return votes(text)


class WeakLabels:
    """prior: share of good texts; right (labeller): how often a labeller that votes is right. Whether it votes says nothing by itself."""

    def __init__(self, counts: dict[int, int], rounds: int = 100, belief: float = 0.1):
        """counts: texts of each pattern. belief: weight, as a share of all texts, of the assumption that each labeller is right four times in five."""
        k = len(LABELLERS)
        self.prior, self.right = 0.7, np.full(k, 0.8)
        codes = np.array(sorted(counts))
        if not len(codes):
            return
        n = np.array([counts[c] for c in codes], float)
        votes = self._votes(codes)
        few = belief * n.sum()
        for _ in range(rounds):
            good = self.posterior(codes)
            self.prior = float(np.clip((good * n).sum() / n.sum(), 0.05, 0.95))
            agree = np.where(votes == 1, good[:, None], np.where(votes == -1, 1 - good[:, None], 0)) * n[:, None]
            self.right = np.clip((agree.sum(0) + 0.8 * few) / ((np.abs(votes) * n[:, None]).sum(0) + few), 0.55, 0.98)

    @staticmethod
    def _votes(codes: np.ndarray) -> np.ndarray:
        """1 good, -1 bad, 0 nothing."""
        return np.array([1, -1, 0])[np.asarray(codes)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3]

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability of a good text for each pattern."""
        odds = np.log(self.prior / (1 - self.prior)) + self._votes(codes) @ np.log(self.right / (1 - self.right))
        return 1 / (1 + np.exp(-odds))


_SHAPE = [(re.compile(p), r) for p, r in ((r"[A-ZÀ-ÖØ-Þ]{2,}", "AA"), (r"[A-ZÀ-ÖØ-Þ]", "A"), (r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a"), (r"\d+", "0"))]


def buckets(word: str, dims: int = DIMS) -> tuple[int, int]:
    """Two hashed features of a word: its shape and itself."""
    shape = word
    for p, r in _SHAPE:
        shape = p.sub(r, shape)
    return xxhash.xxh3_64_intdigest("s" + shape) % dims, xxhash.xxh3_64_intdigest("w" + word) % dims


def hashed(text: str, known: Cache) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their share of the words, share of words that repeat the one before) of a whole text."""
    words = text.split()
    got = Counter(words)
    ids = np.array([known[w] for w in got], np.int32).reshape(-1, 2)
    own, place = np.unique(ids.ravel(), return_inverse=True)
    n = np.bincount(place, weights=np.repeat(np.fromiter(got.values(), float, len(got)), 2), minlength=len(own))
    return own.astype(np.int32), (n / max(1, len(words))).astype(np.float32), sum(map(eq, words, words[1:])) / max(1, len(words))


def samples(text: Column) -> Column:
    """Struct (f, v, again, votes) of a text column: what the scorer learns of a text, packed where the text is.

    With the votes, as a second function over batches would take a second worker
    a task, which executors keep for all later stages.
    """

    @F.pandas_udf("f binary, v binary, again double, votes int")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, plain_ = Cache(buckets), known_words()
        for texts in lean(batches, keep=True):
            own = [hashed(t, known) if isinstance(t, str) else (np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0) for t in texts]
            votes = np.array([pattern(t if isinstance(t, str) else None, plain_) for t in texts], np.int32)
            yield pd.DataFrame([(f.astype("<i4").tobytes(), v.astype("<f4").tobytes(), again) for f, v, again in own], columns=["f", "v", "again"]).assign(votes=votes)

    return pack(text)


class Scorer:
    """score = sigmoid(bias + mean weight of a text's words + a weight for the share of words that repeat the one before)."""

    def __init__(self, dims: int = DIMS):
        self.w, self.bias, self.again, self.dims = np.zeros(dims, np.float32), 0.0, 0.0, dims
        self.seen = Cache(self.weight)

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray, float]], good: np.ndarray, steps: int = 150, rate: float = 0.3, ridge: float = 1e-5) -> None:
        """texts: features, shares of the words and repeats of each, as ``hashed`` gives them."""
        if not texts:
            return
        feats, vals = [f for f, _, _ in texts], [v for _, v, _ in texts]
        rows = [np.full(len(f), i, np.int32) for i, f in enumerate(feats)]
        f, r, v = (np.concatenate(x) for x in (feats, rows, vals))
        if not len(f):
            return
        rep = np.array([x for _, _, x in texts])
        weight = np.where(good > 0.5, 0.5 / max(1e-9, (good > 0.5).mean()), 0.5 / max(1e-9, (good <= 0.5).mean()))
        w, m, s = np.zeros(self.dims + 2), np.zeros(self.dims + 2), np.zeros(self.dims + 2)
        for i in range(1, steps + 1):
            z = np.bincount(r, weights=w[f] * v, minlength=len(texts)) + w[-2] + w[-1] * rep
            d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - good) * weight / len(texts)
            g = np.concatenate([np.bincount(f, weights=d[r] * v, minlength=self.dims), [d.sum(), (d * rep).sum()]]) + ridge * w
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
        self.w, self.bias, self.again = w[:-2].astype(np.float32), float(w[-2]), float(w[-1])

    def weight(self, word: str) -> float:
        a, b = buckets(word, self.dims)
        return float(self.w[a] + self.w[b])

    def score(self, text: str) -> float:
        words = text.split()
        if not words:
            return 0.0
        z = self.bias + sum(map(self.seen.__getitem__, words)) / len(words) + self.again * sum(map(eq, words, words[1:])) / len(words)
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


def fitted(docs: DataFrame, text: str = "text", order: str = "doc_id", rows: int = SAMPLE_ROWS) -> tuple[WeakLabels, Scorer]:
    """The weak-label model of all of ``docs`` and the scorer fitted on at most ``rows`` of them."""
    counts = {r["p"]: r["n"] for r in docs.select(patterns(F.col(text)).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most 3 ** labellers
    labels, scorer = WeakLabels(counts), Scorer()
    some = bounded_sample(docs.where(F.length(text) > 0), rows, [order, text], samples(F.col(text)).alias("s"))
    if some:
        scorer.fit([(np.frombuffer(r.s.f, "<i4"), np.frombuffer(r.s.v, "<f4"), r.s.again) for r in some], labels.posterior(np.array([r.s.votes for r in some])))
    return labels, scorer


def graded(labels: WeakLabels, scorer: Scorer, text: Column) -> Column:
    """Struct (votes, p_good, score, good) of a text column. good: neither the scorer nor the votes are sure of the contrary."""

    @F.pandas_udf("votes int, p_good double, score double, good boolean")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = known_words()
        for texts in lean(batches, keep=True):
            own = [t if isinstance(t, str) else "" for t in texts]
            votes = np.array([pattern(t, words) for t in own], np.int32)
            p, s = labels.posterior(votes), np.array([scorer.score(t) for t in own], float)
            yield pd.DataFrame({"votes": votes, "p_good": p, "score": s, "good": (p + s) / 2 >= 0.5})

    return grade(text)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", graded(*fitted(docs), F.col("text")).alias("_g")).select("doc_id", "_g.*")
