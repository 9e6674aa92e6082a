"""Pattern packing: few-document length patterns fitted to the histogram of lengths.

All that the fit needs is the histogram of piece lengths, at most ``SIZE`` counts
whatever the corpus. Every way of filling a sequence exactly with up to ``DEPTH``
pieces is a pattern; non-negative least squares finds how often to use each so
that the lengths used match the histogram; the repeats are rounded down to what
the counts allow, and what remains is packed best fit decreasing, again by
pattern and repeat. So the whole plan is a table of lengths and rank ranges, of
bounded size, and each piece finds its place by its rank among the pieces of its
length. Ranks come from salted windows and running sums, so that a length that a
third of all pieces share is never in one task.

Defined results: null and empty texts are one piece of the closing token alone.
Texts longer than a sequence are cut; the remainder comes first, so only piece 0
may be shorter. Repeated rows are packed one by one; an empty table gives none.
Pieces of equal length are interchangeable: a random rank, then the other columns,
order them. A null id is kept as it is. Columns other than id and text aren't read;
of ``packed``'s input all columns are kept, whatever their names, unless they are
called sequence_id or offset.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, lean, resident, table, written

VOCABULARY, END = "byte_bpe_50k.json", 2
SIZE, DEPTH = 1024, 3
#: Pieces of one length that a window ranks together, about; or the root of their number, if that is more, so that neither the groups nor their number grow large.
RANKED = 1024


class Ids:
    """ids of texts by a tokenizers file. Texts without a special token's string are merged by rank, several times faster, where the file's merges are in order of rank and odd texts get the same ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._by_rank(path)

    def _by_rank(self, path: str) -> object:
        """The file's vocabulary as ranks; None unless its merges go by rank and texts of all kinds get the same ids."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"].get("merges", [])
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        vocabulary = self.tokenizer.get_vocab()
        try:
            order = [vocabulary[t] for t in made]
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None
        if order != sorted(set(order)) or len(order) + 256 != len(ranks):
            return None
        probes = ["".join(map(chr, range(1, 0x250))), " ".join(self.tokenizer.decode([i]) for i in range(0, len(ranks), 17)), "it's 12\n\n  they'll été Straße 字 \t!?"]
        same = all(fast.encode_ordinary(t) == self.tokenizer.encode(t, add_special_tokens=False).ids for t in probes)
        return fast if same else None

    def __call__(self, text: str) -> bytes:
        if self.ranked and not any(s in text for s in self.special):
            ids = self.ranked.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def ids_by(path: str) -> Ids:
    """The tokenizer of a file, read once in a worker."""
    return resident(("ids", path), lambda: Ids(path))


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones behind a first one that may be shorter."""
    head = n % size or min(n, size)
    return [(0, head), *((at, size) for at in range(head, n, size))]


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every text; the ids themselves stay where they are made."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, end = ids_by(path), np.array([END], "<u4").tobytes()
        for texts in lean(batches, keep=True):
            out = []
            for t in texts:
                raw = memoryview((own(t) if isinstance(t, str) else b"") + end)
                out.append([{"piece": k, "start": a, "length": n, "ids_crc32": zlib.crc32(raw[4 * a : 4 * (a + n)])} for k, (a, n) in enumerate(cut(len(raw) // 4, size))])
            yield pd.Series(out)

    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(split(F.col(text))))


def patterns(hist: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` lengths, descending and filled with 0, that sum to the sequence's size and of which every length occurs."""
    size = len(hist) - 1
    have = np.flatnonzero(hist)
    rows = [np.array([[size] + [0] * (depth - 1)])] if hist[size] else []
    if depth >= 2:
        a = have[(have >= size - have) & (have < size)]
        a = a[hist[size - a] > 0]
        rows.append(np.stack([a, size - a, *[np.zeros_like(a)] * (depth - 2)], 1))
    if depth >= 3:
        a, b = np.meshgrid(have, have, indexing="ij")
        c = size - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        a, b, c = a[ok], b[ok], c[ok]
        ok = hist[c] > 0
        rows.append(np.stack([a[ok], b[ok], c[ok], *[np.zeros_like(a[ok])] * (depth - 3)], 1))
    return np.concatenate(rows) if rows else np.zeros((0, depth), int)


def fit(hist: np.ndarray, rows: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 of the patterns that bring the lengths they use closest to the histogram in least squares, by multiplicative updates."""
    size, b = len(hist), hist.astype(float)
    b[0] = 0
    x = np.ones(len(rows))
    goal = b[rows].sum(1)
    for _ in range(rounds if len(rows) else 0):
        used = np.zeros(size)
        for col in rows.T:
            used += np.bincount(col, weights=x, minlength=size)
        used[0] = 0
        x *= goal / np.maximum(used[rows].sum(1), 1e-12)
    return x


def plan(hist: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram: the rounded fit, then best fit decreasing on what remains."""
    left = hist.astype(np.int64).copy()
    rows = patterns(left, depth)
    x = fit(left, rows)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int) -> None:
        of, n = np.unique(lengths, return_counts=True)
        k = int(min(most, *(left[of] // n)))
        if k > 0:
            left[of] -= k * n
            out.append((lengths, k))

    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        take(tuple(int(v) for v in rows[i] if v), int(np.floor(x[i] + 0.5)))
    size = len(hist) - 1
    while (have := np.flatnonzero(left)).size:
        lengths = [int(have[-1])]
        room = size - lengths[0]
        while room > 0:
            fits = have[: np.searchsorted(have, room, side="right")][::-1]
            best = next((int(v) for v in fits if left[v] > lengths.count(v)), 0)
            if not best:
                break
            lengths.append(best)
            room -= best
        take(tuple(lengths), int(left.max()))
    return out


def places(steps: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset): ranks from there on go to the sequences from there on, at that offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, k in steps:
        offset = 0
        for n in lengths:
            rows.setdefault(n, []).append((ranks.get(n, 0), sequence, offset))
            ranks[n] = ranks.get(n, 0) + k
            offset += n
        sequence += k
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def packed(parts: DataFrame, size: int = SIZE, depth: int = DEPTH) -> DataFrame:
    """``parts`` (with length) and the columns sequence_id and offset. What it reads is written first, so ranks are of one state of it."""
    rand, salt, first, nth, rank, place_ = fresh(parts.columns, "_r", "_s", "_from", "_k", "_rank", "_p")
    kept = written(parts.withColumn(rand, F.rand(13)), "pieces")
    counts = kept.groupBy("length").count().collect()  # at most ``size`` rows
    hist = np.zeros(size + 1, np.int64)
    for r in counts:
        hist[r["length"]] = r["count"]
    where = places(plan(hist, depth), size)
    salts = F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r["length"], -(-r["count"] // max(RANKED, isqrt(r["count"]))))]), F.col("length")) if counts else F.lit(1)
    salted = kept.withColumn(salt, F.floor(F.col(rand) * salts).cast("int"))
    groups = salted.groupBy("length", salt).agg(F.count("*").alias("n")).withColumn(first, F.sum("n").over(W.partitionBy("length").orderBy(salt).rowsBetween(W.unboundedPreceding, -1)))
    ranks = F.row_number().over(W.partitionBy("length", salt).orderBy(rand, *(c for c in ("doc_id", "piece", "ids_crc32") if c in parts.columns)))
    ranked = salted.withColumn(nth, ranks).join(groups.select("length", salt, first), ["length", salt]).withColumn(rank, F.coalesce(first, F.lit(0)) + F.col(nth) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        of, starts = np.unique(n[order], return_index=True)
        for v, rows in zip(of, np.split(order, starts[1:]), strict=True) if len(n) else ():
            t = where[int(v)]
            at = np.searchsorted(t[:, 0], r[rows], side="right") - 1
            seq[rows], off[rows] = t[at, 1] + r[rows] - t[at, 0], t[at, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn(place_, place("length", rank)).select(*parts.columns, F.col(place_)["sequence_id"].alias("sequence_id"), F.col(place_)["offset"].alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(tokenised(table(spark, sf_dir, "documents", "doc_id", "text")))
