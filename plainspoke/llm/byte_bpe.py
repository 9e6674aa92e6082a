"""Byte-level BPE encoding and decoding in linear time.

The bytes of a pre-token are read as Latin-1, so that the Aho-Corasick automaton
of the vocabulary finds every token in them. Encoding takes the longest token at
each place and keeps it if it may stand after the one before: two adjacent tokens
are compatible if no merge would have crossed their border, which is decided by
undoing merges on both sides and memoised. If not, the next shorter token that
is a prefix is tried, then the step before is taken back; a place that was given
up once is never tried again. That reproduces the merges by rank exactly.

The text is cut at the pre-token pattern first. Where a single space stands
between two characters that aren't white space, a pre-token always ends, so
the pieces between such spaces are encoded on their own and remembered in a
cache of bounded size.

Defined results: null and empty texts have no tokens. Long texts and long
pre-tokens take linear time; repeated rows give repeated results, an empty table
none; no column but the text is read, whatever the others are called.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, lean, resident, table

RANKS = "byte_bpe_50k.tiktoken"
#: Pairs of tokens whose compatibility is remembered before it starts anew.
PAIRS = 400_000
#: White space other than space and line feed.
_OTHER = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_BORDER = regex.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Parts of a text that are tokenised independently; every part but the first had a space before it that was removed here."""
    unsure = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _OTHER)
    return _BORDER.split(text) if unsure else text.split(" ")


class ByteBpe:
    """The encoder of one file of ranks. ids are unsigned 32-bit little-endian bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, file)}
        self.text = {i: t for t, i in self.rank.items()}
        self.raw = [self.text.get(i, "").encode("latin-1") for i in range(max(self.text, default=-1) + 1)]
        self.size = {i: len(t) for i, t in self.text.items()}
        self.pattern = regex.compile(pattern)
        self.found = ahocorasick.Automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.text):
            t = self.text[i]
            self.found.add_word(t, (i, len(t) - 1))
            self.shorter[i] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), None)
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k], i), self.rank.get(t[k:], i)
                if a < i and b < i and self.compatible(a, b):
                    self.parts[i] = (a, b)
                    self.merged[a, b] = i
                    break
        self.found.make_automaton()
        self.fits.clear()  # what was found while merges were missing
        self.plain = self.pattern.findall(" ab cd") == [" ab", " cd"]
        self.ends = {c for c in ".,;:!?" if self.pattern.findall("ab" + c) == ["ab", c]} if self.plain else set()
        self.words = Cache(lambda word: self._encode(word.encode().decode("latin-1")), 8 << 20)
        self.first = Cache(self._split, 1 << 20)
        self.rest = Cache(lambda piece: self._split(" " + piece), 64 << 20)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves tokens a and b side by side."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        bound = 1 << 62  # a merge across the border of this rank or above would have come too late
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            # The later of the two last merges is undone; of equal tokens the left one was made first.
            left, right = self.parts.get(a), self.parts.get(b)
            if left and (not right or a > b):
                bound, a = a, left[1]
            elif right:
                bound, b = b + 1, right[0]
            else:
                return True

    def _encode(self, word: str) -> bytes:
        if (whole := self.rank.get(word)) is not None:
            return whole.to_bytes(4, "little")
        n, size, shorter, fits = len(word), self.size, self.shorter, self.fits
        longest: list[int | None] = [None] * (n + 1)
        for end, (i, before) in self.found.iter(word):
            longest[end - before] = i  # later ends are longer
        out, open_, at, token, last = array("I"), bytearray(b"\1") * (n + 1), 0, longest[0], -1
        while token is not None:
            end = at + size[token]
            ok = open_[end] and (last < 0 or fits.get((last, token)))
            if ok is None:
                ok = self.compatible(last, token)
            if ok:
                out.append(token)
                at, last, token = end, token, longest[end]
            elif (less := shorter[token]) is not None:
                token = less
            elif out:
                open_[at] = 0
                token = out.pop()
                last = out[-1] if out else -1
                at -= size[token]
            else:
                break
        if at != n:
            raise ValueError("the vocabulary lacks a byte")
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _split(self, piece: str) -> bytes:
        spaced = piece[:1] == " "
        letters = piece[1:] if spaced else piece
        if letters.isalpha() and self.plain:  # one pre-token
            return self._encode(piece.encode().decode("latin-1"))
        if letters[-1:] in self.ends and letters[:-1].isalpha():
            return (self.rest if spaced else self.first)[letters[:-1]] + self.words[letters[-1]]
        return b"".join(map(self.words.__getitem__, self.pattern.findall(piece)))

    def encode(self, text: str) -> bytes:
        parts = pieces(text)
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """The encoder of a file, read once in a worker."""
    return resident(("bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Binary column of the ids of a text column, 4 bytes each, little-endian. The vocabulary is read where the tasks run."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path, pattern)
        for texts in lean(batches, keep=True):
            yield pd.Series([own.encode(t) if isinstance(t, str) else b"" for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Binary column of the bytes that ids stand for."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path, pattern)
        for some in lean(batches, keep=True):
            yield pd.Series([own.decode(x) if x is not None else b"" for x in some], dtype=object)

    return raw(ids)


def digests(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256): encoded, decoded and digested where the text is, so that no ids travel."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern)
        for texts in lean(batches, keep=True):
            rows = []
            for t in texts:
                ids = own.encode(t) if isinstance(t, str) else b""
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", digests(F.col("text")).alias("_d")).select("doc_id", "_d.*")
