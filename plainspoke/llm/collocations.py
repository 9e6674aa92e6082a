"""Phrase collocations by weighted acyclic automata.

A count transducer is a deterministic acyclic automaton over words: a path spells
a phrase, the weight of the state that it reaches is how often the phrase occurs.
Its states are kept level by level (parent, word, weight), in order of the
phrases. Every task builds one for each language from its sorted n-grams, level
after level: a level's states are the distinct pairs of a state above and a word.

- Prefix ranges: words that start ranges of about equal weight are picked in
  proportion to their counts; a word that alone outweighs a range is split
  by its second word, and what a range has too much of by a hash of both. A task's
  automaton is cut into its ranges, and only these parts are shuffled.
- Union: parts of a range are united and their weights summed, a bounded number of
  states at a time. States that occur too rarely for a candidate go: no part of a
  candidate is rarer than the candidate.
- Composition: what a range needs of the weights of first parts and rests is asked of
  the ranges that hold them, once for each range, phrase by phrase, so that a word
  in a third of all candidates is asked for once a range. The same requests carry the largest
  count of a longer candidate, which decides whether a part is dropped.

Weights are Python integers where they are multiplied, so scores are exact.

Defined results: null and empty texts have no words; a null language is ``und``, like
one called so. Words of any length and texts of any length are read whole. Repeated
rows count as often as they occur. Equal scores go by count, then by phrase. An
empty table gives no phrase; other columns aren't read, whatever they are called.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, sorted_runs, table, written

#: Words that a task holds before it builds automata of them, n-grams of a prefix range, prefix ranges at most before hashes split them, states united at a time.
TOKENS, RANGE, RANGES, STATES = 2 << 20, 1 << 20, 512, 3 << 20
_MARKS = b".,;:!?\n\x0b\x0c\r"
_BORDER = b"."
_FOLD = bytes(32 if c == 9 else 46 if c in _MARKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8, ASCII lower-cased, with ``_BORDER`` wherever a piece ends."""
    return raw.translate(_FOLD).replace(_BORDER, b" . ").split(b" ")


class Counts:
    """A count transducer: ``words`` in order of their bytes, and for each level arrays (parent, word, weight) in order of the phrases.

    The parent of a state of the first level is 0. A weight of 0 stands for a phrase that is only a part of others' paths.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def of(cls, stream: list[bytes], longest: int) -> Counts:
        """Of a stream of words and borders: every phrase of up to ``longest`` words that crosses no border."""
        ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        return cls.numbered(ids, np.fromiter(map(ids.__getitem__, stream), np.int32, len(stream)), longest)

    @classmethod
    def numbered(cls, ids: dict[bytes, int], stream: np.ndarray, longest: int) -> Counts:
        """Of a stream of word numbers."""
        words = sorted(w for w in ids if w and w != _BORDER)
        place = np.zeros(len(ids) + 1, np.int32)
        place[[ids[w] for w in words]] = np.arange(1, len(words) + 1)
        text = place[stream[stream != ids[b""]]] if b"" in ids else place[stream]  # 0 at borders
        levels, state, at, size = [], np.zeros(len(text), np.int64), np.arange(len(text)), max(1, len(words))
        for k in range(longest):
            ok = at + k < len(text)
            at, state = at[ok], state[ok]
            nxt = text[at + k]
            ok = nxt > 0
            at = at[ok]
            keys, state, n = np.unique(state[ok] * size + nxt[ok] - 1, return_inverse=True, return_counts=True)
            levels.append((keys // size, keys % size, n.astype(np.int64)))
        return cls(words, levels)

    @classmethod
    def union(cls, parts: list[Counts]) -> Counts:
        """The automaton of all phrases of ``parts``, weights summed."""
        words = sorted(set().union(*(p.words for p in parts)))
        ids = {w: i for i, w in enumerate(words)}
        own = [np.fromiter(map(ids.__getitem__, p.words), np.int64, len(p.words)) for p in parts]
        state: list[np.ndarray] = [np.zeros(1, np.int64) for _ in parts]
        levels = []
        for k in range(max((len(p.levels) for p in parts), default=0)):
            keyed = [state[i][p.levels[k][0]] * len(words) + own[i][p.levels[k][1]] for i, p in enumerate(parts)]
            keys, inverse = np.unique(np.concatenate(keyed), return_inverse=True)
            weight = np.zeros(len(keys), np.int64)
            np.add.at(weight, inverse, np.concatenate([p.levels[k][2] for p in parts]))
            state = np.split(inverse, np.cumsum([len(x) for x in keyed])[:-1])
            levels.append((keys // (len(words) or 1), keys % (len(words) or 1), weight))
        return cls(words, levels)

    def kept(self, marks: list[np.ndarray]) -> Counts:
        """Only the states whose numbers ``marks`` hold (ascending, one array a level), and those on the way to them, whose weight becomes 0."""
        use = list(marks)
        for k in range(len(use) - 1, 0, -1):
            use[k - 1] = np.union1d(use[k - 1], self.levels[k][0][use[k]])
        named = np.unique(np.concatenate([w[u] for (_, w, _), u in zip(self.levels, use, strict=True)]))
        levels, above = [], np.zeros(1, np.int64)
        for (parent, word, weight), m, u in zip(self.levels, marks, use, strict=True):
            own = weight[u] if len(u) == len(m) else np.where(np.isin(u, m, assume_unique=True), weight[u], 0)
            levels.append((np.searchsorted(above, parent[u]), np.searchsorted(named, word[u]), own))
            above = u
        return Counts([self.words[i] for i in named.tolist()], levels)

    def frequent(self, least: int) -> Counts:
        return self.kept([np.flatnonzero(w >= least) for _, _, w in self.levels])

    def __len__(self) -> int:
        return sum(len(w) for _, w, _ in self.levels)

    def phrases(self) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """For each level, its phrases (space-joined) and weights."""
        above: list[bytes] = []
        for k, (parent, word, weight) in enumerate(self.levels):
            above = [above[p] + b" " + self.words[w] for p, w in zip(parent.tolist(), word.tolist(), strict=True)] if k else [self.words[w] for w in word.tolist()]
            yield above, weight

    def dump(self) -> bytes:
        sizes = struct.pack(f"<{len(self.levels) + 2}I", len(self.words), len(self.levels), *(len(w) for _, w, _ in self.levels))
        numbers = b"".join(np.diff(p, prepend=0).astype("<i4").tobytes() + w.astype("<i4").tobytes() + n.astype("<i8").tobytes() for p, w, n in self.levels)
        return zstandard.ZstdCompressor(level=1).compress(sizes + numbers + b" ".join(self.words))

    @classmethod
    def load(cls, blob: bytes) -> Counts:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, depth = struct.unpack_from("<2I", raw)
        sizes, at, levels = struct.unpack_from(f"<{depth}I", raw, 8), 8 + 4 * depth, []
        for size in sizes:
            parent, word, weight = (np.frombuffer(raw, kind, size, at + skip * size).astype(np.int64) for kind, skip in (("<i4", 0), ("<i4", 4), ("<i8", 8)))
            levels.append((np.cumsum(parent), word, weight))
            at += 16 * size
        return cls(raw[at:].split(b" ") if n else [], levels)


class Ranges:
    """Where phrases live: by their first word's range, by their first two where a word outweighs a range, and by a hash of these two where there are more than ``RANGES``."""

    def __init__(self, starts: list[bytes], split: int):
        self.starts, self.split = starts, split

    def of(self, lang: bytes, first: bytes, second: bytes = b"") -> int:
        at = bisect_right(self.starts, lang + b"\t" + first + b" " + second)
        return at * self.split + (xxhash.xxh3_64_intdigest(first + b" " + second) % self.split if self.split > 1 else 0)

    def one(self, lang: bytes, first: bytes) -> bool:
        """Whether everything that starts with a word lives in one range."""
        key = lang + b"\t" + first
        return self.split == 1 and bisect_right(self.starts, key + b" ") == bisect_right(self.starts, key + b"!")

    def cut(self, lang: bytes, own: Counts) -> Iterator[tuple[int, Counts]]:
        """The parts of an automaton by range."""
        (_, firsts, _), words = own.levels[0], own.words
        home = np.array([self.of(lang, words[w]) for w in firsts.tolist()], np.int64)
        homes = [home]
        if len(own.levels) > 1:
            parent, second, _ = own.levels[1]
            deal = np.array([not self.one(lang, words[w]) for w in firsts.tolist()], bool)[parent]
            near = home[parent]
            near[deal] = [self.of(lang, words[firsts[p]], words[s]) for p, s in zip(parent[deal].tolist(), second[deal].tolist(), strict=True)]
            homes.append(near)
            for parent, _, _ in own.levels[2:]:
                homes.append(homes[-1][parent])
        order = [np.argsort(h, kind="stable") for h in homes]
        dealt = [h[o] for h, o in zip(homes, order, strict=True)]
        for r in np.unique(np.concatenate(dealt)).tolist():
            yield r, own.kept([o[np.searchsorted(h, r, "left") : np.searchsorted(h, r, "right")] for h, o in zip(dealt, order, strict=True)])


class _Stream:
    """The words and borders of texts in one language as numbers."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []

    def add(self, raw: bytes) -> int:
        words = tokens(raw)
        words.append(_BORDER)
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        return len(words)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, dict[bytes, int], np.ndarray]]:
    """(language, numbers of the words, words and borders) of a task's rows, about ``TOKENS`` of all languages together or one text."""
    held: defaultdict[bytes, _Stream] = defaultdict(_Stream)
    size = 0

    def full() -> Iterator[tuple[bytes, dict[bytes, int], np.ndarray]]:
        while held:
            lang, own = held.popitem()
            yield lang, own.ids, np.concatenate(own.parts)

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            if text.is_valid:
                size += held[lang.as_py().encode()].add(text.as_buffer().to_pybytes())
                if size >= TOKENS:
                    yield from full()
                    size = 0
    yield from full()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text): partial counts in the tasks, summed after one shuffle."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, stream in _streams(lean(batches)):
            own = np.bincount(stream, minlength=len(ids))
            words = [w for w in ids if w and w != _BORDER]
            for at in range(0, len(words), 1 << 16):
                some = words[at : at + (1 << 16)]
                yield pa.record_batch([pa.array([lang.decode()] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array(own[[ids[w] for w in some]])], ["lang", "word", "n"])

    return docs.mapInArrow(part, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ranges(words: DataFrame, longest: int) -> Ranges:
    """Ranges of about ``RANGE`` n-grams each, from words picked in proportion to their counts: 8 a range, whatever the table."""
    total = longest * (words.agg(F.sum("n")).first()[0] or 0)
    wanted = max(1, -(-total // RANGE))
    n = min(RANGES, wanted)
    step = total / longest / n / 8
    chance = (F.pmod(F.xxhash64("lang", "word"), F.lit(1 << 20)) + F.lit(0.5)) / (1 << 20)
    picked = sorted((r.lang.encode(), r.word.encode(), max(float(r.n), step)) for r in words.where(F.col("n") >= chance * max(step, 1e-9)).collect()) if n > 1 else []
    starts, held = [], 0.0
    for lang, word, weight in picked:
        key = lang + b"\t" + word + b" "
        if weight > 8 * step:  # more than a range: cut by the second word, where the same picks say
            starts.append(key)
            own = [(w, x) for y, w, x in picked if y == lang]
            sums, share = list(accumulate(x for _, x in own)), 8 * step / weight
            starts += sorted({key + own[min(len(own) - 1, bisect_right(sums, sums[-1] * share * j))][0] for j in range(1, int(1 / share) + 1)})
            held = 0.0
            starts.append(key[:-1] + b"!")
        else:
            held += weight
            if held > 8 * step:
                starts.append(key)
                held = weight
    return Ranges(sorted(set(starts)), max(1, round(wanted / n)))


def shards(docs: DataFrame, where: Ranges, longest: int) -> DataFrame:
    """(home, lang, blob): the tasks' automata, cut into ranges."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, stream in _streams(lean(batches)):
            for home, part in where.cut(lang, Counts.numbered(ids, stream, longest)):
                yield pa.record_batch([pa.array([home], pa.int64()), pa.array([lang.decode()]), pa.array([part.dump()], pa.binary())], ["home", "lang", "blob"])

    return docs.mapInArrow(build, "home long, lang string, blob binary")


def _joined(blobs: Iterator[bytes], least: int = 0) -> Counts:
    """The union of blobs, at most about ``STATES`` states in parts at a time."""
    held: list[Counts] = []
    for blob in blobs:
        held.append(Counts.load(blob))
        if len(held) > 1 and sum(map(len, held)) > STATES:
            held = [Counts.union(held)]
    got = Counts.union(held) if len(held) > 1 else held[0]
    return got.frequent(least) if least else got


def _by_home(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("home").sortWithinPartitions("home", *order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for run in sorted_runs(lean(batches), "home"):
        homes = run.column("home").to_numpy()
        for home, at, n in zip(*np.unique(homes, return_index=True, return_counts=True), strict=True):
            yield int(home), run.slice(at, n)


def united(parts: DataFrame, least: int) -> DataFrame:
    """(home, lang, blob): one automaton for each range and language, without what occurs less than ``least`` times."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, run in _runs(batches):
            langs = np.array(run.column("lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                own = _joined((run.column("blob")[int(i)].as_py() for i in np.flatnonzero(langs == lang)), least)
                if len(own):
                    yield pa.record_batch([pa.array([home], pa.int64()), pa.array([lang]), pa.array([own.dump()], pa.binary())], ["home", "lang", "blob"])

    return _by_home(parts).mapInArrow(merge, "home long, lang string, blob binary")


_ASK = "home long, lang string, blob binary, asker long, phrase binary, n long"


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]], most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), most):
        some = list(zip(*rows[at : at + most], strict=True))
        yield pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(some, schema, strict=True)], [n for n, _ in schema])


_ASKED = [("home", pa.int64()), ("lang", pa.string()), ("asker", pa.int64()), ("phrase", pa.binary()), ("n", pa.int64())]


def asked(unions: DataFrame, where: Ranges) -> DataFrame:
    """(home, lang, asker, phrase, n): each range's requests for contiguous parts of its candidates, n being the largest count of a candidate that holds the part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for home, lang, blob in zip(*(batch.column(c).to_pylist() for c in ("home", "lang", "blob")), strict=True):
                parts: dict[bytes, int] = {}
                for phrases, weights in list(Counts.load(blob).phrases())[1:]:
                    for phrase, n in zip(phrases, weights.tolist(), strict=True):
                        if n:
                            w = phrase.split(b" ")
                            for a in range(len(w)):
                                for b in range(a + 1, len(w) + 1):
                                    if b - a < len(w) and (a == 0 or b == len(w) or b - a > 1):
                                        part = b" ".join(w[a:b])
                                        if parts.get(part, 0) < n:
                                            parts[part] = n
                name = lang.encode()
                yield from _rows([(where.of(name, *p.split(b" ")[:2]), lang, home, p, n) for p, n in parts.items()], _ASKED)

    return unions.mapInArrow(ask, "home long, lang string, asker long, phrase binary, n long")


def answered(unions: DataFrame, requests: DataFrame, least_share: int) -> DataFrame:
    """(home, lang, phrase, n): answers for the range that asked, n the part's count, and for the range that holds a part, n = -1 if a longer candidate takes it."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        current = None
        for batch in lean(batches):
            out = []
            for home, lang, blob, asker, phrase, n in zip(*(batch.column(c).to_pylist() for c in ("home", "lang", "blob", "asker", "phrase", "n")), strict=True):
                if home != current:
                    known, current = {}, home
                if blob is not None:  # automata come first
                    known[lang] = {p: w for phrases, weights in Counts.load(blob).phrases() for p, w in zip(phrases, weights.tolist(), strict=True) if w}
                    continue
                own = known[lang][phrase]
                out.append((asker, lang, phrase, own))
                if b" " in phrase and 100 * n >= least_share * own:
                    out.append((home, lang, phrase, -1))
            yield from _rows(out, [x for x in _ASKED if x[0] != "asker"])

    both = unions.unionByName(requests, allowMissingColumns=True).withColumn("asks", F.col("blob").isNull())
    return _by_home(both, "asks").mapInArrow(answer, "home long, lang string, phrase binary, n long")


def scored(unions: DataFrame, answers: DataFrame, top: int, scale: int) -> DataFrame:
    """(home, lang, phrase, a, l, r, score) of the candidates that stay; of each range and language the first ``top`` by score, count and phrase."""

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                out = []
                for phrases, weights in list(own.phrases())[1:]:
                    for phrase, a in zip(phrases, weights.tolist(), strict=True):
                        if a and (lang, phrase) not in taken:
                            w = phrase.split(b" ")
                            cuts = [(scale * a * a // (x * y), -k, x, y) for k in range(1, len(w)) for x, y in [(part[lang, b" ".join(w[:k])], part[lang, b" ".join(w[k:])])]]
                            score, _, x, y = min(cuts, key=lambda c: (c[0], -c[1]))
                            out.append((current, lang, phrase, a, x, y, score))
                out.sort(key=lambda r: (-r[6], -r[3], r[2]))
                yield from _rows(out[:top], [("home", pa.int64()), ("lang", pa.string()), ("phrase", pa.binary()), *((c, pa.int64()) for c in ("a", "l", "r", "score"))])

        held: dict[str, Counts] = {}
        part: dict[tuple[str, bytes], int] = {}
        taken: set[tuple[str, bytes]] = set()
        current = None
        for batch in lean(batches):
            for home, lang, blob, phrase, n in zip(*(batch.column(c).to_pylist() for c in ("home", "lang", "blob", "phrase", "n")), strict=True):
                if home != current:
                    yield from ended()
                    held, part, taken, current = {}, {}, set(), home
                if blob is not None:
                    held[lang] = Counts.load(blob)
                elif n < 0:
                    taken.add((lang, phrase))
                else:
                    part[lang, phrase] = n
        yield from ended()

    both = unions.unionByName(answers, allowMissingColumns=True)
    return _by_home(both).mapInArrow(grade, "home long, lang string, phrase binary, a long, l long, r long, score long")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, scale: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text): the first ``top`` phrases of 2 to ``longest`` words for each language.

    ``least``: occurrences of a candidate; ``share``: per cent of its occurrences
    within a longer candidate that take it out.
    """
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = written(word_counts(own), "words")
    where = ranges(words, longest)
    unions = written(united(shards(own, where, longest), least), "unions")
    answers = answered(unions, asked(unions, where), share)
    graded = scored(unions, answers, top, scale)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # At most 64 times ``top`` rows a language are left for the last window.
    some = graded.withColumn("_some", F.col("home") % 64)  # first within every 64th range, then over what those leave
    first = some.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_some").orderBy(*order))).where(F.col("_k") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    return best.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))
