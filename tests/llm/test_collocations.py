"""Phrase collocations against a plain count: borders, hot words, long words, nulls, ranges split by second words and hashes, longer phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import collocations as co  # noqa: E402

DOC = "doc_id long, text string, lang string, phrase string, home long, n long, a string, blob string"


def plain(rows, least, longest, share, top):
    f, out = Counter(), []
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            f.update((lang or "und", *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    n = Counter()
    for p, a in f.items():
        if len(p) == 2:
            n[p[0]] += a
    gone = {(p[0], *p[i:j]) for p, a in cand.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * a >= share * f[(p[0], *p[i:j])]}
    by = {}
    for p, a in cand.items():
        if p not in gone:
            cuts = [(1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, x, y = min(cuts)
            by.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), x, y))
    for lang, own in by.items():
        out += [(lang, i, b.decode(), -a, x, y, n[lang], -s) for i, (s, a, b, x, y) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["the"] * 60 + ["of"] * 20 + [f"w{i}" for i in range(40)] + ["Ünder", "straße", "x" * 300, "new york", "New York City", "a.b", "tab\tbed", "c\x01d"]
    texts = [rng.choice(["", " ", "\n"]) + " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\r"]) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return [(rng.choice(["en", "en", "de", None, "und"]), t) for t in texts] + [("en", None), ("fr", ""), (None, "one two one two"), ("en", "new york city " * 400), ("en", "w1 w2 " * 3000)] + [("en", "the of " * 9)] * 7


@pytest.mark.parametrize(("kind", "longest", "least", "top"), [("one", 3, 5, 2000), ("ranges", 3, 5, 40), ("hashes", 3, 3, 2000), ("ranges", 4, 4, 2000), ("small", 2, 2, 10)])
def test_against_a_plain_count(spark, monkeypatch, kind, longest, least, top):
    if kind != "one":
        monkeypatch.setattr(co, "RANGE", 500)
        monkeypatch.setattr(co, "RANGES", {"hashes": 4}.get(kind, 512))
        monkeypatch.setattr(co, "TOKENS", 300)
    rows = rows_of(longest + least, 300)
    docs = spark.createDataFrame([(i, t, x, "p", 1, 2, "a", "b") for i, (x, t) in enumerate(rows)], DOC).repartition(4)
    got = sorted(tuple(r) for r in co.collocations(docs, least, longest, 50, top).collect())
    assert got == plain(rows, least, longest, 50, top) and len(got) > 10


def test_automata_union_and_ranges():
    rng = random.Random(3)
    streams = [[rng.choice([b"a", b"b", b"c", b"dd", b"."]) for _ in range(400)] for _ in range(5)]
    joined = [w for s in streams for w in [*s, b"."]]
    whole = {p: n for ps, ns in co.Counts.of(joined, 3).phrases() for p, n in zip(ps, ns.tolist(), strict=True)}
    for where in (co.Ranges([], 1), co.Ranges([b"en\ta b", b"en\tb ", b"en\tb dd"], 1), co.Ranges([b"en\tb "], 3)):
        homes = {}
        for s in streams:
            for home, part in where.cut(b"en", co.Counts.of(s, 3)):
                homes.setdefault(home, []).append(co.Counts.load(part.dump()))
        got = {}
        for home, parts in homes.items():
            for ps, ns in co.Counts.union(parts).phrases():
                for p, n in zip(ps, ns.tolist(), strict=True):
                    if n:
                        assert p not in got and where.of(b"en", *p.split(b" ")[:2]) == home
                        got[p] = n
        assert got == whole


def test_products_beyond_64_bits():
    big = co.Counts([b"a", b"b"], [(np.zeros(2, np.int64), np.arange(2), np.array([5 * 10**12, 5 * 10**12])), (np.array([0]), np.array([1]), np.array([4 * 10**12]))])
    a, x = 4 * 10**12, 5 * 10**12
    assert {p: int(n) for ps, ns in co.Counts.load(big.dump()).phrases() for p, n in zip(ps, ns, strict=True)} == {b"a": x, b"b": x, b"a b": a}
    assert 1_000_000 * a * a // (x * x) == 640_000


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], DOC)).collect() == []
