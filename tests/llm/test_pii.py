"""Patterns against the plain regular expressions; the field on repeats."""

import random
import re

import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import pii  # noqa: E402

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "_", "%", "-", "+1", " ", "1", "22", "4539578763621486", "255", "256", "0300", "(678)", "555-5272", "x@y.z", "d@e", "é", "\n", "1.2.3.4", "+"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 100_000, "+1" * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def test_luhn():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_repeats_agree():
    rng = random.Random(4)
    graphs = []
    for i in range(300):
        phone = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        text = f"write to ab{i}@mail.example.com or call {phone} about item {rng.randrange(99)} and number {rng.randrange(10**15, 10**16)}"
        graphs.append((g := pii.Nodes(text), g.labels(pii.base_spans(text))))
    field = pii.SkipChain()
    field.fit(graphs)
    text = "call +1 (678) 555-5272 now"
    base, every = pii.spans_of([text], field)[0]
    assert base == every == plain(text)
    g = pii.Nodes("call 5555272 or +1 (678) 555-5272")
    assert g.skip == [(0, 3)]
    alone = pii.SkipChain()
    alone.w, alone.t, alone.s = field.w, field.t, 0.0
    linked = pii.SkipChain()
    linked.w, linked.t, linked.s = field.w, field.t, 4.0
    assert linked.marginals([g])[0][3] > alone.marginals([g])[0][3]


def test_empty():
    assert pii.spans_of([None, "", "word"], None) == [([], [])] * 3
