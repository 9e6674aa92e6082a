"""Spans of many patterns in one pass equal those of each pattern by itself."""

import random
import re

from plainspoke.operators.patterns import Patterns, needed


def test_needed_literals():
    for pattern, want in {
        "only|none": {"only", "none"}, "the [a-z]+ then": {" then"}, "(?:ab|cd)+e?": {"ab", "cd"}, "x*": None, "a?b": {"b"}, "[ab]c": {"ac", "bc"}, "(?i)abc": None, r"\bwhat (?:is|was)\b": {"what "}, "a{2,}bc": {"bc"}, "a|": None, "": None, "(foo(?=bar)|x)": {"foo", "x"}, "(?!no)yes": {"yes"},
    }.items():
        got = needed(pattern)
        assert got == (want if want is None else frozenset(want)), (pattern, got)


def made(rng, depth=2):
    kind = rng.randrange(7 if depth else 2)
    if kind < 2:
        return "".join(rng.choice("abc ") for _ in range(rng.randint(1, 3)))
    own = made(rng, depth - 1)
    return [f"(?:{own}|{made(rng, depth - 1)})", f"(?:{own}){rng.choice(['*', '+', '?', '{2}', '{1,2}'])}", own + rng.choice(["[ab]", "[^c]", ".", r"\b", r"\w"]) + made(rng, depth - 1), f"({own})", f"(?={own}){made(rng, depth - 1)}"][kind - 2]


def test_random_patterns():
    rng = random.Random(8)
    for _ in range(60):
        patterns = [made(rng) for _ in range(rng.randint(1, 12))]
        own = Patterns(patterns)
        for _ in range(12):
            text = "".join(rng.choice("aabbc \n") for _ in range(rng.randint(0, 60)))
            want = sorted((m.start(), m.end(), i) for i, p in enumerate(patterns) for m in re.finditer(p, text) if m.end() > m.start())
            assert sorted(own.spans(text)) == want, (patterns, text)
