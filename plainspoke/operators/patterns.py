"""Many patterns over a text in one pass: an automaton of the literals that patterns need decides which of them run.

From a pattern's syntax tree comes a set of literals of which every match holds one, or
nothing if there is no such set. The literals of all patterns make one Aho-Corasick
automaton, and a pattern runs only over texts in which one of its literals occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C  # noqa: N812
from re import _parser

import ahocorasick

#: Literals of a pattern at most; characters of a class that are spelled out.
MOST, SPELLED = 64, 4


def needed(pattern: str) -> frozenset[str] | None:
    """Literals of which every match holds at least one; None without any."""
    tree = _parser.parse(pattern)
    return None if tree.state.flags & re.IGNORECASE else _of(list(tree))


def _of(items: list) -> frozenset[str] | None:
    """The cover of a sequence whose shortest literal is longest."""
    covers, run = [], [""]
    for op, arg in items:
        step = _spelled(op, arg)
        if step and len(run) * len(step) <= MOST:
            run = [a + b for a in run for b in step]
            continue
        covers.append(frozenset(run))
        run = step or [""]
        covers.append(_inner(op, arg))
    covers.append(frozenset(run))
    own = [c for c in covers if c and "" not in c and len(c) <= MOST]
    return max(own, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _spelled(op: object, arg: object) -> list[str] | None:
    """All texts that an item of one character matches, if they are few."""
    if op is C.LITERAL:
        return [chr(arg)]
    if op is C.IN and len(arg) <= SPELLED and all(o is C.LITERAL for o, _ in arg):
        return [chr(a) for _, a in arg]
    return None


def _inner(op: object, arg: object) -> frozenset[str] | None:
    if op is C.SUBPATTERN:
        return None if arg[1] & re.IGNORECASE else _of(list(arg[-1]))
    if op is C.BRANCH:
        each = [_of(list(branch)) for branch in arg[1]]
        return frozenset().union(*each) if all(each) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        return _of(list(arg[2])) if arg[0] else None
    if op is C.ATOMIC_GROUP:
        return _of(list(arg))
    return None


class Patterns:
    """Patterns with one automaton of their literals."""

    def __init__(self, patterns: list[str]):
        self.compiled = [re.compile(p) for p in patterns]
        covers = [needed(p) for p in patterns]
        self.always = [i for i, c in enumerate(covers) if not c]
        of: dict[str, list[int]] = {}
        for i, cover in enumerate(covers):
            for literal in cover or ():
                of.setdefault(literal, []).append(i)
        self.automaton = None
        if of:
            self.automaton = ahocorasick.Automaton()
            for literal, own in of.items():
                self.automaton.add_word(literal, tuple(own))
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Patterns that may match, in order."""
        met = set(self.always)
        if self.automaton and text:
            for own in {own for _, own in self.automaton.iter(text)}:
                met.update(own)
        return sorted(met)

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, pattern) of every match of every pattern that isn't empty."""
        for i in self.candidates(text):
            for m in self.compiled[i].finditer(text):
                if m.end() > m.start():
                    yield m.start(), m.end(), i
