"""Spans of markers and signals in texts: found over Arrow batches, resolved by JVM-side folds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .patterns import Patterns

#: A signal is (name, pattern over lowered text, priority).
Signals = list[tuple[str, str, int]]
_SPAN = "array<struct<start:int,end:int,signal:string,priority:int>>"
#: Words from which a message is long, matches from which a signal asks for clarification, repeated pairs that count as repetition.
BLOAT, UNCLEAR, ECHOES = 180, 2, 2


def spans_of(text: str | None, signals: Signals, own: Patterns) -> list[dict]:
    """Every non-empty match of every signal in a lowered text, in order of start, end and signal. Offsets are code points, end exclusive."""
    return [{"start": a, "end": b, "signal": signals[i][0], "priority": signals[i][2]} for a, b, i in sorted(own.spans((text or "").lower()))]


def found(text: Column, signals: Signals) -> Column:
    """Array of (start, end, signal, priority) of a text column: one pass tells which patterns run."""

    @F.pandas_udf(_SPAN)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Patterns([p for _, p, _ in signals])
        for texts in batches:
            yield pd.Series([spans_of(t if isinstance(t, str) else None, signals, own) for t in texts])

    return look(text)


def signal_spans(texts: DataFrame, signals: Signals, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, signal, priority) of every match, before overlaps are resolved."""
    return texts.select(F.col(id), F.inline(found(F.col(text), signals)))


def marker_signals(terms: dict[str, list[str]], priority: dict[str, int]) -> Signals:
    """Literal markers as signals: of a category's markers the longest that fits is taken."""
    return [(c, "|".join(re.escape(t) for t in sorted(own, key=len, reverse=True)), priority.get(c, 0)) for c, own in terms.items()]


def register_udtf(spark: SparkSession, signals: Signals, name: str = "signal_spans") -> None:
    """Makes ``SELECT * FROM signal_spans(text)`` known to SQL: an Arrow table function with the spans of one text."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="start: int, end: int, signal: string, priority: int", useArrow=True)
    class Spans:
        def __init__(self) -> None:
            self.own = Patterns([p for _, p, _ in signals])

        def eval(self, text: str) -> Iterator[tuple]:
            for s in spans_of(text, signals, self.own):
                yield s["start"], s["end"], s["signal"], s["priority"]

    spark.udtf.register(name, Spans)


def register_lexicon_sql(spark: SparkSession, terms: dict[str, list[str]]) -> list[str]:
    """SQL functions ``has_<category>(text)`` and ``hits_<category>(text)`` for each category of a lexicon; their names."""
    names = []
    for c, own in terms.items():
        quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in own)
        for kind, body in (("has", f"exists(array({quoted}), x -> contains(lower(t), x))"), ("hits", f"size(filter(array({quoted}), x -> contains(lower(t), x)))")):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {kind}_{c}(t STRING) RETURNS {'BOOLEAN' if kind == 'has' else 'INT'} RETURN {body}")
            names.append(f"{kind}_{c}")
    return names


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (b["end"] <= a["start"])


def resolved(spans: Column) -> Column:
    """Spans kept in order of start, priority, length and signal: one that overlaps kept ones is dropped unless its priority is above all of theirs; then it takes their place."""
    key = lambda s: F.struct(s["start"].alias("a"), (-s["priority"]).alias("b"), (s["start"] - s["end"]).alias("c"), s["signal"].alias("d"), s["end"].alias("end"), s["priority"].alias("priority"))
    back = lambda s: F.struct(s["a"].alias("start"), s["end"].alias("end"), s["d"].alias("signal"), s["priority"].alias("priority"))
    order = F.transform(F.array_sort(F.transform(spans, key)), back)

    def step(kept: Column, x: Column) -> Column:
        hit = F.filter(kept, lambda k: ~_apart(k, x))
        wins = F.forall(hit, lambda k: k["priority"] < x["priority"])
        return F.when(wins, F.array_append(F.filter(kept, lambda k: _apart(k, x)), x)).otherwise(kept)

    return F.array_sort(F.aggregate(order, F.expr(f"cast(array() as {_SPAN})"), step))


def merged(spans: Column, most: int = 200) -> Column:
    """Highlights in order of start: one that overlaps a kept one meets the first such only; the higher priority stays, of equal ones the longer. ``most`` at most."""
    order = F.array_sort(spans)

    def step(kept: Column, x: Column) -> Column:
        first = F.get(F.filter(F.transform(kept, lambda k, i: F.when(~_apart(k, x), i)), lambda i: i.isNotNull()), 0)
        met = F.get(kept, first)
        wins = (x["priority"] > met["priority"]) | ((x["priority"] == met["priority"]) & (x["end"] - x["start"] > met["end"] - met["start"]))
        return F.when(first.isNull(), F.array_append(kept, x)).when(wins, F.transform(kept, lambda k, i: F.when(i == first, x).otherwise(k))).otherwise(kept)

    return F.slice(F.aggregate(order, F.expr(f"cast(array() as {_SPAN})"), step), 1, most)


def heuristics(texts: DataFrame, hedge: str, condition: str, constraint: str, action: str, objective: str, commitment: str, bound: str, contrast: str, settled: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, signals): what a message lacks or does too much, by patterns over its lowered form: long, unclear (two hedges or conditions), without bounds, action or objective, committed without a date, contrasts left open, pairs of words repeated."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    n = lambda p: F.regexp_count(low, F.lit(p))
    has = lambda p: F.rlike(low, F.lit(p))
    tests = {
        "TOKEN_BLOAT": T.word_count(low) >= BLOAT, "CLARIFICATION_TRIGGER": (n(hedge) >= UNCLEAR) | (n(condition) >= UNCLEAR), "BOUNDARY_MISSING": ~has(constraint), "ACTION_MISSING": ~has(action), "OBJECTIVE_MISSING": ~has(objective),
        "COMMITMENT_UNBOUNDED": has(commitment) & ~has(bound), "CONTRADICTION_UNRESOLVED": has(contrast) & ~has(settled), "REPETITION_REDUNDANT": _echoes(T.tokens(low)) >= ECHOES,
    }
    return texts.select(F.col(id), F.array_compact(F.array(*(F.when(test, k) for k, test in tests.items()))).alias("signals"))


def _echoes(tokens: Column) -> Column:
    """Places where a pair of words equals the pair one word before: three equal words in a row."""
    shifted = lambda k, d: F.slice(k, d + 1, F.greatest(F.size(k) - d, F.lit(0)))
    twice = lambda k: F.zip_with(k, shifted(k, 1), lambda a, b: F.coalesce(a == b, F.lit(False)))
    thrice = lambda e: F.zip_with(e, shifted(e, 1), lambda a, b: a & F.coalesce(b, F.lit(False)))
    return T.let(tokens, lambda k: F.size(F.filter(T.let(twice(k), thrice), lambda x: x)))
