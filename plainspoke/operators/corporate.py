"""A ten-dimensional score of public communication, with findings.

Dimensions are whole ten-thousandths: specificity (sentences with figures),
commitment against aspiration, sentence structure, hedges, tilt, claims without
figures, objective (what, for whom, within what), accountability, repetition, and
generic against own vocabulary. The word lists are given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of the dimensions in hundredths, lower ends of the labels in thousandths, points for 0 to 3 anchors.
WEIGHTS = {"specificity": 15, "commitment": 12, "structure": 10, "hedging": 10, "tilt": 12, "claims": 12, "objective": 8, "accountability": 8, "repetition": 8, "vocabulary": 5}
LABELS = [(200, "STRUCTURAL FAILURE"), (350, "POOR STRUCTURE"), (500, "STRUCTURALLY WEAK"), (650, "MIXED SIGNALS"), (800, "MOSTLY CLEAR")]
ANCHORS = (0.15, 0.45, 0.75, 1.0)
#: A dimension below the first is a finding, of the first severity below the second and of the last from there on.
FINDINGS = [("specificity", 4000, 2000, "high", "medium"), ("commitment", 5000, 3500, "high", "medium"), ("structure", 5000, 0, "medium", "medium"), ("hedging", 6000, 0, "medium", "medium"), ("tilt", 8000, 6000, "high", "medium"), ("claims", 5000, 0, "high", "high"), ("objective", 7500, 4500, "high", "medium"), ("accountability", 4000, 0, "medium", "medium"), ("repetition", 6000, 0, "low", "low"), ("vocabulary", 4000, 2500, "medium", "low")]
#: Sentences of figures from here on pass.
SPECIFIC, SHORTEST = 7000, 50
_NUMBER = r"(^|[^A-Za-z0-9_])[0-9][0-9,.]*"


def dimensions(texts: DataFrame, m: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chars, the ten dimensions) of every text.

    m: commit (words), aspire, hedge, filler, generic, claim, what, whom,
    constraint (phrases), account (category to phrases), tilt (tag to (phrases,
    hundredths)), common (words that aren't own vocabulary).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = texts.select(F.col(id), t.alias("t"), F.lower(t).alias("low"), F.filter(T.sentences(t), lambda s: F.length(s) > 5).alias("s"))
    base = base.select(id, "t", "low", "s", T.tokens(F.col("low")).alias("k"), F.transform("s", lambda x: T.word_count(x)).alias("n"), F.transform("s", lambda x: F.array_distinct(T.tokens(F.lower(x)))).alias("w"), F.transform("s", lambda x: F.rlike(x, F.lit("[0-9]"))).alias("f"), F.transform("s", lambda x: T.has_any(F.lower(x), m["claim"])).alias("c"))
    low, n, words = F.col("low"), F.size("s").cast("double"), F.size("k").cast("double")
    one = F.lit(1.0)
    at_least_one = F.greatest(n, one)
    count = lambda a, test: F.size(F.filter(a, test)).cast("double")
    numbers = F.regexp_count("t", F.lit(_NUMBER)).cast("double")
    figures = count("f", lambda x: x)
    commit, aspire = count("k", lambda x: x.isin(m["commit"])), T.hits(low, m["aspire"]).cast("double")
    spread = T.let(F.transform("n", lambda x: x.cast("double")), T.spread)
    heavy = count("s", lambda x: (T.occurrences(x, " and ") >= 3) | (T.occurrences(x, ",") >= 5))
    structure = count("n", lambda x: x.between(10, 25)) / at_least_one * 0.5 + F.when(spread < 2, 0.6).when(spread > 15, 0.5).otherwise(1.0) * 0.3 + (one - count("n", lambda x: x > 35) / at_least_one) * 0.2 - F.least(heavy / at_least_one * 0.3, F.lit(0.25))
    empty = F.size(F.filter(F.zip_with("c", "f", lambda c, f: c & ~f), lambda x: x)).cast("double")
    anchors = sum((T.has_any(low, m[x]).cast("int") for x in ("what", "whom", "constraint")), F.lit(0))
    own = {c: T.hits(low, terms) for c, terms in m["account"].items()}
    held, kinds = sum(own.values(), F.lit(0)), sum(((x > 0).cast("int") for x in own.values()), F.lit(0))
    alike = lambda x, y: F.size(F.array_intersect(x, y)) * 100 > 35 * F.size(F.array_union(x, y))
    size = F.size("s")
    near = sum((F.size(F.filter(F.zip_with(F.slice("w", 1, F.greatest(size - d, F.lit(0))), F.slice("w", d + 1, F.greatest(size - d, F.lit(0))), alike), lambda x: x)) for d in (1, 2, 3)), F.lit(0))
    pairs = sum((F.greatest(size - d, F.lit(0)) for d in (1, 2, 3)), F.lit(0))
    wording = F.size(F.array_distinct(F.filter("k", lambda x: F.rlike(x, F.lit("^[a-z]{6,}$")) & ~x.isin(m["common"])))).cast("double")
    tilt = sum((F.when(T.has_any(low, terms), w).otherwise(0) for terms, w in m["tilt"].values()), F.lit(0))
    none = lambda test, value, other: F.when(test, value).otherwise(other)
    raw = {
        "specificity": none(n == 0, 0.0, F.least(figures / at_least_one + F.least(numbers / at_least_one * 0.1, F.lit(0.15)), one)),
        "commitment": F.when(words == 0, 0.0).when(commit + aspire == 0, 0.4).otherwise(commit / F.greatest(commit + aspire, one) * 0.7 + 0.3),
        "structure": none(n == 0, 0.0, structure),
        "hedging": none(words == 0, 1.0, one - F.least(T.hits(low, m["hedge"]) / F.greatest(words, one) * 15, F.lit(0.7))),
        "tilt": one - tilt / 100,
        "claims": F.when(n == 0, 0.0).when(empty + figures == 0, 0.6).otherwise(one - empty / F.greatest(empty + figures, one)),
        "objective": F.get(F.array(*map(F.lit, ANCHORS)), anchors),
        "accountability": none(held == 0, 0.15, F.least(kinds / 4, one) * 0.6 + F.least(held / 6, one) * 0.4),
        "repetition": none(n < 2, 0.7, one - F.least(T.hits(low, m["filler"]) * 0.08, F.lit(0.3)) - F.least(near / F.greatest(pairs, F.lit(1)) * 0.8, F.lit(0.5))),
        "vocabulary": none(words == 0, 0.0, F.lit(0.7) - F.least(T.hits(low, m["generic"]) * 0.06, F.lit(0.6)) + F.least(wording / 40, F.lit(0.2))),
    }
    return base.select(id, F.length(F.trim("t")).alias("chars"), *(F.floor(F.greatest(F.lit(0.0), F.least(one, x)) * 10000 + 0.5).cast("int").alias(k) for k, x in raw.items()))


def scored(dims: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, the dimensions, score, label): the weighted sum in thousandths; INSUFFICIENT and 0 below 50 characters."""
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    short = F.col("chars") < SHORTEST
    got = dims.withColumn("score", F.when(short, 0).otherwise(F.floor((total + 500) / 1000)).cast("int"))
    return got.select(id, *WEIGHTS, "score", F.when(short, "INSUFFICIENT").otherwise(T.banded(F.col("score"), LABELS, "STRUCTURALLY SOUND")).alias("label"))


def findings(dims: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, place, dimension, severity, value) of each finding of a text that is long enough, in the order of the dimensions; enough figures are a pass."""

    def one(i: int, name: str, below: int, worse: int, bad: str, fair: str) -> Column:
        value = F.col(name)
        severity = F.when(value < min(worse, below), bad).when(value < below, fair)
        if name == "specificity":
            severity = severity.when(value >= SPECIFIC, "pass")
        return F.when(severity.isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(name).alias("dimension"), severity.alias("severity"), value.alias("value")))

    rows = F.array_compact(F.array(*(one(i, *rule) for i, rule in enumerate(FINDINGS, 1))))
    return dims.where(F.col("chars") >= SHORTEST).select(id, F.inline(rows))
