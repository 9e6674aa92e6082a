"""Four lenses on one detection map of a text, for texts, paragraphs and pages.

bounds (thousandths): constraints named, named before capabilities, boundaries kept.
tilt, structure and conduct (tenths of 0 to 100): deductions for tilt, states, framing and
density; ten dimensions by weight; five lenses of talk between people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Tilt tags that count as structural drift; dimensions of structure as (tags or measure, points lost each) and their weights in tenths; lenses of conduct likewise.
DRIFT = ("T2", "T4", "T5", "T9", "T10")
STRUCTURE = {"certainty": (("T2", "T5"), 25, 10), "authority": (("T10",), 35, 8), "scope": (("T9", "T4"), 25, 10), "accountability": (("T3",), 40, 10), "emotion": (("T7",), 30, 7), "social": (("T8",), 30, 7)}
CONDUCT = {"respect": (("T10", "T3"), 20), "honesty": (("T2", "T5", "T4"), 18), "regulation": (("T1", "T7", "T8"), 15)}


def detected(texts: DataFrame, m: dict[str, list[str]], tags: dict[str, list[str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words, constraints, early, hedges, reassurances, tags, states, density): what all lenses look at. density: terms of tilt a hundred words, in tenths."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    own = texts.select(F.col(id), low.alias("t"))
    t = F.col("t")
    words = F.greatest(T.word_count(t), F.lit(1))
    has = {k: T.has_any(t, terms) for k, terms in m.items()}
    c = has["constraint"]
    met = c.cast("int") + (has["capability"] & ~c).cast("int") + (has["hedge"] | has["blend"]).cast("int") + (has["calm"] | has["reassure"]).cast("int")
    points = lambda sure, some: F.when(sure, 2).when(some, 1).otherwise(0)
    states = F.array(points(has["defer"] & ~c, has["defer"]), points(has["collapse"] & F.contains(t, F.lit("and")) & F.contains(t, F.lit("that")), has["collapse"]), points(met == 4, met == 3))
    terms = sum((T.hits(t, own) for own in tags.values()), F.lit(0))
    return own.select(id, words.alias("words"), T.hits(t, m["constraint"]).alias("constraints"), (has["capability"] & ~c).alias("early"), T.hits(t, m["hedge"]).alias("hedges"), T.hits(t, m["reassure"]).alias("reassurances"), F.array_compact(F.array(*(F.when(T.has_any(t, own), k) for k, own in tags.items()))).alias("tags"), states.alias("states"), F.floor(terms * 1000 / words).cast("int").alias("density"))


def _of(names: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect("tags", F.array(*map(F.lit, names))))


def scores(detections: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, words, bounds, tilt, structure, conduct)."""
    active = F.size(F.filter("states", lambda s: s > 0))
    held = lambda x: F.greatest(F.lit(0), F.least(F.lit(1000), x))
    whole = lambda x: F.floor(x).cast("int")
    bounds = whole((F.when(F.col("constraints") >= 1, 1000).otherwise(0) + F.when(F.col("early"), 0).otherwise(1000) + 1000 - F.least(_of(DRIFT) * 150 + active * 250, F.lit(1000))) / 3 + 0.5)
    tilt = held(1000 - F.size("tags") * 50 - F.aggregate("states", F.lit(0), lambda a, s: a + s * 50) - F.col("hedges") * 20 - F.col("reassurances") * 15 - F.greatest(F.col("density") - 50, F.lit(0)) * 2)
    # A hedge costs 30 points for each fifty words, 30 at most for texts below fifty.
    dims = [(F.least(F.lit(1000), F.col("constraints") * 250), 15), (held(1000 - whole(F.col("hedges") * 300 * 50 / F.greatest(F.col("words"), F.lit(50)))), 10), (held(1000 - F.size("tags") * 120), 12), (held(1000 - active * 250), 15)]
    dims += [(held(1000 - _of(own) * less * 10), w) for own, less, w in STRUCTURE.values()]
    structure = whole(sum((d * w for d, w in dims), F.lit(0)) / sum(w for _, w in dims) + 0.5)
    lenses = [held(1000 - F.col("hedges") * 80 - _of(("T6",)) * 150), held(1000 - active * 200), *(held(1000 - _of(own) * less * 10) for own, less in CONDUCT.values())]
    conduct = whole(sum(lenses, F.lit(0)) / len(lenses) + 0.5)
    return detections.select(id, "words", bounds.alias("bounds"), tilt.cast("int").alias("tilt"), structure.alias("structure"), conduct.alias("conduct"))


def paragraph_scores(texts: DataFrame, m: dict[str, list[str]], tags: dict[str, list[str]], between: str = r"\n\s*\n", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, nth, words and the lenses) of each paragraph of more than 20 characters."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), between), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: F.length(p) > 20)
    far = texts.select(F.col(id), F.posexplode(parts).alias("nth", "p")).select(F.struct(id, "nth").alias("k"), "p")
    return scores(detected(far, m, tags, "k", "p"), "k").select(F.col("k")[id].alias(id), F.col("k.nth").alias("nth"), "words", "bounds", "tilt", "structure", "conduct")


def page_scores(paragraphs: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, paragraphs, words and the lenses): means by words, rounded."""
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("words")) / F.greatest(F.sum("words"), F.lit(1)) + 0.5).cast("int").alias(c)
    return paragraphs.groupBy(id).agg(F.count("*").alias("paragraphs"), F.sum("words").alias("words"), *(mean(c) for c in ("bounds", "tilt", "structure", "conduct")))


def issues(detections: DataFrame, findings: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, issues): states that hold and tilt tags, or findings of severity high or medium, whichever are more."""
    n = findings.where(F.col("severity").isin("high", "medium")).groupBy(id).agg(F.count("*").cast("int").alias("_n"))
    own = detections.select(id, (F.size(F.filter("states", lambda s: s > 0)) + F.size("tags")).alias("_m"))
    return own.join(n, id, "left").select(id, F.greatest("_m", F.coalesce("_n", F.lit(0))).alias("issues"))


def weighted_total(statements: DataFrame, group: str, weights: dict[str, int]) -> DataFrame:
    """(group, n, the dimensions, total): each dimension's mean over a group's statements, rounded down, and the weighted sum in hundredths of the weights."""
    means = [F.floor(F.sum(d) / F.count("*")).cast("long").alias(d) for d in weights]
    got = statements.groupBy(group).agg(F.count("*").alias("n"), *means)
    return got.withColumn("total", F.floor(sum((F.col(d) * w for d, w in weights.items()), F.lit(0)) / 100).cast("long"))


def merged_signals(counts: DataFrame, detections: DataFrame, promoted: dict[str, str], id: str = "doc_id") -> DataFrame:
    """(id, signal, n): a text's signal counts, where each tilt tag of ``promoted`` makes its signal count 1 at least."""
    more = detections.select(id, F.explode("tags").alias("_t")).where(F.col("_t").isin(*promoted))
    named = more.select(id, F.try_element_at(F.create_map(*(F.lit(x) for kv in promoted.items() for x in kv)), F.col("_t")).alias("signal"), F.lit(1).alias("n"))
    return counts.select(id, "signal", "n").unionByName(named).groupBy(id, "signal").agg(F.max("n").alias("n"))


