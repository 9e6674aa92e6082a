"""Questions in texts: found, typed, and scored for undertone, traps, necessity and redundancy.

Patterns are given by the caller: each type, signal or trap is a name with the
patterns of which one must match. Scores are whole hundredths or ten-thousandths.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

Patterns = dict[str, list[str]]
#: Upper ends of the bands in hundredths (undertone, necessity) and ten-thousandths (index), and what lowers necessity.
UNDERTONE = [(15, "NEUTRAL"), (35, "LOW_UNDERTONE"), (55, "MODERATE_UNDERTONE"), (75, "HIGH_UNDERTONE")]
NECESSITY = [(25, "PROBE_STRUCTURE"), (45, "POSSIBLY_UNNECESSARY")]
INDEX = [(1000, "GENUINE_INQUIRY"), (2500, "LIGHT_PROBING"), (4500, "STRUCTURED_PROBING"), (6500, "ACTIVE_PROBE")]
LESS = {"ANSWER_IN_CONTEXT": 20, "UNDERTONE_PRESENT": 15, "SELF_DISCLAIMING": 10, "REDUCTION_NOT_CLARIFICATION": 15, "POSITIONING_MOVE": 15}
GENUINE = "clarification_genuine"


def matches_any(t: Column, patterns: list[str]) -> Column:
    return reduce(or_, (F.rlike(t, F.lit(p)) for p in patterns), F.lit(False))


def names_of(t: Column, rules: Patterns) -> Column:
    """The names of which a pattern matches, in the order declared."""
    return F.array_compact(F.array(*(F.when(matches_any(t, own), name) for name, own in rules.items())))


def questions(texts: DataFrame, embedded: list[str], mark: str = "?", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, nth, kind, question): sentences that hold the mark, and clauses between full stops that match a pattern (over lowered text) unless one of the former says the same.

    nth numbers a text's questions by where they begin; explicit ones first on ties.
    Texts without either are dropped before anything is taken apart.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    some = texts.select(F.col(id), t.alias("_t")).where(F.contains("_t", F.lit(mark)) | matches_any(F.lower("_t"), embedded))
    sentence = T.sentences(F.col("_t"))
    bare = lambda s: F.trim(F.rtrim(F.lower(s), F.lit(mark)))
    base = some.select(id, sentence.alias("_s"), F.split("_t", r"\.").alias("_c"))
    explicit = F.filter("_s", lambda s: F.contains(s, F.lit(mark)))
    base = base.withColumn("_e", F.transform(F.filter(explicit, lambda s: F.length(s) > 10), bare))
    found = base.select(id, "_e", F.posexplode("_s").alias("_i", "raw")).select(id, "_i", "raw", F.lit("explicit").alias("kind"), F.lit(None).cast("array<string>").alias("_e"))
    clause = base.select(id, "_e", F.posexplode("_c").alias("_i", "_x"), F.size("_c").alias("_n")).select(id, "_i", F.trim(F.concat("_x", F.when(F.col("_i") < F.col("_n") - 1, ".").otherwise(""))).alias("raw"), F.lit("embedded").alias("kind"), "_e", F.length("_x").alias("_l"))
    # Where a unit begins: the lengths of those before it, with a character between two.
    w = W.partitionBy(id).orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    placed = lambda df, length: df.withColumn("_at", F.coalesce(F.sum(length + 1).over(w), F.lit(0)))
    a = placed(found, F.length("raw")).where(F.contains("raw", F.lit(mark)))
    said = lambda e: F.contains(e, bare(F.col("raw"))) | F.contains(bare(F.col("raw")), e)
    b = placed(clause, F.col("_l")).where((F.col("raw") != "") & matches_any(F.lower("raw"), embedded) & ~F.exists("_e", said))
    both = a.select(id, "_at", "kind", "raw").unionByName(b.select(id, "_at", "kind", "raw"))
    order = W.partitionBy(id).orderBy("_at", F.desc("kind"))
    return both.select(id, (F.row_number().over(order) - 1).alias("nth"), "kind", F.col("raw").alias("question"))


def typed(asked: DataFrame, types: Patterns, question: str = "question") -> DataFrame:
    """``asked`` with types and primary_type: the first that isn't genuine, else genuine, else unclassified."""
    got = asked.withColumn("types", names_of(F.lower(question), types))
    return got.withColumn("primary_type", F.coalesce(F.get(F.filter("types", lambda x: x != GENUINE), 0), F.get("types", 0), F.lit("unclassified")))


def undertone(asked: DataFrame, signals: dict[str, tuple[list[str], int]], question: str = "question") -> DataFrame:
    """``asked`` with undertone (hundredths, 100 at most) and its band: each signal counts once."""
    low = F.lower(question)
    total = sum((F.when(matches_any(low, own), weight).otherwise(0) for own, weight in signals.values()), F.lit(0))
    got = asked.withColumn("undertone", F.least(total, F.lit(100)))
    return got.withColumn("undertone_band", T.banded(F.col("undertone"), UNDERTONE, "PROBE_LIKELY"))


def traps(asked: DataFrame, rules: Patterns, question: str = "question") -> DataFrame:
    """``asked`` with its traps and their severity by number."""
    n = F.size("traps")
    return asked.withColumn("traps", names_of(F.lower(question), rules)).withColumn("severity", F.when(n >= 3, "HIGH").when(n == 2, "MODERATE").when(n == 1, "LOW").otherwise("NONE"))


def necessity(asked: DataFrame, context: str | None = None, question: str = "question") -> DataFrame:
    """``asked`` (typed, with undertone) with flags, necessity and its band: 50 less what each flag takes, 0 at least. context: a column that may answer the question."""
    long = lambda c: F.array_distinct(F.filter(T.tokens(F.coalesce(F.col(c), F.lit(""))), lambda x: F.length(x) >= 4))
    answered = F.lit(False)
    if context:
        both = F.size(F.array_intersect(long(question), long(context)))
        answered = both * 2 > F.size(long(question))
    primary = F.col("primary_type")
    tests = {"ANSWER_IN_CONTEXT": answered, "UNDERTONE_PRESENT": F.col("undertone") > 35, "SELF_DISCLAIMING": primary == "innocence_framed", "REDUCTION_NOT_CLARIFICATION": primary == "reduction_probe", "POSITIONING_MOVE": primary == "anchor_plant"}
    less = sum((F.when(test, LESS[name]).otherwise(0) for name, test in tests.items()), F.lit(0))
    got = asked.withColumn("flags", F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))).withColumn("necessity", F.greatest(F.lit(0), 50 - less))
    return got.withColumn("necessity_band", T.banded(F.col("necessity"), NECESSITY, "LIKELY_NECESSARY"))


def clusters(asked: DataFrame, stopwords: list[str], id: str = "doc_id", question: str = "question") -> DataFrame:
    """(id, n_questions, clusters, redundancy): a question joins the first earlier one that began a cluster and shares more than .30 of their content words, else it begins one. redundancy: half the share of questions in clusters of two or more, in ten-thousandths."""
    words = F.array_distinct(F.filter(T.tokens(F.col(question)), lambda x: ~x.isin(stopwords)))
    own = asked.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("nth", words.alias("w")))).alias("q"))
    alike = lambda a, b: F.size(F.array_intersect(a, b)) * 10 > 3 * F.size(F.array_union(a, b))
    start = F.expr("cast(array() as array<struct<w:array<string>,m:array<int>>>)")

    def step(seeds: Column, x: Column) -> Column:
        near = F.filter(F.transform(seeds, lambda s, i: F.when(alike(s["w"], x["w"]), i)), lambda i: i.isNotNull())
        grown = F.transform(seeds, lambda s, i: F.when(i == F.get(near, 0), F.struct(s["w"].alias("w"), F.array_append(s["m"], x["nth"]).alias("m"))).otherwise(s))
        return F.when(F.size(x["w"]) == 0, seeds).when(F.size(near) > 0, grown).otherwise(F.array_append(seeds, F.struct(x["w"].alias("w"), F.array(x["nth"]).alias("m"))))

    got = own.select(id, F.size("q").alias("n_questions"), F.filter(F.transform(F.aggregate("q", start, step), lambda s: s["m"]), lambda m: F.size(m) > 1).alias("clusters"))
    members = F.aggregate("clusters", F.lit(0), lambda a, m: a + F.size(m))
    return got.withColumn("redundancy", F.least(F.lit(10000), F.floor(members * 5000 / F.col("n_questions") + 0.5)).cast("int"))


def interrogative_index(scored: DataFrame, redundancy: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, n_questions, index, band) in ten-thousandths: .30 of the mean undertone, .25 of the distinct probing types (4 are all), .20 of the share with traps, .15 of what necessity lacks, .10 of redundancy."""
    n = F.count("*")
    probing = F.when(~F.col("primary_type").isin(GENUINE, "unclassified"), F.col("primary_type"))
    got = scored.groupBy(id).agg(n.alias("n_questions"), F.sum("undertone").alias("u"), F.least(F.count_distinct(probing), F.lit(4)).alias("d"), F.count_if(F.size("traps") > 0).alias("t"), F.sum(100 - F.col("necessity")).alias("k"))
    met = got.join(redundancy.select(id, "redundancy"), id, "left")
    total = (F.col("u") * 30 + F.col("t") * 2000 + F.col("k") * 15) / F.col("n_questions") + F.col("d") * 625 + F.coalesce("redundancy", F.lit(0)) / 10
    out = met.select(id, "n_questions", F.least(F.lit(10000), F.floor(total + 0.5)).cast("int").alias("index"))
    return out.withColumn("band", T.banded(F.col("index"), INDEX, "TRAP_ARCHITECTURE"))
