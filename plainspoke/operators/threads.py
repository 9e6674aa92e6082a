"""Threads in order: abstraction and drift, transforms, salience, dictionaries, prompts, continuations, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T

#: What each kind of objective allows, and its range of abstraction levels.
OBJECTIVES = {
    "RESOLVE": (["DECLARE", "ADVANCE", "CLOSE", "CONSOLIDATE", "REPAIR"], 0, 2),
    "EXPLORE": (["DECLARE", "ADVANCE", "OPEN_BRANCH", "PARK", "CONSOLIDATE", "REPAIR"], 0, 4),
    "STRUCTURE": (["DECLARE", "ADVANCE", "CLOSE", "CONSOLIDATE", "REPAIR"], 1, 3),
    "EXECUTE": (["DECLARE", "ADVANCE", "CLOSE", "REPAIR"], 0, 1),
    "DIAGNOSE": (["DECLARE", "ADVANCE", "OPEN_BRANCH", "CLOSE", "CONSOLIDATE", "REPAIR"], 0, 3),
    "ALIGN": (["DECLARE", "ADVANCE", "OPEN_BRANCH", "PARK", "CLOSE", "CONSOLIDATE", "REPAIR"], 1, 4),
}


def _in_order() -> WindowSpec:
    return W.partitionBy("conv_id").orderBy("turn")


def _low(text: str = "text") -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def best(low: Column, terms: dict[str, list[str]]) -> Column:
    """Struct (n, o, name) of the entry with most distinct terms, the first declared on ties."""
    return F.array_max(F.array(*(F.struct(T.hits(low, own).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("name")) for i, (k, own) in enumerate(terms.items()))))


def abstraction(turns: DataFrame, levels: list[list[str]], allowed: int = 1, bounds: tuple[int, int] | None = None) -> DataFrame:
    """(conv_id, turn, level, delta, direction, passed): each turn's level (0 without a term), its step from the turn before, and whether the step is within ``allowed`` and the level within ``bounds``."""
    got = turns.select("conv_id", "turn", best(_low(), {str(i): own for i, own in enumerate(levels)}).alias("b")).select("conv_id", "turn", F.when(F.col("b.n") > 0, F.col("b.name").cast("int")).otherwise(0).alias("level"))
    got = got.withColumn("delta", F.coalesce(F.col("level") - F.lag("level").over(_in_order()), F.lit(0)))
    ok = F.abs("delta") <= allowed
    if bounds:
        ok = ok & F.col("level").between(*bounds)
    return got.select("conv_id", "turn", "level", "delta", F.when(F.col("delta") > 0, "UP").when(F.col("delta") < 0, "DOWN").otherwise("STABLE").alias("direction"), ok.alias("passed"))


def transforms(turns: DataFrame, terms: dict[str, list[str]], objective: str) -> DataFrame:
    """(conv_id, turn, detected, transform, legal): the transforms of which a term occurs, the one with most (ADVANCE without any), and whether the objective allows it."""
    low = _low()
    got = turns.select("conv_id", "turn", F.array_compact(F.array(*(F.when(T.has_any(low, own), k) for k, own in terms.items()))).alias("detected"), best(low, terms).alias("b"))
    got = got.withColumn("transform", F.when(F.col("b.n") > 0, F.col("b.name")).otherwise("ADVANCE"))
    return got.select("conv_id", "turn", "detected", "transform", F.col("transform").isin(OBJECTIVES[objective][0]).alias("legal"))


def salience(turns: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(conv_id, turn, salience, reweighted): the operators of which a term occurs, in order, and whether there are any."""
    low = _low()
    return turns.select("conv_id", "turn", F.array_compact(F.array(*(F.when(T.has_any(low, own), k) for k, own in terms.items()))).alias("salience")).withColumn("reweighted", F.size("salience") > 0)


def state_deltas(turns: DataFrame, added: list[str], resolved: list[str]) -> DataFrame:
    """(conv_id, turn, open, done, delta, state, streak): open and resolved markers so far; delta is what was resolved since the turn before less what was added. PROGRESS above 0, STAGNANT at 0, EXPANDING below; streak counts turns without progress in a row."""
    low = _low()
    w = _in_order().rowsBetween(W.unboundedPreceding, 0)
    n = turns.select("conv_id", "turn", T.hits(low, added).alias("a"), T.hits(low, resolved).alias("r"))
    got = n.select("conv_id", "turn", F.sum("a").over(w).cast("int").alias("open"), F.sum("r").over(w).cast("int").alias("done"), (F.col("r") - F.col("a")).alias("delta"))
    got = got.withColumn("state", F.when(F.col("delta") > 0, "PROGRESS").when(F.col("delta") == 0, "STAGNANT").otherwise("EXPANDING"))
    stuck = F.col("delta") <= 0
    got = got.withColumn("_island", F.count_if(~stuck).over(w))
    return got.withColumn("streak", F.when(stuck, F.count_if(stuck).over(W.partitionBy("conv_id", "_island").orderBy("turn"))).otherwise(0)).drop("_island")


def drift(turns: DataFrame, levels: list[list[str]], terms: dict[str, list[str]], added: list[str], resolved: list[str], objective: str, threshold: int = 3) -> DataFrame:
    """(conv_id, turn, violations, verdict): an illegal transform, an abstraction step or level out of bounds (each counts), stagnation for ``threshold`` turns, and a branch that the objective doesn't allow; CLEAN, MINOR (1), MODERATE (to 3) or SEVERE."""
    allowed, low, high = OBJECTIVES[objective]
    t, a, s = transforms(turns, terms, objective), abstraction(turns, levels), state_deltas(turns, added, resolved)
    met = t.join(a.withColumnRenamed("delta", "delta_level"), ["conv_id", "turn"]).join(s, ["conv_id", "turn"])
    tests = {
        "ILLEGAL_TRANSFORM": ~F.col("legal"), "ABSTRACTION_JUMP": F.abs("delta_level") > 1, "ABSTRACTION_RANGE": ~F.col("level").between(low, high), "STATE_STAGNATION": F.col("streak") >= threshold,
        "UNDECLARED_BRANCH": F.array_contains("detected", "OPEN_BRANCH") & F.lit("OPEN_BRANCH" not in allowed),
    }
    got = met.select("conv_id", "turn", F.array_compact(F.array(*(F.when(test, k) for k, test in tests.items()))).alias("violations"))
    n = F.size("violations")
    return got.withColumn("verdict", F.when(n == 0, "CLEAN").when(n == 1, "MINOR_DRIFT").when(n <= 3, "MODERATE_DRIFT").otherwise("SEVERE_DRIFT"))


def dictionary_stats(dictionary: DataFrame, turns: DataFrame, fillers: list[str]) -> DataFrame:
    """One row: messages, distinct and repeated sequences, pointers to each on average (hundredths), and the share of characters that fillers take (tenths of a hundredth)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = T.words(t)
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, w: s + F.length(w))
    m = turns.select(chars(words).alias("all"), chars(F.filter(words, lambda w: F.lower(w).isin(fillers))).alias("filler")).agg(F.count("*").alias("messages"), F.sum("all").alias("a"), F.sum("filler").alias("f"))
    d = dictionary.agg(F.count("*").alias("sequences"), F.count_if(F.col("frequency") > 1).alias("repeated"), F.sum("frequency").alias("p"))
    both = m.crossJoin(d)  # one row each
    whole = lambda x: F.floor(x + 0.5).cast("long")
    return both.select("messages", "sequences", "repeated", whole(F.coalesce("p", F.lit(0)) * 100 / F.greatest("sequences", F.lit(1))).alias("pointers_each"), whole(F.coalesce("f", F.lit(0)) * 1000 / F.greatest(F.coalesce("a", F.lit(0)), F.lit(1))).alias("filler_share"))


def searched(turns: DataFrame, term: str, synonyms: DataFrame) -> DataFrame:
    """(conv_id, turn, n) of the turns that hold a word of the term's group: the term, what it points to, and what else points there. synonyms: pointer, canonical, active."""
    active = synonyms.where("active").select("pointer", "canonical")
    canonical = active.where(F.col("pointer") == term).select(F.col("canonical").alias("w"))
    head = canonical.unionByName(active.sparkSession.range(1).select(F.lit(term).alias("w")))
    group = head.unionByName(active.join(head, active.canonical == head.w, "left_semi").select(F.col("pointer").alias("w"))).distinct()
    words = turns.select("conv_id", "turn", F.explode(T.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("w"))
    return words.join(group, "w", "left_semi").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


def last_lines(turns: DataFrame, n: int, most: int) -> DataFrame:
    """(conv_id, lines): each thread's last n turns in order of time, a line each of at most ``most`` characters."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    own = turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    line = F.concat(F.upper("role"), F.lit(": "), F.substring(F.coalesce(F.col("text"), F.lit("")), 1, most))
    return own.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


def prompts(turns: DataFrame, system: str, artifacts: DataFrame, ask: str, n: int = 6, most: int = 300) -> DataFrame:
    """(conv_id, prompt): the system line, the artifacts (key, priority: a bounded retrieval) tier by tier, the last turns, what is asked."""
    tiers = artifacts.groupBy("priority").agg(F.array_join(F.array_sort(F.collect_list(F.col("key").cast("string"))), ", ").alias("k"))
    known = tiers.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "k"))), lambda x: F.concat(F.lit("[P"), x["priority"].cast("string"), F.lit("] "), x["k"])), "\n").alias("known"))
    got = last_lines(turns, n, most).crossJoin(known)  # one row
    return got.select("conv_id", F.concat_ws("\n", F.lit(system), F.when(F.col("known") != "", F.col("known")), "lines", F.lit(f"USER: {ask}")).alias("prompt"))


def continuations(turns: DataFrame, n: int = 8, most: int = 200, window: int = 8000) -> DataFrame:
    """(conv_id, core, recent, user_chars, ai_chars, per_mille): what a new thread needs of an old one: lines that recur, by frequency (of both roles where none recurs), the last turns, each side's characters and the share of the window."""
    lines = turns.select("conv_id", "role", F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("l")).withColumn("key", T.dictionary_key(F.col("l"))).where("key <> ''")
    seq = lines.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.count_distinct("role").alias("r"))
    core = seq.where("n >= 2").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))), lambda x: x["key"]).alias("core"))
    chars = F.coalesce(F.length("text"), F.lit(0))
    side = lambda role, name: F.sum(F.when(F.col("role") == role, chars).otherwise(0)).cast("long").alias(name)
    sums = turns.groupBy("conv_id").agg(side("user", "user_chars"), side("assistant", "ai_chars"), F.floor(F.sum(chars) * 1000 / window).cast("long").alias("per_mille"))
    got = sums.join(last_lines(turns, n, most), "conv_id", "left").join(core, "conv_id", "left")
    return got.select("conv_id", F.coalesce("core", F.array().cast("array<string>")).alias("core"), F.col("lines").alias("recent"), "user_chars", "ai_chars", "per_mille")
