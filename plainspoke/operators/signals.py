"""Signals as data: weighted rules, structure audits, actions, filler ratios, candidate roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: A rule is (name, pattern, weight in hundredths).
Rules = list[tuple[str, str, int]]


def signal_counts(texts: DataFrame, rules: Rules, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, signal, n) of every rule that matches, before overlaps are resolved."""
    low = texts.select(F.col(id).alias(id), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    far = low.select(id, F.posexplode(F.array(*(F.regexp_count("_low", F.lit(p)) for _, p, _ in rules))).alias("_i", "n")).where("n > 0")
    return far.select(id, F.get(F.array(*(F.lit(name) for name, _, _ in rules)), F.col("_i")).alias("signal"), "n")


def best_rule(texts: DataFrame, rules: Rules, block_from: int = 90, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rule, weight, blocked): the heaviest rule that matches, the first on ties; null and 0 if none does."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    own = F.array_max(F.array(*(F.struct(F.when(F.rlike(low, F.lit(p)), w).otherwise(0).alias("w"), F.lit(-i).alias("o"), F.lit(name).alias("rule")) for i, (name, p, w) in enumerate(rules))))
    return texts.select(F.col(id), own.alias("m")).select(id, F.when(F.col("m.w") > 0, F.col("m.rule")).alias("rule"), F.col("m.w").alias("weight"), (F.col("m.w") >= block_from).alias("blocked"))


def structure_audit(texts: DataFrame, hedges: list[str], actions: list[str], deferrals: list[str], vague: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, violations): 100 less .05 a hedge (40 at most), 10 without an action, 12 a deferral (25 at most), 12 for two vague words or more."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    n = {k: T.hits(low, own) for k, own in (("hedge", hedges), ("action", actions), ("defer", deferrals), ("vague", vague))}
    less = F.least(n["hedge"] * 5, F.lit(40)) + F.when(n["action"] == 0, 10).otherwise(0) + F.least(n["defer"] * 12, F.lit(25)) + F.when(n["vague"] >= 2, 12).otherwise(0)
    named = F.array_compact(F.array(F.when(n["hedge"] > 0, "HEDGE"), F.when(n["action"] == 0, "NO_ACTION"), F.when(n["defer"] > 0, "DEFERRAL"), F.when(n["vague"] >= 2, "VAGUE")))
    return texts.select(F.col(id), (F.lit(100) - less).cast("int").alias("score"), named.alias("violations"))


def friction_action(friction: DataFrame, mode: str = "standard") -> DataFrame:
    """EXECUTE, CLARIFY or BLOCK by the friction's band; strict mode blocks one band earlier."""
    block = 55 if mode == "strict" else 75
    return friction.withColumn("action", F.when(F.col("friction") >= block, "BLOCK").when(F.col("friction") >= 30, "CLARIFY").otherwise("EXECUTE"))


def filler_ratio(texts: DataFrame, fillers: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept, priority): share of tokens that aren't fillers in ten-thousandths; P1 from 9200, P3 below 7000, P2 between."""
    k = T.tokens(F.coalesce(F.col(text), F.lit("")))
    base = texts.select(F.col(id), F.size(k).alias("n"), F.size(F.filter(k, lambda x: x.isin(fillers))).alias("f"))
    return base.select(id, F.floor((F.col("n") - F.col("f")) * 10000 / F.greatest("n", F.lit(1))).cast("long").alias("kept")).withColumn("priority", F.when(F.col("kept") >= 9200, "P1").when(F.col("kept") < 7000, "P3").otherwise("P2"))


def rollup_by(scored: DataFrame, key: str, score: str, flag: Column) -> DataFrame:
    return scored.groupBy(key).agg(F.count("*").alias("n"), F.floor(F.sum(score) * 10 / F.count("*")).cast("long").alias("mean_tenths"), F.max(score).alias("best"), F.min(score).alias("worst"), F.count_if(flag).alias("flagged"))


def resolved_owner(rows: DataFrame, owners: DataFrame, fallback: DataFrame) -> DataFrame:
    """(id, owner, how): the owner by key, else by the fallback's key, else null."""
    a = owners.select(F.col("key").alias("_a"), F.col("owner").alias("_o"))
    b = fallback.select(F.col("key").alias("_b"), F.col("owner").alias("_f"))
    met = rows.join(a, F.col("key") == F.col("_a"), "left").join(b, F.col("other") == F.col("_b"), "left")
    return met.select("id", F.coalesce("_o", "_f").alias("owner"), F.when(F.col("_o").isNotNull(), "key").when(F.col("_f").isNotNull(), "fallback").alias("how"))


def full_audit(texts: DataFrame, hedges: dict[str, int], actions: list[str], conflicts: list[tuple[str, str]], deferrals: list[str], passive: str, vague: list[str], times: list[str], pronouns: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, violations) of the whole structure audit in hundredths: hedges by severity (40 at most), no action (10), conflicting pairs (15 each, 30), deferrals (12 each, 25), three passives or more (5 each, 15), two vague words or more (4 each, 12), an action without a time in more than 100 characters (6), two sentences or more that begin with a pronoun (5 each, 10)."""
    low = T.squeezed(F.lower(F.coalesce(F.col(text), F.lit(""))))
    t = F.col("t")
    count = lambda tests: sum((x.cast("int") for x in tests), F.lit(0))
    n = texts.select(F.col(id), low.alias("t"))
    n = n.select(
        id, F.length("t").alias("l"), sum((F.contains(t, F.lit(w)).cast("int") * k for w, k in hedges.items()), F.lit(0)).alias("h"), T.has_any(t, actions).alias("a"), count([F.contains(t, F.lit(x)) & F.contains(t, F.lit(y)) for x, y in conflicts]).alias("c"),
        T.hits(t, deferrals).alias("d"), F.regexp_count("t", F.lit(passive)).alias("p"), T.hits(t, vague).alias("v"), T.has_any(t, times).alias("m"), F.size(F.filter(T.sentences(t), lambda s: F.regexp_extract(s, r"^\S+", 0).isin(pronouns))).alias("r"),
    )
    late = F.col("a") & ~F.col("m") & (F.col("l") > 100)
    least = lambda most, c, each: F.least(F.lit(most), F.col(c) * each)
    parts = [
        ("HEDGE_WORD", F.col("h") > 0, F.least(F.lit(40), F.col("h"))), ("MISSING_OBJECTIVE", ~F.col("a"), F.lit(10)), ("CONFLICTING_DIRECTIVE", F.col("c") > 0, least(30, "c", 15)), ("DEFERRED_ENFORCEMENT", F.col("d") > 0, least(25, "d", 12)),
        ("EXCESSIVE_PASSIVE", F.col("p") >= 3, least(15, "p", 5)), ("VAGUE_QUANTIFIER", F.col("v") >= 2, least(12, "v", 4)), ("MISSING_TIMEFRAME", late, F.lit(6)), ("AMBIGUOUS_REFERENCE", F.col("r") >= 2, least(10, "r", 5)),
    ]
    less = sum((F.when(test, lost).otherwise(0) for _, test, lost in parts), F.lit(0))
    return n.select(id, F.greatest(F.lit(0), 100 - less).cast("int").alias("score"), F.array_compact(F.array(*(F.when(test, name) for name, test, _ in parts))).alias("violations"))


def feedback(score: Column, violations: Column) -> Column:
    """A line for the writer."""
    return F.when(score < 60, "Score below threshold.").when(F.size(violations) > 0, "Passed with findings.").otherwise("Clean.")


def gated_friction(texts: DataFrame, rules: Rules, gate: tuple[str, str], pairs: list[tuple[set[str], int, str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, friction, categories, band, hold, stop): every match weighs; the first category of ``gate`` counts only where the second occurs; categories that come together add or take more. Bands end at 30, 55 and 75 hundredths."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    n = texts.select(F.col(id), *(F.regexp_count(low, F.lit(p)).alias(f"_{c}") for c, p, _ in rules))
    n = n.withColumn(f"_{gate[0]}", F.when(F.col(f"_{gate[1]}") > 0, F.col(f"_{gate[0]}")).otherwise(0))
    has = {c: F.col(f"_{c}") > 0 for c, _, _ in rules}
    total = sum((F.col(f"_{c}") * w for c, _, w in rules), F.lit(0))
    for combo, delta, _ in pairs:
        both = F.lit(True)
        for c in sorted(combo):
            both = both & has[c]
        total = total + F.when(both, delta).otherwise(0)
    got = n.select(id, F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("friction"), F.array_compact(F.array(*(F.when(has[c], c) for c, _, _ in rules))).alias("categories"))
    f = F.col("friction")
    return got.withColumns({"band": T.banded(f, [(30, "B0"), (55, "B1"), (75, "B2")], "B3"), "hold": f >= 55, "stop": f >= 75})


def passive_share(texts: DataFrame, passive: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, passive, sentences, overused): sentences with a passive form, and whether they are more than 40 in a hundred."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[.!?]+")
    n = texts.select(F.col(id), parts.alias("s")).select(id, F.size(F.filter("s", lambda x: F.rlike(x, F.lit(passive)))).alias("passive"), F.greatest(F.size(F.filter("s", lambda x: F.trim(x) != "")), F.lit(1)).alias("sentences"))
    return n.withColumn("overused", F.col("passive") * 100 > 40 * F.col("sentences"))


def score_class(*scores: Column) -> Column:
    """good from 80, mid from 60, bad above 0, none: of the first score that isn't 0 or null."""
    s = F.coalesce(*(F.nullif(x, F.lit(0)) for x in scores), F.lit(0))
    return F.when(s >= 80, "good").when(s >= 60, "mid").when(s > 0, "bad").otherwise("none")
