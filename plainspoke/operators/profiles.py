"""Profiles and verdicts of single messages: replies, protocols, topics, modes, complexity, emphasis, statements, speech, full reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: How many artifacts a request of so many clauses may draw.
COMPLEXITY = [(2, 2), (3, 4), (6, 6), (11, 9)]
#: Rules of silent loops, consolidation and confusion in hundredths.
NEAR_OPTIONS, UNDEFINED, REFERENTS = 80, 60, 30


def _low(text: str = "text") -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def _in(words: list[str]) -> object:
    return lambda x: x.isin(words)


def reply_scores(pairs: DataFrame, smooth: list[str], hedges: list[str], fillers: list[str], keys: list[str], prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """``keys`` and words, sentences, opener, hedge, smooth (per ten thousand words), filler, ratio (tenths of the prompt's words), signal (per ten thousand), sovereign, flags and passed of each answer."""
    a = _low(answer)
    w = F.transform(T.words(a), lambda x: F.btrim(x, F.lit(".,!?:;")))
    base = pairs.select(*keys, a.alias("t"), w.alias("w"), F.greatest(T.word_count(F.coalesce(F.col(prompt), F.lit(""))), F.lit(1)).alias("p"))
    n = F.greatest(F.size("w"), F.lit(1))
    got = base.select(*keys, "p", F.size("w").alias("words"), n.alias("n"), F.size(F.filter(F.split("t", "[.!?]"), lambda s: F.trim(s) != "")).alias("sentences"), F.coalesce(F.get("w", 0).isin(smooth), F.lit(False)).alias("opener"), F.size(F.filter("w", _in(hedges))).alias("h"), F.size(F.filter("w", _in(smooth))).alias("s"), T.hits(F.col("t"), fillers).alias("filler"))
    got = got.withColumns({"hedge": F.floor(F.col("h") * 10000 / F.col("n")), "smooth": F.floor(F.col("s") * 10000 / F.col("n")), "ratio": F.floor(F.col("words") * 10 / F.col("p")), "signal": F.floor((F.col("words") - F.col("h") - F.col("s") - F.col("filler")) * 10000 / F.col("n"))})
    tests = {"SMOOTH_OPENER": F.col("opener"), "HEDGE_HEAVY": F.col("h") * 100 > 3 * F.col("n"), "SMOOTH_HEAVY": F.col("s") * 100 > 3 * F.col("n"), "OVEREXPANSION": F.col("words") > 20 * F.col("p"), "FILLER_HEAVY": F.col("filler") > 2}
    flags = F.array_compact(F.array(*(F.when(test, k) for k, test in tests.items())))
    sovereign = ~F.col("opener") & (F.col("s") * 20 < F.col("n")) & (F.col("h") * 20 < F.col("n"))
    return got.select(*keys, "words", "sentences", "opener", *(F.col(c).cast("long").alias(c) for c in ("hedge", "smooth", "ratio", "signal")), "filler", sovereign.alias("sovereign"), flags.alias("flags")).withColumn("passed", F.size("flags") == 0)


def protocol_scores(texts: DataFrame, no_go: list[str], constraints: dict[str, Column], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, followed, total, score): rules kept of all. A no-go rule is broken by any of its words of more than 4 letters; a constraint by its own test. score in hundredths, 75 without rules, 0 for an empty text."""
    low = _low(text)
    broken = [T.has_any(low, [w for w in rule.lower().split() if len(w) > 4]) for rule in no_go] + list(constraints.values())
    n = len(broken)
    v = sum((b.cast("int") for b in broken), F.lit(0))
    score = F.when(low == "", 0).otherwise(F.floor((n - v) * 100 / n + 0.5) if n else F.lit(75))
    return texts.select(F.col(id), F.when(low == "", 0).otherwise(n - v).alias("followed"), F.when(low == "", 0).otherwise(n).alias("total"), score.cast("int").alias("score"))


def topics(texts: DataFrame, map_: dict[str, list[str]], artifacts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, topic, hits, method): the topic with most distinct signals if there are 2 (signal), else one named in the text (keyword), else that of the artifact (key, topic, content: a bounded list) sharing most tokens of 4 letters, 2 at least (overlap), else general (none). Ties: the first declared, the smallest key."""
    low = _low(text)
    best = F.array_max(F.array(*(F.struct(T.hits(low, own).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, own) in enumerate(map_.items()))))
    words = F.array_distinct(T.tokens(low))
    base = texts.select(F.col(id), best.alias("b"), words.alias("w"))
    named = F.get(F.filter(F.array(*map(F.lit, map_)), lambda k: F.array_contains("w", k)), 0)
    base = base.select(id, F.when(F.col("b.n") >= 2, F.struct(F.col("b.k").alias("topic"), F.col("b.n").alias("hits"), F.lit("signal").alias("method"))).when(named.isNotNull(), F.struct(named.alias("topic"), F.lit(1).alias("hits"), F.lit("keyword").alias("method"))).alias("m"), "w")
    long = artifacts.select("key", "topic", F.explode(F.array_distinct(F.filter(T.tokens(F.lower("content")), lambda x: F.length(x) >= 4))).alias("x"))
    open_ = base.where("m is null").select(id, F.explode(F.filter("w", lambda x: F.length(x) >= 4)).alias("x"))
    met = open_.join(long, "x").groupBy(id, "key", "topic").agg(F.count("*").cast("int").alias("n")).where("n >= 2")
    top = met.groupBy(id).agg(F.max_by(F.struct(F.col("topic"), F.col("n").alias("hits"), F.lit("overlap").alias("method")), F.struct("n", -F.col("key"))).alias("o"))
    none = F.struct(F.lit("general").alias("topic"), F.lit(0).alias("hits"), F.lit("none").alias("method"))
    return base.drop("w").join(top, id, "left").select(id, F.coalesce("m", "o", none).alias("r")).select(id, "r.topic", "r.hits", "r.method")


def modes(texts: DataFrame, signals: dict[str, tuple[list[str], int]], constraints: list[str], boosted: list[str], floor: str = "EXPLORE", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mode, score): the mode with most distinct signals by weight, the first declared on ties; two constraint words or more add 3 each to the ``boosted`` modes that have a signal; ``floor`` without any."""
    low = _low(text)
    c = T.hits(low, constraints)
    more = F.when(c >= 2, c * 3).otherwise(0)

    def one(i: int, mode: str, own: list[str], weight: int) -> Column:
        n = T.hits(low, own) * weight
        return F.struct(F.when(n > 0, n + (more if mode in boosted else F.lit(0))).otherwise(0).alias("n"), F.lit(-i).alias("o"), F.lit(mode).alias("mode"))

    got = texts.select(F.col(id), F.array_max(F.array(*(one(i, k, *v) for i, (k, v) in enumerate(signals.items())))).alias("m"))
    return got.select(id, F.when(F.col("m.n") > 0, F.col("m.mode")).otherwise(floor).alias("mode"), F.col("m.n").alias("score"))


def complexity(texts: DataFrame, connectors: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, clauses, draws): parts between end marks, commas, semicolons and connecting words, and how many artifacts that many may draw (12 at most)."""
    cut = r"[.!?,;]+|(?: (?:" + "|".join(connectors) + r") )"
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), cut), lambda x: F.trim(x) != ""))
    got = texts.select(F.col(id), n.alias("clauses"))
    draws = F.when(F.col("clauses") < COMPLEXITY[0][0], COMPLEXITY[0][1])
    for below, most in COMPLEXITY[1:]:
        draws = draws.when(F.col("clauses") < below, most)
    return got.withColumn("draws", draws.otherwise(12))


def balance(texts: DataFrame, entropy: dict[str, tuple[list[str], int]], instruction: dict[str, tuple[list[str], int]], fillers: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words, entropy, instruction, balance, squashed, signal): weighted category words (weights in halves) a thousand words in tenths, their difference, its squash in thousandths, and the share of words that aren't fillers in thousandths."""
    base = texts.select(F.col(id), T.tokens(_low(text)).alias("k"))
    weigh = lambda cats: sum((F.size(F.filter("k", _in(own))) * w for own, w in cats.values()), F.lit(0))
    n = F.greatest(F.size("k"), F.lit(1))
    got = base.select(id, F.size("k").alias("words"), F.floor(weigh(entropy) * 5000 / n).cast("long").alias("entropy"), F.floor(weigh(instruction) * 5000 / n).cast("long").alias("instruction"), F.floor((n - F.size(F.filter("k", _in(fillers)))) * 1000 / n).cast("long").alias("signal"))
    got = got.withColumn("balance", F.col("entropy") - F.col("instruction"))
    return got.withColumn("squashed", F.floor(T.squash(F.col("balance") / 10.0) * 1000 + 0.5).cast("long"))


def flips(profiled: DataFrame, value: str = "balance") -> DataFrame:
    """(conv_id, turns, flips, mean): how often a thread's value changes sign from turn to turn, and its mean absolute value, rounded down."""
    w = W.partitionBy("conv_id").orderBy("turn")
    own = profiled.select("conv_id", F.col(value).alias("v"), (F.col(value) * F.lag(value).over(w) < 0).alias("f"))
    return own.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if("f").alias("flips"), F.floor(F.sum(F.abs("v")) / F.count("*")).cast("long").alias("mean"))


def emphasis(texts: DataFrame, kinds: dict[str, list[str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, one count a kind): distinct words of each kind."""
    low = _low(text)
    return texts.select(F.col(id), *(T.hits(low, own).alias(k) for k, own in kinds.items()))


def statement_dims(texts: DataFrame, patterns: dict[str, str], per: int = 20, most: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, one column a dimension): ``per`` points for each match of its pattern, ``most`` at most."""
    low = _low(text)
    return texts.select(F.col(id), *(F.least(F.regexp_count(low, F.lit(p)) * per, F.lit(most)).alias(k) for k, p in patterns.items()))


def statement_scores(texts: DataFrame, gains: dict[str, tuple[list[str], int]], losses: dict[str, tuple[list[str], int]], start: int = 85, low: int = 10, high: int = 97, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, gained, lost, score): a score that starts at 85, gains and loses for each distinct word by kind, and stays between 10 and 97."""
    t = _low(text)
    total = lambda kinds: sum((T.hits(t, own) * w for own, w in kinds.values()), F.lit(0))
    got = texts.select(F.col(id), total(gains).alias("gained"), total(losses).alias("lost"))
    return got.withColumn("score", F.greatest(F.lit(low), F.least(F.lit(high), start + F.col("gained") - F.col("lost"))))


def speech(texts: DataFrame, actions: list[str], fillers: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, nth, kind, action) of each sentence: ramble with more than .35 fillers a word of more than 2 letters, two such words at most, or more than .6 of them in one of the five sentences before; else signal with a digit or six words; else other. action: whether an action word occurs."""
    parts = F.filter(T.sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: F.length(s) >= 3)
    s = texts.select(F.col(id), F.posexplode(parts).alias("nth", "s"))
    s = s.select(id, "nth", "s", F.array_distinct(F.filter(T.words(F.lower("s")), lambda w: F.length(w) > 2)).alias("w"), F.size(F.filter(T.words(F.lower("s")), lambda w: F.length(w) > 2)).alias("n"))
    w = W.partitionBy(id).orderBy("nth")
    again = F.lit(False)
    for d in range(1, 6):
        before = F.lag("w", d).over(w)
        again = again | (F.coalesce(F.size(F.array_intersect("w", before)), F.lit(0)) * 10 > 6 * F.greatest(F.size("w"), F.lit(1)))
    filler = T.hits(F.lower("s"), fillers)
    got = s.select(id, "nth", "s", "n", filler.alias("f"), F.coalesce(again, F.lit(False)).alias("again"))
    ramble = (F.col("f") * 100 > 35 * F.col("n")) | (F.col("n") <= 2) | F.col("again")
    kind = F.when(ramble, "ramble").when(F.rlike("s", F.lit("[0-9]")) | (F.col("n") >= 6), "signal").otherwise("other")
    return got.select(id, "nth", kind.alias("kind"), T.has_any(F.lower("s"), actions).alias("action"))


def contact_flags(texts: DataFrame, objective: str, hedges: str, timeline: str, shortest: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, flags): no objective, more than one hedge, no time, too short; patterns over lowered text."""
    low = _low(text)
    tests = {"MISSING_OBJECTIVE": ~F.rlike(low, F.lit(objective)), "HEDGE_DENSITY": F.regexp_count(low, F.lit(hedges)) > 1, "NO_TIMELINE_CONSTRAINT": ~F.rlike(low, F.lit(timeline)), "LOW_SPECIFICITY": F.length(low) < shortest}
    return texts.select(F.col(id), F.array_compact(F.array(*(F.when(test, k) for k, test in tests.items()))).alias("flags"))


def loop_score(texts: DataFrame, rules: list[tuple[str, str, int]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, loop, rules): weights in hundredths of the rules that match, 100 at most, and their names."""
    low = _low(text)
    total = sum((F.when(F.rlike(low, F.lit(p)), w).otherwise(0) for _, p, w in rules), F.lit(0))
    return texts.select(F.col(id), F.least(total, F.lit(100)).alias("loop"), F.array_compact(F.array(*(F.when(F.rlike(low, F.lit(p)), n) for n, p, _ in rules))).alias("rules"))


def consolidated(options: DataFrame, group: str, order: str, text: str, stopwords: list[str]) -> DataFrame:
    """(group, options, similarity, merged, merged_text, deltas): a group's options (a bounded list) are one if the first is at least .80 like each other; then sentences come together, each once whatever its case, and deltas are those that the first lacks. similarity in thousandths, rounded down."""
    own = options.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: x["t"]).alias("o"))
    words = lambda t: F.array_distinct(F.filter(T.tokens(t), lambda x: ~x.isin(stopwords)))
    k = F.transform("o", words)
    own = own.select(group, "o", k.alias("k"))
    first, rest = F.get("k", 0), F.slice("k", 2, F.greatest(F.size("k") - 1, F.lit(0)))
    alike = lambda a: F.transform(F.array(F.struct(F.size(F.array_intersect(first, a)).alias("b"), F.size(F.array_union(first, a)).alias("u"))), lambda s: F.when(s["u"] == 0, 1000).otherwise(F.floor(s["b"] * 1000 / s["u"]).cast("int")))[0]
    own = own.withColumn("similarity", F.coalesce(F.array_min(F.transform(rest, alike)), F.lit(0)))
    sentences = F.flatten(F.transform("o", T.sentences))
    own = own.withColumn("s", sentences).withColumn("low", F.transform("s", F.lower)).withColumn("base", F.transform(T.sentences(F.get("o", 0)), F.lower))
    merged = (F.size("o") >= 2) & (F.col("similarity") >= NEAR_OPTIONS * 10)
    once = F.filter("s", lambda x, i: F.array_position("low", F.lower(x)) == i + 1)
    deltas = F.filter("s", lambda x: ~F.array_contains("base", F.lower(x)))
    none = F.array().cast("array<string>")
    return own.select(group, F.size("o").alias("options"), "similarity", merged.alias("merged"), F.when(merged, F.array_join(once, " ")).when(F.size("o") == 1, F.get("o", 0)).otherwise("").alias("merged_text"), F.when(merged, deltas).otherwise(none).alias("deltas"))


def confusion(texts: DataFrame, referents: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, undefined, referents, confusion): acronyms that the text never gives in brackets or before "=" or ":", words that only refer, and 60 hundredths for the former plus 30 for more than .08 of the latter."""
    t = F.coalesce(F.col(text), F.lit(""))
    acronyms = F.array_distinct(F.filter(F.split(t, r"[^\p{L}\p{M}\p{N}_]+"), lambda w: F.rlike(w, F.lit(r"^[A-Z]{2,6}\z"))))
    given = lambda a: F.contains(t, F.concat(F.lit("("), a, F.lit(")"))) | F.contains(t, F.concat(a, F.lit(" ="))) | F.contains(t, F.concat(a, F.lit(":")))
    base = texts.select(F.col(id), F.filter(acronyms, lambda a: ~given(a)).alias("u"), T.tokens(F.lower(t)).alias("k"))
    got = base.select(id, F.size("u").alias("undefined"), F.size(F.filter("k", _in(referents))).alias("referents"), F.size("k").alias("n"))
    return got.select(id, "undefined", "referents", (F.when(F.col("undefined") > 0, UNDEFINED).otherwise(0) + F.when(F.col("referents") * 100 > 8 * F.col("n"), REFERENTS).otherwise(0)).alias("confusion"))


def observation_cards(texts: DataFrame, cards: list[tuple[str, int, str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, nth, source, priority) of the cards (source, priority, pattern) that a text calls for, by priority, then source."""
    low = _low(text)
    own = F.array_sort(F.array_compact(F.array(*(F.when(F.rlike(low, F.lit(p)), F.struct(F.lit(priority).alias("priority"), F.lit(source).alias("source"))) for source, priority, p in cards))))
    return texts.select(F.col(id), F.posexplode(own).alias("nth", "c")).select(id, "nth", "c.source", "c.priority")
