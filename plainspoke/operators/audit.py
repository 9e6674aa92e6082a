"""Text audits over tables of texts: lexicon hits, integrity, friction-like weights, clarity, gates, prevalence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Lower ends of the integrity labels.
LABELS = [(25, "FAILING"), (40, "POOR"), (55, "WEAK"), (70, "MODERATE"), (85, "SOLID")]


def lexicon_hits(texts: DataFrame, terms: dict[str, list[str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, category, term, n) for every term that occurs in a text: non-overlapping occurrences in the lowered text. No shuffle: the lexicon is a literal."""
    pairs = [(c, t) for c, own in terms.items() for t in own]
    low = texts.select(F.col(id).alias(id), F.lower(F.col(text)).alias("_low"))  # lowered once, not once a term
    counts = low.select(id, F.array(*(T.occurrences(F.col("_low"), t) for _, t in pairs)).alias("_n"))
    names = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("term")) for c, t in pairs))
    far = counts.select(id, F.posexplode("_n").alias("_i", "n")).where("n > 0")
    return far.select(id, F.get(names, F.col("_i")).alias("_k"), "n").select(id, "_k.category", "_k.term", "n")


def lexicon_join(texts: DataFrame, lexicon: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with a lexicon table: one pass of an Aho-Corasick automaton over Arrow batches, whatever the number of terms. The lexicon is a list that someone gives, and is held by the driver and each worker."""
    pairs = [(r["category"], r["term"]) for r in lexicon.where("term <> ''").select("category", "term").distinct().collect()]

    @F.pandas_udf("array<struct<category:string,term:string,n:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        words: dict[str, list[str]] = {}
        for category, term in pairs:
            words.setdefault(term, []).append(category)
        automaton = ahocorasick.Automaton()
        for term in words:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for low in batches:
            out = []
            for t in low:
                n: dict[str, int] = {}
                free: dict[str, int] = {}
                for end, term in automaton.iter(t) if words and isinstance(t, str) else ():
                    if end - len(term) + 1 >= free.get(term, 0):  # occurrences of a term don't overlap
                        n[term], free[term] = n.get(term, 0) + 1, end + 1
                out.append([{"category": c, "term": term, "n": k} for term, k in n.items() for c in words[term]])
            yield pd.Series(out)

    return texts.select(F.col(id), F.inline(find(F.lower(F.col(text)))))


def prevalence(hits: DataFrame, keys: list[str], total: DataFrame | None = None, id: str = "doc_id", once: bool = False) -> DataFrame:
    """Texts and occurrences for each key over (id, category, term, n) hits, and with ``total`` (the texts) the share of them in ten-thousandths, rounded down. once: whether an id has one hit a key, as unique ids do with a term among the keys; then nothing distinct is counted."""
    got = hits.groupBy(*keys).agg((F.count("*") if once else F.countDistinct(id)).alias("n_docs"), F.sum("n").cast("long").alias("n_hits"))
    if total is None:
        return got
    return got.crossJoin(F.broadcast(total.agg(F.count("*").alias("_n")))).withColumn("share", F.floor(F.col("n_docs") * 10000 / F.greatest("_n", F.lit(1))).cast("long")).drop("_n")  # one row


def integrity(texts: DataFrame, m: dict[str, list[str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Five dimensions in ten-thousandths, their weighted sum as a score 0 to 100, and its label.

    Constraints: sentences that name one (.6) and distinct ones a hundred words
    (.4). Asks: 8000 unless a capability comes without constraint, else 2000,
    plus 2000 for an ask in the first sentence. Enforcement: sentences without
    deferral less .05 a framing marker (.4 at most). Tilt: less .06 for each of
    deferral, blend and reassurance. Failure modes: less .30 or .15 for each of
    substitution, deferral and collapse that is confirmed or probable. All in
    whole numbers, so that every engine agrees.
    """
    low = F.lower(F.col(text))
    base = texts.select(F.col(id), F.coalesce(low, F.lit("")).alias("t")).withColumn("s", T.loose_sentences(F.col("t")))
    soft = m["defer"] + m["calm"] + m["hedge"]
    t = F.col("t")
    got = base.select(
        id,
        F.greatest(F.size("s"), F.lit(1)).alias("n"), F.greatest(T.word_count(t), F.lit(1)).alias("w"),
        F.size(F.filter("s", lambda x: T.has_any(x, m["constraint"]))).alias("c_sent"), T.hits(t, m["constraint"]).alias("c_hits"),
        F.size(F.filter("s", lambda x: ~T.has_any(x, soft))).alias("clean"),
        T.hits(t, m["hedge"] + m["reassure"] + m["blend"]).alias("framing"),
        T.has_any(F.coalesce(F.get("s", 0), F.lit("")), m["ask"]).cast("int").alias("asks"),
        *(T.has_any(t, m[k]).cast("int").alias(k) for k in ("capability", "defer", "blend", "reassure", "collapse", "calm", "hedge")),
    )
    c = (F.col("c_hits") > 0).cast("int")
    early = ((F.col("capability") == 1) & (c == 0)).cast("int")
    met = c + early + F.greatest("hedge", "blend") + F.greatest("calm", "reassure")
    whole = lambda x: F.floor(x).cast("long")
    got = got.select(
        id,
        (whole(F.col("c_sent") * 6000 / F.col("n")) + F.least(whole(F.col("c_hits") * 400000 / F.col("w")), F.lit(4000))).cast("long").alias("d1"),
        (F.lit(8000) - early * 6000 + F.col("asks") * 2000).cast("long").alias("d2"),
        F.greatest(whole(F.col("clean") * 10000 / F.col("n")) - F.least(F.col("framing") * 500, F.lit(4000)), F.lit(0)).cast("long").alias("d3"),
        (F.lit(10000) - 1200 * F.col("defer") - 600 * F.col("blend") - 800 * F.col("reassure")).cast("long").alias("d4"),
        (F.lit(10000) - F.when(met == 4, 3000).when(met == 3, 1500).otherwise(0) - F.when((F.col("defer") == 1) & (c == 0), 3000).when(F.col("defer") == 1, 1500).otherwise(0) - 1500 * F.col("collapse")).cast("long").alias("d5"),
    )
    got = got.withColumn("score", F.least(F.floor((25 * F.col("d1") + 20 * F.col("d2") + 20 * F.col("d3") + 15 * F.col("d4") + 20 * F.col("d5") + 5000) / 10000).cast("long"), F.lit(100)))
    return got.withColumn("label", T.banded(F.col("score"), LABELS, "STRONG"))


def gate(texts: DataFrame, common: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, passed, reason): the first rule that a text breaks, OK if none."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    # Words of letters only once their marks are off, found in one pass over the text.
    alpha = F.regexp_extract_all(low, F.lit(r"(?<!\S)[.,!?;:'\"()]*+([a-z](?:[a-z']*[a-z])?)[.,!?;:'\"()]*+(?!\S)"), F.lit(1))
    base = texts.select(F.col(id), T.word_count(low).alias("w"), alpha.alias("a"))
    n = F.size("a")
    known = F.size(F.filter("a", lambda x: x.isin(common)))
    total = F.aggregate("a", F.lit(0), lambda s, x: s + F.length(x))
    sorted_ = F.array_sort("a")
    top = F.aggregate(sorted_, F.struct(F.lit("").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("m")), lambda s, x: F.struct(x.alias("x"), F.when(s["x"] == x, s["n"] + 1).otherwise(1).alias("n"), F.greatest(s["m"], F.when(s["x"] == x, s["n"] + 1).otherwise(1)).alias("m")))["m"]
    reason = F.when(F.col("w") == 0, "EMPTY").when(F.col("w") < 4, "TOO_SHORT").when(n < 2, "NO_LANGUAGE").when((known * 10 < n) & (n > 4), "GIBBERISH").when((total > 14 * n) & (n > 2), "KEYBOARD_MASH").when((n > 4) & (top * 10 > 6 * n), "REPETITION").otherwise("OK")
    return base.select(id, reason.alias("reason")).withColumn("passed", F.col("reason") == "OK")


def clarity(texts: DataFrame, fillers: list[str], hedges: list[str], constraints: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and a clarity score in hundredths: deductions for fillers, hedges, ambiguity and long sentences."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    base = texts.select(F.col(id), low.alias("t")).withColumn("k", T.tokens(F.col("t")))
    hedge = sum((T.occurrences(F.col("t"), h) for h in hedges), F.lit(0))
    base = base.select(id, F.greatest(F.size("k"), F.lit(1)).alias("total"), F.size(F.filter("k", lambda x: x.isin(fillers))).alias("filler"), hedge.alias("hedge"), F.size(F.filter("k", lambda x: x.isin(constraints))).alias("constraint"), F.greatest(F.size(F.filter(F.split("t", r"[.!?]+"), lambda x: F.trim(x) != "")), F.lit(1)).alias("n_sentences"))
    less = F.when(F.col("filler") * 50 > F.col("total"), 5).otherwise(0) + F.when(F.col("hedge") * 50 > F.col("total"), 10).otherwise(0) + F.when(F.col("hedge") > F.col("constraint") + 1, 15).otherwise(0) + F.when(F.col("total") > 28 * F.col("n_sentences"), 5).otherwise(0)
    return base.withColumn("clarity", (F.lit(100) - less).cast("int"))


def weighted_index(texts: DataFrame, patterns: dict[str, tuple[str, int]], id: str = "doc_id", text: str = "text", most: int = 100) -> DataFrame:
    """(id, index, categories): weights in hundredths of the categories whose pattern occurs, 100 at most. Each category counts once."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = {c: F.rlike(low, F.lit(p)) for c, (p, _) in patterns.items()}
    total = sum((F.when(hit[c], w).otherwise(0) for c, (_, w) in patterns.items()), F.lit(0))
    return texts.select(F.col(id), F.least(total, F.lit(most)).cast("int").alias("index"), F.array_compact(F.array(*(F.when(hit[c], c) for c in patterns))).alias("categories"))


def match_weights(texts: DataFrame, patterns: dict[str, tuple[str, int]], id: str = "doc_id", text: str = "text", most: int = 100) -> DataFrame:
    """(id, friction, hold, stop): every match counts with its weight; held from 55 hundredths, stopped from 75."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    total = F.least(sum((F.regexp_count(low, F.lit(p)) * w for p, w in patterns.values()), F.lit(0)), F.lit(most)).cast("int")
    return texts.select(F.col(id), total.alias("friction")).withColumn("hold", F.col("friction") >= 55).withColumn("stop", F.col("friction") >= 75)


def undefined_acronyms(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, acronym) for words of 2 to 6 capitals A-Z that a text never gives in brackets; letters, marks and digits of any script, and underscores, are of words."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.array_distinct(F.filter(F.split(t, r"[^\p{L}\p{M}\p{N}_]+"), lambda w: F.rlike(w, F.lit(r"^[A-Z]{2,6}\z"))))
    return texts.select(F.col(id), F.explode(F.filter(found, lambda a: ~F.contains(t, F.concat(F.lit("("), a, F.lit(")"))))).alias("acronym"))


def card_like(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n) for texts with numbers of four groups of four digits."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"))
    return texts.select(F.col(id), n.alias("n")).where("n > 0")


def dedupe_sentences(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, removed): later sentences equal to an earlier one dropped."""
    own = T.sentences(F.coalesce(F.col(text), F.lit("")))
    return texts.select(F.col(id), own.alias("s")).select(id, F.array_join(F.array_distinct("s"), " ").alias("text_out"), (F.size("s") - F.size(F.array_distinct("s"))).alias("removed"))


def keep_on_objective(texts: DataFrame, objective: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, kept): sentences that share a word with the objective; all if none does."""
    own = T.sentences(F.coalesce(F.col(text), F.lit("")))
    base = texts.select(F.col(id), own.alias("s")).withColumn("k", F.filter("s", lambda x: F.arrays_overlap(T.words(F.lower(x)), F.array(*map(F.lit, objective)))))
    out = F.when(F.size("k") > 0, F.col("k")).otherwise(F.col("s"))
    return base.select(id, F.array_join(out, " ").alias("text_out"), F.size("k").alias("kept"))


def dropped_near(sentences: Column, above: int = 70) -> Column:
    """The sentences without those whose words of more than 3 letters overlap a kept one's by more than ``above`` hundredths of the larger set, in order. Each is held against all kept ones, as the rule says; arrays of references are copied, not texts."""
    sets = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.array_distinct(F.filter(T.words(F.lower(s)), lambda w: F.length(w) > 3)).alias("w")))
    near = lambda x, y: F.size(F.array_intersect(x["w"], y["w"])) * 100 > above * F.greatest(F.size(x["w"]), F.size(y["w"]))
    kept = F.aggregate(sets, F.expr("cast(array() as array<struct<s:string,w:array<string>>>)"), lambda k, x: F.when((F.size(x["w"]) > 0) & F.exists(k, lambda y: near(x, y)), k).otherwise(F.array_append(k, x)))
    return F.transform(kept, lambda y: y["s"])


def near_dedupe_sentences(texts: DataFrame, id: str = "doc_id", text: str = "text", above: int = 70) -> DataFrame:
    """(id, text_out, removed): sentences whose words of more than 3 letters overlap a kept sentence's by more than ``above`` hundredths of the larger set dropped, in order."""
    own = texts.select(F.col(id), T.sentences(F.coalesce(F.col(text), F.lit(""))).alias("s")).withColumn("k", dropped_near(F.col("s"), above))
    return own.select(id, F.array_join("k", " ").alias("text_out"), (F.size("s") - F.size("k")).alias("removed"))


def strip_phrases(texts: DataFrame, phrases: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, removed): phrases taken out one after the other, whole words only; later ones see what earlier ones left. Neighbours share a border, so each is looked for twice."""
    out = texts.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("t"), F.lit(0).alias("removed"))
    for p in phrases:
        rule = F.lit(rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{p})($|[^\p{{L}}\p{{N}}_])")
        for _ in range(2):
            out = out.select(id, F.regexp_replace("t", rule, F.lit("$1$2")).alias("t"), (F.col("removed") + F.regexp_count("t", rule)).alias("removed"))
    return out.select(id, T.squeezed(F.col("t")).alias("text_out"), "removed")
