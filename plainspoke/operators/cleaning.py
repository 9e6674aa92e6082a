"""Cleaning and enforcement: what is taken out of a text or replaced, with rows that say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .audit import dropped_near

#: What bounds a word on both sides, in every engine alike.
_EDGE = r"[^\p{L}\p{N}_]"


def bounded(phrase: str) -> str:
    """The pattern of a phrase with whole words only; its first and last group are what bounds it."""
    return rf"(?i)(^|{_EDGE})(?:{phrase})($|{_EDGE})"


def replaced(t: Column, phrase: str, by: str = "") -> Column:
    """Whole-word occurrences replaced. Neighbours share a border, so a second pass finds what the first stepped over."""
    once = lambda x: F.regexp_replace(x, F.lit(bounded(phrase)), F.lit(f"$1{by}$2"))
    return once(once(t))


def _each(df: DataFrame, id: list[str], phrases: list[str], change: object, count: object, name: str) -> DataFrame:
    """Phrases handled one after the other in column t; what each changed is counted in ``name``."""
    for p in phrases:
        df = df.select(*id, *(c for c in df.columns if c not in (*id, "t", name)), change(F.col("t"), p).alias("t"), (F.col(name) + count(F.col("t"), p)).alias(name))
    return df


def stabilized(texts: DataFrame, hedges: list[str], fillers: list[str], transitions: str, objective: list[str] | None = None, most: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removal only, in this order: hedges (whole words), fillers (anywhere), transitions (a pattern), repeated sentences, nearly repeated ones, sentences off the objective, words beyond ``most``.

    (id, text_out, hedges, fillers, transitions, duplicates, near, trimmed, tokens_before, tokens_after, saved): hedges and fillers count phrases that occurred.
    """
    start = T.squeezed(F.coalesce(F.col(text), F.lit("")))
    df = texts.select(F.col(id), start.alias("before"), start.alias("t"), F.lit(0).alias("hedges"), F.lit(0).alias("fillers"))
    df = _each(df, [id], hedges, lambda t, p: T.squeezed(replaced(t, p)), lambda t, p: F.rlike(t, F.lit(bounded(p))).cast("int"), "hedges")
    df = _each(df, [id], fillers, lambda t, p: T.squeezed(F.regexp_replace(t, F.lit(f"(?i){p}"), F.lit(""))), lambda t, p: F.rlike(t, F.lit(f"(?i){p}")).cast("int"), "fillers")
    df = df.withColumn("transitions", F.rlike("t", F.lit(transitions)).cast("int")).withColumn("s", T.sentences(F.regexp_replace("t", F.lit(transitions), F.lit(""))))
    df = df.withColumn("d", F.array_distinct("s")).withColumn("k", dropped_near(F.col("d")))
    kept = F.col("k")
    if objective:
        on = F.filter("k", lambda x: F.arrays_overlap(T.words(F.lower(x)), F.array(*map(F.lit, objective))))
        kept = F.when(F.size(on) > 0, on).otherwise(F.col("k"))
    df = df.withColumn("w", T.words(F.array_join(kept, " ")))
    df = df.select("*", F.array_join(F.slice("w", 1, most), " ").alias("text_out"))
    tokens = lambda c: T.approx_tokens(F.col(c), "quarter")
    return df.select(id, "text_out", "hedges", "fillers", "transitions", (F.size("s") - F.size("d")).alias("duplicates"), (F.size("d") - F.size("k")).alias("near"), (F.size("w") > most).alias("trimmed"), tokens("before").alias("tokens_before"), tokens("text_out").alias("tokens_after"), (tokens("before") - tokens("text_out")).alias("saved"))


#: Kinds of personal data that redaction knows, each a pattern; a card's digits may be grouped.
PERSONAL = {"SSN": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "CARD": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "PASSPORT": "[A-Z][0-9]{8}"}


def personal_hits(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, nth, match) of each whole-word match of ``PERSONAL``, in order; nth numbers a kind's matches."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(t, F.lit(f"(?:^|{_EDGE})({pattern})(?={_EDGE}|$)"), F.lit(1))
        return F.transform(hits, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), m.alias("match")))

    found = F.concat(*(of(k, p) for k, p in PERSONAL.items()))
    return texts.where(F.rlike(t, F.lit("[0-9]{2}"))).select(F.col(id), F.inline(found))


def redacted(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, actions): each match replaced by its kind in brackets, kind by kind, with an action (kind, n) of each that occurred."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = texts.select(F.col(id), t.alias("t"), F.array().cast("array<struct<kind:string,n:int>>").alias("actions"))
    for k, p in PERSONAL.items():
        rule = f"(^|{_EDGE})(?:{p})(?={_EDGE}|$)"
        n = F.regexp_count("t", F.lit(rule))
        df = df.select(id, F.regexp_replace("t", F.lit(rule), F.lit(f"$1[{k}]")).alias("t"), F.when(n > 0, F.array_append("actions", F.struct(F.lit(k).alias("kind"), n.alias("n")))).otherwise(F.col("actions")).alias("actions"))
    return df.select(id, F.col("t").alias("text_out"), "actions")


def policies_merged(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The stricter of two policies by key: the lower length, the narrower tone band, the higher compression, either demand, both sets of phrases in order; an industry and a format of the parent's come first. Missing sides change nothing."""
    p, c = parents.select(key, F.struct(*(x for x in parents.columns if x != key)).alias("p")), children.select(key, F.struct(*(x for x in children.columns if x != key)).alias("c"))
    both = p.join(c, key, "full")
    union = lambda n: F.array_sort(F.array_union(F.coalesce(f"p.{n}", F.array().cast("array<string>")), F.coalesce(f"c.{n}", F.array().cast("array<string>"))))
    either = lambda n: F.coalesce(F.col(f"p.{n}"), F.lit(False)) | F.coalesce(F.col(f"c.{n}"), F.lit(False))
    return both.select(key, F.least("p.max_length", "c.max_length").alias("max_length"), F.greatest("p.tone_low", "c.tone_low").alias("tone_low"), F.least("p.tone_high", "c.tone_high").alias("tone_high"), F.greatest("p.compression", "c.compression").alias("compression"), either("next_step").alias("next_step"), union("blocked").alias("blocked"), F.coalesce("p.industry", "c.industry").alias("industry"))


def enforced(texts: DataFrame, policy: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, level, text_out, actions): a text through the levels of a policy, each of which sees what the one before left.

    0: personal data redacted. 1: blame sentences dropped and exclamation marks
    taken out. 2: blocked phrases replaced, then words beyond max_length cut. 3:
    words beyond the compression target cut, 15 in a hundred of max_length for each
    step. 4: a next step demanded and, where none is found, asked for. actions:
    (level, action, n) of what was done.
    """
    red = redacted(texts.select(F.col(id).alias(id), F.col(text).alias("text")), id, "text")
    actions = F.transform("actions", lambda a: F.struct(F.lit(0).alias("level"), F.concat(F.lit("redacted "), a["kind"]).alias("action"), a["n"].alias("n")))
    df = red.select(id, F.col("text_out").alias("t"), actions.alias("actions"))

    def act(level: int, name: str, n: Column, t: Column) -> DataFrame:
        step = F.struct(F.lit(level).alias("level"), F.lit(name).alias("action"), n.cast("int").alias("n"))
        return df.select(id, t.alias("t"), F.when(n > 0, F.array_append("actions", step)).otherwise(F.col("actions")).alias("actions"))

    top = policy["level"]
    if top >= 1:
        s = T.sentences(F.col("t"))
        blamed = lambda x: F.rlike(F.lower(x), F.lit(policy["blame"]))
        df = act(1, "blame dropped", F.size(F.filter(s, blamed)), F.array_join(F.filter(s, lambda x: ~blamed(x)), " "))
        df = act(1, "exclamations removed", F.regexp_count("t", F.lit("!")), F.replace("t", F.lit("!"), F.lit("")))
    if top >= 2:
        for phrase in policy["blocked"]:
            df = act(2, f"blocked {phrase}", F.rlike("t", F.lit(bounded(phrase))).cast("int"), replaced(F.col("t"), phrase, "[REMOVED]"))
    limits = [(2, "trimmed", policy["max_length"])] if top >= 2 else []
    limits += [(3, "compressed", policy["max_length"] * (100 - 15 * policy["compression"]) // 100)] if top >= 3 else []
    for level, name, most in limits:
        w = T.words(F.col("t"))
        df = act(level, name, F.greatest(F.size(w) - most, F.lit(0)), F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(F.col("t")))
    if top >= 4:
        missing = ~F.rlike(F.lower("t"), F.lit(policy["next_step"]))
        df = act(4, "next step asked for", missing.cast("int"), F.when(missing, F.concat("t", F.lit(" [NEXT STEP?]"))).otherwise(F.col("t")))
    return df.select(id, F.lit(top).alias("level"), F.col("t").alias("text_out"), "actions")


def rewritten(texts: DataFrame, rules: list[tuple[str, str]], passes: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, changes): phrases rewritten by rules in order, in up to two passes; the second only where the first changed anything. changes: rules that applied, both passes."""
    df = texts.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("t"), F.lit(0).alias("changes"))
    for k in range(passes):
        df = df.withColumn("_go", F.lit(True) if k == 0 else F.col("changes") > 0)
        for phrase, by in rules:
            df = df.select(id, "_go", F.when(F.col("_go"), replaced(F.col("t"), phrase, by)).otherwise(F.col("t")).alias("t"), (F.col("changes") + (F.col("_go") & F.rlike("t", F.lit(bounded(phrase)))).cast("int")).alias("changes"))
        df = df.drop("_go")
    return df.select(id, F.col("t").alias("text_out"), "changes")


def calmed(texts: DataFrame, phrases: list[str], blame: str, band: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, band, text_out, stripped, exclamations, dropped): by band of friction. B0 stays; from B1 phrases and exclamation marks go; from B2 blame sentences too; of B3 only the first sentence is left."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = texts.select(F.col(id), band.alias("band"), t.alias("t"), F.lit(0).alias("stripped"))
    some, more = F.col("band") >= "B1", F.col("band") >= "B2"
    for p in phrases:
        df = df.select(id, "band", F.when(some, replaced(F.col("t"), p)).otherwise(F.col("t")).alias("t"), (F.col("stripped") + (some & F.rlike("t", F.lit(bounded(p)))).cast("int")).alias("stripped"))
    df = df.withColumn("exclamations", F.when(some, F.regexp_count("t", F.lit("!"))).otherwise(0)).withColumn("t", F.when(some, F.replace("t", F.lit("!"), F.lit(""))).otherwise(F.col("t")))
    df = df.withColumn("s", T.sentences(F.col("t"))).withColumn("k", F.filter("s", lambda x: ~F.rlike(F.lower(x), F.lit(blame))))
    out = F.when(F.col("band") == "B3", F.coalesce(F.get("k", 0), F.lit(""))).when(more, F.array_join("k", " ")).when(some, T.squeezed(F.col("t"))).otherwise(F.col("t"))
    return df.select(id, "band", out.alias("text_out"), "stripped", "exclamations", F.when(more, F.size("s") - F.size("k")).otherwise(0).alias("dropped"))


def compiled(texts: DataFrame, intensifiers: list[str], blame: list[tuple[str, str]], friction: object, hold: int = 55, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, before, after, accepted): intensifiers removed and blame neutralised, accepted where friction (a function of a text column) was held and doesn't rise."""
    t = T.squeezed(F.coalesce(F.col(text), F.lit("")))
    df = texts.select(F.col(id), t.alias("t"), t.alias("c"))
    for w in intensifiers:
        df = df.withColumn("c", replaced(F.col("c"), w))
    for p, by in blame:
        df = df.withColumn("c", F.regexp_replace("c", F.lit(f"(?i){p}"), F.lit(by)))
    df = df.select(id, "t", T.squeezed(F.col("c")).alias("c"))
    df = df.select(id, "t", "c", friction(F.col("t")).alias("before"), friction(F.col("c")).alias("after"))
    ok = (F.col("before") >= hold) & (F.col("after") <= F.col("before"))
    return df.select(id, F.when(ok, F.col("c")).otherwise(F.col("t")).alias("text_out"), "before", "after", ok.alias("accepted"))


def directives(scored: DataFrame, objective: str, constraints: list[str], no_go: list[str], closure: str) -> Column:
    """Lines for the next reply from a reply's flags (columns opener, flags): the objective, what to correct, the rules, who closes, and the status."""
    has = lambda f: F.array_contains("flags", f)
    lines = [F.lit(f"OBJECTIVE: {objective}"), F.when(F.size("flags") > 0, "VIOLATION: start with substance."), F.when(has("SMOOTH_OPENER"), "CORRECTION: answer first."), F.when(has("HEDGE_HEAVY"), "CORRECTION: say how sure, or leave it out."), F.when(has("OVEREXPANSION"), "CORRECTION: keep to proportion."), F.when(has("FILLER_HEAVY"), "CORRECTION: no filler.")]
    lines += [F.lit(f"CONSTRAINT: {c}") for c in constraints] + [F.lit(f"NO-GO: {c}") for c in no_go] + [F.lit(f"CLOSURE: {closure}")]
    status = F.when(F.size("flags") == 0, "STATUS: PASS").otherwise(F.concat(F.lit("STATUS: "), F.size("flags").cast("string"), F.lit(" flags")))
    return F.array_join(F.array_compact(F.array(*lines, status)), "\n")
