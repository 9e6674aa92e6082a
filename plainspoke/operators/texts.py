"""More text jobs: questions, scope, levels, exchange profiles, claims, redaction, pointers, page cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import folded


def scope_ratio(texts: DataFrame, objective: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, found, per_mille, narrow): how many of the objective's words of more than 3 letters a text holds; narrow below 150 per mille."""
    own = [w for w in dict.fromkeys(objective) if len(w) > 3]
    found = T.hits(F.lower(F.coalesce(F.col(text), F.lit(""))), own)
    return texts.select(F.col(id), found.alias("found")).withColumn("per_mille", F.floor(F.col("found") * 1000 / max(1, len(own))).cast("long")).withColumn("narrow", F.col("per_mille") < 150)


def level(texts: DataFrame, levels: dict[str, list[str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, level, hits): the level with most distinct terms, the first declared on ties; null if none has any."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scores = F.array(*(F.struct(T.hits(low, own).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, own) in enumerate(levels.items())))
    return texts.select(F.col(id), F.array_max(scores).alias("m")).select(id, F.when(F.col("m.n") > 0, F.col("m.name")).alias("level"), F.col("m.n").alias("hits"))


def exchange_profile(texts: DataFrame, hedges: list[str], smooth: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens, hedge, smooth, distinct_per_mille, long_per_mille, mean_sentence): densities of one message in whole numbers."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    base = texts.select(F.col(id), t.alias("t"), T.tokens(t).alias("k"))
    n = F.greatest(F.size("k"), F.lit(1))
    return base.select(
        id, F.size("k").alias("tokens"), sum((T.occurrences(F.col("t"), h) for h in hedges), F.lit(0)).alias("hedge"), sum((T.occurrences(F.col("t"), h) for h in smooth), F.lit(0)).alias("smooth"),
        F.floor(F.size(F.array_distinct("k")) * 1000 / n).cast("long").alias("distinct_per_mille"), F.floor(F.size(F.filter("k", lambda x: F.length(x) > 6)) * 1000 / n).cast("long").alias("long_per_mille"),
        F.floor(n / F.greatest(F.size(T.sentences(F.col("t"))), F.lit(1))).cast("long").alias("mean_sentence"),
    )


def entrenched_claims(turns: DataFrame, above: float = 0.6, role: str = "assistant") -> DataFrame:
    """(conv_id, turn, streak): earlier turns of the same role with a sentence whose words overlap one of this turn's by more than ``above`` of the larger set. Sentences meet only where they share one of their rarest words, as many as such an overlap can't all avoid."""
    s = turns.where(F.col("role") == role).select("conv_id", "turn", F.posexplode(T.sentences(F.coalesce(F.col("text"), F.lit("")))).alias("at", "sentence"))
    s = s.select("conv_id", "turn", "at", F.array_distinct(F.filter(T.words(F.lower("sentence")), lambda w: F.length(w) > 3)).alias("w")).where(F.size("w") > 0)
    words = s.select("conv_id", "turn", "at", F.size("w").alias("n"), F.explode("w").alias("word"))
    known = words.join(words.groupBy("conv_id", "word").agg(F.count("*").alias("f")), ["conv_id", "word"])
    rank = F.row_number().over(W.partitionBy("conv_id", "turn", "at").orderBy("f", "word"))
    # More than above n common words leave at most n - above n others, so the rarest of one more include a common one.
    rare = known.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.floor(F.col("n") * above)).select("conv_id", "word", "turn", "at")
    b = rare.select("conv_id", "word", F.col("turn").alias("turn_b"), F.col("at").alias("at_b"))
    met = rare.join(b, ["conv_id", "word"]).where("turn_b < turn").select("conv_id", "turn", "at", "turn_b", "at_b").distinct()
    met = met.join(s, ["conv_id", "turn", "at"]).join(s.select("conv_id", F.col("turn").alias("turn_b"), F.col("at").alias("at_b"), F.col("w").alias("w_b")), ["conv_id", "turn_b", "at_b"])
    near = F.size(F.array_intersect("w", "w_b")) > above * F.greatest(F.size("w"), F.size("w_b"))
    return met.where(near).groupBy("conv_id", "turn").agg(F.count_distinct("turn_b").alias("streak"))


def relay_step(most: int = 3000) -> Callable[[tuple[int, int], int], tuple[tuple[int, int], tuple]]:
    def step(state: tuple[int, int], n: int) -> tuple[tuple[int, int], tuple]:
        relay, chars = state[0], state[1] + n
        return (relay + 1, 0) if chars >= most else (relay, chars), (relay, chars)

    return step


def relay_numbers(turns: DataFrame, most: int = 3000) -> DataFrame:
    """(conv_id, turn, relay, chars): characters since the last reset; reaching ``most`` ends a relay, the next turn starts another. Each thread's turns are folded in order."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return folded(rows, "conv_id", ["turn", "n"], "n", (1, 0), relay_step(most), ["conv_id", "turn"], {"relay": "int", "chars": "long"})


def redacted_cards(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, n): numbers of 16 digits in groups of four replaced where they stand."""
    rule = r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"
    t = F.coalesce(F.col(text), F.lit(""))
    return texts.select(F.col(id), F.regexp_replace(t, rule, "[CARD]").alias("text_out"), F.regexp_count(t, F.lit(rule)).alias("n"))


def junk(t: Column, prices: str = r"[$€£] ?[0-9]", boilerplate: str | None = None) -> Column:
    """Whether a block of text is junk: three prices or more, fewer than 8 words, or a match of the boilerplate pattern in its lowered form."""
    out = (F.regexp_count(t, F.lit(prices)) >= 3) | (T.word_count(t) < 8)
    return out | F.rlike(F.lower(t), F.lit(boilerplate)) if boilerplate else out


def product_page(t: Column, cart: list[str], prices: str = r"[$€£] ?[0-9]", thin: int = 200) -> Column:
    """Whether a page sells rather than says: a text below ``thin`` characters, a phrase of a cart, or three prices."""
    own = F.coalesce(t, F.lit(""))
    return (F.length(own) < thin) | T.has_any(F.lower(own), cart) | (F.regexp_count(own, F.lit(prices)) >= 3)


def token_ceiling(texts: DataFrame, most: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, kept_per_mille): the first ``most`` words, and the share of words kept."""
    own = T.words(F.coalesce(F.col(text), F.lit("")))
    return texts.select(F.col(id), own.alias("w")).select(id, F.array_join(F.slice("w", 1, most), " ").alias("text_out"), F.floor(F.least(F.size("w"), F.lit(most)) * 1000 / F.greatest(F.size("w"), F.lit(1))).cast("long").alias("kept_per_mille"))


def pointers(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, pointers): each line's dictionary pointer, in order; empty lines have none."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: T.dictionary_key(x) != "")
    return turns.select("conv_id", "turn", F.transform(lines, T.pointer).alias("pointers"))


def reconstructed(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(conv_id, turn, text): pointers turned back into the dictionary's originals, one a line."""
    far = rows.select("conv_id", "turn", F.posexplode("pointers").alias("at", "pointer")).join(dictionary.select("pointer", "original"), "pointer")
    return far.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "original"))), lambda x: x["original"]), "\n").alias("text"))


def distinct_pages(pages: DataFrame, first: int = 500, at_least: int = 30) -> DataFrame:
    """(id, entity): pages whose first characters no earlier page of the entity has, long enough."""
    own = pages.withColumn("_m", F.md5(F.substring("raw_text", 1, first))).where(F.length("raw_text") >= at_least)
    return own.withColumn("_r", F.row_number().over(W.partitionBy("entity", "_m").orderBy("id"))).where("_r = 1").select("id", "entity")


def without_lines(texts: DataFrame, noise: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, dropped): lines that match the pattern, or are empty, dropped."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~F.rlike(F.lower(x), F.lit(noise)) & (F.trim(x) != ""))
    return texts.select(F.col(id), lines.alias("l"), kept.alias("k")).select(id, F.array_join("k", "\n").alias("text_out"), (F.size("l") - F.size("k")).alias("dropped"))


def thread_summary(metrics: DataFrame) -> DataFrame:
    """Pairs, flips and summed lengths of each thread's pair metrics."""
    return metrics.groupBy("conv_id").agg(F.count("*").alias("pairs"), F.count_if("flip").alias("flips"), F.sum(F.abs("longer")).cast("long").alias("distance"))


def requeued(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of ``new`` whose value is distinct from the stored one, nulls compared as values."""
    o = old.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_is"))
    met = new.join(o, F.col(key) == F.col("_k"), "left")
    return met.where(F.col("_is").isNull() | ~F.col(value).eqNullSafe(F.col("_v"))).select(key)


def appended(rows: DataFrame, column: str, item: Column) -> DataFrame:
    """A JSON array column with one more string."""
    return rows.withColumn(column, F.to_json(F.array_append(F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")), item)))


def settings_with(json: Column, key: str, value: Column) -> Column:
    """A JSON object of texts with one key set, the others as they were; null and broken objects are empty. Keys are in order."""
    kept = F.map_filter(F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, F.create_map(F.lit(key), value.cast("string")))))))


def setting(json: Column, key: str) -> Column:
    """The text of one key of a JSON object; null without it."""
    return F.try_element_at(F.from_json(json, "map<string,string>"), F.lit(key))


def exchange_rates(texts: DataFrame, negations: list[str], meta: list[str], metaphors: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sentences, question, negation, meta, metaphor): questions in a thousand sentences, and words of each list in a thousand tokens, rounded down; phrases of the metaphors are counted where they occur."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    base = texts.select(F.col(id), t.alias("t"), T.tokens(t).alias("k"), T.sentences(t).alias("s"))
    rate = lambda n, of: F.floor(n * 1000 / F.greatest(F.size(of), F.lit(1))).cast("long")
    among = lambda words: F.size(F.filter("k", lambda x: x.isin(words)))
    return base.select(
        id, F.size("s").alias("sentences"), rate(F.size(F.filter("s", lambda x: x.endswith("?"))), "s").alias("question"), rate(among(negations), "k").alias("negation"), rate(among(meta), "k").alias("meta"),
        rate(sum((T.occurrences(F.col("t"), m) for m in metaphors), F.lit(0)), "k").alias("metaphor"),
    )


def without_transitions(texts: DataFrame, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, changed): what the pattern of transitions matches taken out of a text with single spaces."""
    t = T.squeezed(F.coalesce(F.col(text), F.lit("")))
    return texts.select(F.col(id), t.alias("t")).select(id, T.squeezed(F.regexp_replace("t", F.lit(pattern), F.lit(""))).alias("text_out"), F.rlike("t", F.lit(pattern)).alias("changed"))


def blocked(texts: DataFrame, phrases: list[str], ceiling: int, level: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_out, blocked, cut): whole-word phrases replaced, then words beyond the target cut: the ceiling less 15 in a hundred for each level, rounded down."""
    from .cleaning import bounded, replaced

    df = texts.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("t"), F.lit(0).alias("blocked"))
    for p in phrases:
        df = df.select(id, replaced(F.col("t"), p, "[REMOVED]").alias("t"), (F.col("blocked") + F.rlike("t", F.lit(bounded(p))).cast("int")).alias("blocked"))
    most, w = ceiling * (100 - 15 * level) // 100, T.words(F.col("t"))
    return df.select(id, F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(F.col("t")).alias("text_out"), "blocked", F.greatest(F.size(w) - most, F.lit(0)).alias("cut"))
