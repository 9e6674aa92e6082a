"""Account, corpus and leaderboard reports; price series; joins with fallbacks; row-level updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def account_stats(scored: DataFrame, account: str, bands: list[str]) -> DataFrame:
    """Total, mean score in tenths and texts of each band for each account, in one pass."""
    return scored.groupBy(account).agg(F.count("*").alias("total"), F.floor(F.sum("score") * 10 / F.count("*")).cast("long").alias("mean_tenths"), *(F.count_if(F.col("label") == b).alias(b.lower()) for b in bands))


def endpoint_latency(views: DataFrame) -> DataFrame:
    cents = F.round(F.col("latency") * 100).cast("long")
    return views.groupBy("path").agg(F.count("*").alias("calls"), F.floor(F.sum(cents) / F.count("*")).cast("long").alias("mean_hundredths"))


def insights(views: DataFrame) -> DataFrame:
    """Ordered key and value rows out of one wide aggregate."""
    wide = views.agg(F.count("*").alias("hits"), F.count_distinct("ip").alias("visitors"), F.count_distinct("path").alias("paths"), F.count_if(F.col("latency") > 100).alias("slow"), F.count_if(F.col("referrer").isNotNull()).alias("referred"))
    return wide.select(F.expr("stack(5, 1, 'hits', hits, 2, 'visitors', visitors, 3, 'paths', paths, 4, 'slow', slow, 5, 'referred', referred) as (place, metric, value)"))


def best_and_worst(scored: DataFrame, entity: str, page: str) -> DataFrame:
    """Best and worst page of each entity, the smaller page on ties, and pages scored."""
    return scored.groupBy(entity).agg(F.max_by(page, F.struct("score", -F.col(page))).alias("best"), F.min_by(page, F.struct("score", page)).alias("worst"), F.max("score").alias("best_score"), F.min("score").alias("worst_score"), F.count("*").alias("pages"))


def weighted_mean(scored: DataFrame, entity: str, score: str, weight: str) -> DataFrame:
    """Mean score by weight, in tenths, rounded down; null without weight."""
    total = F.sum(weight)
    return scored.groupBy(entity).agg(F.when(total > 0, F.floor(F.sum(F.col(score) * F.col(weight)) * 10 / total)).cast("long").alias("mean_tenths"))


def leaderboard(scored: DataFrame, clear: int = 70, issue: int = 40) -> DataFrame:
    return scored.agg(F.count("*").alias("total"), F.floor(F.sum("score") / F.greatest(F.count_if(F.col("score") > 0), F.lit(1))).cast("long").alias("mean"), F.count_if(F.col("score") >= clear).alias("clear"), F.count_if((F.col("score") > 0) & (F.col("score") < issue)).alias("issues"))


def prices(orders: DataFrame) -> DataFrame:
    """Daily open, high, low, close and volume of each ticker."""
    at = F.struct("ts", "id")
    return orders.groupBy("ticker", F.to_date("ts").alias("day")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume"))


def momentum(daily: DataFrame) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("day")
    return daily.select("ticker", "day", "close", (F.col("close") - F.lag("close").over(w)).alias("change"))


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def numbered(df: DataFrame, key: str, order: list[str], name: str, prefix: str) -> DataFrame:
    return df.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("string")))


def first_hit(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df``, and those of ``other`` whose key ``df`` lacks."""
    both = df.withColumn("_p", F.lit(0)).unionByName(other.withColumn("_p", F.lit(1)))
    return both.withColumn("_r", F.rank().over(W.partitionBy(key).orderBy("_p"))).where("_r = 1").drop("_r", "_p")


def presence(wanted: DataFrame, have: DataFrame, key: str, size: str, thin: int) -> DataFrame:
    """missing, thin or present for each wanted key."""
    met = wanted.select(key).join(have.groupBy(key).agg(F.sum(size).alias("_n")), key, "left")
    return met.select(key, F.when(F.col("_n").isNull(), "missing").when(F.col("_n") < thin, "thin").otherwise("present").alias("status"))


def neighbours(texts: DataFrame, key: str, size: Column, reach: int) -> DataFrame:
    """(key, i, j) of a text's ``size`` places at most ``reach`` apart, from their number alone: nothing is shuffled."""
    base = texts.select(F.col(key), size.alias("_n")).where("_n > 1")
    far = base.select(key, "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 2)).alias("i"))
    return far.select(key, "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + reach, F.col("_n") - 1))).alias("j"))


def resolved(rows: DataFrame, pointer: str, synonyms: DataFrame) -> DataFrame:
    """``pointer`` replaced by its canonical form where an active synonym says so; the synonym table is a small list and is broadcast."""
    s = synonyms.where("active").select(F.col("pointer").alias("_p"), "canonical")
    return rows.join(F.broadcast(s), F.col(pointer) == F.col("_p"), "left").withColumn(pointer, F.coalesce("canonical", pointer)).drop("_p", "canonical")


def merged_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Frequencies added, the first writer's text kept; associative."""
    both = a.withColumn("_w", F.lit(0)).unionByName(b.withColumn("_w", F.lit(1)))
    return both.groupBy(key).agg(F.sum("frequency").cast("long").alias("frequency"), F.min_by("original", F.struct("_w", "original")).alias("original"))


def last_write(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    both = target.withColumn("_o", F.lit(0)).unionByName(updates.withColumn("_o", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_o")))).where("_r = 1").drop("_r", "_o")


def routed_writes(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Each update with its route: staged if the row it meets is locked, else written; and the version it would have."""
    met = updates.join(target.select(F.col(key).alias("_k"), "locked", "version"), F.col(key) == F.col("_k"), "left")
    return met.select(key, F.when(F.coalesce("locked", F.lit(False)), "staged").otherwise("written").alias("route"), (F.coalesce("version", F.lit(0)) + 1).alias("version"))


def states(texts: DataFrame, m: dict[str, list[str]], confirm_when: str = "missing", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deferral, collapse and substitution states of each text, and those that hold in order, NONE if none.

    ``confirm_when``: whether deferral is confirmed by missing or by present constraints.
    """
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    has = {k: T.has_any(t, own) for k, own in m.items()}
    c = has["constraint"]
    sure = ~c if confirm_when == "missing" else c
    met = c.cast("int") + (has["capability"] & ~c).cast("int") + (has["hedge"] | has["blend"]).cast("int") + (has["calm"] | has["reassure"]).cast("int")
    got = texts.select(F.col(id), F.when(has["defer"] & sure, "CONFIRMED").when(has["defer"], "PROBABLE").otherwise("FALSE").alias("deferral"), F.when(has["collapse"] & F.contains(t, F.lit("and")) & F.contains(t, F.lit("that")), "CONFIRMED").when(has["collapse"], "PROBABLE").otherwise("FALSE").alias("collapse"), F.when(met == 4, "CONFIRMED").when(met == 3, "PROBABLE").otherwise("FALSE").alias("substitution"))
    named = F.array_compact(F.array(*(F.when(F.col(k) != "FALSE", k) for k in ("collapse", "substitution", "deferral"))))
    return got.withColumn("dominance", F.when(F.size(named) == 0, F.array(F.lit("NONE"))).otherwise(named))


def tilt(texts: DataFrame, tags: dict[str, list[str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tags): the tags of which a term occurs, in the order declared."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    return texts.select(F.col(id), F.array_compact(F.array(*(F.when(T.has_any(t, own), k) for k, own in tags.items()))).alias("tags"))


def routes(texts: DataFrame, words: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    return texts.select(F.col(id), F.when(T.has_any(F.lower(F.coalesce(F.col(text), F.lit(""))), words), "HUMAN_INTERNAL").otherwise("AI_PATH").alias("route"))


def objective(turn_pairs: DataFrame) -> DataFrame:
    """Objective (the prompt's first sentence, 400 characters at most), similarity of tokens, drift."""
    p, a = T.tokens(F.col("prompt")), T.tokens(F.col("answer"))
    sim = T.jaccard(p, a)
    return turn_pairs.select("conv_id", "i", F.substring(F.coalesce(F.get(T.sentences(F.col("prompt")), 0), F.lit("")), 1, 400).alias("objective"), F.floor(sim * 1000 + 0.5).cast("long").alias("similarity"), F.floor((1 - sim) * 1000 + 0.5).cast("long").alias("drift"))


def span_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """(key, kept): spans in order of start, priority and length; one that overlaps the last kept is dropped unless its priority is higher, which replaces it."""
    order = F.array_sort(F.collect_list(F.struct("start", (-F.col("priority")).alias("p"), (F.col("start") - F.col("end")).alias("l"), "signal", "end", "priority")))
    fold = F.aggregate(order, F.expr("cast(array() as array<struct<start:int,end:int,signal:string,priority:int>>)"), lambda k, x: F.when((F.size(k) == 0) | (F.element_at(k, -1)["end"] <= x["start"]), F.concat(k, F.array(_span(x)))).when(x["priority"] > F.element_at(k, -1)["priority"], F.concat(F.slice(k, 1, F.size(k) - 1), F.array(_span(x)))).otherwise(k))
    return spans.groupBy(key).agg(fold.alias("kept"))


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["signal"].alias("signal"), x["priority"].alias("priority"))


def explicit_questions(texts: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "?") -> DataFrame:
    """(id, at, question): sentences that end with the mark."""
    return texts.select(F.col(id), F.posexplode(T.sentences(F.coalesce(F.col(text), F.lit("")))).alias("at", "question")).where(F.col("question").endswith(mark))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


def all_tilt(pairs: DataFrame, tags: dict[str, list[str]], sure: list[str], acts: list[str], universal: list[str], able: list[str], reach: list[str], stopwords: list[str]) -> DataFrame:
    """(conv_id, i, tags) of answers, T1 to T10 in order. T2: certainty without an enforcing verb; T4: a phrase, or a universal word with a capability; T9: at least 6 words of 4 letters that the prompt lacks, and .55 of the answer's."""
    a, p = F.lower(F.coalesce(F.col("answer"), F.lit(""))), F.lower(F.coalesce(F.col("prompt"), F.lit("")))
    own = pairs.select("conv_id", "i", a.alias("a"), T.content_tokens(a, stopwords, 4, 1_000_000).alias("k"), T.content_tokens(p, stopwords, 4, 1_000_000).alias("q"))
    t, new = F.col("a"), F.size(F.array_except("k", "q"))
    tests = {k: T.has_any(t, words) for k, words in tags.items()} | {"T2": T.has_any(t, sure) & ~T.has_any(t, acts), "T4": T.has_any(t, reach) | (T.has_any(t, universal) & T.has_any(t, able)), "T9": (new >= 6) & (new * 100 >= 55 * F.size("k"))}
    return own.select("conv_id", "i", F.array_compact(F.array(*(F.when(tests[k], k) for k in sorted(tests, key=lambda k: int(k[1:]))))).alias("tags"))


def phrase_union(phrases: DataFrame, key: str, side: str, phrase: str) -> DataFrame:
    """(key, phrases): the phrases of all sides of a key, each once, in order."""
    return phrases.select(key, phrase).distinct().groupBy(key).agg(F.array_sort(F.collect_list(phrase)).alias("phrases"))


def latest_scores(entities: DataFrame, scored: dict[str, DataFrame]) -> DataFrame:
    """``entities`` (id, kind) with the latest score (id, score, at) of the table of their kind."""
    every = None
    for kind, df in scored.items():
        own = df.select("id", "score", "at", F.lit(kind).alias("kind"))
        every = own if every is None else every.unionByName(own)
    latest = every.groupBy("id", "kind").agg(F.max_by("score", "at").alias("score"))
    return entities.join(latest, ["id", "kind"], "left").select("id", "kind", "score")


def full_account_stats(scored: DataFrame, decisions: DataFrame, spent: DataFrame, account: str) -> DataFrame:
    """(account, total, mean_tenths, overrides, accepted in a hundred, spend with 15 in a hundred on top, 4 digits): three aggregates, each made before they meet. spent: account, n thousandths of a cent."""
    a = scored.groupBy(account).agg(F.count("*").alias("total"), F.floor(F.sum("score") * 10 / F.count("*")).cast("long").alias("mean_tenths"))
    b = decisions.groupBy(account).agg(F.count_if("override").alias("overrides"), F.floor(F.count_if("accepted") * 100 / F.count("*")).cast("long").alias("accepted"))
    c = spent.groupBy(account).agg(F.round(F.sum("n").cast("decimal(18,0)") * F.expr("0.0000115BD"), 4).cast("decimal(18,4)").alias("spend"))
    got = a.join(b, account, "left").join(c, account, "left")
    return got.select(account, "total", "mean_tenths", F.coalesce("overrides", F.lit(0)).alias("overrides"), F.coalesce("accepted", F.lit(0)).alias("accepted"), "spend")


def page_of(df: DataFrame, order: list[str], page: int, size: int, place: str) -> DataFrame:
    """One page of an ordered list with its places, in order: only so many first rows of each task meet."""
    first = df.orderBy(*order).limit(page * size)
    w = W.orderBy(*order)  # page x size rows
    return first.withColumn(place, F.row_number().over(w).cast("long")).where(F.col(place) > (page - 1) * size)


def audit_source(column: Column, aliases: dict[str, str], other: str = "manual") -> Column:
    """The normal name of a source: trimmed, lowered, hyphens as underscores, then by ``aliases``."""
    name = F.replace(F.lower(F.trim(column)), F.lit("-"), F.lit("_"))
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(known, name), F.lit(other))


def statement_lenses(texts: DataFrame, lenses: dict[str, str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, one boolean a lens): whether a text's lowered form matches the lens's pattern."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return texts.select(F.col(id), *(F.rlike(low, F.lit(p)).alias(k) for k, p in lenses.items()))
