"""Versioned tables, upserts, conversation windows, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def entity_rollup(pages: DataFrame) -> DataFrame:
    return pages.groupBy("entity").agg(F.count("*").alias("pages"), F.count_distinct("page").alias("page_types"), F.sum(T.word_count(F.col("raw_text"))).cast("long").alias("words"), F.max("ts").alias("last_seen"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda x: x.cast("string")), ",").alias("types"))


def entity_pieces(pages: DataFrame, width: int = 1000) -> DataFrame:
    """(entity, place, page, id, text, pages, total_chars): an entity's text in pieces, numbered by page, id and text; in order of place and with a separator between them they are its whole text.

    No page type is skipped. A piece is its page and its text on the next line; a null text stays a null piece of no characters.
    Ids meet in ranges of ``width``: rows are numbered within a range and the counts of the ranges before it are added, so no task
    gets all texts of an entity. Rows with a null id are one range.
    """
    own = pages.select("entity", "page", "id", "raw_text", F.floor(F.col("id") / width).alias("_range"))
    own = own.withColumn("_key", F.to_json(F.struct("entity", "page", "_range")))  # never null, so that window and join share one exchange of the texts
    counts = own.groupBy("_key", "entity", "page", "_range").agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.length("raw_text"), F.lit(0))).alias("_chars"))
    totals = W.partitionBy("entity")
    before = F.sum("_n").over(totals.orderBy("page", "_range").rowsBetween(W.unboundedPreceding, -1))
    sums = counts.select("_key", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(totals).alias("pages"), F.sum("_chars").over(totals).cast("long").alias("total_chars"))
    met = own.withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy("id", "raw_text"))).join(sums, "_key")
    return met.select("entity", (F.col("_before") + F.col("_nth")).alias("place"), "page", "id", F.concat(F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\n"), "raw_text").alias("text"), "pages", "total_chars")


def upsert_keep(target: DataFrame, updates: DataFrame, key: str, value: str, changed: str) -> DataFrame:
    """Upsert of (key, value, changed): ``changed`` moves only if the value does."""
    t, u = target.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(changed).alias("_c")), updates
    met = t.join(u, t._k == u[key], "full")
    return met.select(F.coalesce(key, "_k").alias(key), F.coalesce(value, "_v").alias(value), F.when(F.col(value).isNull() | F.col(value).eqNullSafe(F.col("_v")), F.coalesce("_c", changed)).otherwise(F.col(changed)).alias(changed))


def insert_new(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``target`` and the rows of ``updates`` whose key it lacks."""
    return target.unionByName(updates.join(target.select(key), key, "left_anti"))


def deleted(target: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return target.join(gone.select(key), key, "left_anti")


def thread_windows(turns: DataFrame, most: int = 8000) -> DataFrame:
    """Characters and tokens so far in each thread, its window's per cent, and a status."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    got = turns.select("conv_id", "turn", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(w).alias("chars"), F.sum(T.approx_tokens(F.coalesce(F.col("text"), F.lit("")), "floor")).over(w).alias("tokens"))
    per_mille = F.floor(F.col("chars") * 1000 / most).cast("long")
    return got.withColumn("per_mille", per_mille).withColumn("status", T.banded(F.col("per_mille"), [(700, "ok"), (800, "watch"), (900, "prepare"), (950, "inject")], "full"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("conv_id", "turn", "role")


def pairs(turns: DataFrame) -> DataFrame:
    """The i-th user turn with the i-th assistant turn of each thread."""
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    own = turns.where("role in ('user', 'assistant')").withColumn("i", F.row_number().over(w))
    side = lambda role, name: own.where(F.col("role") == role).select("conv_id", "i", F.col("text").alias(name))
    return side("user", "prompt").join(side("assistant", "answer"), ["conv_id", "i"])


def pair_metrics(turns: DataFrame) -> DataFrame:
    """Drift (1 - similarity of tokens), mirror rate and length ratio of each pair, and whether the drift's direction flipped."""
    got = pairs(turns).select("conv_id", "i", T.tokens(F.col("prompt")).alias("p"), T.tokens(F.col("answer")).alias("a"))
    w = W.partitionBy("conv_id").orderBy("i")
    got = got.select("conv_id", "i", F.round(1 - T.jaccard(F.col("p"), F.col("a")), 3).alias("drift"), F.round(T.mirror_rate(F.col("p"), F.col("a")), 4).alias("mirror"), (F.size("a") - F.size("p")).alias("longer"))
    return got.withColumn("flip", F.coalesce(F.lag("longer").over(w) * F.col("longer") < 0, F.lit(False)))


def role_balance(turns: DataFrame) -> DataFrame:
    return turns.groupBy("role").agg(F.count("*").alias("messages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))


def sequence_dictionary(turns: DataFrame) -> DataFrame:
    """(pointer, original, frequency, roles) of the lines of all turns: equal once normalised, the first original kept. Associative, so sums combine before the shuffle."""
    lines = turns.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("key", T.dictionary_key(F.col("line"))).where("key <> ''")
    return lines.groupBy(F.substring(F.sha2("key", 256), 1, 16).alias("pointer")).agg(F.min_by("line", F.struct("conv_id", "turn", "at")).alias("original"), F.count("*").alias("frequency"), F.count_distinct("role").alias("roles"))


def stagnant_streaks(turns: DataFrame) -> DataFrame:
    """Turns that are no longer than the one before, and how many of them run in a row."""
    w = W.partitionBy("conv_id").orderBy("turn")
    own = turns.select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n")).withColumn("stagnant", F.coalesce(F.col("n") <= F.lag("n").over(w), F.lit(False)))
    own = own.withColumn("_island", F.count_if(~F.col("stagnant")).over(w))
    return own.withColumn("streak", F.when(F.col("stagnant"), F.count_if("stagnant").over(W.partitionBy("conv_id", "_island").orderBy("turn"))).otherwise(0)).drop("_island", "n")


def recency_bonus(updated: Column, as_of: str) -> Column:
    """20 points that decay over 30 whole days, in hundredths."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.to_date(updated)))
    return F.floor(2000 * F.greatest(F.lit(0), 30 - age) / 30 + 0.5).cast("int")


def retrieve(artifacts: DataFrame, topic: str, k: int, weights: dict[int, int], as_of: str, anchor: int | None = None, general: str = "general") -> DataFrame:
    """(key, score in hundredths, anchor): the anchor, then the k best of 2 k artifacts of a topic by priority and date; where a topic other than ``general`` has fewer than two, k of other topics are candidates too.

    score: the priority's weight and the recency bonus. Only the k asked for and the candidates are limited.
    """
    rest = artifacts.where(F.col("key") != F.lit(anchor)) if anchor is not None else artifacts
    order = ["priority", F.desc("updated"), "key"]
    own = rest.where(F.col("topic") == topic).orderBy(*order).limit(2 * k)
    if topic != general:
        other = rest.where(F.col("topic") != topic).orderBy(*order).limit(k)
        own = own.unionByName(other.crossJoin(own.agg(F.count("*").alias("_n"))).where("_n < 2").drop("_n"))  # one row of a count
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("priority")), F.lit(0))
    best = own.select("key", (w * 100 + recency_bonus(F.col("updated"), as_of)).alias("score"), F.lit(False).alias("anchor")).orderBy(F.desc("score"), "key").limit(k)
    if anchor is None:
        return best
    return artifacts.where(F.col("key") == anchor).select("key", F.lit(None).cast("int").alias("score"), F.lit(True).alias("anchor")).unionByName(best)


def soft_deleted(rows: DataFrame, gone: DataFrame, key: str, flag: str = "is_current") -> DataFrame:
    """``rows`` with a flag that is false where ``gone`` has the key; no row is lost."""
    return rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").withColumn(flag, F.col("_gone").isNull()).drop("_gone")


def capped(artifacts: DataFrame, per: int) -> DataFrame:
    """At most ``per`` artifacts of each priority but 0, in order of key."""
    w = W.partitionBy("priority").orderBy("key")
    return artifacts.withColumn("_r", F.row_number().over(w)).where((F.col("priority") == 0) | (F.col("_r") <= per)).select("key", "priority")


def indexed(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """``rows`` with their place in their batch, from 0."""
    return rows.withColumn("index", F.row_number().over(W.partitionBy(batch).orderBy(order)) - 1)


def snapshots(pages: DataFrame, path: str) -> None:
    """Appends each page's text with its SHA-256 and words to a store of Parquet files by entity."""
    t = F.coalesce("raw_text", F.lit(""))
    pages.select("id", "entity", "page", "ts", F.sha2(t, 256).alias("sha"), T.word_count(t).alias("words"), t.alias("raw_text")).write.mode("append").partitionBy("entity").parquet(path)


def rescore_queue(stored: DataFrame, scores: DataFrame, key: str, score: str, changed: str) -> tuple[DataFrame, DataFrame]:
    """The stored rows with new scores, where ``changed`` moves with the score only, and the keys that moved or are new."""
    moved = scores.join(stored.select(F.col(key).alias("_k"), F.col(score).alias("_s"), F.lit(True).alias("_is")), F.col(key) == F.col("_k"), "left").where(F.col("_is").isNull() | ~F.col(score).eqNullSafe(F.col("_s"))).select(key)
    return upsert_keep(stored, scores, key, score, changed), moved
