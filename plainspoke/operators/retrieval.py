"""Retrieval for a table of queries at once.

What a topic can offer is the same for all queries: its first rows by priority and
date, which partial limits find before any shuffle. It is held as one array a
topic, so a query costs one join and no window; a topic that most queries ask for is a
hot key of the queries' side only, which skew handling splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import recency_bonus


def retrieve_many(artifacts: DataFrame, queries: DataFrame, k: int, weights: dict[int, int], as_of: str, general: str = "general") -> DataFrame:
    """(query, key, score in hundredths, anchor) of (query, topic, anchor): the anchor, then the ``k`` best of 2 ``k`` artifacts of the query's topic by priority and date; where a topic other than ``general`` has fewer than two, ``k`` of other topics are candidates too.

    score: the priority's weight and the recency bonus. Of equal scores the smaller key
    comes first. A null anchor is none; an unknown one gives no row of its own. Null
    topics have no artifacts of their own.
    """
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("priority")), F.lit(0))
    rows = artifacts.withColumn("score", (w * 100 + recency_bonus(F.col("updated"), as_of)).cast("int"))
    order = [F.asc("priority"), F.desc("updated"), F.asc("key")]
    # One more than asked for, as one may be the anchor; of all topics three more, as two may be the topic's own.
    offer = F.struct("priority", F.col("updated"), "key", "score", "topic")
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy("topic").orderBy(*order))).where(F.col("_r") <= 2 * k + 1)
    own = best.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("_r", offer.alias("a")))).alias("_s")).select(F.col("topic").alias("_t"), F.transform("_s", lambda x: x["a"]).alias("_own"))
    every = rows.orderBy(*order).limit(k + 3).select(offer.alias("a"), "priority", "updated", "key")
    every = every.agg(F.collect_list(F.struct("priority", (-F.unix_micros(F.col("updated").cast("timestamp"))).alias("u"), "key", "a")).alias("_e")).select(F.transform(F.array_sort("_e"), lambda x: x["a"]).alias("_all"))
    met = queries.join(own, F.col("topic") == F.col("_t"), "left").crossJoin(F.broadcast(every))  # one row of k + 3 artifacts
    mine = lambda c: F.filter(F.col(c), lambda x: ~x["key"].eqNullSafe(F.col("anchor")))
    own_ = F.slice(F.coalesce(mine("_own"), F.array().cast(own.schema["_own"].dataType)), 1, 2 * k)
    met = met.select("query", "topic", "anchor", own_.alias("_own"), F.slice(F.filter(mine("_all"), lambda x: x["topic"] != F.coalesce(F.col("topic"), F.lit(""))), 1, k).alias("_more"))
    more = (F.size("_own") < 2) & ~F.col("topic").eqNullSafe(F.lit(general))
    both = F.when(more, F.concat("_own", "_more")).otherwise(F.col("_own"))
    ranked = F.slice(F.array_sort(F.transform(both, lambda x: F.struct((-x["score"]).alias("s"), x["key"].alias("key")))), 1, k)
    found = met.select("query", F.explode(ranked).alias("x")).select("query", F.col("x.key").alias("key"), (-F.col("x.s")).alias("score"), F.lit(False).alias("anchor"))
    held = queries.where("anchor is not null").select("query", F.col("anchor").alias("key")).join(artifacts.select("key"), "key", "left_semi")
    return found.unionByName(held.select("query", "key", F.lit(None).cast("int").alias("score"), F.lit(True).alias("anchor")))


def capped_many(artifacts: DataFrame, per: int, by: list[str] | None = None) -> DataFrame:
    """(by, key, priority): all artifacts of priority 0 and at most ``per`` of each other priority, for each value of ``by`` (a query, say), in order of key. Priority 0 passes beside the window; the others are limited before they are shuffled."""
    by = by or []
    rest = artifacts.where("priority is null or priority <> 0")
    some = rest.withColumn("_r", F.row_number().over(W.partitionBy(*by, "priority").orderBy("key"))).where(F.col("_r") <= per)
    return artifacts.where("priority = 0").select(*by, "key", "priority").unionByName(some.select(*by, "key", "priority"))
