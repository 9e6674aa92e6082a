"""Queries that run streams to their end over whole tables whose rows arrive in no order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases, cases_texts  # noqa: F401  their SQL is used again
from .plans import logical as L
from .plans import scratch
from .registry import SQL, query
from .streaming import ordered


@query(SQL["w6_low_balance"])
def t12_ordered_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.folder(spark, "alerts")
    rows = L.ledger(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return ordered.drained(ordered.low_balance_alerts(ordered.replayed(spark, rows, "ts", at), 100, "400 days"), at)


@query(SQL["w8_relay_numbers"])
def t6_ordered_relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's place is its time, in minutes of 2024."""
    at = scratch.folder(spark, "relays")
    rows = L.turns(spark, sf_dir).select("conv_id", "turn", "text", F.timestamp_seconds(F.col("turn") * 60 + 1_704_067_200).alias("ts"))
    got = ordered.drained(ordered.relays(ordered.replayed(spark, rows, "ts", at), 3000, "400 days"), at)
    return got.where("turn is not null")
