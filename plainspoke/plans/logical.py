"""Logical tables derived from the supplied ones: traffic, usage, ledger, corpus, threads, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, path, ip, referrer, latency): events as page views."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("/"), "event_type").alias("path"), F.col("user_id").alias("ip"), F.get_json_object("props", "$.k").cast("long").alias("referrer"), F.col("value").alias("latency"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, ts, type, cents): purchases pay in, all else is charged."""
    e = table(spark, sf_dir, "events").withColumn("c", F.round(F.col("value") * 100).cast("long"))
    paid = F.col("event_type") == "purchase"
    return e.select(F.col("event_id").alias("id"), "user_id", "ts", F.when(paid, "deposit").otherwise("charge").alias("type"), F.when(paid, F.col("c")).otherwise(-F.col("c")).alias("cents"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, page, ts, raw_text): a source's documents in five pages, versions in order of id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("entity"), (F.col("doc_id") % 5).alias("page"), F.col("doc_id").alias("ts"), F.col("text").alias("raw_text"))


#: The same tables for the SQL that checks.
PAGE_VIEWS = "SELECT event_id AS id, ts, '/' || event_type AS path, user_id AS ip, CAST(json_extract_string(props, '$.k') AS BIGINT) AS referrer, value AS latency FROM events"
LEDGER = "SELECT event_id AS id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'deposit' ELSE 'charge' END AS type, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT) AS cents FROM events"
COMPANY_PAGES = "SELECT doc_id AS id, source AS entity, doc_id % 5 AS page, doc_id AS ts, text AS raw_text FROM documents"
