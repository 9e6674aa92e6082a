"""Queries of the event log, of feeds in XML, and of folds called from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases, cases_texts  # noqa: F401  their SQL is used again
from .operators import ordered_functions
from .plans import logical as L
from .plans import scratch
from .registry import SQL, query
from .sources import event_log, html


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, event_type AS event_name, ts FROM events")
def s13_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as a log of JSON lines, and the log read as a stream with a bound to each trigger."""
    at = scratch.folder(spark, "event-log")
    e = L.table(spark, sf_dir, "events")
    own = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts")))
    e.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("event_name"), own.alias("event_json")))).write.text(f"{at}/log")
    size = sum(n for _, n in event_log._Log({"path": f"{at}/log"}).files())
    got = event_log.read_events(spark, f"{at}/log", maxBytes=max(1, size // 3), position=f"{at}/position")
    job = got.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    rows = spark.read.schema(got.schema).parquet(f"{at}/rows")
    x = F.from_json("event_json", "event_id long, ts timestamp_ntz")
    return rows.select(x["event_id"].alias("event_id"), "session_id", "event_name", x["ts"].alias("ts"))


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, xml): ten documents a feed, RSS and Atom by turns, Atom with a prefix; every seventh feed has a broken item at its end."""
    d = L.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("feed"), "doc_id", "source", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " ").alias("t"))
    rss = F.format_string("<item><title>No. %d &amp; more</title><description><![CDATA[<p>%s</p>]]></description><link>https://a/%d</link></item>", "doc_id", "t", "doc_id")
    atom = F.format_string('<a:entry><a:title type="text">No. %d &#38; more</a:title><a:link rel="self" href="x"/><a:link href="https://a/%d"/><a:summary>%s</a:summary></a:entry>', "doc_id", "doc_id", "t")
    even = F.col("feed") % 2 == 0
    d = d.select("feed", F.struct("doc_id", F.when(even, rss).otherwise(atom).alias("x")).alias("i"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "\n")
    bad = F.when(F.col("feed") % 7 > 0, "").when(even, "<item><title>a < b</item>").otherwise("<a:entry><a:title>a < b</a:entry>")
    f = d.groupBy("feed").agg(body.alias("b"))
    whole = F.when(even, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>all</title>'), "b", bad, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom">'), "b", bad, F.lit("</a:feed>")))
    return f.select("feed", whole.alias("xml"))


@query("SELECT doc_id // 10 AS feed, CAST(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS INTEGER) AS nth, 'No. ' || doc_id || ' & more' AS title, substr(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), 1, 500) AS summary, 'https://a/' || doc_id AS link, '' AS published, CASE WHEN doc_id // 10 % 2 = 0 THEN 'rss2' ELSE 'atom' END AS kind FROM documents")
def s4_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.feed_items(_feeds(spark, sf_dir), keep=["feed"])


@query("SELECT doc_id // 10 AS feed, CASE WHEN doc_id // 10 % 2 = 0 THEN 'rss2' ELSE 'atom' END AS kind, CAST(count(*) + CASE WHEN doc_id // 10 % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS items, CASE WHEN doc_id // 10 % 7 = 0 THEN 1 ELSE 0 END AS broken FROM documents GROUP BY doc_id // 10")
def s4_feed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.feed_report(_feeds(spark, sf_dir), "feed")


@query(SQL["w5_accepted_charges"])
def w5_charges_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered_functions.register(spark)
    return spark.sql("SELECT * FROM accepted_charges(TABLE(SELECT id, user_id, cents, ts FROM {ledger}) PARTITION BY user_id ORDER BY (ts NULLS LAST, id NULLS LAST))", ledger=L.ledger(spark, sf_dir))


@query(SQL["w8_relay_numbers"])
def w8_relays_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered_functions.register(spark)
    return spark.sql("SELECT * FROM relay_numbers(TABLE(SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(length(text), 0) AS n FROM {turns}) PARTITION BY conv_id ORDER BY (turn NULLS LAST, n))", turns=L.turns(spark, sf_dir))
