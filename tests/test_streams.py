"""Streams return what the same batch does."""

import tempfile

import pytest
from pyspark.sql import functions as F

from plainspoke.streaming import streams

DATA = "/root/testdata/sf0.001/events.parquet"


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


@pytest.fixture
def events(spark):
    batch = spark.read.parquet(DATA)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.coalesce(1).write.mode("overwrite").parquet(folder + "/in")
    return batch.withColumn("ts", F.col("ts").cast("timestamp")), streams.event_stream(spark, folder + "/in", batch.schema)


def test_per_minute(spark, events):
    batch, stream = events
    drained(streams.per_minute(stream, "user_id"), "minutes", "complete")
    want = batch.groupBy(F.window("ts", "1 minute"), "user_id").count()
    assert sorted(map(str, spark.table("minutes").collect())) == sorted(map(str, want.collect()))


def test_once(spark, events):
    batch, stream = events
    drained(streams.once(stream.select("event_id", "ts"), "event_id"), "once", "append")
    assert spark.table("once").count() == batch.select("event_id").distinct().count()


def test_active_visitors(spark, events):
    batch, stream = events
    drained(streams.active_visitors(stream, "user_id"), "active", "complete")
    want = batch.groupBy(F.window("ts", "1 hour", "5 minutes")).agg(F.count_distinct("user_id").alias("visitors"))
    assert sorted(map(str, spark.table("active").collect())) == sorted(map(str, want.collect()))


@pytest.fixture
def turns(spark):
    batch = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    return batch, spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/conversations.parquet*")


def test_relay_state(spark, turns):
    from plainspoke.operators import texts

    batch, stream = turns
    drained(streams.relay_state(stream, 1500), "relay", "append")
    want = texts.relay_numbers(batch, 1500).collect()
    assert sorted(map(tuple, spark.table("relay").collect())) == sorted(map(tuple, want)) and len({r.relay for r in want}) > 1


def test_sequence_counts(spark, turns):
    from plainspoke.operators import tables

    batch, stream = turns
    drained(streams.sequence_counts(stream), "sequences", "complete")
    want = tables.sequence_dictionary(batch).select("pointer", "frequency").collect()
    assert sorted(map(tuple, spark.table("sequences").collect())) == sorted(map(tuple, want))


def test_scored_to(spark):
    from plainspoke.lexicon import PROSE
    from plainspoke.operators import audit

    path = "/root/testdata/sf0.001/documents.parquet"
    batch = spark.read.parquet(path)
    out, at = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    streams.scored_to(spark.readStream.schema(batch.schema).parquet(path + "*"), PROSE, out, at).awaitTermination(120)
    got = spark.read.parquet(out).drop("batch").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, audit.integrity(batch, PROSE).collect()))


@pytest.fixture
def ledger(spark):
    from plainspoke.plans import logical

    batch = logical.ledger(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.coalesce(1).write.mode("overwrite").parquet(folder + "/in")
    return batch, spark.readStream.schema(batch.schema).parquet(folder + "/in")


def test_capped_spend(spark, ledger):
    batch, stream = ledger
    charges = lambda df: df.where("type = 'charge'").withColumn("cents", -F.col("cents"))
    drained(streams.capped_spend(charges(stream), 15_000), "capped", "append")
    day, spent, want = {}, {}, set()
    for r in charges(batch).orderBy("ts", "id").collect():
        now = r.ts.strftime("%Y-%m-%d")
        if day.get(r.user_id) != now:
            day[r.user_id], spent[r.user_id] = now, 0
        take = spent[r.user_id] + r.cents <= 15_000
        spent[r.user_id] += r.cents if take else 0
        want.add((r.id, r.user_id, take, spent[r.user_id]))
    got = {tuple(r) for r in spark.table("capped").select("id", "user_id", "accepted", "spent").collect()}
    assert got == want and {a for _, _, a, _ in want} == {True, False}


def test_daily_spend(spark, ledger):
    batch, stream = ledger
    drained(streams.daily_spend(stream.where("type = 'charge'"), -100), "spend", "complete")
    want = batch.where("type = 'charge'").groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("cents").alias("spent")).withColumn("within", F.col("spent") <= -100)
    assert sorted(map(str, spark.table("spend").collect())) == sorted(map(str, want.collect()))


def test_low_balance_alerts(spark, ledger):
    from plainspoke.operators import traffic

    batch, stream = ledger
    drained(streams.low_balance_alerts(stream), "alerts", "append")
    want = traffic.low_balance_crossings(batch).select("user_id", "epoch", "id")
    assert {tuple(r) for r in spark.table("alerts").collect()} == {tuple(r) for r in want.collect()}


def test_monthly_calls_and_slow_weeks(spark, events):
    batch, stream = events
    drained(streams.monthly_calls(stream, "user_id", 20), "months", "complete")
    want = batch.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").agg(F.count("*").alias("calls")).withColumn("within", F.col("calls") <= 20)
    assert sorted(map(str, spark.table("months").collect())) == sorted(map(str, want.collect()))
    drained(streams.slow_weeks(stream.withColumnRenamed("value", "latency"), 100), "weeks", "complete")
    slow = batch.where("value > 100").groupBy(F.window("ts", "7 days")).agg(F.count("*").alias("slow")).withColumn("alert", F.col("slow") > 3)
    assert sorted(map(str, spark.table("weeks").collect())) == sorted(map(str, slow.collect()))
    assert streams.slow_requests(batch.withColumnRenamed("value", "latency"), 100, 150).where("alarming").count() == batch.where("value > 150").count()


def test_session_records(spark, turns):
    import json

    batch, stream = turns
    drained(streams.session_records(stream, 3, {0: (5, [{"turn": -1, "role": "user", "chars": 0}])}), "records", "update")
    got = {r.conv_id: (r.messages, json.loads(r.recent)) for r in spark.table("records").collect()}
    for conv, n in batch.groupBy("conv_id").count().collect():
        last = [r.turn for r in batch.where(F.col("conv_id") == conv).orderBy("turn").collect()][-3:]
        assert got[conv][0] == n + (5 if conv == 0 else 0) and [x["turn"] for x in got[conv][1]][-len(last):] == last
