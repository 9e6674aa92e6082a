"""Folds over streams in any order of arrival equal the fold in order; first states; alerts."""

import json
import random
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plainspoke.streaming import ordered

T0 = datetime(2024, 1, 1)


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def turns(spark, n=160, threads=5):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, *range(threads)]), T0 + timedelta(seconds=rng.randrange(10_000)), i, rng.choice(["user", "ai"]), "x" * rng.randrange(60)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "conv_id long, ts timestamp, turn long, role string, text string")


def by_thread(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_session_records_go_on_from_stored_ones(spark):
    rows, df = turns(spark)
    stored = {0: (7, json.dumps([{"turn": -1, "role": "user", "chars": 5}])), 99: (1, "[]")}
    initial = spark.createDataFrame([(k, *v) for k, v in stored.items()], "conv_id long, messages long, recent string")
    f = folder()
    got = ordered.drained(ordered.session_records(ordered.replayed(spark, df, "ts", f), 3, "60 days", initial), f)
    want = []
    for k, own in by_thread(rows).items():
        n, recent = stored.get(k, (0, "[]"))
        recent = json.loads(recent)
        for r in own:
            n, recent = n + 1, [*recent, {"turn": r[2], "role": r[3], "chars": len(r[4])}][-3:]
            want.append((k, r[2], n, json.dumps(recent)))
    assert sorted(map(tuple, got.where("conv_id is not null").collect())) == sorted(want)


def test_relays_in_any_order_of_arrival(spark):
    rows, df = turns(spark, 120)
    f = folder()
    got = ordered.drained(ordered.relays(ordered.replayed(spark, df, "ts", f), 200, "60 days"), f)
    want = []
    for k, own in by_thread(rows).items():
        relay, chars = 1, 0
        for r in own:
            chars += len(r[4])
            want.append((k, r[2], relay, chars))
            relay, chars = (relay + 1, 0) if chars >= 200 else (relay, chars)
    assert sorted(map(tuple, got.where("conv_id is not null").collect())) == sorted(want) and max(w[2] for w in want) > 2


def test_rows_wait_for_the_watermark_only(spark):
    """A row that comes a trigger late still finds its place before one that waits; one that comes after the watermark has passed it is dropped."""
    f = folder()
    rows = [(1, T0, 1, "user", "a"), (1, T0 + timedelta(hours=2), 2, "user", "bb")]
    df = spark.createDataFrame(rows, "conv_id long, ts timestamp, turn long, role string, text string")
    for part in (df, spark.createDataFrame([(1, T0 + timedelta(minutes=1), 3, "user", "late")], df.schema), spark.createDataFrame([(2, T0 + timedelta(hours=3), 6, None, None)], df.schema), spark.createDataFrame([(1, T0 + timedelta(minutes=2), 5, "user", "too late")], df.schema), spark.createDataFrame([(None, T0 + timedelta(days=9), 4, None, None)], df.schema)):
        part.coalesce(1).write.mode("append").parquet(f + "/rows")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f + "/rows")
    got = ordered.drained(ordered.relays(stream, 100, "10 minutes"), f)
    assert [tuple(r) for r in got.where("conv_id = 1").orderBy("turn").collect()] == [(1, 1, 1, 1), (1, 2, 1, 7), (1, 3, 1, 5)]


def test_alerts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), T0 + timedelta(seconds=i), i, rng.choice(["deposit", "charge", "charge"]), rng.randrange(1, 300)) for i in range(150)]
    rows = [(u, t, i, k, c if k == "deposit" else -c) for u, t, i, k, c in rows]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, id long, type string, cents long")
    f = folder()
    got = ordered.drained(ordered.low_balance_alerts(ordered.replayed(spark, df, "ts", f), 100, "60 days"), f).where("user_id is not null")
    want, state = [], {}
    for u, _, i, k, c in rows:
        b, e, told = state.get(u, (0, 0, False))
        b += c
        e, told = (e + 1, False) if k == "deposit" else (e, told)
        if b <= 100 and not told:
            want.append((u, e, i))
            told = True
        state[u] = (b, e, told)
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.select(F.max("epoch")).first()[0] > 3
