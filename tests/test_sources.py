"""Feeds by an XML parser, tables over JDBC, transcripts, and folds called from SQL."""

import time

from pyspark.sql import functions as F

RSS = """<?xml version="1.0"?><rss xmlns:dc="u"><channel><title>c</title>
<item><title>T &amp; x</title><description><![CDATA[<b>d</b> <item> in a text]]></description><link>l</link><dc:date>9</dc:date></item>
<item><title/></item><item kind="x"><dc:title>named</dc:title></item></channel></rss>"""
ATOM = """<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title type="html">A</a:title><a:link rel="self" href="me"/><a:link href="https://a/1"/><a:updated>2024-01-02</a:updated><a:content>c</a:content></a:entry></a:feed>"""
BROKEN = "<rss><channel><item><title>x</title></item><item><title>y</item><item><title>a & b</title></item><item a='1'><title>z</title></item></channel></rss>"


def feeds(spark):
    return spark.createDataFrame([(1, RSS), (2, ATOM), (3, BROKEN), (4, None), (5, ""), (6, "no feed"), (7, "<rss><channel/></rss>")], "id int, xml string")


def test_feed_items(spark):
    from plainspoke.sources import html

    got = [tuple(r) for r in html.feed_items(feeds(spark), keep=["id"]).orderBy("id", "nth").collect()]
    assert got == [
        (1, 0, "T & x", "d in a text", "l", "9", "rss2"), (1, 2, "named", "", "", "", "rss2"), (2, 0, "A", "c", "https://a/1", "2024-01-02", "atom"),
        (3, 0, "x", "", "", "", "rss2"), (3, 3, "z", "", "", "", "rss2"),
    ]
    assert html.feed_items(feeds(spark), keep=["id"], most=1).where("id in (1, 3)").count() == 2


def test_broken_items_are_counted(spark):
    from plainspoke.sources import html

    got = {r.id: (r.items, r.broken) for r in html.feed_report(feeds(spark), "id").collect()}
    assert got == {1: (3, 0), 2: (1, 0), 3: (4, 2), 4: (0, 0), 5: (0, 0), 6: (0, 0), 7: (0, 0)}


def test_jdbc_partitions_are_disjoint_and_complete(spark, tmp_path):
    from plainspoke.sources import relational

    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url, p = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(-50, 150).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("ID"), F.concat(F.lit("it's "), F.col("id").cast("string")).alias("NAME"))
    rows.write.option("createTableColumnTypes", "NAME VARCHAR(40)").jdbc(url, "THINGS", properties=p)
    want = sorted(map(str, rows.collect()))
    for how in ({"column": "ID", "parts": 7}, {"column": "NAME", "bounds": ["it's 3", "it's 7", "it's 3"]}, {"column": "NAME", "bounds": []}, {}, {"column": "ID", "parts": 1}):
        got = relational.read_table(spark, url, "THINGS", properties=p, **how)
        assert sorted(map(str, got.collect())) == want, how
        assert got.rdd.getNumPartitions() == (7 if how.get("parts") == 7 else 3 if how.get("bounds") else 1)
    plan = relational.read_table(spark, url, "THINGS", "ID", parts=7, properties=p).where("ID > 3").select("NAME")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ID,3)" in plan and "ReadSchema: struct<NAME:string>" in plan
    rows.where("ID > 1000").write.jdbc(url, "NOTHING", properties=p)
    assert relational.read_table(spark, url, "NOTHING", "ID", parts=4, properties=p).count() == 0


def test_long_transcript_is_read_in_linear_time(spark):
    from plainspoke.sources import files

    n = 20000
    lines = ["head"] + [x for i in range(n) for x in (f"  Human: q{i}", "more", f"AI said: a{i}")]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "You: a\nb\n\n ai: \nUser said: c"), (3, None), (4, "no turns")], "doc_id int, text string")
    start = time.monotonic()
    got = files.parse_thread(df).orderBy("doc_id", "turn").collect()
    assert time.monotonic() - start < 20
    assert [(r.turn, r.role, r.text) for r in got[:2]] == [(0, "human", "q0\nmore"), (1, "ai", "a0")] and len(got) == 2 * n + 2
    assert [(r.turn, r.role, r.text) for r in got[2 * n :]] == [(0, "human", "a\nb"), (1, "human", "c")]


def test_folds_by_sql_hold_a_batch_and_equal_the_operator(spark):
    from plainspoke.operators import ordered_functions, traffic

    ordered_functions.register(spark)
    rows = spark.range(30000).select("id", F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 2 > 0, F.col("id") % 40).alias("user_id"), F.timestamp_seconds(F.hash("id") % 500).alias("ts"), F.when(F.col("id") % 50 > 0, F.hash("id") % 1000).cast("long").alias("cents"))
    got = spark.sql("SELECT * FROM accepted_charges(TABLE(SELECT id, user_id, cents, ts FROM {rows}) PARTITION BY user_id ORDER BY (ts NULLS LAST, id))", rows=rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, traffic.accepted_charges(rows).collect()))
    assert spark.sql("SELECT * FROM accepted_charges(TABLE(SELECT id, user_id, cents FROM {rows}) PARTITION BY user_id ORDER BY id)", rows=rows.where("id < 0")).count() == 0
