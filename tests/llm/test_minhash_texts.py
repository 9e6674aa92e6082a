"""Which texts move: those of families and few others; one copy a task of a row that is repeated very often."""

import random
import time

import pytest

pytest.importorskip("plainspoke.llm")
from pyspark.sql import functions as F  # noqa: E402

from plainspoke.llm import minhash_dedup  # noqa: E402
from plainspoke.llm.common import written  # noqa: E402


def test_only_wanted_texts_move(spark):
    own = spark.range(20000, numPartitions=6).select(F.xxhash64("id").alias("at"), F.concat(F.lit("t"), "id").alias("_text"))
    rows = own.unionByName(spark.range(9000, numPartitions=3).select(F.xxhash64(F.lit(77)).alias("at"), F.lit("t77").alias("_text")))
    wanted = own.where(F.substring("_text", 2, 9).cast("long") % 400 == 77)
    got = minhash_dedup._texts_of(wanted.select("at"), rows.select("at"), rows).collect()
    want = {r.at for r in wanted.collect()}
    assert want <= {r.at for r in got} and len({r.at for r in got} - want) < 20
    assert sum(r._text == "t77" for r in got) == 1 and len(got) < 100


def test_a_third_of_the_rows_is_one_row(spark):
    words = [f"w{i}" for i in range(300)]
    near = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in (50, 150)]
    rows = [(7, " ".join(words))] * 400 + [(3, near[0]), (9, near[1])] + [(100 + i, f"other {i} " * 4) for i in range(500)] + [(None, near[0]), (5, None)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (3, 7, 9)} == {3} and sum(r.kept for r in got) == 1 + 500 + 1


def shuffled(spark) -> int:
    """Bytes that the session's tasks have written to shuffles so far."""
    time.sleep(1)  # the store follows the tasks
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))


def test_texts_of_single_documents_stay(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(400)) for _ in range(2000)]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(5000 + i, texts[i], "copy") for i in range(20)] + [(6000 + i, texts[50 + i] + " end", "near") for i in range(20)] + [(7000, None, "none"), (None, texts[60], "copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_block` string").repartition(6)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a corpus that is too large to be broadcast
    try:
        docs = written(docs, "docs")
        before = shuffled(spark)
        left = written(minhash_dedup.survivors(docs, threshold=0.8), "left")
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text, r["_block"]) for r in left.collect()) == sorted(rows[:2000] + rows[-2:-1], key=lambda r: r[0])
    assert moved < 0.5 * sum(len(t) for t in texts), moved


def test_parted_keeps_every_wanted_row(spark):
    rows = spark.range(30000, numPartitions=5).withColumn("key", F.concat(F.lit("k"), "id")).withColumn("_h", F.lit("mine"))
    wanted = rows.where("id % 100 = 7")
    may, others = minhash_dedup._parted(rows, "key", wanted.select("key"))
    assert may.columns == others.columns == rows.columns
    got = [r.id for r in may.collect()]
    assert set(range(7, 30000, 100)) <= set(got) and len(got) < 320
    assert sorted(got + [r.id for r in others.collect()]) == list(range(30000))
    none, all_ = minhash_dedup._parted(rows, "key", wanted.where("false").select("key"))
    assert none.count() == 0 and all_.count() == 30000
