"""Fits and scores read whole texts and whole words: what stands at the very end of 20,000 words counts."""

import numpy as np
import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import common, language_id, pii, quality  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

LONG = "word " * 20_000


def test_quality_learns_and_scores_the_end(spark):
    known = common.Cache(quality.buckets)
    (a, va, _), (b, vb, _) = quality.hashed(LONG, known), quality.hashed(LONG + "Zz9", known)
    assert set(b.tolist()) - set(a.tolist()) and va.sum() == pytest.approx(2) == vb.sum()
    assert quality.buckets("a" * 100 + "9")[0] != quality.buckets("a" * 100)[0]
    df = spark.createDataFrame([(1, LONG), (2, LONG + "Zz9"), (3, None), (4, "")], "doc_id int, t string")
    got = {r.doc_id: (r.s.f, r.s.v) for r in df.select("doc_id", quality.samples(F.col("t")).alias("s")).collect()}
    assert got[1] != got[2] and got[3] == got[4] == (b"", b"")


def test_language_draws_windows_from_the_end():
    raw = b"a" * 200_000 + b"z" * 200_000
    x, y = language_id.windows([raw, b"short text of its own, padded"], np.array([0, 1]), 4000)
    assert set(y.tolist()) == {0, 1} and 0.4 < (x[y == 0] == ord("z")).mean() < 0.6 and bytes(x[1]).startswith(b"short text")


def test_pii_learns_from_the_end(spark):
    rows = [(i, LONG + f" call +49 30 12345{i} now") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.train(docs)
    assert field is not None and np.abs(field.w).sum() > 0
    got = docs.select(pii.found(field, F.col("text")).alias("f")).select("f.*").collect()
    assert all(r.settled and [s.kind for s in r.base] == ["phone"] for r in got)


def test_samples_are_the_smallest_hashes_at_every_size(spark):
    """One path: repeated ids neither shrink a sample nor change how it is chosen."""
    for n in (5, 50, 3000):
        df = spark.range(n).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("x"))
        got = common.bounded_sample(df, 40, ["doc_id"], F.col("x").alias("x"))
        assert len(got) == min(n, 40)
    whole = common.bounded_sample(spark.range(3000).repartition(7), 40, ["id"], F.col("id").alias("x"))
    assert [r.x for r in whole] == [r.x for r in common.bounded_sample(spark.range(3000), 40, ["id"], F.col("id").alias("x"))]
    assert common.bounded_sample(spark.range(0), 40, ["id"], F.col("id").alias("x")) == []
