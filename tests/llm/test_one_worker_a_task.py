"""A task of a fit uses one Python worker: each further one would stay in the executor's pool for all later stages."""

import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import common, quality  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def test_quality_sample(spark, monkeypatch):
    plans = []

    def noted(df, rows, keys, *cols):
        plans.append(df.select(*cols)._jdf.queryExecution().executedPlan().toString())
        got.extend(common.bounded_sample(df, rows, keys, *cols))
        return got

    got = []
    monkeypatch.setattr(quality, "bounded_sample", noted)
    texts = ["the house and the river were green " * 5, "BUY NOW ! ! ! $$$ " * 9, "a | b | c | d | e", "½ 12"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, ""), (8, None)], "doc_id long, text string")
    quality.fitted(docs)
    assert [p.count("ArrowEvalPython") for p in plans] == [1]
    known, words = common.Cache(quality.buckets), common.Cache(quality.plain)
    f = [quality.hashed(t, known) for t in texts]
    assert sorted((bytes(r.s.f), bytes(r.s.v), r.s.again, r.s.votes) for r in got) == sorted((a.astype("<i4").tobytes(), b.astype("<f4").tobytes(), c, quality.pattern(t, words)) for (a, b, c), t in zip(f, texts, strict=True))


def test_sample_of_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    nothing = quality.pattern(None, common.Cache(quality.plain))
    assert [tuple(r) for r in df.select(quality.samples(F.col("t")).alias("s")).select("s.*").collect()] == [(b"", b"", 0.0, nothing)] * 2
