"""The language stage rejects letters that are no language and keeps clean documents."""

import random
import string

import pytest

pytest.importorskip("plainspoke.llm")
import corpus_pipeline as P  # noqa: E402
from plainspoke.llm.common import table, written  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_random_letters_go(spark):
    rng = random.Random(1)
    docs = table(spark, SF, "documents")
    junk = [(-1 - i, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 10))) for _ in range(100))) for i in range(100)]
    more = docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string"), allowMissingColumns=True).select(*docs.columns)
    kept = written(P.language(spark, more, SF), "kept")
    assert kept.where("doc_id < 0").count() <= 50
    clean = table(spark, SF, "labels").where(F.col("quality") == 1).join(docs, "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.01 * clean.count()
