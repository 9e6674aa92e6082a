"""The pipeline's stages against their own decisions, on a small corpus."""

import pytest

pytest.importorskip("plainspoke.llm")
import corpus_pipeline as P  # noqa: E402
from plainspoke.llm import minhash_dedup  # noqa: E402
from plainspoke.llm.common import table, written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    assert [name for name, _ in P.STAGES] == ["language", "quality", "near_duplicates", "pii", "packing"]
    for name, stage in P.STAGES[:-1]:
        own = written(stage(spark, docs, SF), name)
        assert own.columns == columns and own.dtypes == docs.dtypes and 0 < own.count() <= before
        assert own.join(docs, "doc_id", "left_anti").count() == 0
        if name in ("language", "quality"):  # clean documents stay
            clean = docs.join(table(spark, SF, "labels").where("quality = 1"), "doc_id")
            assert clean.join(own, "doc_id", "left_anti").count() <= 0.01 * clean.count()
        if name == "near_duplicates":
            groups = minhash_dedup.near_duplicates(docs, threshold=P.SIMILAR)
            assert own.count() == groups.select("component_id").distinct().count()
        docs, before = own, own.count()
    out = P.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == before
