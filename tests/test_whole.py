"""Whole jobs: nothing is cut, dropped or held in one task's memory."""

import random

from plainspoke import cases
from plainspoke.operators import audit, tables, texts, traffic


def test_entity_pieces_keep_whole_texts(spark):
    rows = [(i, None if i % 11 == 0 else "ab"[i % 2], i % 5, "é" * (i % 40) if i % 7 else None) for i in range(3000)] + [(None, "a", None, "x" * 50), (None, "a", None, "w"), (7, "b", 2, "copy"), (7, "b", 2, "copy")]
    df = spark.createDataFrame(rows, "id long, entity string, page long, raw_text string").repartition(3)
    low = lambda v: (v is not None, v if v is not None else 0)
    want = []
    for entity in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == entity), key=lambda r: (low(r[2]), low(r[0]), r[3] is not None, r[3] or ""))
        chars = sum(len(r[3] or "") for r in own)
        want += [(entity, n, r[2], r[0], f"{'' if r[2] is None else r[2]}\n{r[3]}" if r[3] is not None else None, len(own), chars) for n, r in enumerate(own, 1)]
    got = [tuple(r) for r in tables.entity_pieces(df, 100).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tables.entity_pieces(df.where("false")).count() == 0


def test_acronyms_of_all_documents(spark, tmp_path):
    texts = ["Die NATO über EU, ÄRZTE und ABÄ; A_B ÜBER", "tab\tUNO – WHO", "ILO (ILO) ABCDEFG A1 X", None, "plain UN\nOECD", "É NASAé EFTA", "e\u0301 CD\u0301 GH"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, cases.queries()["d22_undefined_acronyms"](spark, str(tmp_path)).collect()))
    assert got == [(0, "EU"), (0, "NATO"), (1, "UNO"), (1, "WHO"), (4, "OECD"), (4, "UN"), (5, "EFTA"), (6, "GH")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, audit.undefined_acronyms(df).collect())) == got


def test_folds_keep_a_batch_not_a_group(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else 1 if i % 3 else i % 5, rng.randrange(500), rng.choice([None, *range(-60, 61)])) for i in range(4000)]
    ledger = spark.createDataFrame(rows, "id long, user_id long, ts long, cents long").repartition(5)
    threads = spark.createDataFrame([(u, i, "é" * abs(c or 0)) for i, u, _, c in rows], "conv_id long, turn long, text string").repartition(5)
    taken, relays, state = [], [], {}
    for i, u, _, c in sorted(rows, key=lambda r: (r[2], r[0])):
        ok = c is not None and state.get(u, 0) + c >= 0
        state[u] = state.get(u, 0) + (c if ok else 0)
        taken.append((i, u, c, ok, state[u]))
    state = {}
    for i, u, _, c in rows:
        relay, chars = state.get(u, (1, 0))
        relays.append((u, i, relay, chars := chars + abs(c or 0)))
        state[u] = (relay + 1, 0) if chars >= 300 else (relay, chars)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key goes over many batches
    try:
        got = traffic.accepted_charges(ledger), texts.relay_numbers(threads, 300)
        for df, want in zip(got, (taken, relays), strict=True):
            assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
            assert "InPandas" not in df._jdf.queryExecution().toString() and "MapInArrow" in df._jdf.queryExecution().toString()
            assert df.where("false").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
