"""The registered queries of the training-data operators, as the driver calls them, over whole small tables; SQL where there is some."""

import os

import duckdb
import pytest

pytest.importorskip("plainspoke.llm")
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score", "op2_embedding_dedup": "vec_id n_links component_id kept", "op3_license_scan": "doc_id digest license notices", "op4_minhash_dedup": "doc_id n_shingles component_id kept",
    "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op6_quality": "doc_id votes p_good score good", "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op10_ogg_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op11_toxicity": "doc_id held_out score predicted", "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13_collocations": "lang rank phrase a l r n score",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_op(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    table, key = {"op2": ("embeddings", "vec_id"), "op7": ("pages", "page_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    if name == "op13_collocations":
        assert rows and {r.lang for r in rows} <= {r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().collect()}
    ids = [r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()]
    assert name == "op13_collocations" or {r[key] for r in rows} == set(ids) and (len(rows) == len(ids) or name == "op5_packing")
    sql = entry.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
        got = c.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, ({k: r[k] for k in sorted(names)} for r in rows))) == sorted(map(repr, ({k: x for k, x in sorted(zip(names, t, strict=True))} for t in got.fetchall())))


def test_registry_names_all():
    assert {n for n in entry.queries() if n.startswith("op")} >= set(COLUMNS) and "pipeline" in entry.queries()
