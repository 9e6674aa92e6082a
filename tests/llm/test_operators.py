"""The operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import byte_bpe, common, embedding_dedup, language_id, license_scan, minhash_dedup, packing, pii, quality, warc  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, _h string, rep long, id long"
WORDS = {"en": "the and with there only from house water river stone green".split(), "de": "der und nicht über straße schön zwischen haus grün wasser".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, prose(rng, "de" if i % 3 == 0 else "en", rng.randint(5, 120))) for i in range(150)]
    for i in range(150, 190):  # near copies of a few long texts
        words = out[i % 4][1].split() * 3
        words[rng.randrange(len(words))] = f"x{i}"
        out.append((i, " ".join(words)))
    out += [(190, None), (191, ""), (192, " \n\t "), (193, "one two"), (194, "ONE\ttwo"), (195, out[5][1]), (196, out[5][1].upper()), (197, "12 + 34"), (198, "y" * 30_000), (199, prose(rng, "en", 9000)), (5, out[5][1]), (200, "<|endoftext|> a  b"), (201, "mail ab1@mail.example.com or +1 (678) 555-5272, 4539578763621486; 192.0.2.1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "de" if i % 3 == 0 and i < 150 else "en" if i < 150 else None, None, None, "x", 1, 2) for i, t in rows], DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert all(got[k] == v for k, v in want.items() if k in got) and all(k in got or v == k for k, v in want.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, rows, none):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closure(ids, links)
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and len(links) > 20
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_large_groups_meet_in_chunks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BUCKET", 4)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 500)
    test_near_duplicates(docs, rows, docs.limit(0))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sk = minhash_dedup.sketches([np.unique(a), np.unique(b), a[:1], a[:1]])
    assert abs((sk[0] == sk[1]).mean() - 0.6) < 0.15 and (sk[2] == sk[3]).all() and (sk != np.uint64(2**64 - 1)).all()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = [(centres[i % 6] + rng.normal(size=16) * (0.25 if i % 2 else 0.12)).astype(np.float32).tolist() for i in range(160)]
    x[7], x[8], x[9], x[10] = x[6], x[6], [2 * v for v in x[6]], [0.0] * 16
    odd = [None, [], [float("nan")] * 16, [1.0, None] * 8, [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [float("inf")] + [0.0] * 15]
    every = [*x, *odd]
    df = spark.createDataFrame(list(enumerate(every)), "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    vec = {i: np.array(v, float) for i, v in enumerate(every) if v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(vec)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]) >= 0.95]
    want = closure(range(len(every)), links)
    for chunk in (16384, 20):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, chunk=chunk, blocks=4, pivots=5).collect()}
        assert len(got) == len(every) and len(links) > 100
        for i, r in got.items():
            assert (r.n_links, r.component_id, r.kept) == (sum(i in e for e in links), want[i], want[i] == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_gradients_are_those_of_the_loss():
    net = language_id.ByteGru(["a", "b"], hidden=3)
    rng = np.random.default_rng(4)
    x, y = rng.integers(97, 110, (7, 5)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    _, g = net.gradients(x, y)
    for k in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[k].shape) if not k.startswith("e") else (int(x[2, 1]), 4)
        keep, out = net.p[k][at], []
        for step in (1e-2, -1e-2):
            net.p[k][at] = keep + step
            out.append(net.gradients(x, y)[0])
        net.p[k][at] = keep
        assert abs((out[0] - out[1]) / 2e-2 - g[k][at]) < 2e-3


def test_language(docs, rows, none, monkeypatch):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    right = [got[i].lang_pred == ("de" if i % 3 == 0 else "en") for i in range(150) if got[i].held_out]
    assert sum(right) / len(right) > 0.9
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (190, 191, 192, 197)) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert language_id.identify(none).count() == 0


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(packing.tokenised(docs)).collect()
    ids = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    seen = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == r.length <= 1024
        assert r.piece == 0 or r.length == 1024
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in rows)
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seen) <= -(-sum(r.length for r in got) // 1024) + 3
    assert packing.packed(packing.tokenised(none)).count() == 0


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(5)
    hist = np.bincount(np.r_[rng.integers(1, 1025, 5000), [1024] * 300, [17] * 2000], minlength=1025)
    left = hist.copy()
    for lengths, k in packing.plan(hist):
        assert sum(lengths) <= 1024 and k > 0
        for n in lengths:
            left[n] -= k
    assert not left.any()


def test_bpe_equals_tiktoken(docs, rows, none):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by = dict(rows)
    for r in docs.select("doc_id", byte_bpe.digests(F.col("text")).alias("d")).collect():
        text = by[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert tuple(r.d) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rng = random.Random(6)
    own = byte_bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    alphabet = [chr(c) for c in range(0x250)] + list("     \n\taabbthe") + ["字", "😀", " ", "'s"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == enc.encode_ordinary(text), text
    assert none.select(byte_bpe.digests(F.col("text"))).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 500_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i} \r\n", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    path = warc.written_archive(warc.records(pages))
    read = spark.read.format("warc").load(path)
    got = {r.record_id.split(":")[-1]: r for r in read.collect()}
    assert len(got) == 7
    for i, h in enumerate(html):
        raw = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        r = got[str(i)]
        assert (r.record_type, r.payload_bytes, r.payload_digest) == ("response" if last == i else "revisit", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.refers_to == (None if last == i else f"urn:x-page:{last}") and r.payload == (raw if last == i else None)
    assert read.where("record_type = 'revisit'").count() == 3 and read.where("record_id in ('urn:x-page:1', 'urn:x-page:9')").count() == 1
    empty = warc.written_archive(warc.records(pages.limit(0)))
    assert spark.read.format("warc").load(empty).count() == 0


def test_warc_members_are_plain_gzip_and_damage_is_found():
    import gzip

    raw = warc.record("urn:x-page:1", "response", "http://x/", b"payload")
    packed = warc.member(raw)
    assert gzip.decompress(packed) == raw
    both = gzip.compress(raw) + packed  # a member without a stated length first
    assert [p for _, p in warc.scan(both, lambda h: True, True)] == [b"payload"] * 2
    assert [p for _, p in warc.scan(both, lambda h: False, True)] == []
    with pytest.raises(warc.BadArchive):
        list(warc.scan(packed[:-20], lambda h: True, True))
    with pytest.raises(warc.BadArchive):
        list(warc.scan(warc.member(raw.replace(b"payload\r\n\r\n", b"pbyload\r\n\r\n")), lambda h: True, True))


def test_pii_columns(docs, none):
    got = {r.doc_id: r for r in docs.select("doc_id", pii.found(pii.train(docs), F.col("text")).alias("f")).collect()}
    assert [s.kind for s in got[201].f.base] == ["email", "phone", "card", "ip"] and got[190].f.base == []
    assert docs.where("doc_id = 201").select(pii.redacted(None, F.col("text")).alias("t")).first().t == "mail <EMAIL> or <PHONE>, <CARD>; <IP>"
    assert none.select(pii.found(pii.train(none), F.col("text"))).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(8)
    good = [(i, prose(rng, "en", 60)) for i in range(200)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, "en", 60).split())) for i in range(30)] + [(230 + i, " | ".join(prose(rng, "de", 40).split())) for i in range(30)]
    df = spark.createDataFrame([*good, *bad, (300, None), (301, "")], "doc_id long, text string")
    got = {r.doc_id: r.g for r in df.select("doc_id", quality.graded(*quality.fitted(df), F.col("text")).alias("g")).collect()}
    assert all(got[i].good for i, _ in good) and not any(got[i].good for i, _ in bad) and not got[300].good and not got[301].good
    assert none.select(quality.graded(*quality.fitted(none), F.col("text"))).count() == 0


def test_accuracies_are_estimated():
    rng = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.85, 0.8])
    good = rng.random(20_000) < 0.8
    votes = np.where(rng.random((20_000, 8)) < right, ~good[:, None], good[:, None]).astype(int)
    codes, n = np.unique(votes @ 3 ** np.arange(8), return_counts=True)
    model = quality.WeakLabels(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    assert np.abs(model.right - right).max() < 0.05 and abs(model.prior - 0.8) < 0.05


def test_licences(spark, none):
    texts = ["Released under the MIT License.", "  released UNDER the mit licence ", "some prose\nLicensed under CC BY-NC 4.0.\nmore", None, "", "Copyright (c) 2020 A\n" + license_scan._ISC.replace(",", " ,"), license_scan._ISC + " x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit("z")).withColumn("digest", F.lit("z"))
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scan(df).collect()}
    assert got == {0: ("MIT", ["MIT"]), 1: ("MIT", ["MIT"]), 2: (None, ["CC-BY-NC-4.0"]), 3: (None, []), 4: (None, []), 5: ("ISC", []), 6: (None, [])}
    assert license_scan.scan(none).count() == 0


def test_ids_that_repeat_and_rows_without_id(spark):
    base = [f"w{i}" for i in range(60)]
    text, near, far = " ".join(base), " ".join([*base, "more"]), " ".join(f"z{i}" for i in range(60))
    rows = [(1, text), (5, near), (5, far), (6, far + " "), (7, "q"), (None, near.upper()), (None, "only here"), (None, None), (7, None), (7, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("_row", F.lit(2))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    want = [("1", 56, "1", True), ("5", 57, "1", False), ("5", 56, "5", True), ("6", 56, "5", False), ("7", 1, "7", True), ("7", 1, "7", True), ("7", 0, "7", True), ("None", 57, "1", False), ("None", 1, "None", False), ("None", 0, "None", False)]
    assert got == sorted(want)
    left = minhash_dedup.survivors(df, threshold=0.8)
    assert left.columns == df.columns and sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted([("1", text), ("5", far), ("7", "q"), ("None", "only here"), ("None", "None"), ("7", "None")])


@pytest.mark.parametrize("shape", ["star", "chain", "none"])
def test_large_groups_lose_no_link(spark, monkeypatch, shape):
    """Groups dealt into cells with pivots: near copies of one text, a chain in which only neighbours are linked, and texts that share a bucket but no link."""
    monkeypatch.setattr(minhash_dedup, "BUCKET", 4)
    monkeypatch.setattr(minhash_dedup, "CHUNK", 600)
    monkeypatch.setattr(minhash_dedup, "LOOSE", 3)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    if shape == "star":
        texts = [" ".join([*words[:100], f"x{i}"]) for i in range(60)]
    elif shape == "chain":
        texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(60)]
    else:
        texts = [" ".join([*words[:70], *(f"y{i}x{j}" for j in range(40 + rng.randrange(3)))]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(range(len(sets)), links)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, threshold=0.8).collect()} == want


def test_warc_filters_are_pushed_and_payloads_left_alone(spark, tmp_path):
    """Predicates on headers are taken by the reader, and a record that fails them, or whose payload no column needs, may hold any payload."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith
    from pyspark.sql.types import _parse_datatype_string as parse

    good = [warc.member(warc.record(f"urn:x-page:{i}", "revisit" if i % 2 else "response", f"http://x/{i}", b"payload %d" % i, "urn:x-page:0")) for i in range(6)]
    raw = warc.record("urn:x-page:9", "response", "http://x/9", b"p" * 5000)
    broken = warc.member(raw.replace(b"p" * 100 + b"\r\n\r\n", b"q" * 100 + b"\r\n\r\n"))  # its digest doesn't match
    (tmp_path / "part-a.warc.gz").write_bytes(b"".join([*good, broken]))
    (tmp_path / "manifest.json").write_text('[["part-a.warc.gz", 1]]')
    schema = parse("record_id string, payload binary")
    tests = [EqualTo(("record_type",), "revisit"), In(("record_id",), ("urn:x-page:1", "urn:x-page:3", "urn:x-page:4")), StringStartsWith(("target_uri",), "http://x/"), GreaterThan(("payload_bytes",), 3)]
    reader = warc.WarcReader(str(tmp_path), schema, 1 << 20)
    assert list(reader.pushFilters(tests)) == [tests[3]] and len(reader.tests) == 3
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in rows) == ["urn:x-page:1", "urn:x-page:3"]
    heads = warc.WarcReader(str(tmp_path), parse("record_id string, payload_digest string"), 1 << 20)
    assert len([r for p in heads.partitions() for b in heads.read(p) for r in b.to_pylist()]) == 7
    with pytest.raises(warc.BadArchive):
        whole = warc.WarcReader(str(tmp_path), schema, 1 << 20)
        list(b for p in whole.partitions() for b in whole.read(p))
    warc.register(spark)
    plan = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'revisit'").select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "record_type = revisit" not in plan.split("BatchScan")[0]  # nothing is left for Spark to filter


def test_language_letters(spark):
    texts = ["½ ² 12", "Ⅷ", "① ②", "٣٤", "word", "字", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = language_id.ByteGru(["a", "b"])
    got = [r.p.lang_pred for r in df.select("doc_id", language_id.predict(net, F.col("text")).alias("p")).orderBy("doc_id").collect()]
    assert got[:4] == ["und"] * 4 and "und" not in got[4:]


def test_models_leave_a_worker_one_at_a_time():
    made = []
    for key in ("a", "b", "b", "a"):
        common.resident(key, lambda: made.append(key) or object())
    assert made == ["a", "b", "a"] and len(common._resident) == 1
    assert list(common.lean(iter([1, 2]))) == [1, 2] and not common._resident
    cache = common.Cache(lambda x: x.encode(), limit=2000)
    assert [cache[str(i)] for i in range(100)] == [str(i).encode() for i in range(100)] and len(cache) < 15


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else 1 if i % 2 else i % 5) for i in range(300)], "id long, k long")
    named = common.written(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10).where("k <> 3"), "named")
    got = sorted(((r.id, r.k, r.v) for r in common.joined_hot(rows, named, ["k"], "n").collect()), key=repr)
    assert got == sorted(((r.id, r.k, None if r.k in (None, 3) else r.k * 10) for r in rows.collect()), key=repr)
    assert common.joined_hot(rows, named.where("false"), ["k"], "n").where("v is not null").count() == 0


def test_samples_are_bounded_and_never_empty(spark):
    same = spark.createDataFrame([(None, "x")] * 500, "id long, t string")
    assert [r.t for r in common.bounded_sample(same, 10, ["id", "t"], F.col("t"))] == ["x"] * 10
    rows = spark.createDataFrame([(i, str(i)) for i in range(5000)], "id long, t string")
    a = [r.t for r in common.bounded_sample(rows.repartition(3), 40, ["id", "t"], F.col("t"))]
    assert len(a) == 40 and a == [r.t for r in common.bounded_sample(rows.repartition(7), 40, ["id", "t"], F.col("t"))]
    assert common.bounded_sample(rows.where("false"), 40, ["id"], F.col("t")) == []
