"""Each stage of the pipeline, and the media columns, on rows with nulls, empty and long texts, repeats, shared ids, no ids and clashing column names; and empty tables."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("plainspoke.llm")
import corpus_pipeline as P  # noqa: E402
from plainspoke.llm import ogg_media, quality  # noqa: E402
from plainspoke.llm.common import written  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _told string, _grade string, _row long, id long, text_ string"
WORDS = {"en": "the and with there only from house water river stone green small under".split(), "de": "der und nicht über straße schön zwischen haus grün wasser klein unter".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, "en" if i % 2 else "de", rng.randint(30, 80)), "en" if i % 2 else "de") for i in range(60)]
    long = prose(rng, "en", 9000)
    extra = [(60, None, None), (61, "", None), (62, "½ 12", None), (63, long, "en"), (5, prose(rng, "en", 50), "en"), (5, out[8][1], "de"), (None, prose(rng, "en", 45), "en"), (None, out[9][1].upper(), None), (7, out[7][1], "en"), (64, out[7][1] + " mail ab@mail.example.com", "en")]
    return out + extra


@pytest.fixture(scope="module")
def docs(spark, rows):
    return written(spark.createDataFrame([(i, t, lang, "s", None, "a", "b", 1, 2, "c") for i, t, lang in rows], SCHEMA).repartition(3), "rows")


def texts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text if r.text is not None else "<null>") for r in df.collect())


def test_language_and_quality(spark, docs, rows):
    own = written(P.language(spark, docs, None), "own")
    assert own.columns == docs.columns and own.dtypes == docs.dtypes
    kept = texts(own)
    assert all(t not in ("<null>", "", "½ 12") for _, t in kept) and len(kept) >= len(rows) - 3 - 3
    good = written(P.good_quality(spark, docs, None), "good")
    assert good.columns == docs.columns and not {"<null>", ""} & {t for _, t in texts(good)} and good.count() >= len(rows) - 6


def test_near_duplicates(spark, docs, rows):
    own = P.near_duplicates(spark, docs, None)
    left = texts(own)
    by = dict((i, t) for i, t, _ in rows[:60])
    gone = [(-1, by[9].upper()), (7, by[7]), (64, by[7] + " mail ab@mail.example.com"), (8, by[8])]  # a copy of 9, a copy of 7, one near it; 8 has a copy with id 5
    want = texts(docs)
    for row in gone:
        want.remove(row)
    assert own.columns == docs.columns and left == want


def test_personal_data_and_packing(spark, docs, rows):
    own = written(P.personal_data(spark, docs, None), "own")
    assert own.columns == docs.columns and own.count() == len(rows)
    got = {r.doc_id: r for r in own.collect() if r.doc_id in (60, 61, 64)}
    assert got[60].text is None and got[60].n_chars is None and got[61].n_chars == 0 and got[64].text.endswith("mail <EMAIL>") and got[64].n_chars == len(got[64].text)
    packed = P.packed(spark, docs, None).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and sum(r.length for r in packed if r.doc_id == 60) == 1


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_empty_tables(spark, docs, name):
    none = docs.where("false")
    out = dict(P.STAGES)[name](spark, none, None)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_grades_against_plain_python(spark, docs):
    labels, scorer = quality.fitted(docs)
    words = quality.Cache(quality.plain)
    for r in docs.select("text", quality.graded(labels, scorer, F.col("text")).alias("g")).collect():
        votes = [vote(quality.measures(r.text or "", words)) for vote in quality.LABELLERS.values()]
        assert r.g.votes == sum(v * 3**i for i, v in enumerate(votes))
        odds = labels.prior / (1 - labels.prior)
        for v, right in zip(votes, labels.right, strict=True):
            odds *= {0: right / (1 - right), 1: (1 - right) / right, 2: 1}[v]
        assert abs(r.g.p_good - odds / (1 + odds)) < 1e-9 and abs(r.g.score - scorer.score(r.text or "")) < 1e-9
        assert r.g.good == ((r.g.p_good + r.g.score) / 2 >= 0.5)


def test_media_columns(spark, docs):
    got = docs.select("text", ogg_media.stored(F.col("text")).alias("_m")).select("text", "_m", ogg_media.probed(F.col("_m")).alias("p")).collect()
    seen = {}
    for r in got:
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.p.payload_bytes, r.p.payload_sha256, r.p.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.p.media_bytes, r.p.media_sha256) == (len(r._m), hashlib.sha256(r._m).hexdigest())
        assert seen.setdefault(payload, r.p) == r.p
    bad = spark.createDataFrame([(None,), (b"",), (b"OggS" + bytes(40),)], "m binary").select(ogg_media.probed(F.col("m")).alias("p")).collect()
    assert all(r.p is None or r.p.payload_bytes is None for r in bad) and docs.where("false").select(ogg_media.stored(F.col("text"))).count() == 0
