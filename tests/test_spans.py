"""Spans and their resolution against plain Python, lexicons in SQL, redaction and enforcement by hand, normal forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plainspoke.functions import text as T
from plainspoke.operators import cleaning, lenses, spans, tables, texts
from plainspoke.sources import files

RULES = [("a", "one|two", 2), ("b", "two three", 3), ("c", "[a-z]+ee", 1), ("d", "three [a-z]+ one", 4)]


def span(text):
    """Spans written as "start-end name priority", comma-joined."""
    parts = [x.split() for x in text.split(", ") if x]
    return [(*map(int, a.split("-")), n, int(k)) for a, n, k in parts]


#: (found, resolved, merged), worked out by hand.
BY_HAND = [
    ("", "", ""),
    ("0-3 a 1, 5-8 b 1", "0-3 a 1, 5-8 b 1", "0-3 a 1, 5-8 b 1"),
    ("0-3 a 1, 3-6 b 9", "0-3 a 1, 3-6 b 9", "0-3 a 1, 3-6 b 9"),
    ("0-4 a 2, 2-6 b 2", "0-4 a 2", "0-4 a 2"),
    ("0-4 a 2, 2-6 b 3", "2-6 b 3", "2-6 b 3"),
    ("0-4 a 2, 2-8 b 2", "0-4 a 2", "2-8 b 2"),
    ("0-4 a 1, 0-4 b 1, 0-6 c 1", "0-6 c 1", "0-6 c 1"),
    ("0-9 a 1, 1-2 b 2, 4-5 c 2", "1-2 b 2, 4-5 c 2", "1-2 b 2, 4-5 c 2"),
    ("0-3 a 1, 4-7 b 3, 2-5 c 2", "4-7 b 3", "4-7 b 3"),
    ("0-3 a 3, 2-6 b 1, 5-9 c 1", "0-3 a 3, 5-9 c 1", "0-3 a 3, 5-9 c 1"),
]


def test_resolution_by_hand(spark):
    df = spark.createDataFrame([(i, [tuple(s) for s in span(f)]) for i, (f, _, _) in enumerate(BY_HAND)], "i int, s array<struct<start:int,end:int,signal:string,priority:int>>")
    got = df.select("i", spans.resolved(F.col("s")).alias("r"), spans.merged(F.col("s")).alias("m")).orderBy("i").collect()
    for r, (f, resolved, merged) in zip(got, BY_HAND, strict=True):
        assert (f, sorted(map(tuple, r.r))) == (f, sorted(span(resolved))) and (f, sorted(map(tuple, r.m))) == (f, sorted(span(merged)))


def test_spans_and_what_resolution_promises(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "tree", "four"]) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "ONE éone")]
    df = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", "text", spans.found(F.col("text"), RULES).alias("s"))
    for r in df.select("text", "s", spans.resolved(F.col("s")).alias("r"), spans.merged(F.col("s")).alias("m")).collect():
        every = {(m.start(), m.end(), n, k) for n, p, k in RULES for m in re.finditer(p, (r.text or "").lower())}
        assert {tuple(s) for s in r.s} == every and len(r.s) == len(every)
        kept = [tuple(s) for s in r.r]
        assert set(kept) <= every and kept == sorted(kept) and all(a[1] <= b[0] for a, b in zip(kept, kept[1:], strict=False))
        assert {tuple(s) for s in r.m} <= every and bool(r.m) == bool(every) == bool(kept)


def test_lexicon_in_sql(spark):
    spans.register_lexicon_sql(spark, {"hedge": ["may", "it's"]})
    r = spark.sql("SELECT has_hedge('It''s a Day') AS a, hits_hedge('maybe it''s') AS b, has_hedge('no') AS c").first()
    assert tuple(r) == (True, 2, False)
    spans.register_udtf(spark, RULES)
    got = spark.sql("SELECT s.start, s.signal FROM VALUES ('one two') AS t(x), LATERAL signal_spans(t.x) s ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [(0, "a"), (4, "a")]


def test_redaction_and_enforcement(spark):
    rows = [(1, "Mail 123-45-6789 now! You were late. Pay 1234 5678 9012 3456, 1234567890123456."), (2, None), (3, "ok A12345678 x123-45-6789")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in cleaning.redacted(df).collect()}
    assert got[1].text_out == "Mail [SSN] now! You were late. Pay [CARD], [CARD]." and [tuple(a) for a in got[1].actions] == [("SSN", 1), ("CARD", 2)]
    assert got[2].text_out == "" and got[3].text_out == "ok [PASSPORT] x123-45-6789"
    hits = sorted(tuple(r) for r in cleaning.personal_hits(df).collect())
    assert hits == [(1, "CARD", 0, "1234 5678 9012 3456"), (1, "CARD", 1, "1234567890123456"), (1, "SSN", 0, "123-45-6789"), (3, "PASSPORT", 0, "A12345678")]
    policy = {"level": 4, "blame": "you were", "blocked": ["late", "pay"], "max_length": 4, "compression": 2, "next_step": "please"}
    out = {r.doc_id: r for r in cleaning.enforced(df, policy).collect()}
    assert out[1].text_out == "Mail [SSN] [NEXT STEP?]"
    assert [tuple(a) for a in out[1].actions] == [(0, "redacted SSN", 1), (0, "redacted CARD", 2), (1, "blame dropped", 1), (1, "exclamations removed", 1), (2, "blocked pay", 1), (2, "trimmed", 2), (3, "compressed", 2), (4, "next step asked for", 1)]
    assert [tuple(a) for a in out[2].actions] == [(4, "next step asked for", 1)]


def test_plain_unicode(spark):
    df = spark.createDataFrame([("a​b — ﬁ  x",), (None,), ("plain",)], "t string")
    assert [r.x for r in df.select(T.plain_unicode(F.col("t")).alias("x")).collect()] == ["ab - fi  x", None, "plain"]


def test_entrenched_claims(spark):
    a, b = "alpha bravo charlie delta eagle.", "alpha bravo charlie delta foxes."
    rows = [(1, 0, "assistant", a), (1, 1, "user", a), (1, 2, "assistant", b), (1, 3, "assistant", "other words entirely here."), (1, 4, "assistant", a + " " + b), (2, 0, "assistant", a), (2, 1, "assistant", None)]
    got = {(r.conv_id, r.turn): r.streak for r in texts.entrenched_claims(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {(1, 2): 1, (1, 4): 2}


def test_corporate_score_prefers_specific_texts(spark):
    from plainspoke.cases_corporate import WORDS
    from plainspoke.operators import corporate

    words = WORDS | {"commit": ["ships"], "aspire": ["hopes"], "claim": ["we care"], "what": ["builds"], "whom": ["for growers"], "generic": ["best of all worlds"], "hedge": ["perhaps"]}
    rows = [(1, "The plant builds 40 pumps for growers each week in 2024. It ships 12 of them to 3 countries on time."), (2, "We care about every voice, perhaps. The team hopes to be the best of all worlds for each of us."), (3, "short"), (4, None)]
    got = {r.doc_id: r for r in corporate.scored(corporate.dimensions(spark.createDataFrame(rows, "doc_id int, text string"), words)).collect()}
    assert got[1].score > got[2].score and all(0 <= r.score <= 1000 for r in got.values())
    assert (got[3].label, got[4].label, got[3].score) == ("INSUFFICIENT", "INSUFFICIENT", 0)


def test_files_and_stores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("plain é")
    (tmp_path / "in/b.HTML").write_text("<p>x &amp; y</p>")
    (tmp_path / "in/c.bin").write_text("no")
    (tmp_path / "in/d.md").write_text("z" * 50_001)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_texts(spark, str(tmp_path / "in")).collect()}
    assert {k: (len(r.text), r.cut) for k, r in got.items()} == {"a.txt": (7, False), "b.HTML": (5, False), "d.md": (50_000, True)} and got["b.HTML"].text == "x & y"
    (tmp_path / "t.jsonl").write_text('{"request_id":"r1","status":"COMPLETE","iterations":2,"token_estimate_saved":7,"ai_calls":[{"iteration":1,"tokens_in":3,"tokens_out":4},{"iteration":2,"tokens_in":5,"tokens_out":6}]}\n{"request_id":"r2","status":"INIT"}\nbroken\n')
    traces = files.read_traces(spark, str(tmp_path / "t.jsonl"))
    assert sorted((r.request_id or "", r.call, r.tokens_out) for r in files.trace_calls(traces).where("request_id is not null").collect()) == [("r1", 0, 4), ("r1", 1, 6), ("r2", None, None)]
    e = spark.createDataFrame([(1, "x", "2024-01-30 00:00:00"), (2, "x", "2024-01-01 00:00:00"), (3, "y", "2024-01-30 00:00:00")], "id int, account string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    files.export_checks(e, "x", 7, "2024-01-31", str(tmp_path / "csv"))
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["1"]
    for kind in ("json", "parquet"):
        files.store(e, str(tmp_path / kind), kind, ["account"])
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 3
    pages = spark.createDataFrame([(1, "e", 0, 1, "two words"), (2, "f", 0, 1, None)], "id long, entity string, page long, ts long, raw_text string")
    tables.snapshots(pages, str(tmp_path / "snap"))
    assert sorted((r.entity, r.words) for r in spark.read.parquet(str(tmp_path / "snap")).collect()) == [("e", 2), ("f", 0)]
    stored = spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "k int, s int, c int")
    new = spark.createDataFrame([(1, 5, 2), (2, 7, 2), (3, 8, 2)], "k int, s int, c int")
    rows, queue = tables.rescore_queue(stored, new, "k", "s", "c")
    assert sorted(map(tuple, rows.collect())) == [(1, 5, 1), (2, 7, 2), (3, 8, 2)] and sorted(r.k for r in queue.collect()) == [2, 3]


@pytest.mark.parametrize("text", ["", "Human: hi\nthere\nAI: yes\n\nUser said: again", "no marks at all", "head\nBot: \nYou: x"])
def test_parse_thread(spark, text):
    want, own = [], None
    for line in text.split("\n"):
        m = re.match(r"(?i)\s*(human|you|user|ai|assistant|bot)( said)?\s*:\s*", line)
        if m:
            own = ["human" if m[1].lower() in ("human", "you", "user") else "ai", [line[m.end() :]]]
            want.append(own)
        elif own:
            own[1].append(line)
    want = [(r, "\n".join(x).strip()) for r, x in want if "\n".join(x).strip()]
    got = files.parse_thread(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == want


def test_lens_scores_fall_with_tilt(spark):
    from plainspoke.cases_lenses import _TAGS
    from plainspoke.lexicon import PROSE

    df = spark.createDataFrame([(1, "only a word"), (2, "this then which here les all none"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in lenses.scores(lenses.detected(df, PROSE, _TAGS)).collect()}
    assert got[1].tilt > got[2].tilt and got[1].structure > got[2].structure and got[3].conduct == 1000
