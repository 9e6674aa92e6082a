"""Text functions and audits on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from plainspoke.functions import text as T
from plainspoke.lexicon import lexicon
from plainspoke.operators import history, audit, reports, tables, traffic

MARKERS = {
    "constraint": ["no later than", "at most", "signed", "must"], "hedge": ["maybe", "i suppose"], "reassure": ["have no fear"], "blend": ["more or less"], "capability": ["any shape you like"],
    "defer": ["some other day"], "collapse": ["so to speak"], "calm": ["it is nothing", "totally"], "ask": ["kindly", "answer"],
}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("A b. C d!  E?", ["A b.", "C d!", "E?"]), ("", []), ("  one\n two ", ["one two"]), ("x.y z. w", ["x.y z.", "w"])])
def test_sentences(spark, text, want):
    assert one(spark, text, T.sentences) == want


def test_tokens_and_counts(spark):
    assert one(spark, "It's ÉTÉ 42, it's", T.tokens) == ["it's", "t", "42", "it's"] or one(spark, "It's 42", T.tokens) == ["it's", "42"]
    assert one(spark, "aaaa", lambda t: T.occurrences(t, "aa")) == 2
    assert one(spark, " a  b ", T.word_count) == 2
    assert one(spark, "a&amp;lt;b<br>c", T.plain_html) == "a&lt;b c"
    assert one(spark, "https://www.example.com/x?y", T.base_domain) == "example.com"
    assert one(spark, "x y x y z", lambda t: T.repeated_bigrams(T.tokens(t))) == 1
    assert one(spark, "para one is long enough here\n\nshort\n\n  para two is long enough too", lambda t: F.size(T.paragraphs(t))) == 2


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(T.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [0.333, 1.0, 0.0]


def test_integrity_prefers_specific_texts(spark):
    rows = [(1, "You must send the signed form no later than noon. Kindly answer today."), (2, "Maybe we look at it some other day. It is more or less fine, it is nothing, totally."), (3, ""), (4, None)]
    got = {r.doc_id: r for r in audit.integrity(spark.createDataFrame(rows, "doc_id int, text string"), MARKERS).collect()}
    assert got[1].score > got[2].score and all(0 <= r.score <= 100 for r in got.values()) and len(got) == 4


def test_gate(spark):
    rows = [(1, ""), (2, "one two"), (3, "12 34 56 78"), (4, "xq zz vv ww yy kk"), (5, "the the the the the of"), (6, "the plan of the day is set"), (7, None)]
    got = {r.doc_id: r.reason for r in audit.gate(spark.createDataFrame(rows, "doc_id int, text string"), ["the", "of", "is", "day"]).collect()}
    assert got == {1: "EMPTY", 2: "TOO_SHORT", 3: "NO_LANGUAGE", 4: "GIBBERISH", 5: "REPETITION", 6: "OK", 7: "EMPTY"}


def test_lexicon_forms_agree(spark):
    docs = spark.createDataFrame([(1, "You must must wait, maybe."), (2, "nothing"), (3, None)], "doc_id int, text string")
    a = sorted(map(tuple, audit.lexicon_hits(docs, MARKERS).collect()))
    assert a == sorted(map(tuple, audit.lexicon_join(docs, lexicon(spark, MARKERS)).collect())) and (1, "constraint", "must", 2) in a


def test_sentence_cleaning(spark):
    docs = spark.createDataFrame([(1, "Same thing here. Other words follow. Same thing here."), (2, "The quick brown foxes jumped. The quick brown foxes jumped again."), (3, None)], "doc_id int, text string")
    exact = {r.doc_id: r.removed for r in audit.dedupe_sentences(docs).collect()}
    near = {r.doc_id: r.removed for r in audit.near_dedupe_sentences(docs).collect()}
    assert exact == {1: 1, 2: 0, 3: 0} and near[1] == 1 and near[2] in (0, 1)
    out = audit.strip_phrases(spark.createDataFrame([(1, "I just think it is just fine")], "doc_id int, text string"), ["just"]).first()
    assert (out.text_out, out.removed) == ("I think it is fine", 2)


def test_rejected_charge(spark):
    rows = [(1, 7, 1, "deposit", 100), (2, 7, 2, "charge", -80), (3, 7, 3, "charge", -50), (4, 7, 4, "deposit", 40), (5, 7, 5, "charge", -60)]
    got = [(r.id, r.accepted, r.balance) for r in traffic.accepted_charges(spark.createDataFrame(rows, "id long, user_id long, ts long, type string, cents long")).orderBy("id").collect()]
    assert got == [(1, True, 100), (2, True, 20), (3, False, 20), (4, True, 60), (5, True, 0)]


def test_versions_have_one_current_row(spark):
    rows = [(1, "e", 0, 1, "a"), (2, "e", 0, 2, "a"), (3, "e", 0, 3, "b"), (4, "e", 1, 1, "c"), (5, "f", 0, 1, None)]
    got = {r.id: (r.previous_id, r.is_current) for r in history.versions(spark.createDataFrame(rows, "id long, entity string, page long, ts long, raw_text string")).collect()}
    assert got == {1: (None, False), 3: (1, True), 4: (None, True), 5: (None, True)}


def test_overlaps(spark):
    rows = [(1, 0, 5, "a", 1), (1, 3, 8, "b", 1), (1, 4, 6, "c", 3), (1, 8, 9, "d", 1)]
    got = reports.span_overlaps(spark.createDataFrame(rows, "doc_id int, start int, end int, signal string, priority int"), "doc_id").first()
    assert [s.signal for s in got.kept] == ["c", "d"]


def test_html(spark):
    from plainspoke.sources import html

    page = "<html><nav><p>" + "n" * 80 + "</p></nav><article><p>" + "word " * 20 + "</p><p>short</p></article><a href='#x'>no</a><a href=\"/y\">yes &amp; no</a></html>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    assert [r.text[:9] for r in html.html_blocks(df).orderBy("page_id").collect()] == ["word word", ""]
    assert [(r.href, r.label) for r in html.page_links(df).collect()] == [("/y", "yes & no")]
    assert html.article_text(df).orderBy("page_id").first().text.startswith("word word")
    raw = spark.createDataFrame([("<urlset><loc> https://a/b </loc><loc>https://a/c.xml</loc></urlset>",)], "xml string")
    assert sorted((r.url, r.child) for r in html.sitemap_urls(raw).collect()) == [("https://a/b", False), ("https://a/c.xml", True)]
    feed = spark.createDataFrame([("<rss><item><title>T &amp; x</title><description>d</description><link>l</link></item><item><title/></item></rss>",)], "xml string")
    assert [(r.title, r.summary, r.link, r.kind) for r in html.feed_items(feed).collect()] == [("T & x", "d", "l", "rss2")]
    atom = spark.createDataFrame([('<feed><entry><title>A</title><link href="https://a/1"/><updated>2024-01-02</updated><content>c</content></entry><entry><title>B</title></entry></feed>',)], "xml string")
    assert [tuple(r) for r in html.feed_items(atom, most=1).collect()] == [(0, "A", "c", "https://a/1", "2024-01-02", "atom")]
