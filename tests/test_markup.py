"""Pages by tokens and a stack: hand-made fixtures, the standard library's parser on all supplied pages, linear time."""

import time
from html.parser import HTMLParser

from plainspoke.sources import html, markup

LONG = "words that fill a line of text so that it is long enough to stay in here"


def test_nested_and_broken():
    page = markup.Page(f"<ul><li>one<ul><li>two</li><li>three</ul><li>four</ul><p>five<p title='a > b'>six <b>bo<i>ld</b> &amp; on<div>seven</div></p><blockquote><p>{LONG}</p></blockquote>")
    assert page.blocks == ["two", "three", "one", "four", "five", "six bo ld & on", LONG]
    page = markup.Page('<a title=">" HREF="/x?a=1&amp;b">A <b>b</b></a><a name=q>no</a><a href=/y>c<a href=\'/z\'>d</a> 1 < 2 <3 </nothing> <!-- <a href="/n">n</a> --><script>"<a href=\'/s\'>s</a>"</script ><p>end')
    assert page.links == [("/x?a=1&b", "A b"), ("/y", "c"), ("/z", "d")] and page.blocks == ["end"]
    page = markup.Page("<main>m</main><article>a<br>b<nav>n</nav><div>c</div> d</article><article>other</article>")
    assert page.article == "a\nb\nc\nd"
    assert markup.Page("<MAIN><P>x</MAIN>").article == "x" and markup.Page("").blocks == [] == markup.Page("<p").blocks
    assert markup.Page("<p>a</p><!-- never closed <p>b</p>").blocks == ["a"] and markup.Page('<p>a <b title="x>y</b> z</p>').blocks == ["a y z"]


class Plain(HTMLParser):
    """The standard library's events; paragraphs end where a block or another begins."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.links, self.own, self.link, self.off = [], [], [], None, 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.own or []).split())
        if text:
            self.blocks.append(text)
        self.own = None

    def handle_starttag(self, tag, attrs):
        if tag in markup.DROPPED:
            self.off += 1
        if tag in markup.BLOCKS:
            self.flush()
        if tag == "p" and not self.off:
            self.own = []
        if tag == "a":
            self.link = (dict(attrs).get("href"), [])

    def handle_endtag(self, tag):
        if tag in markup.DROPPED:
            self.off -= 1
        if tag in markup.BLOCKS:
            self.flush()
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(" ".join(self.link[1]).split())))
            self.link = None

    def handle_data(self, data):
        if self.own is not None and not self.off:
            self.own.append(data)
        if self.link:
            self.link[1].append(data)


def test_all_supplied_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    for r in rows:
        got, want = markup.Page(r.html), Plain(r.html)
        assert got.links == want.links and ["".join(b.split()) for b in got.blocks] == ["".join(b.split()) for b in want.blocks]


def test_time_is_linear():
    for unit in ("<li>a<ul>", '<a href="x>', "<!-- ", "<a b='\"'> ", "<p><b>x ", "</p>< <", '<p title="', "<script>", "<td><table>"):
        took = []
        for n in (40_000, 320_000):
            t0 = time.process_time()
            markup.Page(unit * n)
            took.append(time.process_time() - t0)
        assert took[1] < 30 * took[0] + 0.5, (unit, took)
    big = f"<article>{f'<p>{LONG}</p><ul><li>{LONG}</li></ul>' * 120_000}</article>"
    t0 = time.process_time()
    assert len(big) > 20_000_000 and len(markup.Page(big).blocks) == 240_000 and time.process_time() - t0 < 30


def test_columns(spark):
    rows = [(1, f"<p>{LONG}</p><li>{LONG}</li><p>short</p>", "https://www.a.com/x"), (2, None, None), (3, '<a href="https://a.com/y">yes</a><a href="https://b.com/">no</a><a href="#t">up</a>', "https://a.com/")]
    df = spark.createDataFrame(rows, "page_id int, html string, url string")
    assert [tuple(r) for r in html.html_blocks(df).orderBy("page_id").collect()] == [(1, LONG), (2, ""), (3, "")]
    assert [tuple(r) for r in html.page_links(df, url="url").collect()] == [(3, "https://a.com/y", "yes")]
    assert [r.text for r in html.article_text(df).orderBy("page_id").collect()] == ["", "", ""]
