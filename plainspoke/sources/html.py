"""Blocks, links and texts out of HTML and XML columns: pages by ``markup``, XML by Spark's parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .markup import parsed


def html_blocks(pages: DataFrame, id: str = "page_id", html: str = "html", at_least: int = 60, most: int = 5000, junk: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, text): paragraphs, quotes and list items of enough characters that aren't junk, each beginning once, joined and cut."""
    read = pages.select(F.col(id), parsed(F.col(html)).alias("_p")).select(id, F.col("_p.blocks").alias("_b"))
    long = F.filter("_b", lambda b: (F.length(b) >= at_least) & ~junk(b) if junk else F.length(b) >= at_least)
    heads = lambda own: F.transform(own, lambda b: F.lower(F.substring(b, 1, 80)))
    first = T.let(long, lambda own: T.let(heads(own), lambda h: F.filter(own, lambda b, i: F.array_position(h, F.get(h, i)) == i + 1)))
    return read.select(id, F.substring(F.array_join(first, "\n"), 1, most).alias("text"))


def article_text(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, text) of the first article, else main, else nothing; a line for each block."""
    return pages.select(F.col(id), parsed(F.col(html))["article"].alias("text"))


def page_links(pages: DataFrame, id: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """(id, href, label): links with a label of 2 to 100 characters that lead somewhere, each address once a page; with ``url``, only those that stay on the page's domain."""
    got = pages.select(F.col(id), F.lower(F.col(url) if url else F.lit("")).alias("_u"), parsed(F.col(html))["links"].alias("_l")).select(id, "_u", F.inline("_l"))
    if url:
        got = got.where(T.base_domain(F.lower("href")).isin("") | (T.base_domain(F.lower("href")) == T.base_domain(F.col("_u"))))
    return got.where(~F.col("href").startswith("#") & ~F.lower("href").startswith("javascript:") & F.length("label").between(2, 100)).groupBy(id, "href").agg(F.min("label").alias("label"))


def hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.groupBy(T.base_domain(F.lower(url)).alias("host")).agg(F.count("*").alias("pages"))


def sitemap_urls(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """(url, child) of the loc elements; child sitemaps end in .xml."""
    return raw.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).withColumn("child", F.lower("url").endswith(".xml"))


#: The parts of RSS and Atom items that are read, by local name.
_ITEM = "title string, description string, summary string, content string, link array<struct<_VALUE:string,_href:string,_rel:string>>, pubDate string, updated string, published string, date string, _broken string"
_ITEMS = "array<struct<" + _ITEM.replace(" string", ":string").replace(" array", ":array") + ">>"
_FEED = f"channel struct<item:{_ITEMS}>, item {_ITEMS}, entry {_ITEMS}, _broken string"
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def _feeds(raw: DataFrame, xml: str, most: int | None = None) -> DataFrame:
    """``raw`` with _kind and _items by Spark's XML parser, so namespaces, entities and CDATA are read as XML says. A feed that isn't well-formed is cut where its items begin and each is parsed by itself; an item that isn't has its text in ``_broken``."""
    whole = F.col("_f._broken").isNull()
    cut = lambda tag: F.filter(F.split(xml, rf"(?i)(?=<(?:[\w.-]+:)?{tag}[\s/>])"), lambda x: F.rlike(x, F.lit(rf"(?i)^<(?:[\w.-]+:)?{tag}[\s/>]")))
    some = lambda c: F.slice(c, 1, most) if most else c
    one = lambda x: F.from_xml(x, _ITEM, _XML)
    rss, atom = F.coalesce("_f.channel.item", "_f.item"), F.col("_f.entry")
    got = raw.withColumn("_f", F.from_xml(xml, _FEED, _XML)).withColumns({"_rss": F.when(whole, some(rss)), "_cut": F.when(~whole, some(cut("item")))})
    got = got.withColumn("_kind", F.when((F.size("_rss") > 0) | (F.size("_cut") > 0), "rss2").otherwise("atom"))
    items = F.when(F.size("_rss") > 0, F.col("_rss")).when(whole, some(atom)).when(F.size("_cut") > 0, F.transform("_cut", one)).otherwise(F.transform(some(cut("entry")), one))
    return got.withColumn("_items", items).drop("_f", "_rss", "_cut")


def feed_items(raw: DataFrame, xml: str = "xml", most: int = 15, keep: list[str] | None = None) -> DataFrame:
    """(``keep``, nth, title, summary, link, published, kind) of the first ``most`` RSS items, or else Atom entries, of each feed; those without a title, and those that are no XML, are dropped (``feed_report`` counts them)."""
    both = _feeds(raw, xml, most).select(*(keep or []), F.col("_kind").alias("kind"), F.posexplode("_items").alias("nth", "i"))
    filled = lambda *parts: F.coalesce(*(F.nullif(T.plain_html(F.col(f"i.{p}")), F.lit("")) for p in parts), F.lit(""))
    first = lambda part: F.get(F.filter(F.transform("i.link", lambda x: F.nullif(F.trim(x[part]), F.lit(""))), lambda x: x.isNotNull()), 0)
    own = F.get(F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
    return both.where("i._broken is null").select(*(keep or []), "nth", filled("title").alias("title"), F.substring(filled("description", "summary", "content"), 1, 500).alias("summary"), F.coalesce(first("_VALUE"), own, first("_href"), F.lit("")).alias("link"), filled("pubDate", "updated", "published", "date").alias("published"), "kind").where("title <> ''")


def feed_report(raw: DataFrame, id: str, xml: str = "xml") -> DataFrame:
    """(id, kind, items, broken): items of each feed and those among them that are no XML; a feed without any has none of either."""
    got = _feeds(raw, xml).select(F.col(id), F.col("_kind").alias("kind"), F.coalesce("_items", F.lit(None)).alias("_i"))
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return got.select(id, "kind", n(F.col("_i")).alias("items"), n(F.filter("_i", lambda x: x["_broken"].isNotNull())).alias("broken"))
