"""Text functions on columns: built-in expressions only, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = "\u0001"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside lambdas a plain expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(t: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes, lowered."""
    return F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9']+)"), F.lit(1))


def words(t: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.trim(t), r"\s+"), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.coalesce(F.regexp_count(t, F.lit(r"\S+")), F.lit(0))


def squeezed(t: Column) -> Column:
    """White space turned into single spaces, none at the ends."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentences(t: Column) -> Column:
    """Sentences with their end marks; the mark is kept by a sentinel, as look-behind isn't portable."""
    cut = F.regexp_replace(squeezed(t), r"([.!?])\s+", "$1" + _BREAK)
    return F.filter(F.split(cut, _BREAK), lambda x: x != "")


def _bare(t: Column) -> Column:
    """Without white space at the ends, line ends included."""
    return F.btrim(t, F.lit(" \t\n\r\f\v"))


def loose_sentences(t: Column, longer_than: int = 3) -> Column:
    """Parts between end marks, of more than so many characters."""
    return F.filter(F.transform(F.split(t, r"[.!?]+"), _bare), lambda x: F.length(x) > longer_than)


def paragraphs(t: Column, longer_than: int = 20) -> Column:
    """Parts between blank lines, trimmed, of more than so many characters."""
    return F.filter(F.transform(F.split(t, r"\n\s*\n"), _bare), lambda x: F.length(x) > longer_than)


def content_tokens(t: Column, stopwords: list[str], at_least: int = 4, most: int = 80) -> Column:
    """Distinct tokens in order, long enough and not stopwords."""
    own = F.filter(tokens(t), lambda x: (F.length(x) >= at_least) & ~x.isin(stopwords))
    return F.slice(F.array_distinct(own), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets, 3 digits: 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.round(both / either, 3))


def overlap_of_larger(a: Column, b: Column) -> Column:
    """Common elements as a share of the larger set; 0 if both are empty."""
    larger = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(larger == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / larger)


def mirror_rate(prompt: Column, answer: Column) -> Column:
    """Share of the prompt's distinct tokens that the answer repeats."""
    own = F.array_distinct(prompt)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, answer)) / F.size(own))


def repeated_bigrams(own: Column) -> Column:
    """Places where a pair of tokens is followed at once by the same pair."""
    same = lambda k: F.zip_with(k, F.slice(k, 3, F.greatest(F.size(k) - 2, F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    twice = lambda e: F.zip_with(e, F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), lambda a, b: a & F.coalesce(b, F.lit(False)))
    return let(own, lambda k: F.size(F.filter(let(same(k), twice), lambda x: x)))


def unique_ratio(own: Column) -> Column:
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_distinct(own)) / F.size(own))


def occurrences(t: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal, from lengths in bytes, which cost no pass over the text."""
    return ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def markers(t: Column, terms: list[str]) -> Column:
    """The terms that occur in a lowered text, in the order given. Substrings count."""
    return F.filter(F.array(*(F.lit(x) for x in terms)), lambda m: F.contains(t, m)) if terms else F.array().cast("array<string>")


def has_any(t: Column, terms: list[str]) -> Column:
    """Whether a term occurs: a chain of plain containments, which stays in generated code and stops at the first."""
    return reduce(or_, (F.contains(t, F.lit(m)) for m in terms), F.lit(False)) if terms else F.lit(False)


def hits(t: Column, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return reduce(add, (F.contains(t, F.lit(m)).cast("int") for m in terms), F.lit(0))


def dictionary_key(t: Column) -> Column:
    """Lowered, without marks, single spaces."""
    return squeezed(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", ""))


def pointer(t: Column) -> Column:
    return F.substring(F.sha2(dictionary_key(t), 256), 1, 16)


def approx_tokens(t: Column, rule: str = "quarter") -> Column:
    """quarter: a quarter of the characters, rounded; floor: rounded down, 1 at least; words: words."""
    n = F.length(t)
    return {"quarter": F.bround(n / 4).cast("int"), "floor": F.greatest(F.lit(1), F.floor(n / 4).cast("int")), "words": word_count(t)}[rule]


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return ((tokens_in + tokens_out).cast("decimal(18,0)") * F.expr("0.00001BD")).cast("decimal(18,6)")


def email_domain(t: Column) -> Column:
    return F.lower(F.regexp_extract(t, r"@([A-Za-z0-9_.\-]+)", 1))


def base_domain(url: Column) -> Column:
    """Host without www., corporate. and about."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)
    return F.regexp_replace(host, r"^(www|corporate|about)\.", "")


def plain_html(t: Column) -> Column:
    """Tags dropped and six entities decoded, the ampersand last so that nothing is decoded twice."""
    out = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return squeezed(out)


def rollout_bucket(key: Column, user: Column) -> Column:
    """0 to 99 from the md5 of key and user."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key, user)), 1, 8), 16, 10).cast("long") % 100).cast("int")


def readability(t: Column) -> Column:
    """Grade from words a sentence and vowel groups a word, 0 to 18, 2 digits."""
    own = tokens(t)
    n, s = F.greatest(F.size(own), F.lit(1)), F.greatest(F.size(sentences(t)), F.lit(1))
    groups = F.greatest(F.regexp_count(F.lower(t), F.lit("[aeiouy]+")), F.lit(1))
    return F.round(F.least(F.greatest(0.39 * n / s + 11.8 * groups / n - 15.59, F.lit(0.0)), F.lit(18.0)), 2)


def banded(value: Column, cuts: list[tuple[float, str]], last: str) -> Column:
    """The name of the first cut that the value is below."""
    out = F.when(value.isNull(), None)
    for cut, name in cuts:
        out = out.when(value < cut, name)
    return out.otherwise(last)


def content_words(t: Column, stopwords: list[str], at_least: int = 4) -> Column:
    """Distinct lowered words between white space that are long enough and not stopwords."""
    return F.array_distinct(F.filter(words(F.lower(t)), lambda w: (F.length(w) >= at_least) & ~w.isin(stopwords)))


def matches(t: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))


def first_match(t: Column, pattern: str) -> Column:
    """The first match of a pattern, null without one."""
    return F.regexp_substr(t, F.lit(pattern))


#: Characters of no width, and dashes and spaces that have a plain form.
NO_WIDTH, DASHES, SPACES = "​‌‍⁠﻿", "‐‑‒–—―−", "   "


def plain_unicode(t: Column) -> Column:
    """NFKC, without characters of no width, with plain spaces and dashes. Spark has no normal forms, so Arrow batches are normalised; texts of ASCII pass as they are."""
    import unicodedata

    table = {ord(c): None for c in NO_WIDTH} | {ord(c): "-" for c in DASHES} | {ord(c): " " for c in SPACES}

    @F.pandas_udf("string")
    def normal(texts):  # noqa: ANN001, ANN202  a Series
        return texts.map(lambda x: unicodedata.normalize("NFKC", x.translate(table)) if isinstance(x, str) else None)

    return F.when(F.rlike(t, F.lit(r"^\p{ASCII}*\z")), t).otherwise(normal(t))


def markup(cost: Column) -> Column:
    """15 parts in a hundred of a decimal cost, 6 digits."""
    return F.round(cost * F.expr("0.15BD"), 6).cast("decimal(18,6)")


def squash(x: Column) -> Column:
    return F.tanh(x / 200)


def length_spread(t: Column) -> Column:
    """Population standard deviation of the words a sentence has; 0 without sentences."""
    lengths = F.transform(sentences(t), lambda s: word_count(s).cast("double"))
    return let(lengths, spread)


def spread(n: Column) -> Column:
    """Population standard deviation of an array of doubles; 0 if it is empty."""
    total, size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x), F.greatest(F.size(n), F.lit(1))
    return F.sqrt(let(total / size, lambda mean: F.aggregate(n, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))) / size)


def page_kind(url: Column, text: Column, kinds: dict[str, list[str]]) -> Column:
    """The kind with the best match, 3 for a word in the text and 2 for one in the URL; the first declared on ties, other without any."""
    own = F.array_max(F.array(*(F.struct((has_any(text, w).cast("int") * 3 + has_any(url, w).cast("int") * 2).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, w) in enumerate(kinds.items()))))
    return F.when(own["s"] > 0, own["kind"]).otherwise("other")
