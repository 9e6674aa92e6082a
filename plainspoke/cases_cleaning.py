"""Queries of cleaning: stabilised texts, redaction, policies, enforcement, rewriting, calming, compiling, directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _FRICTION, _SENTENCES, _SQUEEZED, _docs, _kept, _list
from .functions import text as T
from .operators import cleaning, texts
from .plans import logical as L
from .registry import query

_E = "[^\\p{L}\\p{N}_]"


def _once(t: str, phrase: str, by: str = "") -> str:
    return f"regexp_replace({t}, '(?i)(^|{_E})(?:{phrase})($|{_E})', '\\1{by}\\2', 'g')"


def _twice(t: str, phrase: str, by: str = "") -> str:
    return _once(_once(t, phrase, by), phrase, by)


def _found(t: str, phrase: str) -> str:
    return f"regexp_matches({t}, '(?i)(^|{_E})(?:{phrase})($|{_E})')"


def _steps(phrases: list[str], first: str, change: object, test: object, name: str, rest: str = "doc_id") -> tuple[str, str]:
    """A chain of SQL tables, one a phrase, and the name of the last."""
    out, before = [], first
    for i, p in enumerate(phrases):
        out.append(f"{name}{i} AS (SELECT * REPLACE ({change('t', p)} AS t, {name} + CAST({test('t', p)} AS INTEGER) AS {name}) FROM {before})")
        before = f"{name}{i}"
    return ", ".join(out), before


_HEDGES, _FILLERS, _SHIFT, _GOAL = ["then", "sich", "avec"], ["on the", "in der"], "(^|[.!?] )(And|Und|Et),? ", ["only", "from", "nicht", "pour"]
_SQ = lambda t: _SQUEEZED.format(t=t)
_CH, _H = _steps(_HEDGES, "b0", lambda t, p: _SQ(_twice(t, p)), _found, "hedges")
_CF, _L = _steps(_FILLERS, _H, lambda t, p: _SQ(f"regexp_replace({t}, '(?i){p}', '', 'g')"), lambda t, p: f"regexp_matches({t}, '(?i){p}')", "fillers")

_STABLE = f"""WITH b0 AS (SELECT doc_id, {_SQ("coalesce(text, '')")} AS before, {_SQ("coalesce(text, '')")} AS t, 0 AS hedges, 0 AS fillers FROM documents), {_CH}, {_CF},
s AS (SELECT doc_id, before, hedges, fillers, CAST(regexp_matches(t, '{_SHIFT}') AS INTEGER) AS transitions, {_SENTENCES.format(t=f"regexp_replace(t, '{_SHIFT}', '', 'g')")} AS s FROM {_L}),
d AS (SELECT *, list_filter(s, lambda x, i: list_position(s, x) = i) AS d FROM s), k AS (SELECT *, {_kept('d')} AS k FROM d),
o AS (SELECT *, list_filter(k, lambda x: list_has_any(regexp_split_to_array(trim(lower(x)), '\\s+'), {_list(_GOAL)})) AS o FROM k),
w AS (SELECT *, list_filter(regexp_split_to_array(array_to_string(CASE WHEN len(o) > 0 THEN o ELSE k END, ' '), '\\s+'), lambda x: x <> '') AS w FROM o),
f AS (SELECT *, array_to_string(w[1:60], ' ') AS text_out FROM w)
SELECT doc_id, text_out, hedges, fillers, transitions, CAST(len(s) - len(d) AS INTEGER) AS duplicates, CAST(len(d) - len(k) AS INTEGER) AS near, len(w) > 60 AS trimmed, CAST(round_even(length(before) / 4.0, 0) AS INTEGER) AS tokens_before, CAST(round_even(length(text_out) / 4.0, 0) AS INTEGER) AS tokens_after, CAST(round_even(length(before) / 4.0, 0) AS INTEGER) - CAST(round_even(length(text_out) / 4.0, 0) AS INTEGER) AS saved FROM f"""


@query(_STABLE)
def x7_stabilized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.stabilized(_docs(spark, sf_dir), _HEDGES, _FILLERS, _SHIFT, _GOAL, 60)


@query(f"SELECT doc_id, {_SQ(f'regexp_replace(t, {chr(39)}{_SHIFT}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')} AS text_out, regexp_matches(t, '{_SHIFT}') AS changed FROM (SELECT doc_id, {_SQ('coalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents)")
def x2_without_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.without_transitions(_docs(spark, sf_dir), _SHIFT)


_P = cleaning.PERSONAL


def _shared(k: str) -> str:
    return _P[k].replace("[ -]?", "(?:  |--)?").replace("-[0-9]", "--[0-9]")


_HITS = {k: f"list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '({_E})', '\\1\\1', 'g'), '(?:^|{_E})({_shared(k)})(?:{_E}|$)', 1), lambda m: replace(replace(m, '  ', ' '), '--', '-'))" for k in _P}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST(i - 1 AS INTEGER) AS nth, h[i] AS match FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, {x} AS h FROM documents))" for k, x in _HITS.items()))
def d55_personal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.personal_hits(_docs(spark, sf_dir))


@query()
def x8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.redacted(_docs(spark, sf_dir))


_NATIONS = "(SELECT n_nationkey AS key, CAST(100 + n_nationkey * 10 AS INTEGER) AS max_length, n_nationkey % 5 AS lo, 9 - n_nationkey % 3 AS hi, CAST(n_nationkey % 4 AS INTEGER) AS comp, n_regionkey = 1 AS step, n_regionkey, n_name FROM nation)"


@query(f"SELECT key, least(CASE WHEN n_regionkey < 3 THEN max_length END, CASE WHEN n_regionkey > 0 THEN 180 END) AS max_length, CAST(greatest(CASE WHEN n_regionkey < 3 THEN lo END, CASE WHEN n_regionkey > 0 THEN 2 END) AS INTEGER) AS tone_low, CAST(least(CASE WHEN n_regionkey < 3 THEN hi END, CASE WHEN n_regionkey > 0 THEN 8 END) AS INTEGER) AS tone_high, greatest(CASE WHEN n_regionkey < 3 THEN comp END, CASE WHEN n_regionkey > 0 THEN 1 END) AS compression, (n_regionkey < 3 AND step) OR n_regionkey = 2 AS next_step, list_sort(list_distinct(list_concat(CASE WHEN n_regionkey < 3 THEN ['now', n_name] ELSE [] END, CASE WHEN n_regionkey > 0 THEN ['later', 'now'] ELSE [] END))) AS blocked, CASE WHEN n_regionkey < 3 AND n_regionkey <> 1 THEN 'legal' WHEN n_regionkey > 0 THEN 'health' END AS industry FROM {_NATIONS}")
def x10_policies_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k, r = L.table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_regionkey")
    parents = n.where("n_regionkey < 3").select(k.alias("key"), (100 + k * 10).cast("int").alias("max_length"), (k % 5).cast("int").alias("tone_low"), (9 - k % 3).cast("int").alias("tone_high"), (k % 4).cast("int").alias("compression"), (r == 1).alias("next_step"), F.array(F.lit("now"), F.col("n_name")).alias("blocked"), F.when(r != 1, "legal").alias("industry"))
    children = n.where("n_regionkey > 0").select(k.alias("key"), F.lit(180).alias("max_length"), F.lit(2).alias("tone_low"), F.lit(8).alias("tone_high"), F.lit(1).alias("compression"), (r == 2).alias("next_step"), F.array(F.lit("later"), F.lit("now")).alias("blocked"), F.lit("health").alias("industry"))
    return cleaning.policies_merged(parents, children, "key")


_POLICY = {"level": 4, "blame": "was |war |est ", "blocked": ["there", "nicht"], "max_length": 80, "compression": 1, "next_step": "only|von|dans"}


@query()
def x9_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.enforced(_docs(spark, sf_dir), _POLICY)


_BLOCK = ["there", "nicht"]


@query("WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT doc_id, " + _twice(_twice("t", "there", "[REMOVED]"), "nicht", "[REMOVED]") + " AS t, CAST(" + _found("t", "there") + " AS INTEGER) + CAST(" + _found(_twice("t", "there", "[REMOVED]"), "nicht") + " AS INTEGER) AS blocked FROM b), w AS (SELECT *, list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '') AS w FROM r) SELECT doc_id, CASE WHEN len(w) > 51 THEN array_to_string(w[1:51], ' ') ELSE t END AS text_out, blocked, CAST(greatest(len(w) - 51, 0) AS INTEGER) AS cut FROM w")
def x11_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.blocked(_docs(spark, sf_dir), _BLOCK, 60, 1)


_RULES = [("the", "a"), ("nicht", "nie"), ("les", "des")]


@query("WITH b AS (SELECT doc_id, coalesce(text, '') AS t, 0 AS n FROM documents), " + ", ".join(f"r{i} AS (SELECT doc_id, {_twice('t', p, by)} AS t, n + CAST({_found('t', p)} AS INTEGER) AS n FROM {'b' if i == 0 else f'r{i - 1}'})" for i, (p, by) in enumerate(_RULES)) + ", s AS (SELECT *, n > 0 AS go FROM r2), " + ", ".join(f"q{i} AS (SELECT doc_id, go, CASE WHEN go THEN {_twice('t', p, by)} ELSE t END AS t, n + CAST(go AND {_found('t', p)} AS INTEGER) AS n FROM {'s' if i == 0 else f'q{i - 1}'})" for i, (p, by) in enumerate(_RULES)) + " SELECT doc_id, t AS text_out, n AS changes FROM q2")
def x12_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.rewritten(_docs(spark, sf_dir), _RULES)


def _friction(t: Column) -> Column:
    return F.least(sum((F.regexp_count(F.lower(t), F.lit(p)) * w for p, w in _FRICTION.values()), F.lit(0)), F.lit(100)).cast("int")


_FR = "CAST(least(" + " + ".join("len(regexp_extract_all(lower({t}), '" + p + f"')) * {w}" for p, w in _FRICTION.values()) + ", 100) AS INTEGER)"
_BAND = "CASE WHEN f < 30 THEN 'B0' WHEN f < 55 THEN 'B1' WHEN f < 75 THEN 'B2' ELSE 'B3' END"
_CS = _SENTENCES.format(t="t")


@query("WITH b AS (SELECT doc_id, t, " + _BAND + " AS band FROM (SELECT doc_id, coalesce(text, '') AS t, " + _FR.format(t="coalesce(text, '')") + " AS f FROM documents)), p AS (SELECT doc_id, band, CASE WHEN band >= 'B1' THEN " + _twice(_twice("t", "then"), "mit") + " ELSE t END AS t, CASE WHEN band >= 'B1' THEN CAST(" + _found("t", "then") + " AS INTEGER) + CAST(" + _found(_twice("t", "then"), "mit") + " AS INTEGER) ELSE 0 END AS stripped FROM b), x AS (SELECT doc_id, band, stripped, CASE WHEN band >= 'B1' THEN length(t) - length(replace(t, '!', '')) ELSE 0 END AS e, CASE WHEN band >= 'B1' THEN replace(t, '!', '') ELSE t END AS t FROM p), s AS (SELECT *, " + _CS + " AS s FROM x), k AS (SELECT *, list_filter(s, lambda x: NOT regexp_matches(lower(x), 'was |war |est ')) AS k FROM s) SELECT doc_id, band, CASE WHEN band = 'B3' THEN coalesce(k[1], '') WHEN band = 'B2' THEN array_to_string(k, ' ') WHEN band = 'B1' THEN " + _SQ("t") + " ELSE t END AS text_out, stripped, CAST(e AS INTEGER) AS exclamations, CAST(CASE WHEN band >= 'B2' THEN len(s) - len(k) ELSE 0 END AS INTEGER) AS dropped FROM k")
def x13_calmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = T.banded(_friction(F.coalesce(F.col("text"), F.lit(""))), [(30, "B0"), (55, "B1"), (75, "B2")], "B3")
    return cleaning.calmed(_docs(spark, sf_dir), ["then", "mit"], "was |war |est ", band)


@query("WITH b AS (SELECT doc_id, " + _SQ("coalesce(text, '')") + " AS t FROM documents), c AS (SELECT doc_id, t, " + _SQ("regexp_replace(" + _twice(_twice("t", "only"), "the") + ", '(?i)was ', 'is ', 'g')") + " AS c FROM b), f AS (SELECT *, " + _FR.format(t="t") + " AS before, " + _FR.format(t="c") + " AS after FROM c) SELECT doc_id, CASE WHEN before >= 55 AND after <= before THEN c ELSE t END AS text_out, before, after, before >= 55 AND after <= before AS accepted FROM f")
def x14_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.compiled(_docs(spark, sf_dir), ["only", "the"], [("was ", "is ")], _friction)
