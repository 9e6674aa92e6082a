"""Queries of the lenses: texts, paragraphs, pages, issues, promoted signals, weighted totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _M, _any, _count, _docs
from .cases_corporate import _CASES, _CORPORATE, WORDS
from .cases_signals import _RULES
from .operators import corporate, lenses, signals
from .registry import query

_TAGS = {"T1": ["this"], "T2": ["nur "], "T3": ["there", "les"], "T4": ["all"], "T5": ["none", "ist"], "T6": ["which", "here"], "T7": ["eux"], "T8": ["then"], "T9": ["mit"], "T10": ["dans"]}


def _detected(rel: str, key: str) -> str:
    """The detection map of a relation with column t, lowered."""
    f = {k: _any("t", own) for k, own in _M.items()}
    met = f"CAST({f['constraint']} AS INT) + CAST({f['capability']} AND NOT {f['constraint']} AS INT) + CAST({f['hedge']} OR {f['blend']} AS INT) + CAST({f['calm']} OR {f['reassure']} AS INT)"
    return f"""SELECT {key}, greatest(len(regexp_extract_all(t, '\\S+')), 1) AS words, {_count('t', _M['constraint'])} AS constraints, {f['capability']} AND NOT {f['constraint']} AS early, {_count('t', _M['hedge'])} AS hedges, {_count('t', _M['reassure'])} AS reassurances,
list_filter([{', '.join(f"CASE WHEN {_any('t', own)} THEN '{k}' END" for k, own in _TAGS.items())}], lambda x: x IS NOT NULL) AS tags,
[CASE WHEN {f['defer']} AND NOT {f['constraint']} THEN 2 WHEN {f['defer']} THEN 1 ELSE 0 END, CASE WHEN {f['collapse']} AND contains(t, 'and') AND contains(t, 'that') THEN 2 WHEN {f['collapse']} THEN 1 ELSE 0 END, CASE {met} WHEN 4 THEN 2 WHEN 3 THEN 1 ELSE 0 END] AS states,
({' + '.join(_count('t', own) for own in _TAGS.values())}) * 1000 // greatest(len(regexp_extract_all(t, '\\S+')), 1) AS density FROM {rel}"""


def _lenses(rel: str, key: str) -> str:
    of = lambda names: "len(list_intersect(tags, [" + ", ".join(f"'{n}'" for n in names) + "]))"
    held = lambda x: f"greatest(0, least(1000, {x}))"
    active = "len(list_filter(states, lambda s: s > 0))"
    dims = [("least(1000, constraints * 250)", 15), (held("1000 - hedges * 15000 // greatest(words, 50)"), 10), (held("1000 - len(tags) * 120"), 12), (held(f"1000 - {active} * 250"), 15)]
    dims += [(held(f"1000 - {of(own)} * {less * 10}"), w) for own, less, w in lenses.STRUCTURE.values()]
    conduct = [held(f"1000 - hedges * 80 - {of(('T6',))} * 150"), held(f"1000 - {active} * 200"), *(held(f"1000 - {of(own)} * {less * 10}") for own, less in lenses.CONDUCT.values())]
    return f"""SELECT {key}, words, CAST(floor((CASE WHEN constraints >= 1 THEN 1000 ELSE 0 END + CASE WHEN early THEN 0 ELSE 1000 END + 1000 - least({of(lenses.DRIFT)} * 150 + {active} * 250, 1000)) / 3 + 0.5) AS INTEGER) AS bounds,
CAST({held('1000 - len(tags) * 50 - list_sum(states) * 50 - hedges * 20 - reassurances * 15 - greatest(density - 50, 0) * 2')} AS INTEGER) AS tilt,
CAST(floor(({' + '.join(f'{d} * {w}' for d, w in dims)}) / {sum(w for _, w in dims)} + 0.5) AS INTEGER) AS structure, CAST(floor(({' + '.join(conduct)}) / {len(conduct)} + 0.5) AS INTEGER) AS conduct FROM {rel}"""


_DOCS = "b AS (SELECT doc_id, source, lower(coalesce(text, '')) AS t FROM documents)"
_PARTS = "b AS (SELECT doc_id, nth, lower(p) AS t FROM (SELECT doc_id, unnest(range(len(p))) AS nth, unnest(p) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: length(x) > 20) AS p FROM documents)))"
_PARAGRAPHS = f"{_PARTS}, d AS ({_detected('b', 'doc_id, nth')}), s AS ({_lenses('d', 'doc_id, nth')})"


@query(f"WITH {_DOCS}, d AS ({_detected('b', 'doc_id')}) SELECT doc_id, CAST(words AS INTEGER) AS words, bounds, tilt, structure, conduct FROM ({_lenses('d', 'doc_id')})")
def d8_lens_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.scores(lenses.detected(_docs(spark, sf_dir), _M, _TAGS))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.paragraph_scores(_docs(spark, sf_dir), _M, _TAGS, "\n")


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, CAST(nth AS INTEGER) AS nth, CAST(words AS INTEGER) AS words, bounds, tilt, structure, conduct FROM s")
def d9_paragraph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir)


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, count(*) AS paragraphs, CAST(sum(words) AS BIGINT) AS words, " + ", ".join(f"CAST(floor(sum({c} * words) / greatest(sum(words), 1) + 0.5) AS INTEGER) AS {c}" for c in ("bounds", "tilt", "structure", "conduct")) + " FROM s GROUP BY doc_id")
def a22_page_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lenses.page_scores(_paragraphs(spark, sf_dir))


@query(f"WITH {_DOCS}, m AS ({_detected('b', 'doc_id')}), f AS (SELECT doc_id, count(*) AS n FROM (WITH {_CORPORATE} " + " UNION ALL ".join(f"SELECT doc_id, {case} AS severity FROM d WHERE chars >= 50" for case in _CASES.values()) + ") WHERE severity IN ('high', 'medium') GROUP BY doc_id) SELECT m.doc_id, CAST(greatest(len(list_filter(states, lambda s: s > 0)) + len(tags), coalesce(n, 0)) AS INTEGER) AS issues FROM m LEFT JOIN f ON m.doc_id = f.doc_id")
def a33_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return lenses.issues(lenses.detected(docs, _M, _TAGS), corporate.findings(corporate.dimensions(docs, WORDS)))


_SHARES = {"bounds": 30, "tilt": 30, "structure": 20, "conduct": 20}


@query(f"WITH {_DOCS}, d AS ({_detected('b', 'doc_id, source')}), g AS (SELECT source, count(*) AS n, " + ", ".join(f"CAST(sum({c}) // count(*) AS BIGINT) AS {c}" for c in _SHARES) + f" FROM ({_lenses('d', 'doc_id, source')}) GROUP BY source) SELECT *, CAST(({' + '.join(f'{c} * {w}' for c, w in _SHARES.items())}) // 100 AS BIGINT) AS total FROM g")
def a25_weighted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.struct("doc_id", "source").alias("doc"), "text")
    return lenses.weighted_total(lenses.scores(lenses.detected(docs, _M, _TAGS, "doc"), "doc").select("doc.source", *_SHARES), "source", _SHARES)


_PROMOTED = {"T4": "absolute", "T8": "then", "T9": "scope"}
_COUNTS = " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{n}' AS signal, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '{p}')) AS INTEGER) AS n FROM documents) WHERE n > 0" for n, p, _ in _RULES)


@query(f"WITH {_DOCS}, c AS ({_COUNTS} UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS signal, 1 AS n FROM b WHERE {_any('t', _TAGS[t])}" for t, s in _PROMOTED.items()) + ") SELECT doc_id, signal, CAST(max(n) AS INTEGER) AS n FROM c GROUP BY doc_id, signal")
def d14_promoted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return lenses.merged_signals(signals.signal_counts(docs, _RULES), lenses.detected(docs, _M, _TAGS), _PROMOTED)
