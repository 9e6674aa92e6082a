"""Queries of the corporate score, its dimensions and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .cases import _S, _any, _count, _docs, _list
from .operators import corporate as C
from .registry import query

#: Words that the supplied prose holds, in place of a caller's lists.
WORDS = {
    "commit": ["is", "was", "ist", "est"], "aspire": ["for", "nicht", "avec"], "hedge": ["then", "there", "with", "sich"], "filler": ["on the", "in der", "de la"],
    "generic": ["tion", "keit", "eux"], "claim": ["and", "und", "et "], "what": ["from", "das"], "whom": ["which", "den"], "constraint": ["only", "nur"], "common": ["nicht", "theres"],
    "account": {"measure": ["as ", "au "], "report": ["this", "mit "], "own": ["that", "von "], "time": ["by ", "zu "]},
    "tilt": {"T1": (["this"], 6), "T4": (["there", "les"], 12), "T5": (["all", "que"], 8), "T6": (["here"], 10)},
}
_M = WORDS
_K = "regexp_extract_all({t}, '[a-z0-9'']+')"
_N = "(^|[^A-Za-z0-9_])[0-9][0-9,.]*"
_ACC = {c: _count("low", own) for c, own in _M["account"].items()}
_ALIKE = "len(list_intersect(w[i], w[i + {d}])) * 100 > 35 * len(list_distinct(list_concat(w[i], w[i + {d}])))"
_NEAR = " + ".join(f"len(list_filter(range(1, len(w) - {d} + 1), lambda i: {_ALIKE.format(d=d)}))" for d in (1, 2, 3))
_PAIRS = " + ".join(f"greatest(len(s) - {d}, 0)" for d in (1, 2, 3))
_CORPORATE = f"""
b AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, list_filter({_S}, lambda x: length(x) > 5) AS s FROM documents),
k AS (SELECT *, {_K.format(t='low')} AS k, list_transform(s, lambda x: len(regexp_extract_all(x, '\\S+'))) AS n, list_transform(s, lambda x: list_distinct({_K.format(t='lower(x)')})) AS w FROM b),
c AS (SELECT *, CAST(len(s) AS DOUBLE) AS ns, CAST(greatest(len(s), 1) AS DOUBLE) AS n1, CAST(len(k) AS DOUBLE) AS nw, CAST(len(regexp_extract_all(t, '{_N}')) AS DOUBLE) AS numbers,
 CAST(len(list_filter(s, lambda x: regexp_matches(x, '[0-9]'))) AS DOUBLE) AS figures, CAST(len(list_filter(s, lambda x: {_any('lower(x)', _M['claim'])} AND NOT regexp_matches(x, '[0-9]'))) AS DOUBLE) AS empty,
 CAST(len(list_filter(k, lambda x: list_contains({_list(_M['commit'])}, x))) AS DOUBLE) AS co, CAST({_count('low', _M['aspire'])} AS DOUBLE) AS asp,
 coalesce(list_sum(n), 0) / CAST(greatest(len(s), 1) AS DOUBLE) AS mean FROM k),
e AS (SELECT *, sqrt(coalesce(list_reduce(list_prepend(0.0::DOUBLE, list_transform(n, lambda x: (x - mean) * (x - mean))), lambda a, x: a + x), 0) / n1) AS spread,
 CAST(len(list_filter(s, lambda x: (length(x) - length(replace(x, ' and ', ''))) // 5 >= 3 OR length(x) - length(replace(x, ',', '')) >= 5)) AS DOUBLE) AS heavy, {' + '.join(_ACC.values())} AS held, {' + '.join(f'CAST({x} > 0 AS INTEGER)' for x in _ACC.values())} AS kinds,
 {' + '.join(f"CAST({_any('low', _M[x])} AS INTEGER)" for x in ('what', 'whom', 'constraint'))} AS anchors FROM c),
r AS (SELECT doc_id, length(trim(t)) AS chars,
 CASE WHEN ns = 0 THEN 0.0 ELSE least(figures / n1 + least(numbers / n1 * 0.1::DOUBLE, 0.15::DOUBLE), 1.0) END AS specificity,
 CASE WHEN nw = 0 THEN 0.0 WHEN co + asp = 0 THEN 0.4 ELSE co / greatest(co + asp, 1.0) * 0.7::DOUBLE + 0.3::DOUBLE END AS commitment,
 CASE WHEN ns = 0 THEN 0.0 ELSE CAST(len(list_filter(n, lambda x: x BETWEEN 10 AND 25)) AS DOUBLE) / n1 * 0.5::DOUBLE + CASE WHEN spread < 2 THEN 0.6::DOUBLE WHEN spread > 15 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * 0.3::DOUBLE + (1.0::DOUBLE - CAST(len(list_filter(n, lambda x: x > 35)) AS DOUBLE) / n1) * 0.2::DOUBLE - least(heavy / n1 * 0.3::DOUBLE, 0.25::DOUBLE) END AS structure,
 CASE WHEN nw = 0 THEN 1.0 ELSE 1.0::DOUBLE - least({_count('low', _M['hedge'])} / greatest(nw, 1.0) * 15, 0.7::DOUBLE) END AS hedging,
 1.0::DOUBLE - ({' + '.join(f"CASE WHEN {_any('low', own)} THEN {w} ELSE 0 END" for own, w in _M['tilt'].values())}) / 100.0::DOUBLE AS tilt,
 CASE WHEN ns = 0 THEN 0.0 WHEN empty + figures = 0 THEN 0.6 ELSE 1.0::DOUBLE - empty / greatest(empty + figures, 1.0) END AS claims,
 CASE anchors WHEN 0 THEN 0.15 WHEN 1 THEN 0.45 WHEN 2 THEN 0.75 ELSE 1.0 END AS objective,
 CASE WHEN held = 0 THEN 0.15 ELSE least(kinds / 4.0::DOUBLE, 1.0) * 0.6::DOUBLE + least(held / 6.0::DOUBLE, 1.0) * 0.4::DOUBLE END AS accountability,
 CASE WHEN ns < 2 THEN 0.7 ELSE 1.0::DOUBLE - least({_count('low', _M['filler'])} * 0.08::DOUBLE, 0.3::DOUBLE) - least(({_NEAR}) / CAST(greatest({_PAIRS}, 1) AS DOUBLE) * 0.8::DOUBLE, 0.5::DOUBLE) END AS repetition,
 CASE WHEN nw = 0 THEN 0.0 ELSE 0.7::DOUBLE - least({_count('low', _M['generic'])} * 0.06::DOUBLE, 0.6::DOUBLE) + least(CAST(len(list_distinct(list_filter(k, lambda x: regexp_full_match(x, '[a-z]{{6,}}') AND NOT list_contains({_list(_M['common'])}, x)))) AS DOUBLE) / 40, 0.2::DOUBLE) END AS vocabulary FROM e),
d AS (SELECT doc_id, chars, {', '.join(f'CAST(floor(greatest(0.0, least(1.0, CAST({k} AS DOUBLE))) * 10000 + 0.5) AS INTEGER) AS {k}' for k in C.WEIGHTS)} FROM r),
v AS (SELECT *, CAST(CASE WHEN chars < 50 THEN 0 ELSE ({' + '.join(f'{k} * {w}' for k, w in C.WEIGHTS.items())} + 500) // 1000 END AS INTEGER) AS score FROM d)"""


@query(f"WITH {_CORPORATE} SELECT doc_id, {', '.join(C.WEIGHTS)}, score, CASE WHEN chars < 50 THEN 'INSUFFICIENT' WHEN score < 200 THEN 'STRUCTURAL FAILURE' WHEN score < 350 THEN 'POOR STRUCTURE' WHEN score < 500 THEN 'STRUCTURALLY WEAK' WHEN score < 650 THEN 'MIXED SIGNALS' WHEN score < 800 THEN 'MOSTLY CLEAR' ELSE 'STRUCTURALLY SOUND' END AS label FROM v")
def d37_corporate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scored(C.dimensions(_docs(spark, sf_dir), WORDS))


_CASES = {name: f"CASE WHEN {name} < {min(worse, below)} THEN '{bad}' WHEN {name} < {below} THEN '{fair}'" + (f" WHEN {name} >= {C.SPECIFIC} THEN 'pass'" if name == "specificity" else "") + " END" for name, below, worse, bad, fair in C.FINDINGS}


@query(f"WITH {_CORPORATE}, f AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS place, '{name}' AS dimension, {case} AS severity, {name} AS value FROM d WHERE chars >= 50" for i, (name, case) in enumerate(_CASES.items(), 1)) + ") SELECT * FROM f WHERE severity IS NOT NULL")
def d38_corporate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.findings(C.dimensions(_docs(spark, sf_dir), WORDS))
