"""Queries of threads: abstraction, transforms, salience, states, drift, dictionaries, search, prompts, continuations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _WEIGHTS, _FOUND, _any, _artifacts, _count, _list
from .cases_texts import _KEY
from .operators import tables, threads
from .plans import logical as L
from .registry import query

_LEVELS = [["only", "this"], ["from", "with", "mit"], ["les", "des"], ["der", "die"], ["que"], ["which"]]
_TERMS = {"DECLARE": ["there", "nicht"], "ADVANCE": ["the", "und"], "OPEN_BRANCH": ["avec", "von"], "CLOSE": ["is ", "ist"], "REPAIR": ["was", "dans"]}
_SALIENT = {"AMPLIFY": ["all"], "SUPPRESS": ["nicht", "ne "], "REORDER": ["then"], "ISOLATE": ["only", "nur"], "INVERT": ["that", "que"], "MERGE": ["and", "und"]}
_ADDED, _RESOLVED = ["from", "von", "dans"], ["the", "der", "la "]
_B = "b AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)"


def _argmax(terms: dict[str, list[str]], none: str) -> str:
    counts = [_count("t", own) for own in terms.values()]
    top = f"greatest({', '.join(counts)})"
    return f"CASE WHEN {top} = 0 THEN '{none}' " + " ".join(f"WHEN {c} = {top} THEN '{k}'" for k, c in zip(terms, counts, strict=True)) + " END"


def _present(terms: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any('t', own)} THEN '{k}' END" for k, own in terms.items()) + "], lambda x: x IS NOT NULL)"


_ABS = f"{_B}, l AS (SELECT conv_id, turn, CAST({_argmax({str(i): own for i, own in enumerate(_LEVELS)}, '0')} AS INTEGER) AS level FROM b), a AS (SELECT *, coalesce(level - lag(level) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS delta_level FROM l)"
_STATE = f"n AS (SELECT conv_id, turn, {_count('t', _ADDED)} AS a, {_count('t', _RESOLVED)} AS r FROM b), d AS (SELECT conv_id, turn, CAST(sum(a) OVER w AS INTEGER) AS open, CAST(sum(r) OVER w AS INTEGER) AS done, CAST(r - a AS INTEGER) AS delta, count(*) FILTER (WHERE r > a) OVER w AS island FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT *, CASE WHEN delta > 0 THEN 'PROGRESS' WHEN delta = 0 THEN 'STAGNANT' ELSE 'EXPANDING' END AS state, CASE WHEN delta <= 0 THEN count(*) FILTER (WHERE delta <= 0) OVER (PARTITION BY conv_id, island ORDER BY turn) ELSE 0 END AS streak FROM d)"
_TRANS = f"t AS (SELECT conv_id, turn, {_present(_TERMS)} AS detected, {_argmax(_TERMS, 'ADVANCE')} AS transform FROM b)"


@query(f"WITH {_ABS} SELECT conv_id, turn, level, delta_level AS delta, CASE WHEN delta_level > 0 THEN 'UP' WHEN delta_level < 0 THEN 'DOWN' ELSE 'STABLE' END AS direction, abs(delta_level) <= 1 AND level BETWEEN 0 AND 3 AS passed FROM a")
def w16_abstraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.abstraction(L.turns(spark, sf_dir), _LEVELS, 1, (0, 3))


@query(f"WITH {_B}, {_TRANS} SELECT conv_id, turn, detected, transform, transform IN ('DECLARE', 'ADVANCE', 'CLOSE', 'REPAIR') AS legal FROM t")
def d34_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.transforms(L.turns(spark, sf_dir), _TERMS, "EXECUTE")


@query(f"WITH {_B}, s AS (SELECT conv_id, turn, {_present(_SALIENT)} AS salience FROM b) SELECT *, len(salience) > 0 AS reweighted FROM s")
def d35_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.salience(L.turns(spark, sf_dir), _SALIENT)


@query(f"WITH {_B}, {_STATE} SELECT conv_id, turn, open, done, delta, state, streak FROM s")
def w14_w15_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.state_deltas(L.turns(spark, sf_dir), _ADDED, _RESOLVED)


@query(f"WITH {_ABS}, {_STATE}, {_TRANS}, m AS (SELECT t.conv_id, t.turn, list_filter([CASE WHEN transform NOT IN ('DECLARE', 'ADVANCE', 'CLOSE', 'REPAIR') THEN 'ILLEGAL_TRANSFORM' END, CASE WHEN abs(delta_level) > 1 THEN 'ABSTRACTION_JUMP' END, CASE WHEN level NOT BETWEEN 0 AND 1 THEN 'ABSTRACTION_RANGE' END, CASE WHEN streak >= 3 THEN 'STATE_STAGNATION' END, CASE WHEN list_contains(detected, 'OPEN_BRANCH') THEN 'UNDECLARED_BRANCH' END], lambda x: x IS NOT NULL) AS violations FROM t JOIN a ON t.conv_id = a.conv_id AND t.turn = a.turn JOIN s ON s.conv_id = t.conv_id AND s.turn = t.turn) SELECT *, CASE WHEN len(violations) = 0 THEN 'CLEAN' WHEN len(violations) = 1 THEN 'MINOR_DRIFT' WHEN len(violations) <= 3 THEN 'MODERATE_DRIFT' ELSE 'SEVERE_DRIFT' END AS verdict FROM m")
def d36_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.drift(L.turns(spark, sf_dir), _LEVELS, _TERMS, _ADDED, _RESOLVED, "EXECUTE")


_FILLERS = ["the", "and", "de", "la", "der", "die"]
_SEQ = f"l AS (SELECT conv_id, role, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM conversations), k AS (SELECT conv_id, role, {_KEY} AS key FROM l)"


@query(f"WITH {_SEQ}, d AS (SELECT key, count(*) AS n FROM k WHERE key <> '' GROUP BY key), w AS (SELECT list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations), c AS (SELECT count(*) AS messages, sum(list_sum(list_transform(w, lambda x: length(x)))) AS a, sum(list_sum(list_transform(list_filter(w, lambda x: list_contains({_list(_FILLERS)}, lower(x))), lambda x: length(x)))) AS f FROM w), e AS (SELECT count(*) AS sequences, count(*) FILTER (WHERE n > 1) AS repeated, sum(n) AS p FROM d) SELECT messages, sequences, repeated, CAST(floor(p * 100 / greatest(sequences, 1) + 0.5) AS BIGINT) AS pointers_each, CAST(floor(f * 1000 / greatest(a, 1) + 0.5) AS BIGINT) AS filler_share FROM c, e")
def a29_dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.turns(spark, sf_dir)
    return threads.dictionary_stats(tables.sequence_dictionary(t), t, _FILLERS)


@query("WITH k AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) AS w FROM conversations) SELECT conv_id, turn, count(*) AS n FROM k WHERE w IN ('die', 'der', 'das', 'den') GROUP BY conv_id, turn")
def j20_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([("die", "der", True), ("das", "der", True), ("den", "der", True), ("les", "der", False), ("und", "and", True)], "pointer string, canonical string, active boolean")
    return threads.searched(L.turns(spark, sf_dir), "die", s)


_LINES = "r AS (SELECT conv_id, turn, upper(role) || ': ' || substr(coalesce(text, ''), 1, {most}) AS l FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}), p AS (SELECT conv_id, string_agg(l, chr(10) ORDER BY turn) AS lines FROM r GROUP BY conv_id)"


@query("WITH f AS (" + _FOUND.format(t="O") + "), c AS (SELECT o_orderkey AS key, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS priority FROM orders WHERE o_orderkey IN (SELECT key FROM f)), q AS (SELECT priority, string_agg(CAST(key AS VARCHAR), ', ' ORDER BY CAST(key AS VARCHAR)) AS k FROM c GROUP BY priority), z AS (SELECT string_agg('[P' || priority || '] ' || k, chr(10) ORDER BY priority) AS known FROM q), " + _LINES.format(n=6, most=300) + " SELECT conv_id, 'Be exact.' || chr(10) || known || chr(10) || lines || chr(10) || 'USER: go on' AS prompt FROM p, z")
def x18_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _artifacts(spark, sf_dir)
    found = tables.retrieve(a, "O", 6, _WEIGHTS, "1998-08-03", 1)
    return threads.prompts(L.turns(spark, sf_dir), "Be exact.", a.join(F.broadcast(found.select("key")), "key").select("key", "priority"), "go on")  # seven keys at most


@query(f"WITH {_SEQ}, s AS (SELECT conv_id, key, count(*) AS n FROM k WHERE key <> '' GROUP BY conv_id, key HAVING count(*) >= 2), c AS (SELECT conv_id, list(key ORDER BY n DESC, key) AS core FROM s GROUP BY conv_id), " + _LINES.format(n=8, most=200) + ", m AS (SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN coalesce(length(text), 0) ELSE 0 END) AS BIGINT) AS user_chars, CAST(sum(CASE WHEN role = 'assistant' THEN coalesce(length(text), 0) ELSE 0 END) AS BIGINT) AS ai_chars, CAST(sum(coalesce(length(text), 0)) * 1000 // 8000 AS BIGINT) AS per_mille FROM conversations GROUP BY conv_id) SELECT m.conv_id, coalesce(core, CAST([] AS VARCHAR[])) AS core, lines AS recent, user_chars, ai_chars, per_mille FROM m LEFT JOIN p ON p.conv_id = m.conv_id LEFT JOIN c ON c.conv_id = m.conv_id")
def x19_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.continuations(L.turns(spark, sf_dir))
