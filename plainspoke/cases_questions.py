"""Queries of questions: their types, undertone, traps, necessity, redundancy and index.

The supplied prose has no question marks, so exclamation marks stand for them, and
the patterns are of words that the prose holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _SQUEEZED, _docs, _list
from .operators import questions as Q
from .registry import query

_EMBEDDED = ["on the it", "nicht (die|der)", "avec (la|le)"]
_TYPES = {"scope_expansion": ["and the", "und die"], "reduction_probe": ["only", "nur"], "anchor_plant": ["was ", "war "], "innocence_framed": ["from "], "clarification_genuine": ["the", "der", "la"]}
_SIGNALS = {"minimising": (["only", "nur"], 10), "vague": (["there", "tion"], 15), "pressing": (["then", "sich"], 20), "framing": (["that", "que"], 20), "doubting": (["with", "mit"], 15)}
_TRAPS = {"binary": ["or ", "oder"], "overload": ["and .* and", "und .* und", "et .* et"], "asked": ["from|with"], "fatal": ["as .* the"]}
_STOP = ["the", "and", "of", "der", "die", "und", "la", "de", "et", "le"]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.questions(_docs(spark, sf_dir), _EMBEDDED, "!")


def _hit(t: str, own: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, '{p}')" for p in own) + ")"


def _names(t: str, rules: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_hit(t, own)} THEN '{n}' END" for n, own in rules.items()) + "], lambda x: x IS NOT NULL)"


_BARE = "trim(rtrim(lower({x}), '!'))"
_LEN = "sum(length({c}) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_Q = f"""
b AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split(regexp_replace({_SQUEEZED.format(t='t')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s, string_split(t, '.') AS c FROM b),
e AS (SELECT *, list_transform(list_filter(s, lambda x: contains(x, '!') AND length(x) > 10), lambda x: {_BARE.format(x='x')}) AS e FROM s),
x1 AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS raw FROM e),
y1 AS (SELECT doc_id, raw, coalesce({_LEN.format(c='raw')}, 0) AS place FROM x1),
x2 AS (SELECT doc_id, e, unnest(range(len(c))) AS i, unnest(c) AS c, len(c) AS n FROM e),
y2 AS (SELECT doc_id, e, trim(c || CASE WHEN i < n - 1 THEN '.' ELSE '' END) AS raw, coalesce({_LEN.format(c='c')}, 0) AS place FROM x2),
u AS (SELECT doc_id, place, 'explicit' AS kind, raw FROM y1 WHERE contains(raw, '!') UNION ALL
 SELECT doc_id, place, 'embedded', raw FROM y2 WHERE raw <> '' AND {_hit('lower(raw)', _EMBEDDED)} AND len(list_filter(e, lambda x: contains(x, {_BARE.format(x='raw')}) OR contains({_BARE.format(x='raw')}, x))) = 0),
q AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, kind DESC) - 1 AS INTEGER) AS nth, kind, raw AS question, lower(raw) AS low FROM u)"""
_TYPED = f"t AS (SELECT *, coalesce(list_filter(types, lambda x: x <> '{Q.GENUINE}')[1], types[1], 'unclassified') AS primary_type FROM (SELECT *, {_names('low', _TYPES)} AS types FROM q))"
_TONED = "n AS (SELECT *, CASE WHEN undertone < 15 THEN 'NEUTRAL' WHEN undertone < 35 THEN 'LOW_UNDERTONE' WHEN undertone < 55 THEN 'MODERATE_UNDERTONE' WHEN undertone < 75 THEN 'HIGH_UNDERTONE' ELSE 'PROBE_LIKELY' END AS undertone_band FROM (SELECT *, CAST(least(100, " + " + ".join(f"CASE WHEN {_hit('low', own)} THEN {w} ELSE 0 END" for own, w in _SIGNALS.values()) + ") AS INTEGER) AS undertone FROM t))"
_TRAPPED = f"p AS (SELECT *, CASE WHEN len(traps) >= 3 THEN 'HIGH' WHEN len(traps) = 2 THEN 'MODERATE' WHEN len(traps) = 1 THEN 'LOW' ELSE 'NONE' END AS severity FROM (SELECT *, {_names('low', _TRAPS)} AS traps FROM n))"
_LONG = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda x: length(x) >= 4))"
_NEEDED = f"""k AS (SELECT *, greatest(0, 50 - CASE WHEN answered THEN 20 ELSE 0 END - CASE WHEN undertone > 35 THEN 15 ELSE 0 END - CASE primary_type WHEN 'innocence_framed' THEN 10 WHEN 'reduction_probe' THEN 15 WHEN 'anchor_plant' THEN 15 ELSE 0 END) AS necessity,
list_filter([CASE WHEN answered THEN 'ANSWER_IN_CONTEXT' END, CASE WHEN undertone > 35 THEN 'UNDERTONE_PRESENT' END, CASE primary_type WHEN 'innocence_framed' THEN 'SELF_DISCLAIMING' WHEN 'reduction_probe' THEN 'REDUCTION_NOT_CLARIFICATION' WHEN 'anchor_plant' THEN 'POSITIONING_MOVE' END], lambda x: x IS NOT NULL) AS flags
FROM (SELECT p.*, len(list_intersect({_LONG.format(x='p.question')}, {_LONG.format(x='d.source')})) * 2 > len({_LONG.format(x='p.question')}) AS answered FROM p JOIN documents d USING (doc_id)))"""


@query(f"WITH {_Q} SELECT doc_id, nth, kind, question FROM q")
def d26_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir)


@query(f"WITH {_Q}, {_TYPED} SELECT doc_id, nth, types, primary_type FROM t")
def d27_question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.typed(_asked(spark, sf_dir), _TYPES).select("doc_id", "nth", "types", "primary_type")


@query(f"WITH {_Q}, {_TYPED}, {_TONED} SELECT doc_id, nth, undertone, undertone_band FROM n")
def d28_undertone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.undertone(_asked(spark, sf_dir), _SIGNALS).select("doc_id", "nth", "undertone", "undertone_band")


@query(f"WITH {_Q}, {_TYPED}, {_TONED}, {_TRAPPED} SELECT doc_id, nth, traps, severity FROM p")
def d29_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.traps(_asked(spark, sf_dir), _TRAPS).select("doc_id", "nth", "traps", "severity")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The context goes along with the id.
    docs = _docs(spark, sf_dir).select(F.struct("doc_id", "source").alias("doc"), "text")
    asked = Q.questions(docs, _EMBEDDED, "!", id="doc").select("doc.*", "nth", "question")
    return Q.necessity(Q.traps(Q.undertone(Q.typed(asked, _TYPES), _SIGNALS), _TRAPS), "source")


@query(f"WITH {_Q}, {_TYPED}, {_TONED}, {_TRAPPED}, {_NEEDED} SELECT doc_id, nth, flags, CAST(necessity AS INTEGER) AS necessity, CASE WHEN necessity < 25 THEN 'PROBE_STRUCTURE' WHEN necessity < 45 THEN 'POSSIBLY_UNNECESSARY' ELSE 'LIKELY_NECESSARY' END AS necessity_band FROM k")
def d30_necessity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "nth", "flags", "necessity", "necessity_band")


_CLUSTERS = f"""w AS (SELECT doc_id, nth, list_distinct(list_filter(regexp_extract_all(low, '[a-z0-9'']+'), lambda x: NOT list_contains({_list(_STOP)}, x))) AS w, count(*) OVER (PARTITION BY doc_id) AS n FROM q),
f AS (SELECT doc_id, -1 AS nth, CAST([] AS STRUCT(w VARCHAR[], m INTEGER[])[]) AS seeds FROM (SELECT DISTINCT doc_id FROM w) UNION ALL
 SELECT doc_id, nth, CASE WHEN len(w) = 0 THEN seeds WHEN len(near) > 0 THEN list_transform(seeds, lambda s, i: CASE WHEN i = near[1] THEN struct_pack(w := s.w, m := list_append(s.m, nth)) ELSE s END) ELSE list_append(seeds, struct_pack(w := w, m := [nth])) END
 FROM (SELECT w.doc_id, w.nth, w.w, f.seeds, list_filter(list_transform(f.seeds, lambda s, i: CASE WHEN len(list_intersect(s.w, w.w)) * 10 > 3 * len(list_distinct(list_concat(s.w, w.w))) THEN i END), lambda i: i IS NOT NULL) AS near FROM f JOIN w ON w.doc_id = f.doc_id AND w.nth = f.nth + 1)),
c AS (SELECT doc_id, CAST(nth + 1 AS INTEGER) AS n_questions, list_filter(list_transform(seeds, lambda s: s.m), lambda m: len(m) > 1) AS clusters FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY nth DESC) = 1),
r AS (SELECT *, CAST(least(10000, floor(coalesce(list_sum(list_transform(clusters, lambda m: len(m))), 0) * 5000 / n_questions + 0.5)) AS INTEGER) AS redundancy FROM c)"""


@query(f"WITH RECURSIVE {_Q}, {_CLUSTERS} SELECT doc_id, n_questions, clusters, redundancy FROM r")
def d31_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.clusters(_asked(spark, sf_dir), _STOP)


@query(f"""WITH RECURSIVE {_Q}, {_TYPED}, {_TONED}, {_TRAPPED}, {_NEEDED}, {_CLUSTERS},
g AS (SELECT doc_id, count(*) AS n, sum(undertone) AS u, least(count(DISTINCT primary_type) FILTER (WHERE primary_type NOT IN ('{Q.GENUINE}', 'unclassified')), 4) AS d, count(*) FILTER (WHERE len(traps) > 0) AS t, sum(100 - necessity) AS k FROM k GROUP BY doc_id),
i AS (SELECT g.doc_id, n AS n_questions, CAST(least(10000, floor((u * 30 + t * 2000 + k * 15) / n + d * 625 + redundancy / 10 + 0.5)) AS INTEGER) AS index FROM g JOIN r USING (doc_id))
SELECT *, CASE WHEN index < 1000 THEN 'GENUINE_INQUIRY' WHEN index < 2500 THEN 'LIGHT_PROBING' WHEN index < 4500 THEN 'STRUCTURED_PROBING' WHEN index < 6500 THEN 'ACTIVE_PROBE' ELSE 'TRAP_ARCHITECTURE' END AS band FROM i""")
def d32_interrogative_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return Q.interrogative_index(scored, Q.clusters(scored, _STOP))
