"""Queries of profiles: replies, protocols, topics, modes, complexity, balance, emphasis, statements, speech, loops, options, confusion, cards, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _INTEGRITY, _M, _PAIRS, _PATTERNS, _SENTENCES, _WORDS, _any, _count, _docs, _list
from .functions import text as T
from .operators import audit, profiles, tables
from .plans import logical as L
from .registry import query

_LOW = "b AS (SELECT doc_id, coalesce(text, '') AS x, lower(coalesce(text, '')) AS t FROM documents)"
_SMOOTH, _HEDGES, _FILL = ["die", "the", "éienç"], ["der", "et", "of"], ["in der", "de la", "sich"]
_TOK = "regexp_extract_all({t}, '[a-z0-9'']+')"


def _in(k: str, own: list[str]) -> str:
    return f"len(list_filter({k}, lambda x: list_contains({_list(own)}, x)))"


@query(_PAIRS.replace("u.text AS prompt", "u.text AS prompt, a.text AS answer") + f""", w AS (SELECT conv_id, i, lower(coalesce(answer, '')) AS t, list_transform(list_filter(regexp_split_to_array(trim(lower(coalesce(answer, ''))), '\\s+'), lambda x: x <> ''), lambda x: trim(x, '.,!?:;')) AS w, greatest({_WORDS.format(t="coalesce(prompt, '')")}, 1) AS p FROM m),
c AS (SELECT *, len(w) AS words, greatest(len(w), 1) AS n, len(list_filter(regexp_split_to_array(t, '[.!?]'), lambda x: trim(x) <> '')) AS sentences, coalesce(list_contains({_list(_SMOOTH)}, w[1]), false) AS opener, {_in('w', _HEDGES)} AS h, {_in('w', _SMOOTH)} AS s, {_count('t', _FILL)} AS filler FROM w),
f AS (SELECT conv_id, i, CAST(words AS INTEGER) AS words, CAST(sentences AS INTEGER) AS sentences, opener, CAST(h * 10000 // n AS BIGINT) AS hedge, CAST(s * 10000 // n AS BIGINT) AS smooth, CAST(words * 10 // p AS BIGINT) AS ratio, CAST((words - h - s - filler) * 10000 // n AS BIGINT) AS signal, CAST(filler AS INTEGER) AS filler, NOT opener AND s * 20 < n AND h * 20 < n AS sovereign,
list_filter([CASE WHEN opener THEN 'SMOOTH_OPENER' END, CASE WHEN h * 100 > 3 * n THEN 'HEDGE_HEAVY' END, CASE WHEN s * 100 > 3 * n THEN 'SMOOTH_HEAVY' END, CASE WHEN words > 20 * p THEN 'OVEREXPANSION' END, CASE WHEN filler > 2 THEN 'FILLER_HEAVY' END], lambda x: x IS NOT NULL) AS flags FROM c) SELECT *, len(flags) = 0 AS passed FROM f""")
def d39_reply_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.reply_scores(tables.pairs(L.turns(spark, sf_dir)), _SMOOTH, _HEDGES, _FILL, ["conv_id", "i"])


@query(f"WITH {_LOW}, v AS (SELECT doc_id, t, CAST({_any('t', ['there', 'which'])} AS INT) + CAST({_any('t', ['nicht'])} AS INT) + CAST(regexp_matches(t, '[^ -~\\n]') AS INT) + CAST(starts_with(t, 'the') AS INT) AS v FROM b) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE 4 - v END AS followed, CASE WHEN t = '' THEN 0 ELSE 4 END AS total, CAST(CASE WHEN t = '' THEN 0 ELSE floor((4 - v) * 100 / 4 + 0.5) END AS INTEGER) AS score FROM v")
def d40_protocol_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    tests = {"ascii": F.rlike(low, F.lit("[^ -~\n]")), "opening": F.startswith(low, F.lit("the"))}
    return profiles.protocol_scores(_docs(spark, sf_dir), ["there or which", "the nicht"], tests)


_TOPICS = {"der": ["schst", "ungkeit", "zwischen"], "which": ["ationth", "thereth", "only the"], "avec": ["euxelle", "tionment"]}


@query(f"""WITH {_LOW}, k AS (SELECT doc_id, t, list_distinct({_TOK.format(t='t')}) AS w, {', '.join(f"{_count('t', own)} AS s{i}" for i, own in enumerate(_TOPICS.values()))} FROM b),
m AS (SELECT doc_id, w, CASE {' '.join(f"WHEN s{i} >= 2 AND s{i} = greatest({', '.join(f's{j}' for j in range(len(_TOPICS)))}) THEN '{k}'" for i, k in enumerate(_TOPICS))} END AS sig, greatest({', '.join(f's{j}' for j in range(len(_TOPICS)))}) AS top, list_filter({_list(list(_TOPICS))}, lambda x: list_contains(w, x))[1] AS named FROM k),
a AS (SELECT DISTINCT item_id, 'item' || (item_id % 3) AS topic, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS x FROM benchmark), o AS (SELECT doc_id, unnest(list_filter(w, lambda x: length(x) >= 4)) AS x FROM m WHERE sig IS NULL AND named IS NULL),
n AS (SELECT doc_id, item_id, topic, count(*) AS n FROM o JOIN a ON o.x = a.x AND length(a.x) >= 4 GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT doc_id, topic, n FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id) = 1)
SELECT m.doc_id, coalesce(sig, named, t.topic, 'general') AS topic, CAST(CASE WHEN sig IS NOT NULL THEN top WHEN named IS NOT NULL THEN 1 ELSE coalesce(t.n, 0) END AS INTEGER) AS hits, CASE WHEN sig IS NOT NULL THEN 'signal' WHEN named IS NOT NULL THEN 'keyword' WHEN t.topic IS NOT NULL THEN 'overlap' ELSE 'none' END AS method FROM m LEFT JOIN t ON t.doc_id = m.doc_id""")
def d42_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.concat(F.lit("item"), (F.col("item_id") % 3).cast("string")).alias("topic"), F.col("text").alias("content"))
    return profiles.topics(_docs(spark, sf_dir), _TOPICS, b)


_MODES = {"EXECUTE": (["the", "und"], 3), "RETRAIN": (["from", "mit"], 4), "REVIEW": (["avec", "les"], 5)}
_MODE = {k: f"CASE WHEN {_count('t', own)} > 0 THEN {_count('t', own)} * {w}" + (f" + CASE WHEN {_count('t', _M['constraint'])} >= 2 THEN {_count('t', _M['constraint'])} * 3 ELSE 0 END" if k != "REVIEW" else "") + " ELSE 0 END" for k, (own, w) in _MODES.items()}


@query(f"WITH {_LOW}, s AS (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in _MODE.items())} FROM b) SELECT doc_id, CASE WHEN greatest({', '.join(_MODE)}) = 0 THEN 'EXPLORE' {' '.join(f'WHEN {k} = greatest({chr(44).join(_MODE)}) THEN {chr(39)}{k}{chr(39)}' for k in _MODE)} END AS mode, CAST(greatest({', '.join(_MODE)}) AS INTEGER) AS score FROM s")
def d43_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.modes(_docs(spark, sf_dir), _MODES, _M["constraint"], ["EXECUTE", "RETRAIN"])


@query("SELECT conv_id, turn, clauses, CASE WHEN clauses < 2 THEN 2 WHEN clauses < 3 THEN 4 WHEN clauses < 6 THEN 6 WHEN clauses < 11 THEN 9 ELSE 12 END AS draws FROM (SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?,;]+|(?: (?:and|und|et) )'), lambda x: trim(x) <> '')) AS INTEGER) AS clauses FROM conversations)")
def d44_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("k"), "text")
    return profiles.complexity(own, ["and", "und", "et"], id="k").select("k.*", "clauses", "draws")


_ENTROPY, _INSTRUCTION, _PLAIN = {"meta": (["nicht", "que"], 4), "stance": (["sich", "les"], 3)}, {"orders": (["die", "the"], 3), "limits": (["von", "dans"], 4)}, ["the", "der", "die", "und", "de", "la", "et"]
_BAL = f"b AS (SELECT conv_id, turn, {_TOK.format(t=chr(108) + 'ower(coalesce(text, ' + chr(39) * 2 + '))')} AS k FROM conversations), c AS (SELECT conv_id, turn, CAST(len(k) AS INTEGER) AS words, ({' + '.join(f'{_in(chr(107), own)} * {w}' for own, w in _ENTROPY.values())}) * 5000 // greatest(len(k), 1) AS entropy, ({' + '.join(f'{_in(chr(107), own)} * {w}' for own, w in _INSTRUCTION.values())}) * 5000 // greatest(len(k), 1) AS instruction, (greatest(len(k), 1) - {_in('k', _PLAIN)}) * 1000 // greatest(len(k), 1) AS signal FROM b), p AS (SELECT *, entropy - instruction AS balance FROM c)"


def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("turn_of"), "text")
    return profiles.balance(own, _ENTROPY, _INSTRUCTION, _PLAIN, id="turn_of").select("turn_of.*", "words", "entropy", "instruction", "balance", "squashed", "signal")


@query(f"WITH {_BAL} SELECT *, CAST(floor(tanh(balance / 10.0::DOUBLE / 200) * 1000 + 0.5) AS BIGINT) AS squashed FROM p")
def d45_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir)


@query(f"WITH {_BAL}, f AS (SELECT conv_id, balance AS v, balance * lag(balance) OVER (PARTITION BY conv_id ORDER BY turn) < 0 AS f FROM p) SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE f) AS flips, CAST(floor(sum(abs(v)) / count(*)) AS BIGINT) AS mean FROM f GROUP BY conv_id")
def a27_w9_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.flips(_balance(spark, sf_dir))


_GAINS, _LOSSES = {"specific": (["there", "nur"], 3), "accountable": (["was", "von"], 2)}, {"hedged": (["then", "sich"], 4), "charged": (["que", "all"], 6), "vague": (["with", "les"], 5)}


@query(f"WITH {_LOW}, s AS (SELECT doc_id, CAST({' + '.join(f'{_count(chr(116), own)} * {w}' for own, w in _GAINS.values())} AS INTEGER) AS gained, CAST({' + '.join(f'{_count(chr(116), own)} * {w}' for own, w in _LOSSES.values())} AS INTEGER) AS lost FROM b) SELECT *, CAST(greatest(10, least(97, 85 + gained - lost)) AS INTEGER) AS score FROM s")
def d46_statement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.statement_scores(_docs(spark, sf_dir), _GAINS, _LOSSES)


_DIMS = {"clarity": "only|nur", "evidence": "[0-9]+", "scope": "from|von", "owner": "was|war", "time": "then|dann", "risk": "nicht|not", "tone": "que|les", "action": "the|die", "cost": "with|mit", "truth": "that|das"}


@query(f"WITH {_LOW} SELECT doc_id, " + ", ".join(f"CAST(least(len(regexp_extract_all(t, '{p}')) * 20, 100) AS INTEGER) AS {k}" for k, p in _DIMS.items()) + " FROM b")
def d47_statement_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.statement_dims(_docs(spark, sf_dir), _DIMS)


_KINDS = {"vague": ["with", "les", "mit"], "specific": ["there", "nur", "avec"], "charged": ["que", "all"]}


@query(f"WITH {_LOW} SELECT doc_id, " + ", ".join(f"CAST({_count('t', own)} AS INTEGER) AS {k}" for k, own in _KINDS.items()) + " FROM b")
def d48_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.emphasis(_docs(spark, sf_dir), _KINDS)


_W = "list_filter(regexp_split_to_array(trim(lower(s)), '\\s+'), lambda x: length(x) > 2)"
_AGAIN = " OR ".join(f"coalesce(len(list_intersect(w, lag(w, {d}) OVER o)), 0) * 10 > 6 * greatest(len(w), 1)" for d in range(1, 6))
_S = _SENTENCES.format(t="coalesce(text, '')")


@query(f"WITH s AS (SELECT conv_id, turn, unnest(range(len(s))) AS nth, unnest(s) AS s FROM (SELECT conv_id, turn, list_filter({_S}, lambda x: length(x) >= 3) AS s FROM conversations)), w AS (SELECT *, list_distinct({_W}) AS w, len({_W}) AS n FROM s), a AS (SELECT *, {_AGAIN} AS again, {_count('lower(s)', _FILL)} AS f FROM w WINDOW o AS (PARTITION BY conv_id, turn ORDER BY nth)) SELECT conv_id, turn, CAST(nth AS INTEGER) AS nth, CASE WHEN f * 100 > 35 * n OR n <= 2 OR again THEN 'ramble' WHEN regexp_matches(s, '[0-9]') OR n >= 6 THEN 'signal' ELSE 'other' END AS kind, {_any('lower(s)', ['die ', 'the '])} AS action FROM a")
def d49_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("k"), "text")
    return profiles.speech(own, ["die ", "the "], _FILL, id="k").select("k.*", "nth", "kind", "action")


@query(f"WITH {_LOW} SELECT doc_id, list_filter([CASE WHEN NOT regexp_matches(t, 'only|nur') THEN 'MISSING_OBJECTIVE' END, CASE WHEN len(regexp_extract_all(t, 'then|sich|avec')) > 1 THEN 'HEDGE_DENSITY' END, CASE WHEN NOT regexp_matches(t, 'before|von|dans') THEN 'NO_TIMELINE_CONSTRAINT' END, CASE WHEN length(t) < 50 THEN 'LOW_SPECIFICITY' END], lambda x: x IS NOT NULL) AS flags FROM b")
def d50_contact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.contact_flags(_docs(spark, sf_dir), "only|nur", "then|sich|avec", "before|von|dans")


_LOOP = [("REPEAT", "the .* the", 25), ("COMPLAINT", "only|nur", 35), ("SPAM", "![^a-z]*!", 25), ("ABSTRACT", "tion", 10), ("OPEN", "then|avec", 15)]
_LOOPED = "least(" + " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for _, p, w in _LOOP) + ", 100)"


@query(f"WITH {_LOW} SELECT doc_id, CAST({_LOOPED} AS INTEGER) AS loop, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p, _ in _LOOP) + "], lambda x: x IS NOT NULL) AS rules FROM b")
def d23_loop_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.loop_score(_docs(spark, sf_dir), _LOOP)


_STOPS = ["the", "der", "die", "de", "la", "et", "und", "of"]
_OW = f"list_distinct(list_filter({_TOK.format(t='lower(x)')}, lambda y: NOT list_contains({_list(_STOPS)}, y)))"


@query(f"""WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS o FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role = 'user' GROUP BY conv_id),
k AS (SELECT *, list_transform(o, lambda x: {_OW}) AS k FROM g),
s AS (SELECT *, CAST(coalesce(list_min(list_transform(k[2:], lambda a: CASE WHEN len(list_distinct(list_concat(k[1], a))) = 0 THEN 1000 ELSE len(list_intersect(k[1], a)) * 1000 // len(list_distinct(list_concat(k[1], a))) END)), 0) AS INTEGER) AS similarity, flatten(list_transform(o, lambda x: {_SENTENCES.format(t='x').replace('lambda x: x', 'lambda z: z')})) AS s, list_transform({_SENTENCES.format(t='o[1]')}, lambda x: lower(x)) AS base FROM k),
m AS (SELECT *, len(o) >= 2 AND similarity >= 800 AS merged, list_transform(s, lambda x: lower(x)) AS low FROM s)
SELECT conv_id, CAST(len(o) AS INTEGER) AS options, similarity, merged, CASE WHEN merged THEN array_to_string(list_filter(s, lambda x, i: list_position(low, lower(x)) = i), ' ') WHEN len(o) = 1 THEN o[1] ELSE '' END AS merged_text, CASE WHEN merged THEN list_filter(s, lambda x: NOT list_contains(base, lower(x))) ELSE CAST([] AS VARCHAR[]) END AS deltas FROM m""")
def d25_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.consolidated(L.turns(spark, sf_dir).where("role = 'user'"), "conv_id", "turn", "text", _STOPS)


_REFER = ["that", "this", "das", "les", "que", "the", "die", "la"]
_UNDEF = "len(list_filter(list_distinct(regexp_split_to_array(x, '[^\\p{L}\\p{M}\\p{N}_]+')), lambda a: regexp_full_match(a, '[A-Z]{2,6}') AND NOT contains(x, '(' || a || ')') AND NOT contains(x, a || ' =') AND NOT contains(x, a || ':')))"
_CONF = f"q AS (SELECT doc_id, CAST({_UNDEF} AS INTEGER) AS undefined, CAST({_in(_TOK.format(t='t'), _REFER)} AS INTEGER) AS referents, len({_TOK.format(t='t')}) AS n FROM b), r AS (SELECT doc_id, undefined, referents, CAST(CASE WHEN undefined > 0 THEN 60 ELSE 0 END + CASE WHEN referents * 100 > 8 * n THEN 30 ELSE 0 END AS INTEGER) AS confusion FROM q)"


@query(f"WITH {_LOW}, {_CONF} SELECT * FROM r")
def d22_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.confusion(_docs(spark, sf_dir), _REFER)


_CARDS = [("tone", 2, "only|nur"), ("scope", 1, "from|von"), ("timing", 1, "then|dann"), ("risk", 3, "nicht|not")]


@query(f"WITH {_LOW}, c AS (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS source, {p} AS priority FROM b WHERE regexp_matches(t, '{x}')" for s, p, x in _CARDS) + ") SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY priority, source) - 1 AS INTEGER) AS nth, source, priority FROM c")
def d41_observation_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.observation_cards(_docs(spark, sf_dir), _CARDS)


_EDGE = "least(" + " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for p, w in _PATTERNS.values()) + ", 100)"


@query(f"WITH x AS (SELECT doc_id, coalesce(text, '') AS x, lower(coalesce(text, '')) AS t FROM documents), {_CONF.replace('FROM b)', 'FROM x)')}, {_INTEGRITY}, e AS (SELECT doc_id, CAST({_EDGE} AS INTEGER) AS edge, CAST({_LOOPED} AS INTEGER) AS loop FROM x) SELECT l.doc_id, score, label, edge, loop, confusion, '1.0' AS build FROM labelled l JOIN e ON e.doc_id = l.doc_id JOIN r ON r.doc_id = l.doc_id")
def d59_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    edge = F.least(sum((F.when(F.rlike(low, F.lit(p)), w).otherwise(0) for p, w in _PATTERNS.values()), F.lit(0)), F.lit(100))
    # Each score takes what went before along in the id, so the report is one pass over the texts.
    own = docs.select(F.struct("doc_id", edge.alias("edge"), F.col("text").alias("again")).alias("doc"), "text")
    looped = profiles.loop_score(own, _LOOP, id="doc").select(F.struct("doc.doc_id", "doc.edge", "loop", "doc.again").alias("doc"), F.col("doc.again").alias("text"))
    confused = profiles.confusion(looped, _REFER, id="doc").select(F.struct("doc.doc_id", "doc.edge", "doc.loop", "confusion").alias("doc"), F.col("doc.again").alias("text"))
    return audit.integrity(confused, _M, id="doc").select("doc.*", "score", "label", F.lit("1.0").alias("build"))


@query(f"WITH {_INTEGRITY} SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS index, source, score, label FROM labelled")
def d57_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.struct("doc_id", "source").alias("doc"), "text")
    return tables.indexed(audit.integrity(docs, _M, id="doc").select("doc.*", "score", "label"), "source", "doc_id")


@query(f"WITH {_LOW}, k AS (SELECT doc_id, x, t, {_TOK.format(t='t')} AS k, {_SENTENCES.format(t='x')} AS s FROM b) SELECT doc_id, len(list_distinct(list_filter(k, lambda y: length(y) >= 4 AND NOT list_contains({_list(_STOPS)}, y))))::INTEGER AS content, CAST(CASE WHEN len(k) = 0 THEN 0 ELSE len(list_distinct(k)) * 1000 // len(k) END AS BIGINT) AS variety, lower(coalesce(regexp_extract(x, '@([A-Za-z0-9_.\\-]+)', 1), '')) AS domain, CAST(len(list_filter(range(1, len(k) - 2), lambda i: k[i] = k[i + 2] AND k[i + 1] = k[i + 3])) AS INTEGER) AS echoes, CAST(CASE WHEN len(list_distinct(k)) = 0 THEN 0 ELSE len(list_intersect(k, {_list(_REFER)})) * 1000 // greatest(len(list_distinct(k)), {len(_REFER)}) END AS BIGINT) AS overlap FROM k")
def f_more_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    k = T.tokens(t)
    whole = lambda x: F.floor(x * 1000 + 1e-9).cast("long")
    return _docs(spark, sf_dir).select("doc_id", F.size(T.content_tokens(t, _STOPS, 4, 1_000_000)).alias("content"), whole(T.unique_ratio(k)).alias("variety"), T.email_domain(t).alias("domain"), T.repeated_bigrams(k).alias("echoes"), whole(T.overlap_of_larger(k, F.array(*map(F.lit, _REFER)))).alias("overlap"))


@query(f"WITH n AS (SELECT doc_id, list_transform({_S}, lambda x: CAST(len(regexp_extract_all(x, '\\S+')) AS DOUBLE)) AS n FROM documents), m AS (SELECT *, coalesce(list_sum(n), 0) / greatest(len(n), 1) AS mean FROM n) SELECT doc_id, CAST(floor(sqrt(coalesce(list_sum(list_transform(n, lambda x: (x - mean) * (x - mean))), 0) / greatest(len(n), 1)) * 100 + 0.5) AS BIGINT) AS spread FROM m")
def f33_sentence_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.floor(T.length_spread(F.coalesce("text", F.lit(""))) * 100 + 0.5).cast("long").alias("spread"))
