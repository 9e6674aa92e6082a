"""The registry: every query as (spark, sf_dir) -> DataFrame, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .lexicon import PROSE, lexicon
from .operators import audit, history, tables, texts, traffic
from .plans import logical as L
from .registry import QUERIES, SQL, Query
from .registry import query as _query
from .sources import html

def queries() -> dict[str, Query]:
    from . import cases_cleaning, cases_corporate, cases_decisions, cases_files, cases_history, cases_lenses, cases_more, cases_profiles, cases_questions, cases_ranges, cases_signals, cases_sources, cases_spans, cases_streams, cases_texts, cases_threads  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "documents")


def _list(terms: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _count(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS BIGINT)" for t in terms) + ")"


_WORDS = "len(list_filter(regexp_split_to_array(trim({t}), '\\s+'), lambda x: x <> ''))"
_SQUEEZED = "trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
_SENTENCES = "list_filter(string_split(regexp_replace(" + _SQUEEZED + ", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_TOKENS = "regexp_extract_all(lower({t}), '[a-z0-9'']+')"
_M = PROSE
_SOFT = _M["defer"] + _M["calm"] + _M["hedge"]
#: Integrity per document in SQL, written apart from the operator.
_INTEGRITY = f"""
base AS (SELECT doc_id, lang, source, lower(coalesce(text, '')) AS t FROM documents),
sent AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 3) AS s FROM base),
feat AS (SELECT doc_id, lang, source, greatest(len(s), 1) AS n, greatest({_WORDS.format(t='t')}, 1) AS w,
  len(list_filter(s, lambda x: {_any('x', _M['constraint'])})) AS c_sent, {_count('t', _M['constraint'])} AS c_hits,
  len(list_filter(s, lambda x: NOT {_any('x', _SOFT)})) AS clean,
  {_count('t', _M['hedge'])} + {_count('t', _M['reassure'])} + {_count('t', _M['blend'])} AS framing,
  CAST(coalesce({_any('s[1]', _M['ask'])}, false) AS BIGINT) AS asks,
  {', '.join(f"CAST({_any('t', _M[k])} AS BIGINT) AS f_{k}" for k in ('capability', 'defer', 'blend', 'reassure', 'collapse', 'calm', 'hedge'))} FROM sent),
met AS (SELECT *, CAST(c_hits > 0 AS BIGINT) AS c, CAST(f_capability = 1 AND c_hits = 0 AS BIGINT) AS early FROM feat),
dims AS (SELECT doc_id, lang, source, (c_sent * 6000) // n + least((c_hits * 400000) // w, 4000) AS d1,
  8000 - early * 6000 + asks * 2000 AS d2, greatest((clean * 10000) // n - least(framing * 500, 4000), 0) AS d3,
  10000 - 1200 * f_defer - 600 * f_blend - 800 * f_reassure AS d4,
  10000 - CASE c + early + greatest(f_hedge, f_blend) + greatest(f_calm, f_reassure) WHEN 4 THEN 3000 WHEN 3 THEN 1500 ELSE 0 END
    - CASE WHEN f_defer = 1 AND c = 0 THEN 3000 WHEN f_defer = 1 THEN 1500 ELSE 0 END - 1500 * f_collapse AS d5 FROM met),
scored AS (SELECT *, least((25 * d1 + 20 * d2 + 20 * d3 + 15 * d4 + 20 * d5 + 5000) // 10000, 100) AS score FROM dims),
labelled AS (SELECT *, CASE WHEN score < 25 THEN 'FAILING' WHEN score < 40 THEN 'POOR' WHEN score < 55 THEN 'WEAK' WHEN score < 70 THEN 'MODERATE' WHEN score < 85 THEN 'SOLID' ELSE 'STRONG' END AS label FROM scored)
"""


@_query(f"WITH {_INTEGRITY} SELECT lang, label, count(*) AS n_docs, CAST(sum(score) AS BIGINT) AS sum_score, CAST(sum(d1) AS BIGINT) AS sum_d1, CAST(sum(d3) AS BIGINT) AS sum_d3 FROM labelled GROUP BY lang, label")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    # The score keeps the language beside it, so that no join is needed.
    scored = audit.integrity(docs.select(F.struct("doc_id", "lang").alias("doc"), "text"), _M, id="doc")
    return scored.groupBy("doc.lang", "label").agg(F.count("*").alias("n_docs"), F.sum("score").alias("sum_score"), F.sum("d1").alias("sum_d1"), F.sum("d3").alias("sum_d3"))


@_query(f"WITH {_INTEGRITY} SELECT doc_id, d1, d2, d3, d4, d5, score, label FROM labelled")
def d6_integrity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.integrity(_docs(spark, sf_dir), _M)


_LEX = "(VALUES " + ", ".join(f"('{c}', '{t}')" for c, own in _M.items() for t in own) + ") AS lex(category, term)"
_HITS = f"SELECT doc_id, lang, category, term, CAST((length(t) - length(replace(t, term, ''))) // length(term) AS INTEGER) AS n FROM (SELECT doc_id, lang, lower(text) AS t FROM documents) d, {_LEX} WHERE contains(t, term)"


@_query(f"SELECT doc_id, category, term, n FROM ({_HITS})")
def d1_lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lexicon_hits(_docs(spark, sf_dir), _M)


@_query(f"SELECT doc_id, category, term, n FROM ({_HITS})")
def j15_lexicon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lexicon_join(_docs(spark, sf_dir), lexicon(spark, _M))


@_query(f"SELECT category, term, count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits, count(DISTINCT doc_id) * 10000 // (SELECT count(*) FROM documents) AS share FROM ({_HITS}) GROUP BY category, term")
def a37_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.prevalence(audit.lexicon_hits(_docs(spark, sf_dir), _M), ["category", "term"], _docs(spark, sf_dir), once=True)


@_query(f"SELECT lang, category, count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits FROM ({_HITS}) GROUP BY ROLLUP (lang, category)")
def a37_prevalence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = audit.lexicon_hits(_docs(spark, sf_dir).select(F.struct("doc_id", "lang").alias("doc"), "text"), _M, id="doc")
    return hits.select("doc.lang", "doc.doc_id", "category", "n").rollup("lang", "category").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n").cast("long").alias("n_hits"))


_COMMON = ["the", "and", "der", "les", "que", "of", "in", "de", "la", "to", "on", "die", "und", "as", "it", "et", "el", "en"]


@_query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, w, list_filter(list_transform(w, lambda x: lower(regexp_replace(x, '^[.,!?;:''"()]+|[.,!?;:''"()]+$', '', 'g'))), lambda x: regexp_matches(x, '^[a-z'']+$')) AS a FROM w),
m AS (SELECT doc_id, len(w) AS nw, len(a) AS na, len(list_filter(a, lambda x: list_contains({_list(_COMMON)}, x))) AS known, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0) AS total, coalesce(list_max(list_transform(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)))), 0) AS top FROM a),
r AS (SELECT doc_id, CASE WHEN nw = 0 THEN 'EMPTY' WHEN nw < 4 THEN 'TOO_SHORT' WHEN na < 2 THEN 'NO_LANGUAGE' WHEN known * 10 < na AND na > 4 THEN 'GIBBERISH' WHEN total > 14 * na AND na > 2 THEN 'KEYBOARD_MASH' WHEN na > 4 AND top * 10 > 6 * na THEN 'REPETITION' ELSE 'OK' END AS reason FROM m)
SELECT doc_id, reason, reason = 'OK' AS passed FROM r""")
def p19_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gate(_docs(spark, sf_dir), _COMMON)


_FILL, _HEDGE, _CONS = ["the", "de", "der"], ["then", "with", "avec"], ["only", "was", "nur"]


@_query(f"""WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT doc_id, t, {_TOKENS.format(t='t')} AS k FROM b),
m AS (SELECT doc_id, CAST(greatest(len(k), 1) AS INTEGER) AS total, CAST(len(list_filter(k, lambda x: list_contains({_list(_FILL)}, x))) AS INTEGER) AS filler,
CAST({' + '.join(f"(length(t) - length(replace(t, '{h}', ''))) // {len(h)}" for h in _HEDGE)} AS INTEGER) AS hedge, CAST(len(list_filter(k, lambda x: list_contains({_list(_CONS)}, x))) AS INTEGER) AS "constraint",
CAST(greatest(len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x) <> '')), 1) AS INTEGER) AS n_sentences FROM k)
SELECT *, CAST(100 - CASE WHEN filler * 50 > total THEN 5 ELSE 0 END - CASE WHEN hedge * 50 > total THEN 10 ELSE 0 END - CASE WHEN hedge > "constraint" + 1 THEN 15 ELSE 0 END - CASE WHEN total > 28 * n_sentences THEN 5 ELSE 0 END AS INTEGER) AS clarity FROM m""")
def d21_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.clarity(_docs(spark, sf_dir), _FILL, _HEDGE, _CONS)


_PATTERNS = {"absolute": ("only|none|all", 20), "blame": ("was |were ", 35), "urgency": ("then |there", 25), "vague": ("with|from", 40)}


@_query("SELECT doc_id, CAST(least(" + " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for p, w in _PATTERNS.values()) + ", 100) AS INTEGER) AS index, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{c}' END" for c, (p, _) in _PATTERNS.items()) + "], lambda x: x IS NOT NULL) AS categories FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def d18_edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.weighted_index(_docs(spark, sf_dir), _PATTERNS)


_FRICTION = {"a": ("only", 10), "b": ("was ", 5), "c": ("then", 7)}


@_query("SELECT *, friction >= 55 AS hold, friction >= 75 AS stop FROM (SELECT doc_id, CAST(least(" + " + ".join(f"len(regexp_extract_all(t, '{p}')) * {w}" for p, w in _FRICTION.values()) + ", 100) AS INTEGER) AS friction FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))")
def d19_friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.match_weights(_docs(spark, sf_dir), _FRICTION)


@_query("SELECT doc_id, unnest(list_filter(list_distinct(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{M}\\p{N}_]+')), lambda x: regexp_full_match(x, '[A-Z]{2,6}') AND NOT contains(text, '(' || x || ')'))) AS acronym FROM documents")
def d22_undefined_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.undefined_acronyms(_docs(spark, sf_dir))


@_query("SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\\b')) AS INTEGER) AS n FROM documents) WHERE n > 0")
def d55_card_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.card_like(_docs(spark, sf_dir))


_S = _SENTENCES.format(t="coalesce(text, '')")
_ORDERED = "list_filter(s, lambda x, i: list_position(s, x) = i)"


@_query(f"SELECT doc_id, array_to_string({_ORDERED}, ' ') AS text_out, CAST(len(s) - len(list_distinct(s)) AS INTEGER) AS removed FROM (SELECT doc_id, {_S} AS s FROM documents)")
def x3_dedupe_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dedupe_sentences(_docs(spark, sf_dir))


_GOAL = ["only", "there", "was", "nur"]
_STRIPPED = ["only the", "there", "was", "the"]
_EDGE = "[^\\p{L}\\p{N}_]"


def _without(t: str, phrase: str) -> str:
    return f"regexp_replace({t}, '(?i)(^|{_EDGE})(?:{phrase})($|{_EDGE})', '\\1\\2', 'g')"


_WORD = "list_distinct(list_filter(regexp_split_to_array(trim(lower({x})), '\\s+'), lambda w: length(w) > 3))"


def _kept(s: str) -> str:
    """Sentences that are not nearly one kept before, as a fold over lists of one."""
    near = "len(list_intersect(x[1].w, y.w)) * 100 > 70 * greatest(len(x[1].w), len(y.w))"
    return f"CASE WHEN len({s}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(list_reduce(list_transform({s}, lambda x: [struct_pack(s := x, w := {_WORD.format(x='x')})]), lambda k, x: CASE WHEN len(x[1].w) > 0 AND len(list_filter(k, lambda y: {near})) > 0 THEN k ELSE list_concat(k, x) END), lambda y: y.s) END"


@_query(f"SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE s END, ' ') AS text_out, CAST(len(k) AS INTEGER) AS kept FROM (SELECT doc_id, s, list_filter(s, lambda x: list_has_any(regexp_split_to_array(trim(lower(x)), '\\s+'), {_list(_GOAL)})) AS k FROM (SELECT doc_id, {_S} AS s FROM documents))")
def x5_objective_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.keep_on_objective(_docs(spark, sf_dir), _GOAL)


@_query(f"SELECT doc_id, array_to_string(k, ' ') AS text_out, CAST(len(s) - len(k) AS INTEGER) AS removed FROM (SELECT doc_id, s, {_kept('s')} AS k FROM (SELECT doc_id, {_S} AS s FROM documents))")
def x4_near_dedupe_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.near_dedupe_sentences(_docs(spark, sf_dir))


@_query("WITH b AS (SELECT doc_id, coalesce(text, '') AS t, 0 AS n FROM documents), " + ", ".join(f"s{i} AS (SELECT doc_id, {_without('t', p)} AS t, n + len(regexp_extract_all(t, '(?i)(^|{_EDGE})(?:{p})($|{_EDGE})')) AS n FROM {'b' if i == 0 else f's{i - 1}'})" for i, p in enumerate(p for p in _STRIPPED for _ in range(2))) + f" SELECT doc_id, {_SQUEEZED.format(t='t')} AS text_out, CAST(n AS INTEGER) AS removed FROM s{2 * len(_STRIPPED) - 1}")
def x1_strip_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.strip_phrases(_docs(spark, sf_dir), _STRIPPED)


@_query(f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, CAST({_WORDS.format(t='t')} AS INTEGER) AS n_words, CAST(len({_SENTENCES.format(t='t')}) AS INTEGER) AS n_sentences, CAST(len(list_distinct(k)) AS INTEGER) AS n_distinct, CAST((length(t) - length(replace(t, 'th', ''))) // 2 AS INTEGER) AS n_th, sha256(t) AS sha, md5(t) AS checksum, {_SQUEEZED.format(t='t')} AS squeezed FROM (SELECT doc_id, coalesce(text, '') AS t, {_TOKENS.format(t='text')} AS k FROM documents)")
def f_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    k = T.tokens(t)
    return _docs(spark, sf_dir).select("doc_id", F.size(k).alias("n_tokens"), T.word_count(t).alias("n_words"), F.size(T.sentences(t)).alias("n_sentences"), F.size(F.array_distinct(k)).alias("n_distinct"), T.occurrences(t, "th").alias("n_th"), F.sha2(t, 256).alias("sha"), F.md5(t).alias("checksum"), T.squeezed(t).alias("squeezed"))


@_query("SELECT user_id, bucket, bucket < 30 AS enabled, 'new' AS flag FROM (SELECT user_id, CAST(CAST('0x' || substr(md5('new:' || user_id), 1, 8) AS BIGINT) % 100 AS INTEGER) AS bucket FROM (SELECT DISTINCT user_id FROM events))")
def f34_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = L.table(spark, sf_dir, "events").select("user_id").distinct()
    return traffic.rollout(users, "new", 30, T.rollout_bucket(F.lit("new"), F.col("user_id").cast("string")))


def _pv(sql: str) -> str:
    return f"WITH pv AS ({L.PAGE_VIEWS}) {sql}"


def _lg(sql: str) -> str:
    return f"WITH lg AS ({L.LEDGER}) {sql}"


@_query(_pv("SELECT id, ip, path FROM pv WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND NOT contains(path, 'error')"))
def p_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.without(traffic.between(L.page_views(spark, sf_dir), "2024-01-05", "2024-01-12"), "path", ["error"]).select("id", "ip", "path")


_PERIODS = {"first": ("2024-01-01", "2024-01-08"), "second": ("2024-01-08", "2024-01-15"), "day": ("2024-01-20", "2024-01-21")}


@_query(_pv("SELECT " + ", ".join(f"count(DISTINCT ip) FILTER (WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}') AS {n}_visitors, count(*) FILTER (WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}') AS {n}_hits" for n, (a, b) in _PERIODS.items()) + " FROM pv"))
def a1_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.period_counts(L.page_views(spark, sf_dir), _PERIODS)


@_query(_pv("SELECT path, count(DISTINCT ip) AS visitors, count(*) AS hits FROM pv GROUP BY path ORDER BY visitors DESC, hits DESC, path LIMIT 3"))
def a5_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.top_groups(L.page_views(spark, sf_dir), "path", 3)


@_query(_pv("SELECT referrer, count(DISTINCT ip) AS visitors, count(*) AS hits FROM pv WHERE referrer IS NOT NULL GROUP BY referrer ORDER BY visitors DESC, hits DESC, referrer LIMIT 10"))
def a6_top_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.top_groups(L.page_views(spark, sf_dir).where("referrer is not null"), "referrer", 10)


@_query(_pv("SELECT ip, count(*) AS hits, count(DISTINCT path) AS pages, string_agg(DISTINCT path, ',' ORDER BY path) AS paths, max(ts) AS last_seen, max(referrer) AS referrer FROM pv GROUP BY ip"))
def a7_visitor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.visitor_profiles(L.page_views(spark, sf_dir))


@_query(_pv("SELECT ip, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS hits FROM pv GROUP BY ip HAVING count(DISTINCT CAST(ts AS DATE)) >= 2"))
def a8_repeat_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.repeat_visitors(L.page_views(spark, sf_dir))


@_query(_pv("SELECT ip, count(DISTINCT path) AS pages, max(ts) AS last_seen, min(path) AS first_path FROM pv GROUP BY ip HAVING count(DISTINCT path) >= 5"))
def a9_engaged_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.engaged_visitors(L.page_views(spark, sf_dir))


@_query(_pv("SELECT CAST(ts AS DATE) AS day, count(DISTINCT ip) AS visitors, count(*) AS hits FROM pv GROUP BY 1"))
def a10_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.daily(L.page_views(spark, sf_dir))


@_query(_pv("SELECT hour, hits, CAST(hits * 100 // max(hits) OVER () AS BIGINT) AS bar FROM (SELECT strftime(ts, '%H') || ':00' AS hour, count(*) AS hits FROM pv GROUP BY 1)"))
def a11_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.hourly(L.page_views(spark, sf_dir))


@_query(_pv("SELECT path, count(*) AS entries FROM (SELECT ip, CAST(ts AS DATE) AS day, path FROM pv GROUP BY ALL) GROUP BY path"))
def a12_entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.entry_counts(L.page_views(spark, sf_dir))


@_query(_pv("SELECT ip, CAST(ts AS DATE) AS day, path, id FROM pv QUALIFY row_number() OVER (PARTITION BY ip, CAST(ts AS DATE) ORDER BY ts, id) = 1"))
def w2_first_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.first_touches(L.page_views(spark, sf_dir))


@_query(_pv("SELECT a AS before_visitors, b AS now_visitors, CAST(round((b - a) * 100.0 / greatest(a, 1)) AS BIGINT) AS change, CAST(trunc((b - a) * 100.0 / greatest(a, 1)) AS BIGINT) AS change_cut FROM (SELECT count(DISTINCT ip) FILTER (WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08') AS a, count(DISTINCT ip) FILTER (WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-11') AS b FROM pv)"))
def a13_period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.period_change(L.page_views(spark, sf_dir), "2024-01-01", "2024-01-08", "2024-01-11")


@_query(_pv("SELECT a, b, b * 100 // greatest(a, 1) AS ratio FROM (SELECT count(DISTINCT ip) FILTER (WHERE path = '/view') AS a, count(DISTINCT ip) FILTER (WHERE path = '/purchase') AS b FROM pv)"))
def a14_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.funnel(L.page_views(spark, sf_dir), "/view", "/purchase")


@_query(_pv("SELECT d.day, count(DISTINCT p.ip) AS visitors FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM pv) d JOIN pv p ON CAST(p.ts AS DATE) BETWEEN d.day - INTERVAL 6 DAY AND d.day GROUP BY d.day"))
def w20_rolling_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.rolling_visitors(L.page_views(spark, sf_dir))


@_query(_pv("SELECT ip AS api_key, strftime(ts, '%Y-%m') AS month, count(*) AS calls FROM pv GROUP BY 1, 2"))
def a16_monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.monthly_usage(L.page_views(spark, sf_dir))


@_query(_pv("SELECT path, good, total, good * 1000 // total AS per_mille FROM (SELECT path, count(*) FILTER (WHERE latency <= 50) AS good, count(*) AS total FROM pv GROUP BY path)"))
def a34_attainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.slow_share(L.page_views(spark, sf_dir), 50)


@_query(_pv("SELECT id, ip, minute, nth FROM (SELECT id, ip, strftime(ts, '%Y-%m-%d %H:%M') AS minute, CAST(row_number() OVER (PARTITION BY ip, strftime(ts, '%Y-%m-%d %H:%M') ORDER BY ts, id) AS INTEGER) AS nth FROM pv) WHERE nth > 1"))
def f39_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.rate_limited(L.page_views(spark, sf_dir), 1)


@_query(_lg("SELECT id, user_id, cents, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM lg"))
def w4_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.running_balance(L.ledger(spark, sf_dir))


@_query(_lg("SELECT user_id, epoch, arg_min(id, row(ts, id)) AS id FROM (SELECT id, user_id, ts, sum(cents) OVER w AS balance, count(*) FILTER (WHERE type = 'deposit') OVER w AS epoch FROM lg WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) WHERE balance <= 100 GROUP BY user_id, epoch"))
def w6_low_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.low_balance_crossings(L.ledger(spark, sf_dir))


@_query("WITH RECURSIVE lg AS (" + L.LEDGER + "), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS i FROM lg), f AS (SELECT id, user_id, cents, i, cents >= 0 AS accepted, CAST(greatest(cents, 0) AS BIGINT) AS balance FROM t WHERE i = 1 UNION ALL SELECT t.id, t.user_id, t.cents, t.i, f.balance + t.cents >= 0, CASE WHEN f.balance + t.cents >= 0 THEN f.balance + t.cents ELSE f.balance END FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1) SELECT id, user_id, cents, accepted, balance FROM f")
def w5_accepted_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.accepted_charges(L.ledger(spark, sf_dir))


@_query(_lg("SELECT user_id, CAST(-sum(cents) AS BIGINT) AS spent FROM lg WHERE type = 'charge' GROUP BY user_id HAVING -sum(cents) > 200000"))
def a42_spend_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.spend_alerts(L.ledger(spark, sf_dir), 200000)


_SCHEDULE = [(1, "2024-01-01 00:00:00", "2024-01-08 12:00:00", 2), (2, "2024-01-05 00:00:00", "2024-01-10 00:00:00", 1), (3, "2024-01-09 00:00:00", "2024-01-20 00:00:00", 2), (4, "2024-01-15 00:00:00", "2024-01-16 00:00:00", 1), (5, "2024-01-22 00:00:00", "2024-01-29 00:00:00", 3), (6, "2024-01-25 00:00:00", "2024-01-26 00:00:00", 3)]


@_query(_pv("SELECT id, person FROM pv JOIN (VALUES " + ", ".join(f"({p}, TIMESTAMP '{a}', TIMESTAMP '{b}', {o})" for p, a, b, o in _SCHEDULE) + ") AS s(person, a, b, o) ON ts BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, person) = 1"))
def j9_on_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame(_SCHEDULE, "person int, a string, b string, escalation int")
    s = s.select("person", F.col("a").cast("timestamp_ntz").alias("start_time"), F.col("b").cast("timestamp_ntz").alias("end_time"), "escalation")
    return traffic.covering(L.page_views(spark, sf_dir), s)


@_query(_lg(", p AS (SELECT id, user_id, ts FROM lg WHERE type = 'charge'), d AS (SELECT user_id, ts, max(cents) AS cents FROM lg WHERE type = 'deposit' GROUP BY 1, 2) SELECT p.id, p.user_id, p.ts, d.cents FROM p ASOF LEFT JOIN d ON p.user_id = d.user_id AND p.ts >= d.ts").replace(") , p AS", "), p AS"))
def j18_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = L.ledger(spark, sf_dir)
    deposits = lg.where("type = 'deposit'").select("user_id", F.col("ts").alias("since"), "cents")
    return traffic.as_of(lg.where("type = 'charge'").select("id", "user_id", "ts"), deposits, "user_id", "ts", "since", "cents")


@_query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j5_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "customer").join(L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j7_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = L.table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return L.table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@_query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def j8_correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = L.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return L.table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@_query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def j1_latest_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (L.table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "c_name", "n_name")


def _cp(sql: str) -> str:
    return f"WITH cp AS ({L.COMPANY_PAGES}) {sql}"


@_query(_cp("SELECT id, entity, page FROM cp QUALIFY row_number() OVER (PARTITION BY entity, page ORDER BY ts DESC, id DESC) = 1"))
def w1_latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(L.company_pages(spark, sf_dir), ["entity", "page"], "ts", "id").select("id", "entity", "page")


@_query(_cp(", h AS (SELECT id, entity, page, ts, md5(raw_text) AS checksum FROM cp), k AS (SELECT * FROM h WINDOW w AS (PARTITION BY entity, page ORDER BY ts, id) QUALIFY lag(checksum) OVER w IS DISTINCT FROM checksum OR lag(checksum) OVER w IS NULL) SELECT id, entity, page, checksum, lag(id) OVER w AS previous_id, lag(id) OVER w IS NOT NULL AS changed, lead(id) OVER w IS NULL AS is_current FROM k WINDOW w AS (PARTITION BY entity, page ORDER BY ts, id)").replace(") , h AS", "), h AS"))
def v4_page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(L.company_pages(spark, sf_dir))


@_query(_cp(f"SELECT entity, count(*) AS pages, count(DISTINCT page) AS page_types, CAST(sum({_WORDS.format(t='raw_text')}) AS BIGINT) AS words, max(ts) AS last_seen, array_to_string(list_sort(list(DISTINCT page)), ',') AS types FROM cp GROUP BY entity"))
def a20_entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.entity_rollup(L.company_pages(spark, sf_dir))


@_query(_cp(", s AS (SELECT id, string_split(raw_text, chr(10)) AS n, lag(string_split(raw_text, chr(10))) OVER (PARTITION BY entity, page ORDER BY ts, id) AS t FROM cp) SELECT id, CAST(len(list_filter(list_distinct(n), lambda x: NOT list_contains(t, x))) AS INTEGER) AS added, CAST(len(list_filter(list_distinct(t), lambda x: NOT list_contains(n, x))) AS INTEGER) AS removed FROM s WHERE t IS NOT NULL").replace(") , s AS", "), s AS"))
def u1_line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.line_changes(L.company_pages(spark, sf_dir))


@_query("SELECT coalesce(u.doc_id, t.doc_id) AS doc_id, coalesce(u.score, t.score) AS score, CASE WHEN u.score IS NULL OR u.score IS NOT DISTINCT FROM t.score THEN coalesce(t.changed, u.changed) ELSE u.changed END AS changed FROM (SELECT doc_id, quality AS score, 1 AS changed FROM labels) t FULL JOIN (SELECT doc_id, toxic AS score, 2 AS changed FROM labels WHERE quality = 0 OR toxic = 1) u ON t.doc_id = u.doc_id")
def u6_upsert_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = L.table(spark, sf_dir, "labels")
    return tables.upsert_keep(lab.select("doc_id", F.col("quality").alias("score"), F.lit(1).alias("changed")), lab.where("quality = 0 or toxic = 1").select("doc_id", F.col("toxic").alias("score"), F.lit(2).alias("changed")), "doc_id", "score", "changed")


@_query("SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 0 AS quality FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def u8_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_new(L.table(spark, sf_dir, "labels").select("doc_id", "quality"), _docs(spark, sf_dir).select("doc_id", F.lit(0).alias("quality")), "doc_id")


#: Prompts with answers, their tokens, similarity and lengths, in SQL.
_PAIRS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT u.conv_id, CAST(u.i AS INTEGER) AS i, u.text AS prompt, regexp_extract_all(lower(u.text), '[a-z0-9'']+') AS p, regexp_extract_all(lower(a.text), '[a-z0-9'']+') AS a FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.i = a.i AND u.role = 'user' AND a.role = 'assistant'),
j AS (SELECT *, len(list_intersect(p, a)) AS shared, len(list_distinct(list_concat(p, a))) AS either FROM k),
s AS (SELECT *, CASE WHEN either = 0 THEN 1.0 ELSE round(shared / either, 3) END AS alike FROM j),
m AS (SELECT *, round(1 - alike, 3) AS drift, CASE WHEN len(p) = 0 THEN 0.0 ELSE round(shared / len(list_distinct(p)), 4) END AS mirror, len(a) - len(p) AS longer FROM s) """
_CHARS = "sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"


@_query(f"SELECT *, CASE WHEN per_mille < 700 THEN 'ok' WHEN per_mille < 800 THEN 'watch' WHEN per_mille < 900 THEN 'prepare' WHEN per_mille < 950 THEN 'inject' ELSE 'full' END AS status FROM (SELECT conv_id, turn, CAST({_CHARS} AS BIGINT) AS chars, CAST(sum(greatest(1, coalesce(length(text), 0) // 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens, CAST({_CHARS} * 1000 // 8000 AS BIGINT) AS per_mille FROM conversations)")
def w7_thread_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.thread_windows(L.turns(spark, sf_dir))


@_query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w12_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_turns(L.turns(spark, sf_dir), 3)


@_query("WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS i FROM conversations) SELECT u.conv_id, u.i, u.text AS prompt, a.text AS answer FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.i = a.i WHERE u.role = 'user' AND a.role = 'assistant'")
def j16_prompt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pairs(L.turns(spark, sf_dir))


@_query(_PAIRS + "SELECT conv_id, i, drift, mirror, CAST(longer AS INTEGER) AS longer, coalesce(lag(longer) OVER (PARTITION BY conv_id ORDER BY i) * longer < 0, false) AS flip FROM m")
def w9_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pair_metrics(L.turns(spark, sf_dir))


@_query("SELECT role, count(*) AS messages, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def a28_role_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.role_balance(L.turns(spark, sf_dir))


@_query("WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations), k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM l) SELECT substr(sha256(key), 1, 16) AS pointer, arg_min(line, row(conv_id, turn, pos)) AS original, count(*) AS frequency, count(DISTINCT role) AS roles FROM k WHERE key <> '' GROUP BY key")
def a30_sequence_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sequence_dictionary(L.turns(spark, sf_dir))


@_query("WITH s AS (SELECT conv_id, turn, coalesce(coalesce(length(text), 0) <= lag(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn), false) AS stagnant FROM conversations), i AS (SELECT *, count(*) FILTER (WHERE NOT stagnant) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s) SELECT conv_id, turn, stagnant, CASE WHEN stagnant THEN count(*) FILTER (WHERE stagnant) OVER (PARTITION BY conv_id, island ORDER BY turn) ELSE 0 END AS streak FROM i")
def w15_stagnant_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stagnant_streaks(L.turns(spark, sf_dir))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored artifacts: the status is the topic, the order priority the tier."""
    o = L.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("topic"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"), F.col("o_orderdate").alias("updated"))


_ARTIFACTS = "a AS (SELECT o_orderkey AS key, o_orderstatus AS topic, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS priority, o_orderdate AS updated FROM orders)"
_WEIGHTS = {0: 100, 1: 60, 2: 30, 3: 10}
_BEST = "CAST(CASE priority WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 30 WHEN 3 THEN 10 ELSE 0 END * 100 + floor(2000 * greatest(0, 30 - greatest(0, date_diff('day', CAST(updated AS DATE), DATE '{d}'))) / 30 + 0.5) AS INTEGER)"


_FOUND = f"""WITH {_ARTIFACTS}, t AS (SELECT * FROM a WHERE topic = '{{t}}' AND key <> 1 ORDER BY priority, updated DESC, key LIMIT 12), g AS (SELECT * FROM a WHERE topic <> '{{t}}' AND key <> 1 AND (SELECT count(*) FROM t) < 2 ORDER BY priority, updated DESC, key LIMIT 6),
s AS (SELECT key, {_BEST.format(d='1998-08-03')} AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM g) ORDER BY score DESC, key LIMIT 6)
SELECT key, CAST(NULL AS INTEGER) AS score, true AS anchor FROM a WHERE key = 1 UNION ALL SELECT key, score, false FROM s"""


@_query(_FOUND.format(t="O"))
def o6_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.retrieve(_artifacts(spark, sf_dir), "O", 6, _WEIGHTS, "1998-08-03", 1)


@_query(_FOUND.format(t="X"))
def o6_retrieve_other_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic without artifacts of its own: others fill in."""
    return tables.retrieve(_artifacts(spark, sf_dir), "X", 6, _WEIGHTS, "1998-08-03", 1)


@_query(f"WITH {_ARTIFACTS} SELECT key, priority FROM a QUALIFY priority = 0 OR row_number() OVER (PARTITION BY priority ORDER BY key) <= 2")
def o7_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.capped(_artifacts(spark, sf_dir), 2)


@_query("SELECT host, count(*) AS pages FROM (SELECT regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#:]+)', 1), '^(www|corporate|about)\\.', '') AS host FROM pages) GROUP BY host")
def f25_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.hosts(L.table(spark, sf_dir, "pages"))


@_query()
def s5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_blocks(L.table(spark, sf_dir, "pages"), junk=lambda b: texts.junk(b, boilerplate="released under|licensed"))


@_query()
def s6_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.article_text(L.table(spark, sf_dir, "pages"))


@_query()
def s7_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(L.table(spark, sf_dir, "pages"), url="url")
