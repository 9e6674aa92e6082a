"""Queries of spans, heuristics, arrays of hits, fuller audits, and further reports over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _INTEGRITY, _M, _any, _count, _cp, _docs, _lg, _list, _pv
from .cases_more import _scored
from .cases_signals import _A
from .functions import text as T
from .operators import history, reports, signals, spans, tables, texts, traffic
from .plans import logical as L
from .registry import query

_SIGNALS = [("absolute", "only|none|nur", 2), ("shift", "then the|und die", 3), ("with", "with|avec|mit", 1), ("ending", "[a-z]+tion", 1), ("long", "the [a-z]+ the", 4)]


@query()
def d10_signal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.signal_spans(_docs(spark, sf_dir), _SIGNALS)


@query()
def d11_resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", spans.found(F.col("text"), _SIGNALS).alias("s")).select("doc_id", F.inline(spans.resolved(F.col("s"))))


@query()
def d12_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", spans.found(F.col("text"), _SIGNALS).alias("s")).select("doc_id", F.inline(spans.merged(F.col("s"))))


@query()
def f16_marker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.signal_spans(_docs(spark, sf_dir), spans.marker_signals(_M, {"constraint": 2}))


_P = ("then|sich", "if |wenn", "only|nur", "the |die ", "from|von", "was |war ", "before|im ", "and |und ", "is |ist ")
_TOK = "regexp_extract_all(t, '[a-z0-9'']+')"


@query(f"WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT *, {_TOK} AS k FROM b) SELECT doc_id, list_filter([CASE WHEN len(regexp_extract_all(t, '\\S+')) >= 180 THEN 'TOKEN_BLOAT' END, CASE WHEN len(regexp_extract_all(t, '{_P[0]}')) >= 2 OR len(regexp_extract_all(t, '{_P[1]}')) >= 2 THEN 'CLARIFICATION_TRIGGER' END, CASE WHEN NOT regexp_matches(t, '{_P[2]}') THEN 'BOUNDARY_MISSING' END, CASE WHEN NOT regexp_matches(t, '{_P[3]}') THEN 'ACTION_MISSING' END, CASE WHEN NOT regexp_matches(t, '{_P[4]}') THEN 'OBJECTIVE_MISSING' END, CASE WHEN regexp_matches(t, '{_P[5]}') AND NOT regexp_matches(t, '{_P[6]}') THEN 'COMMITMENT_UNBOUNDED' END, CASE WHEN regexp_matches(t, '{_P[7]}') AND NOT regexp_matches(t, '{_P[8]}') THEN 'CONTRADICTION_UNRESOLVED' END, CASE WHEN len(list_filter(range(1, len(k) - 1), lambda i: k[i] = k[i + 1] AND k[i + 1] = k[i + 2])) >= 2 THEN 'REPETITION_REDUNDANT' END], lambda x: x IS NOT NULL) AS signals FROM k")
def d13_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.heuristics(_docs(spark, sf_dir), *_P)


_KINDS = ("constraint", "hedge", "reassure", "blend")


@query("SELECT doc_id, " + ", ".join(f"list_filter({_list(_M[k])}, lambda x: contains(t, x))[1:{20 if k == 'constraint' else 10}] AS {k}" for k in _KINDS) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def d1_d2_hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", *(F.slice(T.markers(low, _M[k]), 1, 20 if k == "constraint" else 10).alias(k) for k in _KINDS))


_TAGS = {"T1": ["this"], "T3": ["there", "les"], "T5": ["none", "all"], "T6": ["which", "here"], "T7": ["eux"], "T8": ["then"], "T10": ["dans"]}
_SURE, _ACTS, _ALL, _CAN, _WIDE = ["nur", "only"], ["was", "der"], ["all", "que"], ["from", "von"], ["im ", "pour"]
_STOPS = ["that", "with", "this", "nicht", "sich", "avec", "dans"]
_DOMAIN = "list_distinct(list_filter(regexp_extract_all({t}, '[a-z0-9'']+'), lambda x: length(x) >= 4 AND NOT list_contains(" + _list(_STOPS) + ", x)))"
_T9 = f"len(list_filter({_DOMAIN.format(t='a')}, lambda x: NOT list_contains({_DOMAIN.format(t='p')}, x)))"


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations), b AS (SELECT u.conv_id, CAST(u.i AS INTEGER) AS i, lower(coalesce(u.text, '')) AS p, lower(coalesce(a.text, '')) AS a FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.i = a.i AND u.role = 'user' AND a.role = 'assistant') SELECT conv_id, i, list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{k}' END" for k, test in sorted({**{k: _any("a", own) for k, own in _TAGS.items()}, "T2": f"{_any('a', _SURE)} AND NOT {_any('a', _ACTS)}", "T4": f"{_any('a', _WIDE)} OR ({_any('a', _ALL)} AND {_any('a', _CAN)})", "T9": f"{_T9} >= 6 AND {_T9} * 100 >= 55 * len({_DOMAIN.format(t='a')})"}.items(), key=lambda x: int(x[0][1:]))) + "], lambda x: x IS NOT NULL) AS tags FROM b")
def d3_all_tilt_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.all_tilt(tables.pairs(L.turns(spark, sf_dir)), _TAGS, _SURE, _ACTS, _ALL, _CAN, _WIDE, _STOPS)


_CONFLICTS, _PASSIVE, _TIME, _PRONOUNS = [("only", "there"), ("nicht", "nur")], "(is|was|ist|sont) [a-z]+(ed|en|et)", ["then", "dann"], ["that", "die", "it"]
_H, _ACT, _DEFER, _VAGUE = _A
_S2 = "list_filter(string_split(regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_N = {"h": _count("t", _H), "a": _count("t", _ACT), "d": _count("t", _DEFER), "v": _count("t", _VAGUE), "c": " + ".join(f"CAST(contains(t, '{x}') AND contains(t, '{y}') AS INT)" for x, y in _CONFLICTS), "p": f"len(regexp_extract_all(t, '{_PASSIVE}'))", "m": _count("t", _TIME), "r": f"len(list_filter({_S2}, lambda s: list_contains({_list(_PRONOUNS)}, regexp_extract(s, '^\\S+'))))"}


@query(f"WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), n AS (SELECT doc_id, length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS l, {', '.join(f'{x} AS {k}' for k, x in _N.items())} FROM b) SELECT doc_id, CAST(greatest(0, 100 - least(40, h * 5) - CASE WHEN a = 0 THEN 10 ELSE 0 END - least(30, c * 15) - least(25, d * 12) - CASE WHEN p >= 3 THEN least(15, p * 5) ELSE 0 END - CASE WHEN v >= 2 THEN least(12, v * 4) ELSE 0 END - CASE WHEN a > 0 AND m = 0 AND l > 100 THEN 6 ELSE 0 END - CASE WHEN r >= 2 THEN least(10, r * 5) ELSE 0 END) AS INTEGER) AS score, list_filter([CASE WHEN h > 0 THEN 'HEDGE_WORD' END, CASE WHEN a = 0 THEN 'MISSING_OBJECTIVE' END, CASE WHEN c > 0 THEN 'CONFLICTING_DIRECTIVE' END, CASE WHEN d > 0 THEN 'DEFERRED_ENFORCEMENT' END, CASE WHEN p >= 3 THEN 'EXCESSIVE_PASSIVE' END, CASE WHEN v >= 2 THEN 'VAGUE_QUANTIFIER' END, CASE WHEN a > 0 AND m = 0 AND l > 100 THEN 'MISSING_TIMEFRAME' END, CASE WHEN r >= 2 THEN 'AMBIGUOUS_REFERENCE' END], lambda x: x IS NOT NULL) AS violations FROM n")
def d15_full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.full_audit(_docs(spark, sf_dir), {h: 5 for h in _H}, _ACT, _CONFLICTS, _DEFER, _PASSIVE, _VAGUE, _TIME, _PRONOUNS)


@query(f"WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), n AS (SELECT doc_id, length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS l, {', '.join(f'{x} AS {k}' for k, x in _N.items())} FROM b), s AS (SELECT doc_id, CAST(greatest(0, 100 - least(40, h * 5) - CASE WHEN a = 0 THEN 10 ELSE 0 END - least(30, c * 15) - least(25, d * 12) - CASE WHEN p >= 3 THEN least(15, p * 5) ELSE 0 END - CASE WHEN v >= 2 THEN least(12, v * 4) ELSE 0 END - CASE WHEN a > 0 AND m = 0 AND l > 100 THEN 6 ELSE 0 END - CASE WHEN r >= 2 THEN least(10, r * 5) ELSE 0 END) AS INTEGER) AS score, h + d + c > 0 OR a = 0 OR p >= 3 OR v >= 2 OR (a > 0 AND m = 0 AND l > 100) OR r >= 2 AS bad FROM n) SELECT doc_id, score >= 80 AND NOT bad AS strict, score >= 60 AS standard, true AS permissive, CASE WHEN score < 60 THEN 'Score below threshold.' WHEN bad THEN 'Passed with findings.' ELSE 'Clean.' END AS feedback FROM s")
def p20_d17_gate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import decisions

    got = signals.full_audit(_docs(spark, sf_dir), {h: 5 for h in _H}, _ACT, _CONFLICTS, _DEFER, _PASSIVE, _VAGUE, _TIME, _PRONOUNS)
    return got.select("doc_id", *(decisions.gated(got, m).alias(m) for m in ("strict", "standard", "permissive")), signals.feedback(F.col("score"), F.col("violations")).alias("feedback"))


_FR = [("F1", "only|nur", 10), ("F2", "was |war ", 5), ("F3", "then|dann", 7), ("F4", "all |que ", 4)]
_PAIRS = [({"F1", "F3"}, 8, "F1+F3"), ({"F3", "F4"}, -3, "F3+F4")]
_FN = {k: f"len(regexp_extract_all(t, '{p}'))" for k, p, _ in _FR}


@query(f"WITH n AS (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in _FN.items())} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)), g AS (SELECT doc_id, F1, CASE WHEN F1 > 0 THEN F2 ELSE 0 END AS F2, F3, F4 FROM n), s AS (SELECT doc_id, CAST(greatest(0, least(100, {' + '.join(f'{k} * {w}' for k, _, w in _FR)} + CASE WHEN F1 > 0 AND F3 > 0 THEN 8 ELSE 0 END + CASE WHEN F3 > 0 AND F4 > 0 THEN -3 ELSE 0 END)) AS INTEGER) AS friction, list_filter([{', '.join(f'CASE WHEN {k} > 0 THEN {chr(39)}{k}{chr(39)} END' for k, _, _ in _FR)}], lambda x: x IS NOT NULL) AS categories FROM g) SELECT *, CASE WHEN friction < 30 THEN 'B0' WHEN friction < 55 THEN 'B1' WHEN friction < 75 THEN 'B2' ELSE 'B3' END AS band, friction >= 55 AS hold, friction >= 75 AS stop FROM s")
def d19_gated_friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.gated_friction(_docs(spark, sf_dir), _FR, ("F2", "F1"), _PAIRS)


@query("SELECT doc_id, CAST(len(p) AS INTEGER) AS passive, CAST(n AS INTEGER) AS sentences, len(p) * 100 > 40 * n AS overused FROM (SELECT doc_id, list_filter(s, lambda x: regexp_matches(x, '(is|was|ist|sont) [a-z]+(ed|en|et)')) AS p, greatest(len(list_filter(s, lambda x: trim(x) <> '')), 1) AS n FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[.!?]+') AS s FROM documents))")
def d21_passive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.passive_share(_docs(spark, sf_dir), _PASSIVE)


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[$€£] ?[0-9]')) >= 3 OR len(regexp_extract_all(coalesce(text, ''), '\\S+')) < 8 OR regexp_matches(lower(coalesce(text, '')), 'licensed|released under') AS junk, length(coalesce(text, '')) < 200 OR contains(lower(text), 'cart') OR contains(lower(text), 'licensed') OR len(regexp_extract_all(coalesce(text, ''), '[$€£] ?[0-9]')) >= 3 AS product FROM documents")
def p12_p13_junk_and_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", texts.junk(t, boilerplate="licensed|released under").alias("junk"), texts.product_page(t, ["cart", "licensed"]).alias("product"))


@query(_cp(", s AS (SELECT id, string_split(coalesce(raw_text, ''), chr(10)) AS n, lag(string_split(coalesce(raw_text, ''), chr(10))) OVER (PARTITION BY entity, page ORDER BY ts, id) AS o FROM cp), x AS (SELECT id, 'added' AS kind, unnest(list_filter(list_distinct(n), lambda x: NOT list_contains(o, x))) AS line, n AS l FROM s WHERE o IS NOT NULL UNION ALL SELECT id, 'removed', unnest(list_filter(list_distinct(o), lambda x: NOT list_contains(n, x))), o FROM s WHERE o IS NOT NULL) SELECT id, kind, CAST(len(l) - list_position(list_reverse(l), line) AS INTEGER) AS nth, line FROM x").replace(") , s AS", "), s AS"))
def u1_v3_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changed_lines(L.company_pages(spark, sf_dir))


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def u2_renamed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    s = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return c.unionByName(s)


@query("SELECT conv_id, list_sort(list(DISTINCT w)) AS phrases FROM (SELECT conv_id, role, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{9,}')) AS w FROM conversations) GROUP BY conv_id")
def u3_phrase_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = L.turns(spark, sf_dir).select("conv_id", "role", F.explode(T.matches(F.lower(F.coalesce("text", F.lit(""))), "[a-z]{9,}")).alias("w"))
    return reports.phrase_union(w, "conv_id", "role", "w")


@query(_lg(", c AS (SELECT user_id, ts, cents FROM lg WHERE type = 'deposit'), p AS (SELECT id, user_id, ts FROM lg WHERE type = 'charge') SELECT p.id, count(c.ts) AS changes, max(c.ts) AS latest FROM p JOIN c ON c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 7 DAY GROUP BY p.id").replace(") , c AS", "), c AS"))
def j18_changes_within_a_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = L.ledger(spark, sf_dir)
    return traffic.changes_before(lg.where("type = 'charge'").select("id", "user_id", "ts"), lg.where("type = 'deposit'").select("user_id", F.col("ts").alias("since")), "user_id", 7)


@query("WITH s AS (SELECT c_custkey AS id, 'vc' AS kind, o_totalprice AS score, o_orderdate AS ts, o_orderkey AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'other', o_totalprice, o_orderdate, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'), l AS (SELECT id, kind, arg_max(score, row(ts, k)) AS score FROM s GROUP BY id, kind) SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'vc' ELSE 'other' END AS kind, score FROM customer LEFT JOIN l ON l.id = c_custkey AND l.kind = CASE WHEN c_mktsegment = 'BUILDING' THEN 'vc' ELSE 'other' END")
def j21_latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "vc").otherwise("other")
    entities = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"))
    o = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score"), F.struct("o_orderdate", "o_orderkey").alias("at")).join(entities, "id")
    return reports.latest_scores(entities, {k: o.where(F.col("kind") == k).select("id", "score", "at") for k in ("vc", "other")})


@query(f"WITH {_INTEGRITY}, c AS (SELECT source, count(*) AS total, CAST(sum(score) * 10 // count(*) AS BIGINT) AS mean_tenths, map_from_entries([(b, count(*) FILTER (WHERE label = b)) for b in ['FAILING', 'MODERATE', 'POOR', 'SOLID', 'STRONG', 'WEAK']]) AS x FROM labelled GROUP BY source), o AS (SELECT d.source, count(*) FILTER (WHERE l.toxic = 1) AS overrides, count(*) FILTER (WHERE l.quality = 1) * 100 // count(*) AS accepted FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source), s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS spent FROM documents GROUP BY source) SELECT c.source, total, mean_tenths, coalesce(overrides, 0) AS overrides, CAST(coalesce(accepted, 0) AS BIGINT) AS accepted, CAST(round(CAST(spent AS DECIMAL(18,0)) * 0.0000115, 4) AS DECIMAL(18,4)) AS spend FROM c LEFT JOIN o ON o.source = c.source LEFT JOIN s ON s.source = c.source".replace(", map_from_entries([(b, count(*) FILTER (WHERE label = b)) for b in ['FAILING', 'MODERATE', 'POOR', 'SOLID', 'STRONG', 'WEAK']]) AS x", ""))
def a3_full_account_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    lab = L.table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id")
    spent = docs.select("source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return reports.full_account_stats(_scored(spark, sf_dir), lab.select("source", (F.col("toxic") == 1).alias("override"), (F.col("quality") == 1).alias("accepted")), spent, "source")


@query(_pv(", w AS (SELECT count(*) AS hits, count(DISTINCT ip) AS visitors, count(DISTINCT path) AS paths, count(*) FILTER (WHERE latency > 100) AS slow, count(referrer) AS referred, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (WHERE path = '/purchase') AS purchases, count(*) FILTER (WHERE path = '/error') AS errors, count(*) FILTER (WHERE path = '/signup') AS signups, count(DISTINCT ip) FILTER (WHERE path = '/purchase') AS buyers, count(*) FILTER (WHERE hour(ts) < 6) AS nightly, count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS weekend, count(*) FILTER (WHERE latency > 150) AS very_slow FROM pv) SELECT place, metric, value FROM (" + " UNION ALL ".join(f"SELECT {i} AS place, '{m}' AS metric, {m} AS value FROM w" for i, m in enumerate(traffic.METRICS, 1)) + ")").replace(") , w AS", "), w AS"))
def a15_thirteen_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.insights(L.page_views(spark, sf_dir))


@query("SELECT c.conv_id, c.turn, n FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations) c WHERE n BETWEEN 21 AND 40")
def o4_o10_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_of(L.turns(spark, sf_dir).select("conv_id", "turn"), ["conv_id", "turn"], 2, 20, "n")


_LINKS = "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY u) - 1 AS INTEGER) AS nth, u AS href FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1))) AS u FROM pages)"
_KIND = "CASE WHEN regexp_matches(lower(href), '^/(a|b|c)') THEN 'values' WHEN regexp_matches(lower(href), '^/(d|e|f|i)') THEN 'about' ELSE 'news' END"


@query(f"WITH l AS ({_LINKS}), k AS (SELECT *, {_KIND} AS kind, CAST(least(length(href), 9) AS INTEGER) AS confidence FROM l), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, kind ORDER BY confidence DESC, nth) = 1) SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, CASE kind WHEN 'news' THEN 0 WHEN 'values' THEN 1 WHEN 'about' THEN 2 ELSE 99 END, nth) AS INTEGER) AS place FROM o")
def o5_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import decisions

    hrefs = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))))
    links = L.table(spark, sf_dir, "pages").select("page_id", F.posexplode(hrefs).alias("nth", "href"))
    low = F.lower("href")
    kind = F.when(F.rlike(low, F.lit("^/(a|b|c)")), "values").when(F.rlike(low, F.lit("^/(d|e|f|i)")), "about").otherwise("news")
    return decisions.best_links(links.withColumns({"kind": kind, "confidence": F.least(F.length("href"), F.lit(9))}), "page_id", "kind", "confidence", {"news": 0, "values": 1, "about": 2})


@query(f"WITH {_INTEGRITY} SELECT doc_id, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'mid' WHEN score > 0 THEN 'bad' ELSE 'none' END AS class, CASE WHEN score < 60 THEN 'HIGH' WHEN score < 75 THEN 'MEDIUM' ELSE 'LOW' END AS execution, CASE WHEN n_chars < 500 THEN 'CHEAP' WHEN n_chars < 5000 THEN 'FAIR' ELSE 'DEAR' END AS cost, CASE WHEN (100 - score) * 60 < 1500 THEN 'STABLE' WHEN (100 - score) * 60 < 3000 THEN 'WATCH' ELSE 'CRITICAL' END AS observability FROM labelled JOIN documents USING (doc_id)")
def p16_d51_classes_and_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import audit

    docs = _docs(spark, sf_dir).select(F.struct("doc_id", "n_chars").alias("doc"), "text")
    s = F.col("score")
    got = audit.integrity(docs, _M, id="doc").select("doc.*", "score")
    return got.select("doc_id", signals.score_class(s, F.lit(0)).alias("class"), T.banded(s, [(60, "HIGH"), (75, "MEDIUM")], "LOW").alias("execution"), T.banded(F.col("n_chars"), [(500, "CHEAP"), (5000, "FAIR")], "DEAR").alias("cost"), T.banded((100 - s) * 60, [(1500, "STABLE"), (3000, "WATCH")], "CRITICAL").alias("observability"))
