"""Queries of decisions, composites, lifecycles and further scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _INTEGRITY, _PATTERNS, _docs, _lg, _list, _pv
from .cases_more import _orders, _PRICES, _scored
from .functions import text as T
from .operators import audit, decisions, reports, traffic
from .plans import logical as L
from .registry import query

_POLICIES = [
    (1, "orders", "read", 10, "deny", {"segment": ["BUILDING", "MACHINERY"], "nation": ["1", "2", "3", "4"]}),
    (2, "orders", "read", 20, "allow", {"segment": ["BUILDING"], "nation": ["2", "3"]}),
    (3, "orders", "read", 5, "deny", {"nation": [str(i) for i in range(10, 20)]}),
    (4, "orders", "write", 50, "deny", {"segment": ["AUTOMOBILE"]}),
]
_HOLDS = {p: " AND ".join(f"list_contains({_list(own)}, {a})" for a, own in c.items()) for p, _, _, _, _, c in _POLICIES}


@query("WITH c AS (SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer), m AS (SELECT c_custkey, list_filter([" + ", ".join(f"CASE WHEN {_HOLDS[p]} THEN {p} END" for p, _, a, _, _, _ in sorted(_POLICIES, key=lambda x: -x[3]) if a == "read") + "], lambda x: x IS NOT NULL)[1] AS policy FROM c) SELECT c_custkey, coalesce(policy = 2, true) AS allowed, policy FROM m")
def f36_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame(_POLICIES, "policy int, resource string, action string, priority int, effect string, conditions map<string,array<string>>")
    c = L.table(spark, sf_dir, "customer")
    asked = c.select("c_custkey", F.lit("orders").alias("resource"), F.lit("read").alias("action"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attributes"))
    return decisions.access(asked, p, "c_custkey")


@query("""WITH g AS (SELECT o_custkey, 'orders' AS feature, count(*) AS used, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey, f AS feature, reason, reason IS NULL AS allowed FROM (SELECT c_custkey, f, CASE WHEN f = 'export' OR used IS NULL THEN 'no_entitlement' WHEN last < TIMESTAMP '1998-01-01' THEN 'trial_expired' WHEN used >= 15 THEN 'limit_exceeded' END AS reason FROM customer CROSS JOIN (VALUES ('orders'), ('export')) AS v(f) LEFT JOIN g ON o_custkey = c_custkey)""")
def f37_entitlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = L.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("used"), F.max("o_orderdate").alias("trial_ends"))
    granted = used.withColumns({"feature": F.lit("orders"), "limit_type": F.lit("count"), "limit_value": F.lit(15)})
    asked = L.table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit("orders"), F.lit("export"))).alias("feature"))
    return decisions.entitlement(asked, granted, ["c_custkey", "feature"], F.lit("1998-01-01").cast("timestamp"))


@query("""WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN ' Session:u-' || user_id WHEN 'click' THEN 'account' WHEN 'error' THEN 'session:bad id' WHEN 'signup' THEN 'shared:topic' END AS token, CASE WHEN json_extract_string(props, '$.k') <> '0' THEN 'key' || user_id END AS k FROM events)
SELECT event_id, CASE WHEN ok THEN 'session' WHEN token = 'account' AND k IS NOT NULL THEN 'account' ELSE 'call' END AS kind, CASE WHEN ok THEN 'session_' || CASE WHEN k IS NULL THEN '' ELSE substr(k, 1, 8) || '_' END || trim(substr(lower(trim(token)), 9)) WHEN token = 'account' AND k IS NOT NULL THEN 'account_' || k ELSE 'call_' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) END AS effective_id, coalesce(token IS NOT NULL AND NOT ok AND NOT (token = 'account' AND k IS NOT NULL), false) AS fell_back
FROM (SELECT *, coalesce(regexp_full_match(lower(trim(token)), 'session:[a-z0-9_-]{1,64}'), false) AS ok FROM t)""")
def f40_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    token = F.when(F.col("event_type") == "view", F.concat(F.lit(" Session:u-"), user)).when(F.col("event_type") == "click", "account").when(F.col("event_type") == "error", "session:bad id").when(F.col("event_type") == "signup", "shared:topic")
    key = F.when(F.get_json_object("props", "$.k") != "0", F.concat(F.lit("key"), user))
    return e.select("event_id", decisions.scope(token, key, F.col("event_id")).alias("s")).select("event_id", "s.*")


_DEFAULTS = {"audit_threshold": 0.6, "max_passes": 2, "token_ceiling": 2000, "gate_mode": "standard"}


@query("SELECT event_id, greatest(0.0, least(1.0, coalesce(CASE WHEN event_type = 'purchase' THEN value / 100 END, 0.6))) AS audit_threshold, CAST(greatest(1, least(5, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 2))) AS INTEGER) AS max_passes, CAST(greatest(100, least(8000, CAST(floor(value * 100) AS INTEGER))) AS INTEGER) AS token_ceiling, CASE event_type WHEN 'click' THEN 'strict' ELSE 'standard' END AS gate_mode FROM events")
def f41_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.table(spark, sf_dir, "events")
    asked = {"audit_threshold": F.when(F.col("event_type") == "purchase", F.col("value") / 100), "gate_mode": F.when(F.col("event_type") == "click", "strict").when(F.col("event_type") == "view", "loose")}
    stored = {"max_passes": F.get_json_object("props", "$.k").cast("int"), "token_ceiling": F.floor(F.col("value") * 100).cast("int"), "gate_mode": F.lit("standard")}
    return e.select("event_id", *decisions.settings(asked, stored, _DEFAULTS))


@query("SELECT event_id, TIMESTAMP '2024-02-01' AS as_of, 'UTC' AS zone, '1.0' AS build, 'r-' || event_id AS request_id, CAST(CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 422 ELSE 502 END AS INTEGER) AS status FROM events")
def f42_f43_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "gated").otherwise("failed")
    own = L.table(spark, sf_dir, "events").select("event_id", decisions.status_code(outcome).alias("status"))
    return decisions.provenance(own, "2024-02-01", "UTC", "1.0", F.concat(F.lit("r-"), F.col("event_id").cast("string")))


_EDGE = "least(" + " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for p, w in _PATTERNS.values()) + ", 100)"
_HINT = "CASE WHEN score >= 75 AND e < 60 THEN 'AI_OPTIMAL' WHEN score < 75 AND e < 40 THEN 'CLARIFICATION_REQUIRED' WHEN score >= 75 THEN 'HUMAN_RECOMMENDED' ELSE 'HUMAN_REQUIRED' END"


@query(f"WITH {_INTEGRITY}, x AS (SELECT doc_id, CAST({_EDGE} AS BIGINT) AS e FROM base) SELECT l.doc_id, score, CAST(e AS INTEGER) AS edge, {_HINT} AS hint, CAST((100 - score) * 60 + e * 40 AS INTEGER) AS risk FROM labelled l JOIN x ON l.doc_id = x.doc_id")
def d52_d53_hint_and_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    edge = F.least(sum((F.when(F.rlike(low, F.lit(p)), w).otherwise(0) for p, w in _PATTERNS.values()), F.lit(0)), F.lit(100))
    # The edge index goes along with the id, so that the two scores need no join.
    docs = _docs(spark, sf_dir).select(F.struct("doc_id", edge.alias("edge")).alias("doc"), "text")
    from .lexicon import PROSE

    got = audit.integrity(docs, PROSE, id="doc").select("doc.*", "score")
    return got.select("doc_id", "score", "edge", decisions.governance_hint(F.col("score"), F.col("edge")).alias("hint"), decisions.risk_composite(F.col("score"), F.col("edge")).alias("risk"))


@query(f"""WITH p AS ({_PRICES}), m AS (SELECT ticker, day, close, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS before FROM p),
w AS (SELECT day, max(close) FILTER (WHERE ticker = '1-URGENT') AS lc, max(before) FILTER (WHERE ticker = '1-URGENT') AS lb, max(close) FILTER (WHERE ticker = '2-HIGH') AS bc, max(before) FILTER (WHERE ticker = '2-HIGH') AS bb, max(close) FILTER (WHERE ticker = '3-MEDIUM') AS fc FROM m GROUP BY day),
c AS (SELECT day, (lc - lb) / lb AS l, (bc - bb) / bb AS b, fc, lb FROM w WHERE lb IS NOT NULL),
s AS (SELECT day, CAST(greatest(0, least(1000, floor(500 + coalesce(l, 0) * 5000 + 0.5) + CASE WHEN fc > 25 THEN -50 WHEN fc < 15 THEN 20 ELSE 0 END + CASE WHEN b > 0 AND l > 0 THEN 20 WHEN b < 0 AND l < 0 THEN -20 ELSE 0 END)) AS BIGINT) AS state FROM c)
SELECT day, state, CASE WHEN state > 550 THEN 'UP' WHEN state < 450 THEN 'DOWN' ELSE 'FLAT' END AS call, CASE WHEN state >= 650 OR state <= 350 THEN 'HIGH' WHEN state > 550 OR state < 450 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM s""")
def d54_market_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.market_state(reports.prices(_orders(spark, sf_dir)).select("ticker", "day", "close"), "1-URGENT", "2-HIGH", "3-MEDIUM")


@query(f"WITH {_INTEGRITY}, g AS (SELECT source, count(*) AS n, CAST(round_even(sum(score) / count(*), 0) AS INTEGER) AS mean FROM labelled GROUP BY source) SELECT source, n, mean, CASE WHEN mean >= 70 THEN 'CLEAR' WHEN mean >= 50 THEN 'MIXED' ELSE 'NOISY' END AS environment, CAST(CASE WHEN mean >= 70 THEN 2 WHEN mean >= 50 THEN 0 ELSE -3 END AS INTEGER) AS delta FROM g")
def a26_feed_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.feed_environment(_scored(spark, sf_dir), "source")


@query("""SELECT o_orderkey AS request_id, coalesce(n, 0) AS n_items, q AS items, CAST(coalesce(r, 0) AS BIGINT) AS n_returns, d AS returns FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) i ON i.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS r, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_orderkey = o_orderkey""")
def j12_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = L.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "request_id")
    checks = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"))
    return decisions.lifecycle(checks, items=(items.select("request_id", "l_quantity"), F.sum("l_quantity").cast("long")), returns=(items.where("l_returnflag = 'R'").select("request_id", "l_shipdate"), F.max("l_shipdate")))


@query("SELECT conv_id, turn, CASE WHEN done THEN 'completed' WHEN coalesce(lag(done) OVER (PARTITION BY conv_id ORDER BY turn), true) THEN 'open' ELSE 'locked' END AS state FROM (SELECT conv_id, turn, coalesce(length(text), 0) > 200 AS done FROM conversations)")
def w18_unlocked_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = L.turns(spark, sf_dir).select("conv_id", "turn", (F.coalesce(F.length("text"), F.lit(0)) > 200).alias("done"))
    return decisions.unlocked(steps, "conv_id", "turn", "done")


@query("SELECT d.doc_id, d.source, coalesce(l.quality, 0) + 1 AS version FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def u15_versioned_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.versioned(L.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("version")), _docs(spark, sf_dir).select("doc_id", "source"), "doc_id")


@query("SELECT event_id, trim(split_part('10.0.' || user_id || '.1 , proxy', ',', 1)) AS client, substr('agent of ' || event_type || ' and more', 1, 14) AS agent FROM events WHERE NOT starts_with('/' || event_type, '/cl') AND NOT starts_with('/' || event_type, '/err') AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def p3_p4_p5_p7_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.table(spark, sf_dir, "events").withColumns({"forwarded": F.concat(F.lit("10.0."), F.col("user_id").cast("string"), F.lit(".1 , proxy")), "path": F.concat(F.lit("/"), "event_type"), "ua": F.concat(F.lit("agent of "), "event_type", F.lit(" and more"))})
    kept = traffic.since(traffic.without_prefixes(e, "path", ["/cl", "/err"]), "2024-01-31", 7)
    return kept.select("event_id", traffic.client_ip(F.col("forwarded")).alias("client"), F.substring("ua", 1, 14).alias("agent"))


@query("SELECT user_id, count(*) AS hits, count(*) FILTER (WHERE NULLIF(trim(b), '') IS NOT NULL) AS named, CAST(sum(coalesce(length(b), 0)) AS BIGINT) AS chars FROM (SELECT user_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN '  ' WHEN 'error' THEN NULL ELSE event_type END AS b FROM events WHERE event_type LIKE '%e%' AND NOT event_type LIKE 'pur%') GROUP BY user_id")
def p8_p9_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.table(spark, sf_dir, "events").where(F.col("event_type").like("%e%") & ~F.col("event_type").like("pur%"))
    own = e.select("user_id", F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "  ").when(F.col("event_type") != "error", F.col("event_type")).alias("b"))
    return own.groupBy("user_id").agg(F.count("*").alias("hits"), F.count_if(traffic.filled(F.col("b"))).alias("named"), F.sum(F.coalesce(F.length("b"), F.lit(0))).alias("chars"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def p21_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.lookup(L.table(spark, sf_dir, "orders"), {"o_orderpriority": "1-URGENT", "o_orderstatus": "O"}, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50).select("o_orderkey", "o_orderdate")


@query("SELECT c.conv_id, c.turn, d.lang, d.source FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id AND c.role = 'user'")
def j3_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.turns(spark, sf_dir).select("conv_id", "turn", "role")
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("_d"), "lang", "source")
    return t.join(d, (F.col("conv_id") == F.col("_d")) & (F.col("role") == "user"), "left").select("conv_id", "turn", "lang", "source")


@query("SELECT event_type AS org, strftime(date_trunc('month', ts), '%Y-%m') AS period, event_type || ':value:' || strftime(date_trunc('month', ts), '%Y-%m') AS id, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS quantity, CAST(date_trunc('month', ts) AS TIMESTAMP) AS since, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS TIMESTAMP) AS until FROM events GROUP BY event_type, date_trunc('month', ts)")
def a18_monthly_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.monthly_meters(L.table(spark, sf_dir, "events"), "event_type", "value", "value")


@query("SELECT count(DISTINCT conv_id) AS sessions, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS asked, count(DISTINCT role) AS roles FROM conversations")
def a32_trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.turns(spark, sf_dir).agg(F.count_distinct("conv_id").alias("sessions"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.count_distinct("role").alias("roles"))


@query(_pv("SELECT path, count(*) AS n, CAST(floor(avg(CAST(round(latency * 100) AS BIGINT))) AS BIGINT) AS mean, CAST(min(latency) * 100 AS BIGINT) AS least, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.75) AS p75 FROM pv GROUP BY path"))
def a36_page_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.vitals(L.page_views(spark, sf_dir), "path", "latency")


@query("SELECT count(DISTINCT l.doc_id) AS changed, count(DISTINCT d.source) AS sources FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS DISTINCT FROM l.toxic")
def a38_changed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = L.table(spark, sf_dir, "labels").where("not (quality <=> toxic)").select("doc_id")
    return lab.join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").agg(F.count_distinct("doc_id").alias("changed"), F.count_distinct("source").alias("sources"))


@query("SELECT count(DISTINCT user_id) AS active FROM events WHERE ts >= TIMESTAMP '2024-01-30'")
def a40_active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).agg(F.count_distinct("user_id").alias("active"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def a39_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_counts({t: L.table(spark, sf_dir, t) for t in _TABLES})


@query("SELECT doc_id, CAST(len(regexp_extract_all(t, '[a-z]+tion')) AS INTEGER) AS n, coalesce(regexp_extract(t, '[a-z]+tion'), '') AS first, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[a-z]+tion'))), ' ') AS every FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def f15_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.lower(F.coalesce("text", F.lit(""))), "[a-z]+tion"
    return _docs(spark, sf_dir).select("doc_id", F.regexp_count(t, F.lit(p)).alias("n"), F.coalesce(T.first_match(t, p), F.lit("")).alias("first"), F.array_join(F.array_sort(F.array_distinct(T.matches(t, p))), " ").alias("every"))


@query(_lg("SELECT id, CAST(round(CAST(abs(cents) AS DECIMAL(18,0)) * 0.00015, 6) AS DECIMAL(18,6)) AS markup FROM lg"))
def f21_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger(spark, sf_dir).select("id", T.markup(F.abs("cents").cast("decimal(18,0)") * F.expr("0.001BD")).alias("markup"))


_KINDS = {"news": ["the", "from"], "letter": ["nicht", "der"], "about": ["avec", "les"]}


@query("SELECT page_id, CASE WHEN greatest(" + ", ".join(f"s_{k}" for k in _KINDS) + ") = 0 THEN 'other' " + " ".join(f"WHEN s_{k} = greatest({', '.join(f's_{x}' for x in _KINDS)}) THEN '{k}'" for k in _KINDS) + " END AS kind FROM (SELECT page_id, " + ", ".join("CAST(" + " OR ".join(f"contains(lower(html), '{w}')" for w in own) + " AS INTEGER) * 3 + CAST(" + " OR ".join(f"contains(lower(url), '{w}')" for w in own) + f" AS INTEGER) * 2 AS s_{k}" for k, own in _KINDS.items()) + " FROM pages)")
def f26_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "pages").select("page_id", T.page_kind(F.lower("url"), F.lower("html"), _KINDS).alias("kind"))


@query(_pv("SELECT id, CAST(round(tanh((latency - 50) / 200) * 1000) AS BIGINT) AS squashed FROM pv"))
def f31_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_views(spark, sf_dir).select("id", F.round(T.squash(F.col("latency") - 50) * 1000).cast("long").alias("squashed"))


_TIERS = [("BUILDING", 1, 20), ("MACHINERY", 2, 10), ("AUTOMOBILE", 1, 5), ("FURNITURE", 3, 40), ("HOUSEHOLD", 1, 15)]


@query(_pv(", t(tier, rpm, monthly) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in _TIERS) + "), n AS (SELECT id, ip, rpm, monthly, row_number() OVER (PARTITION BY ip, strftime(ts, '%Y-%m-%d %H:%M') ORDER BY ts, id) AS n, row_number() OVER (PARTITION BY ip, strftime(ts, '%Y-%m') ORDER BY ts, id) AS m FROM pv JOIN customer ON c_custkey = ip JOIN t ON tier = c_mktsegment) SELECT id, ip, CASE WHEN n > rpm THEN 'minute' ELSE 'month' END AS limit FROM n WHERE n > rpm OR m > monthly").replace(") , t(", "), t(").replace("AS limit", "AS \"limit\""))
def f39_limited_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ip"), F.col("c_mktsegment").alias("tier"))
    return traffic.limited_by_tier(L.page_views(spark, sf_dir).join(who, "ip"), spark.createDataFrame(_TIERS, "tier string, rpm int, monthly int"))


@query(_pv("SELECT ip AS tenant, date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) FILTER (WHERE path = '/error') AS errors, CAST(sum(CAST(round(latency * 100) AS BIGINT)) // count(*) AS BIGINT) AS mean FROM pv GROUP BY 1, 2"))
def a35_tenant_minutes_with_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.tenant_minutes(L.page_views(spark, sf_dir))


@query("SELECT doc_id, CASE replace(lower(trim(source)), '-', '_') WHEN 'src1' THEN 'live_feed' WHEN 'src2' THEN 'live_feed' WHEN 'src3' THEN 'batch' ELSE 'manual' END AS audit_source FROM documents")
def p18_audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", reports.audit_source(F.col("source"), {"src1": "live_feed", "src2": "live_feed", "src3": "batch"}).alias("audit_source"))


_FOUR = {"commitment": "is |ist ", "specificity": "[0-9]", "accountability": "was |war ", "hedge": "then|sich"}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(t, '{p}') AS {k}" for k, p in _FOUR.items()) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def p15_four_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.statement_lenses(_docs(spark, sf_dir), _FOUR)
