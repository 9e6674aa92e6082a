"""More queries: reports, price series, joins with fallbacks, updates, states, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _INTEGRITY, _M, _PAIRS, _SENTENCES, _any, _cp, _docs, _lg, _pv
from .functions import text as T
from .operators import audit, reports, tables, traffic
from .plans import logical as L
from .registry import query

_BANDS = ["MODERATE", "SOLID", "WEAK"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.struct("doc_id", "lang", "source").alias("doc"), "text")
    return audit.integrity(docs, _M, id="doc").select("doc.*", "score", "label")


@query(f"WITH {_INTEGRITY} SELECT source, count(*) AS total, CAST(sum(score) * 10 // count(*) AS BIGINT) AS mean_tenths, " + ", ".join(f"count(*) FILTER (WHERE label = '{b}') AS {b.lower()}" for b in _BANDS) + " FROM labelled GROUP BY source")
def a3_account_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.account_stats(_scored(spark, sf_dir), "source", _BANDS)


@query(_pv("SELECT path, count(*) AS calls, CAST(sum(CAST(round(latency * 100) AS BIGINT)) // count(*) AS BIGINT) AS mean_hundredths FROM pv GROUP BY path"))
def a4_endpoint_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.endpoint_latency(L.page_views(spark, sf_dir))


@query(_pv(", w AS (SELECT count(*) AS h, count(DISTINCT ip) AS v, count(DISTINCT path) AS p, count(*) FILTER (WHERE latency > 100) AS s, count(referrer) AS r FROM pv) SELECT 1 AS place, 'hits' AS metric, h AS value FROM w UNION ALL SELECT 2, 'visitors', v FROM w UNION ALL SELECT 3, 'paths', p FROM w UNION ALL SELECT 4, 'slow', s FROM w UNION ALL SELECT 5, 'referred', r FROM w").replace(") , w AS", "), w AS"))
def a15_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.insights(L.page_views(spark, sf_dir))


@query("SELECT event_type AS meter, strftime(ts, '%Y-%m') AS month, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS quantity FROM events GROUP BY 1, 2")
def a17_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("meter"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(F.round("value").cast("long")).alias("quantity"))


@query(_cp("SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY page NULLS FIRST, id NULLS FIRST, raw_text NULLS FIRST) AS place, page, id, coalesce(CAST(page AS VARCHAR), '') || chr(10) || raw_text AS text, count(*) OVER (PARTITION BY entity) AS pages, CAST(sum(coalesce(length(raw_text), 0)) OVER (PARTITION BY entity) AS BIGINT) AS total_chars FROM cp"))
def a19_entity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of all types with their whole texts, in numbered pieces, so that no entity's text is in one row."""
    return tables.entity_pieces(L.company_pages(spark, sf_dir))


@query(f"WITH {_INTEGRITY} SELECT source, arg_max(doc_id, row(score, -doc_id)) AS best, arg_min(doc_id, row(score, doc_id)) AS worst, max(score) AS best_score, min(score) AS worst_score, count(*) AS pages FROM labelled GROUP BY source")
def a21_best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_and_worst(_scored(spark, sf_dir), "source", "doc_id")


@query(f"WITH {_INTEGRITY} SELECT s.source, CAST(sum(s.score * d.n_chars) * 10 // sum(d.n_chars) AS BIGINT) AS mean_tenths FROM labelled s JOIN documents d ON s.doc_id = d.doc_id GROUP BY s.source")
def a22_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.struct("doc_id", "source", "n_chars").alias("doc"), "text")
    return reports.weighted_mean(audit.integrity(docs, _M, id="doc").select("doc.*", "score"), "source", "score", "n_chars")


@query(f"WITH {_INTEGRITY} SELECT count(*) AS total, CAST(sum(score) // greatest(count(*) FILTER (WHERE score > 0), 1) AS BIGINT) AS mean, count(*) FILTER (WHERE score >= 60) AS clear, count(*) FILTER (WHERE score > 0 AND score < 50) AS issues FROM labelled")
def a23_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.leaderboard(_scored(spark, sf_dir), 60, 50)


@query(_pv("SELECT ip AS tenant, date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) FILTER (WHERE path = '/error') AS errors FROM pv GROUP BY 1, 2"))
def a35_tenant_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.page_views(spark, sf_dir).groupBy(F.col("ip").alias("tenant"), F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("path") == "/error").alias("errors"))
    return got.select("tenant", F.col("w.start").alias("minute"), "requests", "errors")


@query(_pv("SELECT ip, count(*) AS used, max(ts) AS last_used FROM pv GROUP BY ip"))
def a41_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_views(spark, sf_dir).groupBy("ip").agg(F.count("*").alias("used"), F.max("ts").alias("last_used"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))


_PRICES = "SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS close, count(*) AS volume FROM orders GROUP BY 1, 2"


@query(_PRICES)
def u9_daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.prices(_orders(spark, sf_dir))


@query(f"SELECT ticker, day, close, close - lag(close) OVER (PARTITION BY ticker ORDER BY day) AS change FROM ({_PRICES})")
def w10_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.momentum(reports.prices(_orders(spark, sf_dir)))


@query(f"SELECT ticker, day, close FROM ({_PRICES}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) <= 5")
def w11_last_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_n(reports.prices(_orders(spark, sf_dir)).select("ticker", "day", "close"), ["ticker"], [F.desc("day")], 5)


@query("SELECT event_id, user_id, 'T-' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS task FROM events")
def w13_task_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.numbered(L.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "task", "T-").drop("ts")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) = 1")
def w19_chosen_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_n(L.turns(spark, sf_dir).withColumn("n", F.length("text")), ["conv_id", "role"], [F.desc("n"), F.asc("turn")], 1).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, n, coalesce(greatest(0, lag(n) OVER w - n) - greatest(0, n - lag(n) OVER w), 0) AS delta FROM (SELECT conv_id, turn, CAST(coalesce(length(text), 0) AS INTEGER) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w14_state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("n").over(W.partitionBy("conv_id").orderBy("turn"))
    own = L.turns(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return own.select("conv_id", "turn", "n", F.coalesce(F.when(before.isNotNull(), F.greatest(F.lit(0), before - F.col("n")) - F.greatest(F.lit(0), F.col("n") - before)), F.lit(0)).alias("delta"))


@query("SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 5) k ON c.conv_id = k.conv_id WHERE contains(lower(c.text), 'the')")
def j2_message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = L.turns(spark, sf_dir)
    long = t.groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 5").select("conv_id")
    return t.join(long, "conv_id").where(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0")
def j4_filtered_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id").join(L.table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN n < 500000 THEN 'thin' ELSE 'present' END AS status FROM customer LEFT JOIN (SELECT o_custkey, sum(CAST(round(o_totalprice) AS BIGINT)) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j6_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.round("o_totalprice").cast("long").alias("n"))
    return reports.presence(L.table(spark, sf_dir, "customer"), o, "c_custkey", "n", 500000)


@query("SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, 9 AS v FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j10_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_hit(L.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v")), _docs(spark, sf_dir).select("doc_id", F.lit(9).alias("v")), "doc_id")


@query("SELECT a.n_regionkey, a.n_nationkey, b.n_nationkey AS opponent FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def j13_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = L.table(spark, sf_dir, "nation")
    b = n.select(F.col("n_regionkey").alias("_r"), F.col("n_nationkey").alias("opponent"))
    return n.join(b, (F.col("n_regionkey") == F.col("_r")) & (F.col("n_nationkey") != F.col("opponent"))).select("n_regionkey", "n_nationkey", "opponent")


@query("SELECT r_name, string_agg(n_name || ':' || s, ';' ORDER BY n_name) AS children FROM (SELECT r_name, n_name, count(s_suppkey) AS s FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY r_name")
def j14_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (L.table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    per = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    both = n.join(per, "n_nationkey", "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", F.coalesce("s", F.lit(0)).alias("s")))), lambda x: F.concat_ws(":", x["n_name"], x["s"].cast("string"))), ";").alias("children"))


@query("WITH s AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) SELECT a.doc_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 3")
def j17_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.neighbours(_docs(spark, sf_dir), "doc_id", F.size(F.split("text", "\n")), 3)


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'click' WHEN 'signup' THEN 'purchase' ELSE event_type END AS event_type FROM events")
def j19_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([("view", "click", True), ("signup", "purchase", True), ("error", "click", False)], "pointer string, canonical string, active boolean")
    return reports.resolved(L.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", s)


@query("WITH a AS (SELECT text, count(*) AS f FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT text, count(*) AS f FROM documents WHERE lang IS DISTINCT FROM 'en' GROUP BY 1) SELECT md5(text) AS pointer, CAST(sum(f) AS BIGINT) AS frequency, text AS original FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY text")
def a31_dictionary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    own = lambda test: _docs(spark, sf_dir).where(test).groupBy(F.md5("text").alias("pointer")).agg(F.count("*").alias("frequency"), F.min("text").alias("original"))
    return reports.merged_counts(own(english), own(~english), "pointer")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN toxic + 10 ELSE quality END AS v FROM labels")
def u9_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = L.table(spark, sf_dir, "labels")
    return reports.last_write(lab.select("doc_id", F.col("quality").alias("v")), lab.where("toxic = 1").select("doc_id", (F.col("toxic") + 10).alias("v")), "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'staged' ELSE 'written' END AS route, coalesce(l.quality, 0) + 1 AS version FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def u11_routed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = L.table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("locked"), F.col("quality").alias("version"))
    return reports.routed_writes(target, _docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def u4_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = L.table(spark, sf_dir, "labels")
    return lab.where("quality = 1").select("doc_id").intersect(lab.where("toxic = 0").select("doc_id"))


@query("SELECT DISTINCT source, lang FROM documents")
def u5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("source", "lang").distinct()


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def u13_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.deleted(_docs(spark, sf_dir).select("doc_id", "source"), L.table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query(f"""WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), f AS (SELECT doc_id, {', '.join(f"{_any('t', own)} AS f_{k}" for k, own in _M.items())}, contains(t, 'and') AND contains(t, 'that') AS f_list FROM b),
s AS (SELECT doc_id, CASE WHEN f_defer AND NOT f_constraint THEN 'CONFIRMED' WHEN f_defer THEN 'PROBABLE' ELSE 'FALSE' END AS deferral, CASE WHEN f_collapse AND f_list THEN 'CONFIRMED' WHEN f_collapse THEN 'PROBABLE' ELSE 'FALSE' END AS collapse,
CASE CAST(f_constraint AS INT) + CAST(f_capability AND NOT f_constraint AS INT) + CAST(f_hedge OR f_blend AS INT) + CAST(f_calm OR f_reassure AS INT) WHEN 4 THEN 'CONFIRMED' WHEN 3 THEN 'PROBABLE' ELSE 'FALSE' END AS substitution FROM f)
SELECT *, CASE WHEN deferral = 'FALSE' AND collapse = 'FALSE' AND substitution = 'FALSE' THEN ['NONE'] ELSE list_filter([CASE WHEN collapse <> 'FALSE' THEN 'collapse' END, CASE WHEN substitution <> 'FALSE' THEN 'substitution' END, CASE WHEN deferral <> 'FALSE' THEN 'deferral' END], lambda x: x IS NOT NULL) END AS dominance FROM s""")
def d4_d5_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.states(_docs(spark, sf_dir), _M)


_TAGS = {"T1": ["this"], "T3": ["there", "les"], "T6": ["which", "here"], "T8": ["then"]}


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {_any('t', own)} THEN '{k}' END" for k, own in _TAGS.items()) + "], lambda x: x IS NOT NULL) AS tags FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def d3_tilt_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tilt(_docs(spark, sf_dir), _TAGS)


@query(f"SELECT doc_id, CASE WHEN {_any('lower(text)', ['licensed', 'token'])} THEN 'HUMAN_INTERNAL' ELSE 'AI_PATH' END AS route FROM documents")
def d16_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.routes(_docs(spark, sf_dir), ["licensed", "token"])


@query(f"WITH {_INTEGRITY} SELECT doc_id, CASE WHEN score < 50 THEN 'UNSTABLE' WHEN score < 75 THEN 'PARTIAL' WHEN score < 90 THEN 'STABLE' ELSE 'OPTIMAL' END AS structural, CASE WHEN 100 - score < 30 THEN 'STABLE' WHEN 100 - score < 60 THEN 'WATCH' WHEN 100 - score < 80 THEN 'TENSION' ELSE 'CRITICAL' END AS risk FROM labelled")
def d51_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return _scored(spark, sf_dir).select("doc_id", T.banded(s, [(50, "UNSTABLE"), (75, "PARTIAL"), (90, "STABLE")], "OPTIMAL").alias("structural"), T.banded(100 - s, [(30, "STABLE"), (60, "WATCH"), (80, "TENSION")], "CRITICAL").alias("risk"))


@query(_PAIRS + f", o AS (SELECT *, {_SENTENCES.format(t='prompt')} AS s FROM m) SELECT conv_id, i, substr(coalesce(s[1], ''), 1, 400) AS objective, CAST(floor(alike * 1000 + 0.5) AS BIGINT) AS similarity, CAST(floor((1 - alike) * 1000 + 0.5) AS BIGINT) AS drift FROM o")
def d7_objective_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.objective(tables.pairs(L.turns(spark, sf_dir)))


@query("SELECT doc_id FROM documents WHERE text IS NULL OR length(text) < 200")
def p11_thin_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("text is null or length(text) < 200").select("doc_id")


@query("SELECT doc_id, CASE WHEN lower(trim(source)) IN ('src1', 'src2') THEN 'live_feed' ELSE 'manual' END AS audit_source FROM documents")
def p18_audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.when(F.lower(F.trim("source")).isin("src1", "src2"), "live_feed").otherwise("manual").alias("audit_source"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'auto')")
def p17_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("12")) | F.contains(F.lower("c_mktsegment"), F.lit("auto"))).select("c_custkey", "c_name")


@query(_lg("SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(-cents) AS BIGINT) AS spent, sum(-cents) <= 20000 AS within FROM lg WHERE type = 'charge' GROUP BY 1, 2"))
def f38_spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.ledger(spark, sf_dir).where("type = 'charge'").groupBy("user_id", F.to_date("ts").alias("day")).agg((-F.sum("cents")).alias("spent"))
    return got.withColumn("within", F.col("spent") <= 20000)


@query(_pv("SELECT id, ts + CASE WHEN dayofyear(ts) BETWEEN 67 AND 304 THEN INTERVAL '-4 hours' ELSE INTERVAL '-5 hours' END AS eastern FROM pv"))
def f28_eastern(spark: SparkSession, sf_dir: str) -> DataFrame:
    summer = F.dayofyear("ts").between(67, 304)
    return L.page_views(spark, sf_dir).select("id", F.when(summer, F.col("ts") - F.expr("interval 4 hours")).otherwise(F.col("ts") - F.expr("interval 5 hours")).alias("eastern"))


@query("SELECT doc_id, CAST(round_even(length(text) / 4.0, 0) AS INTEGER) AS quarter, CAST(greatest(1, length(text) // 4) AS INTEGER) AS floor FROM documents")
def f19_approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.approx_tokens(F.col("text"), "quarter").alias("quarter"), T.approx_tokens(F.col("text"), "floor").alias("floor"))


@query(_pv("SELECT ip, count(*) AS slow, count(*) FILTER (WHERE latency > 150) AS very_slow FROM pv WHERE latency > 100 GROUP BY ip"))
def t13_slow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_views(spark, sf_dir).where("latency > 100").groupBy("ip").agg(F.count("*").alias("slow"), F.count_if(F.col("latency") > 150).alias("very_slow"))


@query(_pv(", g AS (SELECT ip, ts, id, CASE WHEN ts - lag(ts) OVER (PARTITION BY ip ORDER BY ts, id) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM pv), s AS (SELECT ip, ts, sum(new) OVER (PARTITION BY ip ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT ip, min(ts) AS started, count(*) AS hits FROM s GROUP BY ip, k").replace(") , g AS", "), g AS"))
def t3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.page_views(spark, sf_dir).groupBy("ip", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("hits"))
    return got.select("ip", F.col("w.start").alias("started"), "hits")


@query("SELECT DISTINCT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def u12_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.table(spark, sf_dir, "events")
    return traffic.between(e.unionByName(e), "2024-01-01", "2024-02-01").dropDuplicates(["event_id"]).select("event_id")
