"""Queries of signals, structure audits and further reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _FRICTION, _INTEGRITY, _M, _TOKENS, _any, _count, _docs, _list, _pv
from .cases_more import _scored
from .operators import audit, signals, tables, traffic
from .plans import logical as L
from .registry import query

_RULES = [("absolute", "only|none", 40), ("then", "then the", 90), ("with", "with|avec", 90), ("from", "from", 20)]


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, '{n}' AS signal, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '{p}')) AS INTEGER) AS n FROM documents) WHERE n > 0" for n, p, _ in _RULES))
def d10_signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signal_counts(_docs(spark, sf_dir), _RULES)


_W = [f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for _, p, w in _RULES]


@query(f"SELECT doc_id, CASE WHEN w = 0 THEN NULL {' '.join(f'WHEN {c} = w THEN {chr(39)}{n}{chr(39)}' for c, (n, _, _) in zip(_W, _RULES, strict=True))} END AS rule, w AS weight, w >= 90 AS blocked FROM (SELECT doc_id, t, greatest({', '.join(_W)}) AS w FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))")
def d24_best_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.best_rule(_docs(spark, sf_dir), _RULES)


_A = (["then", "with", "les"], ["was", "der"], ["which", "here", "des"], ["that", "from", "les"])


@query(f"SELECT doc_id, CAST(100 - least(h * 5, 40) - CASE WHEN a = 0 THEN 10 ELSE 0 END - least(d * 12, 25) - CASE WHEN v >= 2 THEN 12 ELSE 0 END AS INTEGER) AS score, list_filter([CASE WHEN h > 0 THEN 'HEDGE' END, CASE WHEN a = 0 THEN 'NO_ACTION' END, CASE WHEN d > 0 THEN 'DEFERRAL' END, CASE WHEN v >= 2 THEN 'VAGUE' END], lambda x: x IS NOT NULL) AS violations FROM (SELECT doc_id, {', '.join(f'{_count(chr(116), own)} AS {n}' for n, own in zip('hadv', _A, strict=True))} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))")
def d15_structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.structure_audit(_docs(spark, sf_dir), *_A)


@query("SELECT doc_id, friction, friction >= 55 AS hold, friction >= 75 AS stop, CASE WHEN friction >= 55 THEN 'BLOCK' WHEN friction >= 30 THEN 'CLARIFY' ELSE 'EXECUTE' END AS action FROM (SELECT doc_id, CAST(least(" + " + ".join(f"len(regexp_extract_all(t, '{p}')) * {w}" for p, w in _FRICTION.values()) + ", 100) AS INTEGER) AS friction FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))")
def d20_friction_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.friction_action(audit.match_weights(_docs(spark, sf_dir), _FRICTION), "strict")


_F = ["the", "and", "de", "la", "der"]


@query(f"SELECT doc_id, kept, CASE WHEN kept >= 9200 THEN 'P1' WHEN kept < 7000 THEN 'P3' ELSE 'P2' END AS priority FROM (SELECT doc_id, (len(k) - len(list_filter(k, lambda x: list_contains({_list(_F)}, x)))) * 10000 // greatest(len(k), 1) AS kept FROM (SELECT doc_id, {_TOKENS.format(t=chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS k FROM documents))")
def x17_filler_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.filler_ratio(_docs(spark, sf_dir), _F)


@query(f"WITH {_INTEGRITY} SELECT lang, count(*) AS n, CAST(sum(score) * 10 // count(*) AS BIGINT) AS mean_tenths, max(score) AS best, min(score) AS worst, count(*) FILTER (WHERE label = 'WEAK') AS flagged FROM labelled GROUP BY lang")
def a24_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.rollup_by(_scored(spark, sf_dir), "lang", "score", F.col("label") == "WEAK")


@query(f"WITH {_INTEGRITY} SELECT doc_id, score FROM labelled WHERE score >= 60 AND score < 70")
def p16_score_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score >= 60 and score < 70").select("doc_id", "score")


@query(f"WITH {_INTEGRITY} SELECT doc_id, score FROM labelled ORDER BY score, doc_id LIMIT 10")
def o2_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).orderBy("score", "doc_id").limit(10).select("doc_id", "score")


@query(f"WITH {_INTEGRITY} SELECT doc_id, score FROM labelled WHERE score >= 65")
def d58_stamp_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score >= 65").select("doc_id", "score")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (l.quality IS NULL OR l.quality = 0) AND length(d.text) >= 80")
def p10_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = L.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _docs(spark, sf_dir).join(lab, "doc_id", "left").where("(quality is null or quality = 0) and length(text) >= 80").select("doc_id")


@query("SELECT o_orderkey AS id, coalesce(c.n_name, n.n_name) AS owner, CASE WHEN c.n_name IS NOT NULL THEN 'key' WHEN n.n_name IS NOT NULL THEN 'fallback' END AS how FROM orders LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) c ON o_custkey = c.c_custkey LEFT JOIN nation n ON o_custkey % 30 = n.n_nationkey")
def j11_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = L.table(spark, sf_dir, "customer"), L.table(spark, sf_dir, "nation")
    owners = c.where("c_mktsegment in ('BUILDING', 'MACHINERY')").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("key"), F.col("n_name").alias("owner"))
    rows = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), (F.col("o_custkey") % 30).alias("other"))
    return signals.resolved_owner(rows, owners, n.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("owner")))


@query(_pv("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE path = '/error') AS errors, count(*) FILTER (WHERE path = '/view') AS views, count(*) FILTER (WHERE latency > 100) AS slow FROM pv GROUP BY 1"))
def a2_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pv = traffic.between(L.page_views(spark, sf_dir), "1970-01-01", "2999-01-01")
    return pv.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("path") == "/error").alias("errors"), F.count_if(F.col("path") == "/view").alias("views"), F.count_if(F.col("latency") > 100).alias("slow"))


@query("SELECT doc_id, source, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) AS is_current FROM documents d")
def u10_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.soft_deleted(_docs(spark, sf_dir).select("doc_id", "source"), L.table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query(f"SELECT doc_id, {_any('lower(coalesce(text, ' + chr(39) * 2 + '))', _M['hedge'])} AS hedged, {_count('lower(coalesce(text, ' + chr(39) * 2 + '))', _M['constraint'])} >= 2 AS specific FROM documents")
def p15_lens_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import text as T

    low = F.lower(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", T.has_any(low, _M["hedge"]).alias("hedged"), (F.size(T.markers(low, _M["constraint"])) >= 2).alias("specific"))
