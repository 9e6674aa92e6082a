"""Queries of page histories that are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _cp
from .operators import history
from .plans import logical as L
from .plans import scratch
from .registry import SQL, query

_V4 = SQL["v4_page_versions"].replace("SELECT id, entity, page, checksum,", "SELECT id, entity, CAST(page AS VARCHAR) AS page, checksum,")


@query(_V4)
def v4_merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches by language, so that each brings late versions of the same pages; the last one is merged twice."""
    pages = L.company_pages(spark, sf_dir).join(L.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    store = history.PageStore(spark, scratch.folder(spark, "pages"))
    for name, own in (("en", F.col("lang") == "en"), ("de", F.col("lang") == "de"), ("rest", ~F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))), ("rest", F.lit(True))):
        store.merge(pages.where(own).drop("lang"), name)
    return store.versions()


_BATCH = "CASE WHEN ts * 3 < m THEN 'a' WHEN ts * 3 < 2 * m THEN 'b' ELSE 'c' END"


@query(_cp(f", m AS (SELECT max(ts) AS m FROM cp), h AS (SELECT id, entity, page, ts, {_BATCH} AS batch, md5(raw_text) AS checksum FROM cp, m), k AS (SELECT *, lag(checksum) OVER w AS b, lag(id) OVER w AS p FROM h WINDOW w AS (PARTITION BY entity, page ORDER BY ts, id)) SELECT batch, count(*) FILTER (b IS DISTINCT FROM checksum) AS new, count(*) FILTER (b IS NOT DISTINCT FROM checksum) AS unchanged, count(*) FILTER (p IS NULL) AS first FROM k GROUP BY batch").replace(") , m AS", "), m AS"))
def v2_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in order of time: new versions, unchanged pages and first versions of each."""
    pages = L.company_pages(spark, sf_dir)
    most = pages.agg(F.max("ts")).first()[0]
    store = history.PageStore(spark, scratch.folder(spark, "pages"))
    third = F.when(F.col("ts") * 3 < most, "a").when(F.col("ts") * 3 < 2 * most, "b").otherwise("c")
    for name in "abc":
        store.merge(pages.where(third == name), name)
    return store.counts()


@query("WITH cp AS (" + L.COMPANY_PAGES + "), c AS (SELECT *, md5(raw_text) AS checksum FROM cp QUALIFY row_number() OVER (PARTITION BY entity, page ORDER BY ts DESC, id DESC) = 1) SELECT checksum, CAST(max(len(regexp_extract_all(raw_text, '[^ \\n\\t]+'))) AS DOUBLE) AS score FROM c GROUP BY checksum")
def v6_stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current texts scored once each, though the batches meet some of them twice."""
    store, path = history.PageStore(spark, scratch.folder(spark, "pages")), scratch.folder(spark, "scores")
    store.merge(L.company_pages(spark, sf_dir), "all")
    words = F.size(F.regexp_extract_all("raw_text", F.lit("[^ \\n\\t]+"), F.lit(0)))
    for name in ("first", "again"):
        scores = history.page_scores(store.current(), words, path, name)
    return scores.groupBy("checksum").agg(F.max("score").alias("score"))
