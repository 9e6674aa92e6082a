"""Queries of traces, stored scores, transcripts and exports, made of the supplied tables as their JSON and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _docs
from .plans import logical as L
from .registry import query
from .sources import files


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END AS csi, CASE WHEN toxic = 0 THEN 'q' || quality END AS label, CASE WHEN toxic = 0 THEN toxic + 0.5 END AS nti FROM labels")
def s3_parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit('{"csi":{"score":'), F.col("quality").cast("string"), F.lit(',"label":"q'), F.col("quality").cast("string"), F.lit('"},"nti":{"score":'), (F.col("toxic") + 0.5).cast("string"), F.lit("}}"))
    stored = L.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, made).otherwise("no json").alias("score_json"))
    return files.parse_scores(stored, "score_json").select("doc_id", F.col("csi.score").alias("csi"), "csi.label", F.col("nti.score").alias("nti"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS role, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def s9_parse_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads written as one transcript each, and taken apart again."""
    t = L.turns(spark, sf_dir)
    line = F.concat(F.when(F.col("role") == "user", "Human: ").otherwise("AI said: "), F.coalesce("text", F.lit("")))
    raw = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return files.parse_thread(raw.select("conv_id", F.concat(F.lit("a head line\n"), "text").alias("text")), "conv_id")


@query("SELECT event_id AS id, event_type AS account, ts FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def s10_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = L.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("account"), "ts")
    return files.export_checks(e, "view", 7, "2024-01-31")


@query("SELECT CASE WHEN quality = 1 THEN 'COMPLETE' ELSE 'ROUTED_INTERNAL' END AS status, count(*) AS n, CAST(sum(toxic + 1) AS BIGINT) AS iterations, CAST(sum(n_chars // 4) AS BIGINT) AS saved FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def s2_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "COMPLETE").otherwise("ROUTED_INTERNAL")
    made = L.table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("request_id"), status.alias("status"), (F.col("toxic") + 1).alias("iterations"), F.floor(F.col("n_chars") / 4).alias("token_estimate_saved")))
    return files.trace_summary(made.select(F.from_json(line, files.TRACE).alias("t")).select("t.*"))
