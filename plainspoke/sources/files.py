"""Traces, stored scores, threads as text, files to score, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import traffic

#: The columns of a trace, one JSON object a line.
TRACE = "request_id string, timestamp timestamp, status string, iterations int, ai_invoked boolean, final_score double, token_estimate_saved long, token_estimate_output long, ai_calls array<struct<iteration:int,tokens_in:long,tokens_out:long>>"
SCORES = "csi struct<score:double,label:string>, nti struct<score:double,label:string>"
#: Sizes of a file to score, in bytes and characters, and the endings that are read.
MOST_BYTES, MOST_CHARS, ENDINGS = 2 << 20, 50_000, ("txt", "md", "csv", "html")
_HUMAN, _MACHINE = r"(?i)^\s*(human|you|user)( said)?\s*:\s*", r"(?i)^\s*(ai|assistant|bot)( said)?\s*:\s*"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces out of JSON Lines; a line that isn't an object gives nulls."""
    return spark.read.schema(TRACE).json(path)


def trace_calls(traces: DataFrame) -> DataFrame:
    """(request_id, status, iterations, call, tokens_in, tokens_out): one row a call, one with nulls for traces without any."""
    far = traces.select("request_id", "status", "iterations", F.posexplode_outer("ai_calls").alias("call", "c"))
    return far.select("request_id", "status", "iterations", "call", "c.tokens_in", "c.tokens_out")


def trace_summary(traces: DataFrame) -> DataFrame:
    """(status, n, iterations, saved): traces, iterations and tokens saved by status."""
    return traces.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("iterations", F.lit(0))).alias("iterations"), F.sum(F.coalesce("token_estimate_saved", F.lit(0))).alias("saved"))


def parse_scores(df: DataFrame, column: str) -> DataFrame:
    """``df`` with csi and nti out of a column of stored JSON, which goes; both null where it is no JSON."""
    (own,) = [c for c in ("_scores", "__scores") if c not in df.columns][:1]
    got = df.withColumn(own, F.from_json(column, SCORES))
    return got.withColumns({"csi": F.col(own)["csi"], "nti": F.col(own)["nti"]}).drop(own, column)


def parse_thread(raw: DataFrame, id: str = "doc_id", text: str = "text", human: str = _HUMAN, machine: str = _MACHINE) -> DataFrame:
    """(id, turn, role, text) of transcripts: a line that begins with a speaker's mark begins a turn, the lines that follow belong to it; lines before the first mark and turns without text are left out."""
    h, m = (lambda x: F.rlike(x, F.lit(human))), (lambda x: F.rlike(x, F.lit(machine)))
    said = lambda x: F.regexp_replace(F.regexp_replace(x, human, ""), machine, "")
    whose = lambda lines: F.transform(lines, lambda x: F.when(h(x), "human").when(m(x), "ai"))
    begins = lambda roles: F.filter(F.transform(roles, lambda r, i: F.when(r.isNotNull(), i)), lambda i: i.isNotNull())

    def turn(lines: Column, roles: Column, at: Column, i: Column, k: Column) -> Column:
        more = F.slice(lines, i + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - i - 1)
        return F.struct(F.get(roles, i).alias("role"), F.btrim(F.array_join(F.concat(F.array(said(F.get(lines, i))), more), "\n"), F.lit(" \t\r\n")).alias("text"))

    all_turns = lambda lines: T.let(whose(lines), lambda roles: T.let(begins(roles), lambda at: F.transform(at, lambda i, k: turn(lines, roles, at, i, k))))
    turns = T.let(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), all_turns)
    return raw.select(F.col(id), F.posexplode(F.filter(turns, lambda t: t["text"] != "")).alias("turn", "t")).select(id, "turn", "t.role", "t.text")


def export_checks(df: DataFrame, account: str, days: int, as_of: str, path: str | None = None) -> DataFrame:
    """An account's rows of the last ``days``, newest first; with a path, also written as CSV with a header."""
    own = traffic.since(df.where(F.col("account") == account), as_of, days).orderBy(F.desc("ts"), "id")
    if path:
        own.write.mode("overwrite").option("header", True).csv(path)
    return own


def store(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Appends results as Parquet or JSON Lines, in folders by columns if any are given."""
    writer = df.write.mode("append")
    writer = writer.partitionBy(*by) if by else writer
    {"parquet": writer.parquet, "json": writer.json}[kind](path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ending, bytes, text, cut) of files to score: those with a known ending and of at most ``MOST_BYTES``; HTML becomes plain text. cut: whether more than ``MOST_CHARS`` characters were there, the limit of one score."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    own = files.select("path", ending.alias("ending"), F.col("length").alias("bytes"), F.col("content").cast("string").alias("t")).where(F.col("ending").isin(*ENDINGS) & (F.col("bytes") <= MOST_BYTES))
    text = F.when(F.col("ending") == "html", T.plain_html(F.col("t"))).otherwise(F.col("t"))
    return own.select("path", "ending", "bytes", text.alias("t")).select("path", "ending", "bytes", F.substring("t", 1, MOST_CHARS).alias("text"), (F.length("t") > MOST_CHARS).alias("cut"))
