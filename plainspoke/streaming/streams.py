"""Streaming operators. Event time is ``ts``; rows later than the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import audit


def event_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file stream of events whose ts is a UTC timestamp."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def per_minute(stream: DataFrame, key: str, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, "1 minute"), key).count()


def active_visitors(stream: DataFrame, key: str, ts: str = "ts", watermark: str = "10 minutes", exact: bool = True) -> DataFrame:
    """Distinct visitors of each hour, every five minutes. Exact counts keep a window's visitors in the state store, which is what they need; ``exact`` False keeps a sketch instead."""
    n = F.size(F.collect_set(key)) if exact else F.approx_count_distinct(key)
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, "1 hour", "5 minutes")).agg(n.cast("long").alias("visitors"))


def sessions(stream: DataFrame, key: str, gap: str, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), key).count()


def once(stream: DataFrame, key: str, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def sequence_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """(pointer, frequency) of lines as they arrive; update or complete mode."""
    lines = stream.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).withColumn("key", T.dictionary_key(F.col("line"))).where("key <> ''")
    return lines.groupBy(F.substring(F.sha2("key", 256), 1, 16).alias("pointer")).agg(F.count("*").alias("frequency"))


def relay_state(stream: DataFrame, most: int = 3000) -> DataFrame:
    """(conv_id, turn, relay, chars) of each turn as it arrives: characters since the last reset; reaching ``most`` ends a relay.

    Each thread's state is its relay and characters, in the state store. Turns of
    one trigger are taken in order; one that arrives in a later trigger than its
    successor counts when it arrives.
    """
    import pandas as pd

    def fold(key: tuple, frames: object, state: object) -> object:
        rows = pd.concat(list(frames)).sort_values("turn")
        relay, chars = state.get if state.exists else (1, 0)
        out = []
        for n in rows["n"].tolist():
            chars += int(n)
            out.append((relay, chars))
            if chars >= most:
                relay, chars = relay + 1, 0
        state.update((relay, chars))
        yield pd.DataFrame({"conv_id": rows["conv_id"].to_numpy(), "turn": rows["turn"].to_numpy(), "relay": [r for r, _ in out], "chars": [c for _, c in out]})

    own = stream.select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return own.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, turn long, relay int, chars long", "relay int, chars long", "append", "NoTimeout")


def daily_spend(stream: DataFrame, cap: int, key: str = "user_id", ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """(window, key, spent, within) of each day's charges in cents."""
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day"), key).agg(F.sum("cents").alias("spent")).withColumn("within", F.col("spent") <= cap)


def capped_spend(stream: DataFrame, cap: int) -> DataFrame:
    """(id, user_id, accepted, spent): a charge (id, user_id, ts, cents) beyond what is left of its day's cap is refused. A user's state is the day and what was spent on it; a new day starts anew. Charges of one trigger are taken in order of time and id."""
    import pandas as pd

    def fold(key: tuple, frames: Iterator, state: object) -> Iterator:
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        day, spent = state.get if state.exists else ("", 0)
        out = []
        for t, cents in zip(rows["ts"], rows["cents"], strict=True):
            now = t.strftime("%Y-%m-%d")
            if now > day:
                day, spent = now, 0
            take = now == day and spent + cents <= cap  # a charge of a day gone by comes too late
            spent += int(cents) if take else 0
            out.append((take, spent))
        state.update((day, spent))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "user_id": key[0], "accepted": [a for a, _ in out], "spent": [s for _, s in out]})

    own = stream.select("id", "user_id", "ts", F.col("cents").cast("long").alias("cents"))
    return own.groupBy("user_id").applyInPandasWithState(fold, "id long, user_id long, accepted boolean, spent long", "day string, spent long", "append", "NoTimeout")


def monthly_calls(stream: DataFrame, key: str, limit: int, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """(month, key, calls, within): calls of each key and month so far against a free limit; update or complete mode."""
    month = F.date_format(ts, "yyyy-MM").alias("month")
    return stream.withWatermark(ts, watermark).groupBy(month, key).agg(F.count("*").alias("calls")).withColumn("within", F.col("calls") <= limit)


def low_balance_alerts(stream: DataFrame, at_most: int = 100) -> DataFrame:
    """(user_id, epoch, id): once after each deposit, the first transaction (id, user_id, ts, type, cents) that leaves ``at_most`` cents or less."""
    import pandas as pd

    def fold(key: tuple, frames: Iterator, state: object) -> Iterator:
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        balance, epoch, told = state.get if state.exists else (0, 0, False)
        out = []
        for i, kind, cents in zip(rows["id"], rows["type"], rows["cents"], strict=True):
            balance += int(cents)
            if kind == "deposit":
                epoch, told = epoch + 1, False
            if balance <= at_most and not told:
                out.append((key[0], epoch, int(i)))
                told = True
        state.update((balance, epoch, told))
        yield pd.DataFrame(out, columns=["user_id", "epoch", "id"]).astype({"user_id": "int64", "epoch": "int64", "id": "int64"})

    own = stream.select("id", "user_id", "ts", "type", F.col("cents").cast("long").alias("cents"))
    return own.groupBy("user_id").applyInPandasWithState(fold, "user_id long, epoch long, id long", "balance long, epoch long, told boolean", "append", "NoTimeout")


def session_records(stream: DataFrame, keep: int = 8, initial: dict[int, tuple[int, list[str]]] | None = None) -> DataFrame:
    """(conv_id, messages, recent): after each trigger, how many messages of a thread there were and its last ``keep`` as a JSON array. ``initial``, a bounded set of threads that go on, gives what was known of them before (messages, recent)."""
    import json

    import pandas as pd

    def fold(key: tuple, frames: Iterator, state: object) -> Iterator:
        rows = pd.concat(list(frames)).sort_values("turn")
        if state.exists:
            n, recent = state.get
            own = json.loads(recent)
        else:
            n, own = (initial or {}).get(int(key[0]), (0, []))
        own = [*own, *({"turn": int(t), "role": r, "chars": int(c)} for t, r, c in zip(rows["turn"], rows["role"], rows["n"], strict=True))][-keep:]
        n, recent = n + len(rows), json.dumps(own)
        state.update((n, recent))
        yield pd.DataFrame({"conv_id": [key[0]], "messages": [n], "recent": [recent]})

    own = stream.select("conv_id", "turn", "role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return own.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, messages long, recent string", "messages long, recent string", "update", "NoTimeout")


def slow_requests(stream: DataFrame, logged: float = 1000, alarming: float = 5000, latency: str = "latency") -> DataFrame:
    """The requests slower than ``logged`` milliseconds, with whether they are alarming."""
    return stream.where(F.col(latency) > logged).withColumn("alarming", F.col(latency) > alarming)


def slow_weeks(stream: DataFrame, alarming: float, most: int = 3, latency: str = "latency", ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """(window, slow, alert) of each week: alarming requests, and whether there are more than ``most``."""
    slow = stream.where(F.col(latency) > alarming).withWatermark(ts, watermark)
    return slow.groupBy(F.window(ts, "7 days")).agg(F.count("*").alias("slow")).withColumn("alert", F.col("slow") > most)


def scored_to(stream: DataFrame, markers: dict[str, list[str]], path: str, checkpoint: str, id: str = "doc_id") -> object:
    """Starts a query that scores arriving texts and writes each batch under its number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        audit.integrity(batch, markers, id=id).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
