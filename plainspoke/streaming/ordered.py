"""Keyed folds over streams whose rows arrive in any order: rows wait until the watermark has passed them, then they are folded in order of event time.

State lives in the session's state store (RocksDB): the fold's state in a value, the
waiting rows in a list. A timer a key wakes it when the watermark passes its
earliest waiting row. A first state, of any number of keys, comes as a DataFrame
and is dealt to the stores like the rows are; nothing of it is in a closure.

Memory: the rows of one key that wait, which the watermark's delay bounds, not all
that a key ever had. Rows later than the watermark are dropped before they get
here. Rows of equal time are taken in order of ``tie``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """``start``: state of a key that has none. ``step``: (state, row) to (state, output or None); state and output are tuples in order of their schemas, which are DDL."""

    state: str
    start: tuple
    output: str
    step: Callable[[tuple, tuple], tuple[tuple, tuple | None]]


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, waiting: str, outputs: list[str]):
        self.fold, self.waiting, self.outputs = fold, waiting, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state)
        self.rows = handle.getListState("rows", self.waiting)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        self.state.update(tuple(initialState.iloc[0].tolist()[len(key) :]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            own = frame.iloc[:, len(key) :]
            own.iloc[:, 0] = own.iloc[:, 0].astype("int64")
            some = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in own.itertuples(index=False, name=None)]
            self.rows.appendList(some)
            least = min(r[0] for r in some)
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.rows.get()), key=lambda r: [(x is not None, 0 if x is None else x) for x in r])
        due, later = [r for r in rows if r[0] // 1000 <= passed], [r for r in rows if r[0] // 1000 > passed]
        if later:
            self.rows.put(later)
            self._wake(later[0][0], passed)
        else:
            self.rows.clear()
        if due:
            got = self.state.get()
            state, out = tuple(got) if got is not None else self.fold.start, []
            for row in due:
                state, told = self.fold.step(state, row)
                if told is not None:
                    out.append((*key, *told))
            self.state.update(state)
            if out:
                yield pd.DataFrame(out, columns=self.outputs)

    def _wake(self, micros: int, passed: int) -> None:
        """One timer a key, the earliest; those that the watermark has passed are about to go."""
        at = max(micros // 1000, passed) + 1
        timers = [t for t in self.handle.listTimers() if t > passed]
        for t in timers:
            if t > at:
                self.handle.deleteTimer(t)
        if not any(t <= at for t in timers):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, fold: Fold, key: str, ts: str, tie: str, *cols: str, watermark: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """Output of the fold for (key, ts, tie, cols) in order of ts and tie of each key. Steps get rows (ts in microseconds, tie, *cols). ``initial``: (key, state's columns), one row a key."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own = stream.select(key, ts, tie, *cols).withWatermark(ts, watermark)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    waiting = ", ".join(["ts long", f"tie {kinds[tie]}", *(f"c{i} {kinds[c]}" for i, c in enumerate(cols))])
    # Event time stays a column of its own for the watermark; steps see it as a number.
    own = own.select(key, F.unix_micros(ts).alias("_micros"), tie, *cols, ts)
    names = [key, *(part.split()[0] for part in fold.output.split(","))]
    grouped = own.groupBy(key)
    first = initial.groupBy(key) if initial is not None else None
    return grouped.transformWithStateInPandas(_Trimmed(fold, waiting, names), f"{key} {kinds[key]}, {fold.output}", "append", "eventTime", initialState=first)


class _Trimmed(_Ordered):
    """Leaves the watermark's own column out of what waits."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return super().handleInputRows(key, (r.iloc[:, :-1] for r in rows), timerValues)


def relays(stream: DataFrame, most: int = 3000, watermark: str = "10 minutes", initial: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """(conv_id, turn, relay, chars) of (conv_id, ts, turn, text): characters since the last reset; reaching ``most`` ends a relay. ``initial``: (conv_id, relay, chars)."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        relay, chars = state[0], state[1] + row[2]
        return ((relay + 1, 0) if chars >= most else (relay, chars)), (row[1], relay, chars)

    own = stream.withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return ordered(own, Fold("relay int, chars long", (1, 0), "turn long, relay int, chars long", step), "conv_id", ts, "turn", "n", watermark=watermark, initial=initial)


def session_records(stream: DataFrame, keep: int = 8, watermark: str = "10 minutes", initial: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """(conv_id, turn, messages, recent) of (conv_id, ts, turn, role, text): messages so far and the last ``keep`` as a JSON array. ``initial``: stored sessions (conv_id, messages, recent) that go on."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        recent = json.dumps([*json.loads(state[1]), {"turn": row[1], "role": row[2], "chars": row[3]}][-keep:])
        return (state[0] + 1, recent), (row[1], state[0] + 1, recent)

    own = stream.withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return ordered(own, Fold("messages long, recent string", (0, "[]"), "turn long, messages long, recent string", step), "conv_id", ts, "turn", "role", "n", watermark=watermark, initial=initial)


def low_balance_alerts(stream: DataFrame, at_most: int = 100, watermark: str = "10 minutes", initial: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """(user_id, epoch, id) of (user_id, ts, id, type, cents): once after each deposit, the first transaction that leaves ``at_most`` cents or less. ``initial``: (user_id, balance, epoch, told)."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        balance, epoch, told = state
        balance += row[3]
        if row[2] == "deposit":
            epoch, told = epoch + 1, False
        tell = balance <= at_most and not told
        return (balance, epoch, told or tell), ((epoch, row[1]) if tell else None)

    return ordered(stream, Fold("balance long, epoch long, told boolean", (0, 0, False), "epoch long, id long", step), "user_id", ts, "id", "type", "cents", watermark=watermark, initial=initial)


def replayed(spark: SparkSession, rows: DataFrame, ts: str, folder: str, files: int = 4) -> DataFrame:
    """``rows`` as a stream of ``files`` files in no order of time, one a trigger, and at last a row without a key, a year after all others, that lets the watermark pass them."""
    last = rows.agg(F.max(ts).alias(ts)).select((F.col(ts) + F.expr("interval 400 days")).alias(ts))
    rows.repartition(files, F.xxhash64(*rows.columns)).write.mode("overwrite").parquet(f"{folder}/rows")
    end = last.select(*(F.col(ts) if c == ts else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream in append mode gives, written to a folder and read again."""
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
