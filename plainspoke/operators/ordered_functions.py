"""Folds as table functions for SQL: the argument is a table with PARTITION BY and ORDER BY.

Spark deals and sorts the rows and hands each partition over in Arrow batches, so memory
is one batch, however many rows a key has. A key's rows go through one task, as order decides.

    SELECT * FROM accepted_charges(TABLE(SELECT user_id, id, cents FROM ledger) PARTITION BY user_id ORDER BY (ts, id))

The argument's columns are found by name; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .texts import relay_step
from .traffic import charge_step

_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def fold_function(value: str, start: Any, step: Callable[[Any, Any], tuple[Any, tuple]], kept: dict[str, str], made: dict[str, str]) -> Any:
    """A table function that gives the columns ``kept`` and ``made`` (name: SQL type) of every row, where ``step(state, value)`` gives the next state and the made values."""

    class Fold:
        def __init__(self) -> None:
            self.state = start

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            out = []
            for v in rows.column(value).to_pylist():
                self.state, new = step(self.state, v)
                out.append(new)
            columns = {c: rows.column(c).cast(_ARROW[t]) for c, t in kept.items()}
            columns |= {c: pa.array([x[i] for x in out], _ARROW[t]) for i, (c, t) in enumerate(made.items())}
            yield pa.table(columns)

    return arrow_udtf(Fold, returnType=", ".join(f"{c} {t}" for c, t in (kept | made).items()))


def register(spark: SparkSession) -> None:
    """accepted_charges(id, user_id, cents) and relay_numbers(conv_id, turn, n) in this session's SQL."""
    spark.udtf.register("accepted_charges", fold_function("cents", 0, charge_step, {"id": "long", "user_id": "long", "cents": "long"}, {"accepted": "boolean", "balance": "long"}))
    spark.udtf.register("relay_numbers", fold_function("n", (1, 0), relay_step(), {"conv_id": "long", "turn": "long"}, {"relay": "int", "chars": "long"}))
