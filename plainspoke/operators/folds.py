"""Rules in which order decides, folded over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def folded(rows: DataFrame, key: str, order: list[str], value: str, start: Any, step: Callable[[Any, Any], tuple[Any, tuple]], kept: list[str], made: dict[str, str]) -> DataFrame:
    """The columns ``kept`` and ``made`` (name: SQL type) of every row, where ``step(state, value)`` gives the key's next state and the made values.

    Rows are hash-partitioned by the key and sorted, and only the state of the current key goes from one Arrow batch to the next:
    memory is a batch, however many rows a key has. Nulls come last in order, and are a key like any other.
    """
    names = [*kept, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), start
        for batch in batches:
            out = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if k != at:
                    at, state = k, start
                state, new = step(state, v)
                out.append(new)
            columns = [pa.array([x[i] for x in out], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for i, t in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names)

    types = dict(rows.dtypes)
    dealt = rows.repartition(key).sortWithinPartitions(key, *(rows[c].asc_nulls_last() for c in order))
    return dealt.mapInArrow(run, ", ".join(f"{c} {types.get(c) if c in kept else made[c]}" for c in names))
