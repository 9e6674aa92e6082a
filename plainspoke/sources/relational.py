"""Relational tables over JDBC, read by many tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _literal(value: object) -> str:
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def ranges(column: str, bounds: list) -> list[str]:
    """Predicates that part a table between ``bounds``: each row meets just one of them, those below the first bound and those without a value too. Bounds are sorted and told apart first."""
    c, cuts = _quoted(column), sorted(set(bounds))
    if not cuts:
        return ["1 = 1"]
    first = f"{c} < {_literal(cuts[0])} OR {c} IS NULL"
    between = [f"{c} >= {_literal(a)} AND {c} < {_literal(b)}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [first, *between, f"{c} >= {_literal(cuts[-1])}"]


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: list | None = None, parts: int | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a database; filters, columns and counts that Spark can hand down are done there.

    ``bounds`` of a column of any sortable type: one task for each range between them.
    ``parts`` of a column of whole numbers: equal ranges between its least and its
    greatest value, which the database is asked for. Neither: one task, for small tables.
    """
    properties = properties or {}
    if bounds is not None:
        return spark.read.jdbc(url, table, predicates=ranges(column, bounds), properties=properties)
    if parts is None or parts < 2:
        return spark.read.jdbc(url, table, properties=properties)
    c = _quoted(column)
    low, high = spark.read.jdbc(url, f"(SELECT MIN({c}) AS LOW, MAX({c}) AS HIGH FROM {table}) ends", properties=properties).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=properties)
    step = max(1, -(-(int(high) - int(low) + 1) // parts))
    return spark.read.jdbc(url, table, predicates=ranges(column, list(range(int(low) + step, int(high) + 1, step))), properties=properties)
