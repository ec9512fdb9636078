"""Registration of queries and of the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is taken")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def literal(value) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(literal(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A subquery of fixed rows for DuckDB; columns: "a VARCHAR, b INTEGER"."""
    parts = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    names = ", ".join(n for n, _ in parts)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in parts)
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"(SELECT {casts} FROM (VALUES {body}) AS t({names}))"


def fixed_in(catalog: Catalog):
    def fixed(name: str, rows: list[tuple], columns: str, sql: str):
        """A query on fixed rows: f(df) in Spark, sql with {rows} in DuckDB (empty: rows only)."""
        types = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "long", "DOUBLE": "double", "BOOLEAN": "boolean"}
        schema = columns
        for name_, spark_name in types.items():
            schema = schema.replace(name_, spark_name)

        def add(f):
            catalog.query(name, sql.replace("{rows}", values(rows, columns)) if sql else None)(lambda spark, sf: f(spark.createDataFrame(rows, schema)))
            return f

        return add

    return fixed


__all__ = ["Catalog", "fixed_in", "literal", "table", "values"]
