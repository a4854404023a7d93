"""Small row sets for behaviour the tables don't show, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


class Rows:
    """Rows with a Spark schema; timestamps are texts in both, cast by ``times``."""

    def __init__(self, schema: str, *rows: tuple, times: tuple[str, ...] = ()):
        self.schema, self.rows, self.times = schema, list(rows), times
        self.names = [part.split()[0] for part in _fields(schema)]

    def df(self, spark: SparkSession) -> DataFrame:
        out = spark.createDataFrame(self.rows, self.schema)
        return out.withColumns({c: out[c].cast("timestamp") for c in self.times}) if self.times else out

    @property
    def sql(self) -> str:
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
        types = dict(part.split(None, 1) for part in _fields(self.schema))
        cols = ", ".join(f"CAST({n} AS {'TIMESTAMP' if n in self.times else kinds[types[n]]}) AS {n}" for n in self.names)
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(SELECT {cols} FROM (VALUES {rows}) AS v({', '.join(self.names)}))"


def _fields(schema: str) -> list[str]:
    return [p.strip() for p in schema.split(",")]
