"""The registry of queries: each has a function of (session, data folder) and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that types don't hang on which function gave them."""
    return df.select(
        *(F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes)
    )


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@dataclass(frozen=True)
class Fixture:
    """A few typed rows that trigger what the shared tables don't, and the rows that ``derived``, SQL for both engines with tables in braces, makes of the
    tables, by place; the same for Spark and for SQL."""

    schema: str
    rows: tuple[tuple, ...]
    derived: str | None = None

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        typed = spark.createDataFrame(list(self.rows), self.schema)
        if self.derived is None:
            return typed
        names = {n for _, n, _, _ in Formatter().parse(self.derived) if n}
        made = spark.sql(self.derived, **{n: table(spark, sf_dir, n) for n in names})
        return typed.unionAll(made.toDF(*typed.columns).select(*(F.col(f.name).cast(f.dataType) for f in typed.schema)))

    @property
    def sql(self) -> str:
        columns = [f'"{c.split()[0]}"' for c in self.schema.split(",")]
        types = {"string": "VARCHAR", "int": "BIGINT", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

        def value(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, float) and not math.isfinite(v):
                return f"'{v}'::DOUBLE"
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

        body = "VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in self.rows)
        if self.derived is not None:
            tables = {n: n for _, n, _, _ in Formatter().parse(self.derived) if n}
            body += f" UNION ALL ({self.derived.format(**tables)})"
        casts = ", ".join(f"CAST({c} AS {types[s.split()[1]]}) AS {c}" for c, s in zip(columns, self.schema.split(","), strict=True))
        return f"(SELECT {casts} FROM ({body}) AS v({', '.join(columns)}))"
