"""Registered queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain_counts(sql: str) -> str:
    """``count_if(x)`` as ``count(case ...)``: DuckDB's own yields null when every x is null."""
    out, rest = "", sql
    while "count_if(" in rest:
        head, rest = rest.split("count_if(", 1)
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        out += f"{head}count(case when {rest[:end - 1]} then 1 end)"
        rest = rest[end:]
    return out + rest


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = plain_counts(sql)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table, dealt over all cores if the file has too few splits."""
    df = table(spark, sf, name)
    return spread(df.select(*columns) if columns else df)


def as_int(*names: str):
    """Boolean columns as 0/1, so both engines print them alike."""
    return [F.col(n).cast("int").alias(n) for n in names]
