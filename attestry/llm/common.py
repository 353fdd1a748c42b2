"""Small helpers of the operators: bound expressions, stored intermediate tables, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import shared_dir


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, even where the body uses it often or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once into the shared folder and read back; survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(rows: int, per_bucket: int) -> int:
    """A power of two, so that buckets hold about ``per_bucket`` rows at every size."""
    return 1 << max(0, (max(1, rows) // per_bucket).bit_length())


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
