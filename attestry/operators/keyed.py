"""Keyed building blocks that stay balanced when one key holds much of the data.

* newest or first row per key: an aggregate with partial results on the map side;
* n rows per key: a ranked filter, which Spark cuts to n per key and task before it shuffles; for few keys, a bound first;
* previous row per key: blocked, so no task sorts a whole key;
* lookups: rows without a key stay out of the join;
* exact medians: an approximate bracket, then exact ranks inside it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row that sorts last per key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row that sorts first per key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """At most n rows per key in the given order, numbered from 1. None keeps all rows, without numbers: no key is sorted whole."""
    if n is None:
        return df.withColumn(rank, F.lit(None).cast("int"))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def first_of_few(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str = "rank", total: str | None = None, buckets: int = 1024) -> DataFrame:
    """``first_n`` in ascending order for a small vocabulary of keys (their bounds are broadcast), without sorting what cannot be among the first.

    Every key's rows are dealt over buckets. The n-th of the buckets' smallest places bounds the n-th place of all
    rows, so few rows more than n a key are ranked; a key with fewer filled buckets is ranked whole. ``total`` names the uncut count.
    The rows are read twice; pass only the columns needed, so that both times need the same and a join below is shuffled once.
    """
    place = F.struct(*order)
    hashed = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t])
    least = df.groupBy(*keys, F.pmod(hashed, F.lit(buckets)).alias("_bucket")).agg(F.count("*").alias("_n"), F.min(place).alias("_least"))
    bounds = least.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.sum("_n").alias("_total"), F.get(F.sort_array(F.collect_list("_least")), F.lit(n - 1)).alias("_bound"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    near = df.join(F.broadcast(bounds), same).filter(F.col("_bound").isNull() | (place <= F.col("_bound")))
    ranked = near.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)
    return ranked.select(*df.columns, rank, *([F.col("_total").alias(total)] if total else []))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count. Null keys do not count as repeats."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], block: Column,
    prefix: str = "previous_",
) -> DataFrame:
    """Adds the carried columns of the row before, per key.

    ``block`` cuts a key's rows into ordered stretches (a day of a timestamp, say); it must
    not decrease along ``order``. Only rows of one block are sorted in one task; the first
    row of a block takes the last row of the block before it from a one-row-per-block table.
    """
    blocked = df.withColumn("_block", block)
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    inside = blocked.withColumn("_prev", F.lag(F.struct(*carry)).over(w)).withColumn("_nth", F.row_number().over(w))
    ends = blocked.groupBy(*keys, "_block").agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    before = ends.select(*keys, "_block", F.lag("_last").over(over_blocks).alias("_before"))
    heads = inside.filter("_nth = 1").drop("_prev").join(before, [*keys, "_block"], "left").withColumnRenamed("_before", "_prev")
    out = inside.filter("_nth > 1").unionByName(heads)
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in carry])


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on one key whose missing values bypass the join, so they pile up nowhere."""
    keyed = left.filter(F.col(key).isNotNull()).join(right, key, "left")
    extra = [f for f in right.schema.fields if f.name != key]
    bare = left.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    return keyed.select(*bare.columns).unionByName(bare)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order; every row carries the uncut count as ``total``."""
    total = df.agg(F.count("*").alias("total"))
    cut = df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
    return cut.crossJoin(F.broadcast(total))  # one row, whatever the input


def exact_median(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 2000) -> DataFrame:
    """Exact median per key without holding a key's values in one place.

    Approximate percentiles bound the middle from both sides (their rank error is at most
    n / accuracy). Counting the rows below the bracket and the distinct values inside it
    gives the exact ranks; only the bracket, a small share of a key, is ordered.
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    step = 2.0 / accuracy
    bounds = present.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", F.array(F.lit(0.5 - step), F.lit(0.5 + step)), accuracy).alias("_b"),
        F.min("_v").alias("min_value"), F.max("_v").alias("max_value"),
    )
    # bracket edges widened to the extremes for small groups, where the error bound is loose
    bounds = bounds.select(
        *keys, "_n", "min_value", "max_value",
        F.when(F.col("_n") < accuracy, F.col("min_value")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(F.col("_n") < accuracy, F.col("max_value")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        """By key, where null is a key like any other."""
        other = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
        return left.join(other, same).drop(*[f"_key_{k}" for k in keys])

    near = joined(present, bounds.select(*keys, "_lo", "_hi")).filter(F.col("_v") <= F.col("_hi"))
    # values below the bracket collapse to one row per key before the shuffle
    counted = near.groupBy(*keys, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_to", F.sum("_c").over(w))
    ranked = joined(ranked, bounds)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    at = lambda r: F.min(F.when(F.col("_to") >= r, F.col("_v")))
    return ranked.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.first("min_value").alias("min_value"),
        ((at(low) + at(high)) / 2).alias("median_value"), F.first("max_value").alias("max_value"),
    )
