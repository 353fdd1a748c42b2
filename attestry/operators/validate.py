"""Data-quality rules as rows: (rule, severity, entity, key, message).

A rule is a query that yields what breaks it. An import is accepted when no row of severity
``error`` exists; warnings travel with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("rule", "severity", "entity", "key", "message")


def broken(df: DataFrame, rule: str, entity: str, key: Column, message: Column | str = "", severity: str = "error") -> DataFrame:
    """Every row of ``df`` breaks ``rule``."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(entity).alias("entity"),
                     F.coalesce(key.cast("string"), F.lit("")).alias("key"), text.cast("string").alias("message"))


def row_rules(df: DataFrame, entity: str, key: Column, rules: Sequence[tuple[str, Column, str]], severity: str = "error") -> DataFrame:
    """All row-level rules in one pass. Each is (rule, condition that breaks it, message).

    Conditions are columns of their own before the rules are listed: a higher-order function, in a condition or around the list, would
    otherwise keep Spark from compiling all the others, and parts they share would be evaluated for each rule.
    """
    names = [f"_broken_{i}" for i in range(len(rules))]
    judged = df.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), *[F.coalesce(bad, F.lit(False)).alias(n) for n, (_, bad, _) in zip(names, rules, strict=True)])
    hits = [F.when(F.col(n), F.struct(F.lit(rule).alias("rule"), F.lit(text).alias("message"))) for n, (rule, _, text) in zip(names, rules, strict=True)]
    out = judged.select("key", F.explode(F.array(*hits)).alias("h")).filter("h is not null")
    return out.select("h.rule", F.lit(severity).alias("severity"), F.lit(entity).alias("entity"), "key", "h.message")


def all_violations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def accepted(violations: DataFrame) -> bool:
    """Whether an import may go on. Reads until the first error only."""
    return violations.filter("severity = 'error'").isEmpty()
