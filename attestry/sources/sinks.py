"""Writing: published snapshots, run logs, sorted exports.

A snapshot is a folder per run with one table each. It becomes visible when its manifest row
is written, which happens last; a job that dies before leaves nothing readers would see.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.validate import accepted

MANIFEST = "_manifest"


def publish_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str, at: str, note: str = "") -> None:
    """Writes all tables of a run, then the manifest row that makes them current."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{run_id}/{name}")
    row = [(run_id, at, sorted(tables), note)]
    spark.createDataFrame(row, "run_id string, published_at string, tables array<string>, note string").coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{MANIFEST}")


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published run that has it."""
    has = manifest(spark, root).filter(F.array_contains("tables", name))
    run = has.agg(F.max_by("run_id", F.struct("published_at", "run_id"))).first()[0]
    if run is None:
        raise ValueError(f"no published run has table {name}")
    return spark.read.parquet(f"{root}/{run}/{name}")


def import_package(
    spark: SparkSession, root: str, run_id: str, at: str, violations: DataFrame, plans: dict[str, DataFrame], tables: dict[str, DataFrame], dry_run: bool = False,
) -> str:
    """All or nothing: ``rejected`` on any error row, ``stale`` when a row would go back to
    content already replaced, ``planned`` for a dry run, else ``imported``."""
    if not accepted(violations):
        return "rejected"
    if any(not plan.filter("action = 'stale'").isEmpty() for plan in plans.values()):
        return "stale"
    if dry_run:
        return "planned"
    publish_snapshot(spark, tables, root, run_id, at)
    return "imported"


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces only the partitions the rows belong to; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run_log(spark: SparkSession, counts: DataFrame, run_id: str, source: str, sha256: str, at: str, warnings: DataFrame) -> DataFrame:
    """One row per run with its counts and the warnings by rule, both as JSON."""
    c = counts.agg(F.to_json(F.array_sort(F.collect_list(F.struct("entity", "action", "n")))).alias("counts_json"))
    w = warnings.filter("severity = 'warn'").groupBy("rule").agg(F.count("*").alias("n")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("warnings_json"))
    return c.crossJoin(w).select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source_name"), F.lit(sha256).alias("sha256"), F.lit(at).alias("imported_at"), "counts_json", "warnings_json")  # one row each


def export_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Rows as sorted JSON lines, range-sorted across files (file names keep the order)."""
    df.select(*[F.col(c).alias(c) for c in sorted(df.columns)]).orderBy(*order).write.mode("overwrite").json(path)
