"""Reading records, reports and labels: one JSON document per file, or one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.identity import canonical_json

PREDICTION_FIELD = (
    "struct<path:string,value:variant,conflict_values:array<variant>,status:string,"
    "source:variant,sources:array<variant>>"
)


def parse_records(df: DataFrame, text: str) -> DataFrame:
    """A JSON text column as VARIANT ``v`` plus ``valid``: it parses, and it is an object."""
    parsed = df.withColumn("v", F.try_parse_json(F.coalesce(F.col(text), F.lit("")))).drop(text)
    return parsed.withColumn("valid", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def record(records: DataFrame, slug: str) -> DataFrame:
    return records.filter(F.col("slug") == slug)


def validity(records: DataFrame) -> DataFrame:
    """How many records there are, can be read, and cannot."""
    return records.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("readable"), F.count_if(~F.col("valid")).alias("invalid"))


def explode_reports(reports: DataFrame, v: str = "v") -> DataFrame:
    """Re-check reports to one row per (slug, path) verdict. The report's own slug wins over its file's."""
    get = lambda path: F.try_variant_get(v, path, "string")
    entries = F.map_entries(F.try_variant_get(v, "$.claims", "map<string,variant>"))
    rows = reports.select(
        F.coalesce(F.nullif(get("$.slug"), F.lit("")), F.col("slug")).alias("slug"), get("$.checked_at").alias("checked_at"),
        F.coalesce(F.nullif(get("$.model"), F.lit("")), F.lit("unknown")).alias("checker"), F.explode(entries).alias("e"))
    of = lambda path: F.try_variant_get("e.value", path, "string")
    return rows.select(
        "slug", F.col("e.key").alias("path"), of("$.verdict").alias("verdict"), of("$.reason").alias("reason"),
        of("$.correct_reading").alias("correct_reading"), "checked_at", "checker")


def explode_predictions(sets: DataFrame, v: str = "v") -> DataFrame:
    """Prediction sets to one row per (paper_id, path)."""
    papers = F.explode(F.variant_get(v, "$.predictions", "array<struct<paper_id:string,fields:array<variant>>>"))
    rows = sets.select(papers.alias("p")).select("p.paper_id", F.explode("p.fields").alias("f"))
    return rows.select("paper_id", *_labelled("f"))


def explode_golden(papers: DataFrame, v: str = "v") -> DataFrame:
    """Golden papers to one row per labelled field."""
    rows = papers.select(
        F.variant_get(v, "$.paper.id", "string").alias("paper_id"), F.explode(F.variant_get(v, "$.fields", "array<variant>")).alias("f"))
    return rows.select("paper_id", F.variant_get("f", "$.family", "string").alias("family"), *_labelled("f"))


def _labelled(f: str) -> list:
    value = F.try_variant_get(f, "$.value", "variant")
    source = "struct<section:string,page:int,locator:string,evidence:string,origin:string,claimed_value:variant>"
    one = F.try_variant_get(f, "$.source", source)
    many = F.coalesce(F.try_variant_get(f, "$.sources", f"array<{source}>"), F.array().cast(f"array<{source}>"))
    alternatives = F.coalesce(F.try_variant_get(f, "$.conflict_values", "array<variant>"), F.array().cast("array<variant>"))
    shape = lambda s: F.struct(
        s["section"].alias("section"), s["page"].alias("page"), s["locator"].alias("locator"), s["evidence"].alias("evidence"),
        s["origin"].alias("origin"), canonical_json(s["claimed_value"]).alias("claimed_json"))
    return [
        F.variant_get(f, "$.path", "string").alias("path"), F.variant_get(f, "$.status", "string").alias("status"),
        F.when(value.isNotNull() & ~F.is_variant_null(value), canonical_json(value)).alias("value_json"),
        F.transform(alternatives, lambda a: canonical_json(a)).alias("conflict_values"),
        F.transform(F.concat(F.array_compact(F.array(one)), many), shape).alias("sources"),
    ]


def require_distinct(df: DataFrame, key: str) -> DataFrame:
    """Fails while the rows are read when a key occurs twice (used for golden and prediction sets)."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    check = twice.agg(F.min(key).alias("_twice"))
    guard = F.when(F.col("_twice").isNotNull(), F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col("_twice").cast("string"))).cast("boolean"))
    return df.crossJoin(F.broadcast(check)).filter(F.coalesce(guard, F.lit(True))).drop("_twice")  # one row
