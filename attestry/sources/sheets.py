"""Sheets exported one file each: reading, header checks, package kinds, embedded JSON."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.text import blank_to_null

_ISSUE = "rule string, severity string, entity string, key string, message string"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a sheet: one line is read."""
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader([first[0][0]]), []) if first else []


def header_issues(spark: SparkSession, sheet: str, path: str) -> DataFrame:
    """Empty sheets, repeated and missing columns, as violations."""
    names = [n.strip() for n in header_of(spark, path)]
    named = [n for n in names if n]
    issues = [] if names else [("sheet_empty", "error", sheet, "", "")]
    issues += [("column_repeated", "error", sheet, n, "") for n in sorted({n for n in named if named.count(n) > 1})]
    issues += [("column_missing", "error", sheet, n, "") for n in V.REQUIRED_COLUMNS.get(sheet, ()) if n not in named]
    return spark.createDataFrame(issues, _ISSUE)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a sheet as text: cells trimmed, blanks null, unnamed columns and blank rows dropped."""
    names = [n.strip() for n in header_of(spark, path)]
    schema = ", ".join(f"`_c{i}` string" for i in range(len(names)))
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', enforceSchema=True)
    return clean(raw.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n and n not in names[:i]]))


def clean(rows: DataFrame) -> DataFrame:
    cells = rows.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in rows.columns])
    return cells.filter(F.coalesce(*[F.col(f"`{c}`") for c in rows.columns]).isNotNull())


def label_text(rows: DataFrame) -> DataFrame:
    """A two-column sheet as (label, text); rows without a label are dropped."""
    label, text = rows.columns[:2]
    return rows.select(F.col(label).alias("label"), F.coalesce(text, F.lit("")).alias("text")).filter("label is not null")


def package_kinds(sheets: DataFrame) -> DataFrame:
    """sheets(package, sheet) to the kind of each package and the sheets it lacks."""
    known = sorted({*V.BASE_SHEETS, *V.SUPPLEMENT_SHEETS})
    has = sheets.groupBy("package").agg(F.collect_set(F.when(F.col("sheet").isin(*known), F.col("sheet"))).alias("has"))
    lacks = lambda names: F.array_except(F.array(*[F.lit(n) for n in names]), "has")
    supplement = (F.size(lacks(V.BASE_SHEETS)) > 0) & ~F.array_contains("has", "PAPER_RECORDS") & ~F.array_contains("has", "FIELD_CONTRACT")
    return has.select("package", F.when(supplement, "supplement").otherwise("base").alias("kind"),
                      F.array_sort(F.when(supplement, lacks(V.SUPPLEMENT_SHEETS)).otherwise(lacks(V.BASE_SHEETS))).alias("missing"))


def embedded_records(rows: DataFrame, text: str = "record_json", key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(rows with their document ``v``, violations): bad JSON, another thing than an object, another id inside."""
    parsed = rows.withColumn("v", F.try_parse_json(F.coalesce(text, F.lit(""))))
    kind = F.schema_of_variant("v")
    inner = F.try_variant_get("v", f"$.{key}", "string")
    rule = (F.when(F.col("v").isNull(), "json_invalid").when(~F.startswith(kind, F.lit("OBJECT")), "json_not_object").when(~inner.eqNullSafe(F.col(key).cast("string")), "id_differs"))
    tagged = parsed.withColumn("_rule", rule)
    bad = tagged.filter("_rule is not null")
    issues = bad.select(F.col("_rule").alias("rule"), F.lit("error").alias("severity"), F.lit("PAPER_RECORDS").alias("entity"), F.col(key).cast("string").alias("key"), F.lit("").alias("message"))
    return tagged.filter("_rule is null or _rule = 'id_differs'").drop("_rule", text), issues


def slots(records: DataFrame, v: str = "v", key: str = "paper_id") -> DataFrame:
    """Record slots: group, name and claim id of ``field_claim_ids``, one row per claim; an empty
    slot keeps one row with a null claim."""
    groups = F.explode(F.map_entries(F.try_variant_get(v, "$.field_claim_ids", "map<string,map<string,array<string>>>")))
    rows = records.select(key, groups.alias("g")).select(key, F.col("g.key").alias("group"), F.explode(F.map_entries("g.value")).alias("f"))
    return rows.select(key, F.concat_ws(".", "group", "f.key").alias("field_path"), F.explode_outer("f.value").alias("claim_id"))


def document_rows(sheet: DataFrame, name: str, package: str | None = None) -> DataFrame:
    """A sheet kept verbatim, row by row, under its name or ``package:name``."""
    full = name if package is None else f"{package}:{name}"
    return sheet.select(F.lit(full).alias("name"), F.to_json(F.struct(*sheet.columns)).alias("row_json"))


def document_fingerprints(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of each stored document: no sheet is gathered to hash it."""
    h = F.sha2("row_json", 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy("name").agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13), part(25)), 256).alias("fingerprint"))
