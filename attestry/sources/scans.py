"""Strict scans of folders of JSON files: the rows of what is sound, and one refusal row for everything that is not.

A scan never fails on a bad file and never drops one silently: refusals(scan, file, rule, key) say which file, what is wrong, and
where. Ids that occur twice are refused in all their files, as none is more right than the other. A file is known by its stem; where
each document is in a folder ``name=value`` of its own, by the value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.ledger import append_once
from attestry.operators.validate import all_violations
from attestry.session import kept
from attestry.sources import records as R

# The keys that a prediction file may have.
SET_KEYS, PAPER_KEYS = ("schema_version", "predictions"), ("paper_id", "fields")
FIELD_KEYS = ("path", "value", "conflict_values", "status", "source", "sources")
MANIFEST_STATES = ("DOWNLOADED", "ALREADY_PRESENT", "DUPLICATE", "BLOCKED", "NO_OA_PDF", "UNRESOLVED")


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, v, valid) of every file below a folder; ``v`` is null where a file is no JSON.

    A scan looks at its documents several times, so they are stored once: small files are listed and opened a single time.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("_at"))
    folder = F.regexp_extract("_at", r"/[^/=]+=([^/]*)/[^/]*$", 1)
    stem = F.regexp_replace(F.substring_index("_at", "/", -1), r"\.[^.]*$", "")
    return R.parse_records(kept(raw.select("value", F.coalesce(F.nullif(folder, F.lit("")), stem).alias("file")), "documents"), "value")


def _refused(df: DataFrame, scan: str, rule: str | Column, key: Column | None = None) -> DataFrame:
    said = F.lit(rule) if isinstance(rule, str) else rule
    return df.select(F.lit(scan).alias("scan"), "file", said.alias("rule"), F.coalesce(key.cast("string") if key is not None else F.lit(""), F.lit("")).alias("key"))


def unreadable(docs: DataFrame, scan: str) -> DataFrame:
    return _refused(docs.filter("not valid"), scan, F.when(F.col("v").isNull(), "not_json").otherwise("not_an_object"))


def nothing(docs: DataFrame, scan: str) -> DataFrame:
    """A refusal if there is no file at all."""
    return _refused(docs.agg(F.count("*").alias("n")).filter("n = 0").withColumn("file", F.lit("")), scan, "empty_set")


def _twice(rows: DataFrame, scan: str, rule: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(refusals, keys) of rows(file, *keys) whose keys occur more than once."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return _refused(rows.join(again, list(keys)), scan, rule, F.concat_ws("/", *keys)).distinct(), again


def scan_records(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """records(slug, v) of a folder. A record that names itself otherwise than its file is refused."""
    docs = documents(spark, path, glob)
    own = F.try_variant_get("v", "$.slug", "string")
    named = docs.filter("valid").withColumn("_own", own)
    other = F.col("_own").isNotNull() & (F.col("_own") != F.col("file"))
    rows = named.filter(~F.coalesce(other, F.lit(False))).select(F.col("file").alias("slug"), "v", "valid")
    return rows, all_violations([unreadable(docs, "records"), nothing(docs, "records"), _refused(named.filter(other), "records", "other_slug", F.col("_own"))])


def scan_golden(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Labelled fields of a folder of golden papers: ids and the paths of a paper are unique, and there is one file at least.

    A paper without a list of fields, with a field that names no path, or with a path twice is refused whole.
    """
    docs = documents(spark, path, glob)
    papers = docs.filter("valid").withColumn("paper_id", F.try_variant_get("v", "$.paper.id", "string")).withColumn("fields", F.try_variant_get("v", "$.fields", "array<variant>"))
    named = papers.filter("paper_id is not null")
    fields = named.select("file", "paper_id", F.explode("fields").alias("f")).withColumn("path", F.try_variant_get("f", "$.path", "string"))
    repeats, again = _twice(named.select("file", "paper_id"), "golden", "id_repeated", ["paper_id"])
    inside = all_violations([
        _refused(named.filter("fields is null"), "golden", "fields_missing", F.col("paper_id")), _refused(fields.filter("path is null"), "golden", "path_missing", F.col("paper_id")).distinct(),
        _twice(fields.filter("path is not null").select("file", "paper_id", "path"), "golden", "path_repeated", ["file", "paper_id", "path"])[0],
    ])
    sound = named.join(again, "paper_id", "left_anti").join(inside.select("file").distinct(), "file", "left_anti")
    return R.explode_golden(sound), all_violations([unreadable(docs, "golden"), nothing(docs, "golden"), _refused(papers.filter("paper_id is null"), "golden", "id_missing"), repeats, inside])


def _unknown(value: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(F.map_keys(F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))), F.array(*[F.lit(k) for k in allowed]))


def scan_predictions(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Predicted fields of a folder of prediction sets. A file with a key that no prediction has, a paper twice, or a path twice
    in a paper is refused whole."""
    docs = documents(spark, path, glob)
    sets = docs.filter("valid")
    items = lambda v, at: F.explode(F.coalesce(F.try_variant_get(v, at, "array<variant>"), F.array().cast("array<variant>")))
    papers = sets.select("file", items("v", "$.predictions").alias("p")).withColumn("paper_id", F.try_variant_get("p", "$.paper_id", "string"))
    fields = papers.select("file", "paper_id", items("p", "$.fields").alias("f")).withColumn("path", F.try_variant_get("f", "$.path", "string"))
    keys = lambda df, v, allowed: _refused(df.select("file", F.explode(_unknown(F.col(v), allowed)).alias("k")), "predictions", "key_unknown", F.col("k")).distinct()
    refusals = all_violations([
        unreadable(docs, "predictions"), nothing(docs, "predictions"), keys(sets, "v", SET_KEYS), keys(papers, "p", PAPER_KEYS), keys(fields, "f", FIELD_KEYS),
        _twice(papers.select("file", "paper_id"), "predictions", "paper_repeated", ["file", "paper_id"])[0],
        _twice(fields.select("file", "paper_id", "path"), "predictions", "path_repeated", ["file", "paper_id", "path"])[0],
    ])
    sound = sets.join(refusals.select("file").distinct(), "file", "left_anti")
    return R.explode_predictions(sound), refusals


def scan_manifest(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Entries(doi, status, title, v) of access manifests: JSON lists, all keys kept in ``v``; DOIs are unique, states are known."""
    raw = documents(spark, path, glob)
    lists = raw.withColumn("valid", F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False)))
    entries = lists.filter("valid").select("file", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
    of = lambda at: F.try_variant_get("v", at, "string")
    entries = entries.select("file", of("$.doi").alias("doi"), of("$.status").alias("status"), of("$.title").alias("title"), "v")
    bad = ~F.coalesce(F.col("status").isin(*MANIFEST_STATES), F.lit(False))
    repeats, again = _twice(entries.filter("doi is not null").select("file", "doi"), "manifest", "doi_repeated", ["doi"])
    wrong = F.when(F.col("v").isNull(), "not_json").otherwise("not_a_list")
    refusals = all_violations([_refused(lists.filter("not valid"), "manifest", wrong), nothing(lists, "manifest"), _refused(entries.filter(bad), "manifest", "state_unknown", F.col("doi")), repeats])
    return entries.filter(~bad).join(again, "doi", "left_anti"), refusals


def append_run(events: DataFrame, root: str, run_id: str, key: str = "event_id") -> None:
    """Adds a run's events to a ledger. Run again under its id it replaces what it wrote; events of other runs are not repeated."""
    spark = events.sparkSession
    events.limit(0).withColumn("run_id", F.lit("")).write.mode("append").partitionBy("run_id").parquet(root)  # the ledger exists, if empty
    schema = events.schema.add("run_id", "string")
    earlier = spark.read.schema(schema).parquet(root).filter(F.col("run_id") != run_id)
    append_once(events, earlier, key).write.mode("overwrite").parquet(f"{root}/run_id={run_id}")


def ledger(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(root)
