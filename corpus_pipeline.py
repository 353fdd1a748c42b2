"""A training corpus from ``documents``: language ID, near-dedup, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last adds where
each one goes. ``run`` writes every stage's rows to the shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontam, langid, minhash, mix, shard
from attestry.llm.common import id_remainder, stored
from attestry.llm.queries import SEED, SHARDS, TARGETS
from attestry.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language of the training labels: those without a letter."""
    labelled = docs.filter(id_remainder("doc_id", 4) != 2)
    prototypes = langid.profiles(labelled, "text", "lang")
    labels = langid.predict(docs, "text", prototypes, [F.col(c) for c in COLUMNS])
    return labels.filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``_key``, the same for rows with the same id and text only. It is the id itself, but for rows without one and for further texts of
    an id, which get a hash above all ids: so the smallest key of a group is an id where there is one."""
    docs = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))
    spans = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("_hash").alias("_first"), F.max("_hash").alias("_last"))
    # as a table its size is known, so Spark moves the texts only if there are very many such ids
    several = stored(spans.filter("_first <> _last").select("doc_id", "_first"), "repeated-ids")
    marked = docs.join(several, "doc_id", "left")
    high = F.xxhash64("doc_id", "_hash", F.col("text").cast("string")).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    own = F.col("doc_id").isNotNull() & (F.col("_first").isNull() | (F.col("_first") == F.col("_hash")))
    return marked.withColumn("_key", F.when(own, F.col("doc_id").cast("long")).otherwise(high)).select(*COLUMNS, "_key")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group. Texts that share an id are documents of their own, and so is a row without an
    id; of rows with the same id (or none) and the same text one stays."""
    docs = _keyed(docs)
    found = minhash.near_duplicates(docs.select(F.col("_key").alias("doc_id"), "text"))
    kept = cut_lineage(found.filter("kept").select(F.col("doc_id").alias("_key")).distinct())
    return docs.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.matches(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = cut_lineage(found)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash"))
    return docs.join(found, same, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the rows into the order of the mix: the files, read in the order of their names, follow it row by row."""
    keyed = docs.select(*COLUMNS).withColumns({"_k1": F.xxhash64(*COLUMNS), "_k2": F.xxhash64(F.lit("second"), *COLUMNS)})
    placed = mix.mixed(keyed, ["_k1", "_k2"], "source", TARGETS)
    # rows that agree in all columns are interchangeable: one of them meets each of their positions
    places = cut_lineage(placed.select("_k1", "_k2", F.col("position").alias("_position")))
    rows = keyed.dropDuplicates(["_k1", "_k2"]).join(places, ["_k1", "_k2"]).select(*COLUMNS, "_position")
    return rows.repartitionByRange("_position").sortWithinPartitions("_position").select(*COLUMNS)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers the rows in the order of the mix, permutes the numbers, and deals them out."""
    numbers = shard.numbered_by_file(docs.select(*COLUMNS))
    return shard.dealt(numbers, docs.count(), SHARDS, SEED)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

# Prototypes of random vectors and MinHash have no counterpart in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
