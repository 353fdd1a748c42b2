"""Streams without state: each batch writes a mergeable part, and parts are compacted behind a manifest.

Nothing is held in executor memory between batches. A batch leaves the rows it adds (events not seen before) or what it adds
to a result (the newest decision per target, counts per day) in ``parts/batch=k``, which a retry overwrites. A reader merges
the newest compacted table with the parts after it. ``compact`` merges the parts up to the newest finished batch into one
table sorted by key range, so files can be skipped by their statistics; its manifest row, written last, makes it current. A
compaction that dies before leaves a folder nobody reads and the next one overwrites. Old parts and tables are only dropped by
whoever knows that no reader is left.

Defined cases: late events of any age count. Events without an id are all kept. A stream that had no batch reads as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.streaming.events import write_batches

Step = Callable[[DataFrame], DataFrame]
DAY = "_day"  # days since 1970
NO_DAY = -(1 << 31)  # of events without a time


def _prepare(empty: DataFrame, out: str) -> None:
    """An empty part and a manifest row before the first batch, so that readers always find a table."""
    empty.limit(0).write.mode("overwrite").parquet(f"{out}/parts/batch=-1")
    empty.sparkSession.range(1).write.mode("overwrite").parquet(f"{out}/manifest/upto=-1")


def _empty(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


def _compacted(spark: SparkSession, out: str) -> int:
    return spark.read.parquet(f"{out}/manifest").agg(F.max("upto")).first()[0]


def rows_until(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The compacted table and the parts after it, unmerged; with ``before`` only batches below that number."""
    upto = _compacted(spark, out)
    # the first part holds no rows, and its schema is that of all others
    late = spark.read.schema(spark.read.parquet(f"{out}/parts/batch=-1").schema.add("batch", "integer")).parquet(f"{out}/parts").filter(F.col("batch") > upto)
    late = (late if before is None else late.filter(F.col("batch") < before)).drop("batch")
    return late if upto < 0 else spark.read.parquet(f"{out}/compacted/upto={upto}").unionByName(late)


def read_parts(spark: SparkSession, out: str, merge: Step = lambda rows: rows) -> DataFrame:
    return merge(rows_until(spark, out))


def compact(spark: SparkSession, out: str, keys: Sequence[str], merge: Step = lambda rows: rows) -> bool:
    """Merges what finished batches left. The newest batch stays apart: it may still be written or retried."""
    newest = spark.read.schema("batch int").parquet(f"{out}/parts").agg(F.max("batch")).first()[0]
    upto = -1 if newest is None else newest - 1
    if upto <= _compacted(spark, out):
        return False
    merge(rows_until(spark, out, newest)).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{out}/compacted/upto={upto}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/upto={upto}")
    return True


def write_parts(stream: DataFrame, out: str, checkpoint: str, each: Step) -> None:
    """Runs the stream over what is there; batch k leaves ``each(batch)``."""
    _prepare(each(_empty(stream)), out)
    write_batches(stream, f"{out}/parts", checkpoint, "append", each)


def write_new_events(stream: DataFrame, out: str, checkpoint: str, key: str = "event_id", at: str | None = "ts", results: Mapping[str, Step] | None = None) -> None:
    """Each event once, whenever it arrives, with what the new ones add to each result (below ``out``/name).

    Ids that were made from an event's content come back with its time, so a batch asks only for the days of its own events;
    parts and compacted tables are sorted by day, and row groups of other days are skipped. For ids that may come back with
    another time give ``at`` as None: all ids are asked then.
    """
    spark, results = stream.sparkSession, results or {}
    day: Column = F.lit(None).cast("int") if at is None else F.unix_date(F.to_date(F.col(at).cast("timestamp")))
    dated = lambda rows: rows.withColumn(DAY, F.coalesce(day, F.lit(NO_DAY)))
    _prepare(dated(_empty(stream)), out)
    for name, each in results.items():
        _prepare(each(_empty(stream)), f"{out}/{name}")

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = dated(batch)
        span = rows.filter(F.col(DAY) != NO_DAY).agg(F.min(DAY), F.max(DAY)).first()
        old = rows_until(session, out, number).filter(F.col(DAY).between(F.lit(span[0]), F.lit(span[1])) | (F.col(DAY) == NO_DAY))
        days = rows.select(DAY).distinct()
        seen = old.join(days, DAY, "left_semi").select(key)
        named = rows.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(seen, key, "left_anti")
        new = named.unionByName(rows.filter(F.col(key).isNull())).select(*rows.columns)
        new.repartitionByRange(DAY, key).sortWithinPartitions(DAY, key).write.mode("overwrite").parquet(f"{out}/parts/batch={number}")
        added = session.read.schema(rows.schema).parquet(f"{out}/parts/batch={number}").drop(DAY)
        for name, each in results.items():
            each(added).write.mode("overwrite").parquet(f"{out}/{name}/parts/batch={number}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_new_events(spark: SparkSession, out: str) -> DataFrame:
    return rows_until(spark, out).drop(DAY)


# --- results of batches that merge ------------------------------------------------------

def newest_of(target: str, at: str, event_id: str, *carry: str) -> tuple[Step, Step]:
    """(part, merge) of the newest decision per target."""

    def part(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct(F.col(at).cast("timestamp").alias("at"), event_id, *carry)).alias("last")
        return rows.groupBy(target).agg(last).select(target, "last.*")

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(target).agg(F.max(F.struct("at", event_id, *carry)).alias("last")).select(target, "last.*")

    return part, merge


def counts_of(state: str, at: str, window: str = "1 day") -> tuple[Step, Step]:
    """(part, merge) of events per state and window."""

    def part(rows: DataFrame) -> DataFrame:
        start = F.window(F.col(at).cast("timestamp"), window)
        return rows.groupBy(state, start.alias("w")).agg(F.count("*").alias("n")).select(state, F.col("w.start").alias("day"), "n")

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(state, "day").agg(F.sum("n").alias("n"))

    return part, merge
