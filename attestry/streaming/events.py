"""Structured Streaming over audit events and arriving pages.

Events are append-only, carry an id and may come late or twice. Every sink is a table keyed
by batch, overwritten when a batch is retried, so results do not depend on retries. Intake, newest
decisions and progress without state between batches are in ``parts``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.gate import locate_on_cited_page
from attestry.operators.ledger import attach_verdicts


def read_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def intake(events: DataFrame, at: str = "ts", key: str = "event_id", delay: str | None = None) -> DataFrame:
    """Each event once, whenever it arrives.

    Without ``delay`` all ids seen are kept as state and no event is lost. With a delay the state is bounded by it, but an event
    that comes later than that is dropped: only for sources that promise not to be later.
    """
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return events.dropDuplicates([key]) if delay is None else events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str, each: Callable[[DataFrame], DataFrame] = lambda b: b) -> None:
    """Runs the stream over what is there and ends. Batch k lands in ``out/batch=k``."""

    def sink(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stale_verdicts(changed_claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts a batch of changed claims(claim_id, fingerprint) made stale."""
    return attach_verdicts(changed_claims, verdicts).filter("audit_state = 'STALE'")


def gate_pages(arrived: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending quotes that cite a page of this batch, located or not."""
    cited = pending.join(arrived.select("source_file", F.col("page").alias("page_pdf")).distinct(), ["source_file", "page_pdf"], "left_semi")
    return locate_on_cited_page(cited, arrived)
