"""Paging at any depth: a result is put in order once, and a page reads only the files that hold it.

The rows are sorted by range into files of the shared folder; a file's rows lie in order, and so do the files by their number. With the
counts of the files, one number each, every row's position follows from its file and its place there: no page is sorted again, and none
meets the rows before it. The input is computed once, however many pages are asked.

Defined cases: a page behind the end is empty, as is every page of an empty table; ``total`` is always the uncut count. The order must be
total (end it with a key), or pages of tied rows differ between two listings.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.session import kept

POSITION = "position"


@dataclass(frozen=True)
class Listing:
    """``files`` holds (name, position of its first row, rows) in order: one entry a written file."""

    rows: DataFrame
    files: tuple[tuple[str, int, int], ...]
    total: int

    def positions(self, first: int = 0, limit: int | None = None) -> DataFrame:
        """Rows with their position from 0, those of ``limit`` rows from ``first`` on."""
        end = self.total if limit is None else min(self.total, first + limit)
        held = [f for f in self.files if f[1] < end and f[1] + f[2] > first]
        columns, name = self.rows.columns, F.col("_metadata.file_name")
        if not held:
            return self.rows.select(*columns, F.lit(0).cast("long").alias(POSITION)).filter(F.lit(False))
        starts = F.create_map(*[F.lit(x) for f in held for x in f[:2]])
        # a filter on file names alone leaves the other files unread
        rows = self.rows.filter(name.isin(*[f[0] for f in held]) if len(held) < len(self.files) else F.lit(True))
        placed = rows.select(*columns, (F.element_at(starts, name) + F.col("_metadata.row_index")).cast("long").alias(POSITION))
        return placed.filter(F.col(POSITION).between(first, end - 1))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """One page with positions; every row carries the uncut count as ``total``."""
        return self.positions(offset, limit).withColumn("total", F.lit(self.total).cast("long"))


def listed(df: DataFrame, order: Sequence[Column]) -> Listing:
    """Writes the rows in order and counts its files (their number is that of the shuffle's partitions)."""
    rows = kept(df.orderBy(*order), "listing")
    counts = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect()
    files, first = [], 0
    for file, n in sorted(counts, key=lambda r: [int(x) for x in re.search(r"^part-(\d+)-.*-c(\d+)", r["file"]).groups()]):
        files.append((file, first, n))
        first += n
    return Listing(rows, tuple(files), first)
