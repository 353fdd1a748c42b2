"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers 0..N-1 are permuted by a keyed Feistel network over pairs (left < a, right < b) with
a = ceil(sqrt N) and b = ceil(N / a); a result of N or more is permuted again until it falls below N.
Position p then lies in shard ``p mod shards`` at slot ``p div shards``, so counts differ by one row at
most, slots have no gap, and both can be computed from the row number alone.

Row numbers come from the keys (buckets of a hash, counts per bucket, ranks inside a bucket) or from the
physical order of a file scan; neither sorts the table as a whole. Rows that are the same in every key are
counted before they are shuffled and spread out again, so copies do not pile up.

Defined cases: a null text has 0 bytes (size 16) and crc 0; equal rows get different slots; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import bucket_count, let

ROUNDS = 6


def _whole(x: Column, by: int) -> Column:
    """Whole-number division, exact over all of long."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def sides(rows: int) -> tuple[int, int]:
    a = max(1, int(rows**0.5))
    while a * a < rows:
        a += 1
    return a, max(1, -(-rows // a))


def permuted(number: Column, rows: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The permutation's image of a row number below ``rows``."""
    a, b = sides(rows)

    def once(x: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            odd = k % 2 == 1
            left, right = state["l"], state["r"]
            # the first 60 bits of an MD5: any engine can recompute them
            digest = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"), F.when(odd, right).otherwise(left).cast("string")).cast("binary"))
            add = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
            return F.struct(F.when(odd, (left + add % a) % a).otherwise(left).alias("l"), F.when(odd, right).otherwise((right + add % b) % b).alias("r"))

        start = F.struct(_whole(x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["l"] * b + s["r"])

    # At most a*b - N numbers lie outside, so a walk ends after that many steps; 64 in a row have a chance below N**-32.
    walks = min(a * b - rows, 64)
    first = once(number.cast("long"))
    if walks == 0:
        return first
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < rows, x).otherwise(once(x)))
    return let(inside, lambda x: F.when(x < rows, x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def numbered(df: DataFrame, keys: list[str], per_bucket: int = 4096, column: str = "row_number") -> DataFrame:
    """The key columns of every row with its global number from 0; independent of the order and layout of the rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = df.count()
    buckets = bucket_count(total, per_bucket)
    placed = counted.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sums = placed.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    before = sums.select("_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    ranked = placed.withColumn("_rank", F.sum("_n").over(inside) - F.col("_n"))
    spread = ranked.join(before, "_bucket").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return spread.select(*keys, (F.col("_before") + F.col("_rank") + F.col("_copy")).alias(column))


def numbered_by_file(scan: DataFrame, column: str = "row_number") -> DataFrame:
    """All columns and the global number of each row in the physical order of a file scan: no row is shuffled.

    File names sort in the order in which Spark's writers number them. The frame must be a file scan (it has ``_metadata``).
    """
    rows = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    sizes = scan.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_size"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    before = sizes.select("_file", (F.sum("_size").over(Window.orderBy(part, "_file")) - F.col("_size")).alias("_before"))
    return rows.join(before, "_file").withColumn(column, F.col("_before") + F.col("_index")).drop("_file", "_index", "_before")


def dealt(numbers: DataFrame, rows: int, shards: int, seed: int, column: str = "row_number") -> DataFrame:
    """Adds position, shard and slot."""
    if not rows:
        return numbers.withColumns({c: F.lit(0).cast(t) for c, t in (("position", "long"), ("shard", "int"), ("slot", "long"))})
    placed = numbers.withColumn("position", permuted(F.col(column), rows, seed))
    shard = (F.col("position") % shards).cast("int")
    return placed.withColumn("shard", shard).withColumn("slot", _whole(F.col("position"), shards))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text and 16 more) and the text's crc32."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16).cast("long")).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def sharded(docs: DataFrame, shards: int = 40, seed: int = 2026) -> DataFrame:
    """Every document with shard and slot, by its row number in key order."""
    narrow = sizes(docs)
    numbers = numbered(narrow, ["doc_id", "size", "text_crc32"])
    return dealt(numbers, docs.count(), shards, seed)
