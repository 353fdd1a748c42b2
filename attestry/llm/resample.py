"""Importance resampling towards a target text, and a distributed radix sort that ranks the draw.

Features are runs of words, hashed into a fixed number of buckets. A bucket's gain is the log ratio of its smoothed shares in the
target and in the documents; a document's weight is the sum of its features' gains, looked up in one array. Weights with Gumbel
noise from a hash of the id are scores, and the highest scores are the draw.

Ranks come from an LSD radix sort over the digits of (score falling, id rising), 11 bits each, least significant first. One pass:
rows stand at dense positions, cut into blocks; each block counts its digits; prefix sums over (digit, block) say where each
block's rows of a digit begin; a row's new position is that offset plus its number among its block's rows of its digit, in the old
order. Digits in which no two rows differ are skipped, so the number of passes follows the range of the keys, not the rows.

Moved: bucket counts (pre-aggregated), and per pass the narrow rows (no texts) to their block. A block holds a bounded number of
rows whatever the keys are, so hot scores need no splitting. Broadcast: the gains, one number per bucket. Each pass is written to
the shared folder: it is read twice, for the counts and for the moves.

Defined results: a null text has no words, weight 0. A null id is hashed as the empty text and comes after all others among equal
scores. Repeated rows are rows of their own with ranks of their own. Fewer than ``least_words`` words: never drawn, rank null, but
counted among the documents' features. Empty tables: no rows; an empty target still gives gains. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import ascii_lower, let, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DIGIT = 11  # bits
BLOCK = 1 << 18  # rows


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def runs(tokens: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, joined by one space."""
    def of(n: int) -> Column:
        joined = F.transform(tokens, lambda w, i: F.concat_ws(" ", w, *(F.get(tokens, i + k) for k in range(1, n))))
        return F.slice(joined, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))

    return F.concat(tokens, *(of(n) for n in range(2, longest + 1)))


def bucketed(features: Column, buckets: int) -> Column:
    return F.transform(features, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucket_counts(texts: DataFrame, text: str, buckets: int, longest: int) -> DataFrame:
    """bucket, n: the features of all texts in each bucket."""
    return texts.select(F.explode(let(words(F.col(text)), lambda w: bucketed(runs(w, longest), buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, from the two tables of bucket counts: at most ``buckets`` rows each."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    both = documents.select("bucket", "n", F.lit(0).alias("side")).unionByName(target.select("bucket", "n", F.lit(1).alias("side")))
    for row in both.collect():
        (t if row["side"] else s)[row["bucket"]] = row["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, features: str, gain: np.ndarray) -> DataFrame:
    """``rows`` without the bucket lists, with n_features and weight."""
    kept = [c for c in rows.columns if c != features]
    held = rows.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(features)
            cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
            sums = np.concatenate(([0], np.cumsum(held.value[lists.flatten().to_numpy()], dtype=np.int64)))
            columns = [batch.column(c) for c in kept] + [pa.array(np.diff(cuts)), pa.array(sums[cuts[1:]] - sums[cuts[:-1]])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_features", "weight"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*kept).dtypes) + ", n_features long, weight long"
    return rows.mapInArrow(weigh, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of ``<seed>:<key>``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def digits_of(rows: DataFrame, keys: list[str]) -> list[Column]:
    """The digits of unsigned 64-bit keys in which rows differ, least significant first; ``keys`` from the most significant on."""
    seen = rows.agg(*(f(k).alias(f"{n}_{k}") for k in keys for n, f in (("or", F.bit_or), ("and", F.bit_and)))).first()
    out = []
    for key in reversed(keys):
        varies = ((seen[f"or_{key}"] or 0) ^ (seen[f"and_{key}"] or 0)) & (2**64 - 1)
        out += [F.shiftrightunsigned(F.col(key), at).bitwiseAND(2**DIGIT - 1).cast("int") for at in range(0, 64, DIGIT) if varies >> at & (2**DIGIT - 1)]
    return out


def radix_ranked(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with ``position`` from 0 in rising order of unsigned 64-bit ``keys``; rows of equal keys in any order."""
    rows = stored(rows.withColumn("_pos", F.monotonically_increasing_id()), "unsorted")
    digits = digits_of(rows, keys)
    # the first pass takes the places in the files; the high bits name a file's part, so that a block is within one
    cut = F.struct(F.shiftright("_pos", 33).alias("part"), F.floor(F.col("_pos").bitwiseAND((1 << 33) - 1) / block).cast("long").alias("piece"))
    for digit in digits or [F.lit(0)]:  # rows without any difference still need dense positions
        placed = rows.withColumn("_block", cut).withColumn("_digit", digit)
        counts = placed.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
        # offsets: rows of smaller digits in any block, and rows of the same digit in earlier blocks
        smaller = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
        smaller = smaller.withColumn("_below", F.sum("_all").over(Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)))  # one row per digit: 2048 at most
        earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.withColumn("_earlier", earlier).join(smaller, "_digit").select("_digit", "_block", (F.coalesce("_earlier", F.lit(0)) + F.coalesce("_below", F.lit(0))).alias("_offset"))
        nth = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_pos")) - 1  # a block at most
        moved = placed.withColumn("_nth", nth).join(offsets, ["_block", "_digit"])
        rows = stored(moved.withColumn("_pos", F.col("_offset") + F.col("_nth")).drop("_block", "_digit", "_offset", "_nth"), "pass")
        cut = F.floor(F.col("_pos") / block).cast("long")
    return rows.withColumnRenamed("_pos", "position")


def resampled(
    documents: DataFrame, target: DataFrame, *, id_column: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, block: int = BLOCK
) -> DataFrame:
    """id, n_features, weight, score, and the rank of the drawn: ``percent`` of the documents of enough words."""
    gain = gains(bucket_counts(documents, text, buckets, longest), bucket_counts(target, target_text, buckets, longest), buckets)
    tokens = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), bucketed(runs(w, longest), buckets).alias("buckets")))
    lists = documents.select(F.col(id_column).cast("long").alias("_id"), tokens.alias("_t")).select("_id", F.col("_t.n").alias("_n_words"), F.col("_t.buckets").alias("_buckets"))
    scored = stored(weighed(lists, "_buckets", gain).withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "scored")
    enough = scored.filter(F.col("_n_words") >= least_words)
    drawn = enough.count() * percent // 100
    # as unsigned keys: the score's bits turned so that high ones come first, null ids behind all, ids in their order
    low = -(2**63)
    keyed = enough.withColumns({"_k1": F.bitwise_not(F.col("score").bitwiseXOR(F.lit(low))), "_k2": F.col("_id").isNull().cast("long"), "_k3": F.coalesce(F.col("_id"), F.lit(0)).bitwiseXOR(F.lit(low))})
    ranked = radix_ranked(keyed, ["_k1", "_k2", "_k3"], block).withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1))
    rest = scored.filter(F.col("_n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("_id").alias(id_column), "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
