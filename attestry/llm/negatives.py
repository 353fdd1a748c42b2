"""Hard negatives from exact integer inner products, many candidates to a multiplication.

Components become ``floor(scale * x)``. A block of candidates is packed per component into one wide integer: each candidate's
component, biased to be non-negative, takes a field of its own (Kronecker substitution). One product per anchor component then
scores the whole block, and the fields of their sum, less what the biases added, are the exact inner products.

1. Anchors and candidates are dealt into blocks of bounded size, and each pair of blocks meets once, in a task of its own: the
   stated queries against all rows. No label, vector or id decides where a row goes, so hot ones need no splitting.
2. First pass: each block of candidates gives an anchor its best other rows of the same label; the best of all blocks are the positives.
3. Second pass: an anchor brings the scores of its positives; each block gives the best rows of other labels within each
   positive's band, and the best of all blocks remain.

Stored once in the shared folder: the rows that take part, numbered. Moved: each row once per block of the other side. Broadcast: nothing. Sent to the driver: two counts.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. A null id is no anchor and
comes last among equal scores. Rows that share an id are rows of their own: each anchor row has its own results, and only the
anchor's own row is left out of its positives. Vectors of different length are compared over the components they share. A score
beyond 64 bits counts as the nearest 64-bit number. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import stored

BLOCK = 8192  # rows of either side in a task, at most about
PACK = 1024  # candidates to a wide integer
LOW, HIGH = -(2**63), 2**63 - 1


def quantised(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of ragged lists as a matrix, short rows filled with zeros; exact whatever the magnitude."""
    lists = column.combine_chunks()
    cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
    lengths, flat = np.diff(cuts), lists.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if np.abs(scaled).max(initial=0.0) < 2.0**61:
        return scaled.astype(np.int64)
    return np.array([int(y) if np.isfinite(y) else int(x) * int(scale) for x, y in zip(out.ravel(), scaled.ravel())], dtype=object).reshape(out.shape)


class Packed:
    """Candidates packed into wide integers, to be multiplied by one anchor after the other."""

    def __init__(self, rows: np.ndarray, anchor_bound: int):
        self.n, self.width = rows.shape
        self.bias = max((int(abs(x)) for x in (rows.min(initial=0), rows.max(initial=0))), default=0)
        self.anchor_bias = anchor_bound
        most = max(2 * self.bias, self.width * (2 * self.bias) * (2 * self.anchor_bias))
        self.field = 4 if most < 2**32 else 8 if most < 2**64 else -(-most.bit_length() // 8)  # bytes
        self.small = self.field <= 8 and self.width * self.bias * self.anchor_bias < 2**62
        self.sums = (rows if self.small else rows.astype(object)).sum(axis=1)
        shifted = rows + self.bias
        self.packs = []
        for at in range(0, self.n, PACK):
            part = shifted[at : at + PACK]
            self.packs.append((len(part), [self._joined(part[:, k]) for k in range(self.width)]))

    def _joined(self, column: np.ndarray) -> int:
        if self.field <= 8:
            return int.from_bytes(column.astype(f"<u{self.field}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.field, "little") for x in column), "little")

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The exact inner products with all candidates, in their order."""
        lifted = [int(x) + self.anchor_bias for x in anchor]
        parts = []
        for n, wide in self.packs:
            raw = sum(map(mul, lifted, wide)).to_bytes(n * self.field, "little")
            if self.field <= 8:
                parts.append(np.frombuffer(raw, dtype=f"<u{self.field}"))
            else:
                parts.append(np.array([int.from_bytes(raw[i : i + self.field], "little") for i in range(0, len(raw), self.field)], dtype=object))
        fields = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        own = int(sum(int(x) for x in anchor))
        shift = self.bias * own + self.width * self.bias * self.anchor_bias
        if self.small:
            return fields.astype(np.int64) - shift - self.anchor_bias * self.sums.astype(np.int64)
        exact = fields.astype(object) - shift - self.anchor_bias * self.sums.astype(object)
        return np.array([min(max(int(x), LOW), HIGH) for x in exact], dtype=np.int64)


def _common(anchors: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both over the components they share: what one side lacks is zero on the other."""
    width = min(anchors.shape[1], candidates.shape[1])
    return anchors[:, :width], candidates[:, :width]


class _Block:
    """Candidates of a task in the order of ties, packed per label or all together."""

    def __init__(self, table: pa.Table, scale: float, anchors: np.ndarray, by_label: bool):
        ids = table.column("id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((values, ~known))
        self.ids, self.known = values[order], known[order]
        self.labels = table.column("label").to_numpy()[order]
        self.at = table.column("at").to_numpy()[order]
        rows = quantised(table.column("vec"), scale)[order]
        anchors, rows = _common(anchors, rows)
        self.anchors = anchors
        bound = max((int(abs(x)) for x in (anchors.min(initial=0), anchors.max(initial=0))), default=0)
        if by_label:
            self.members = {int(v): np.flatnonzero(self.labels == v) for v in np.unique(self.labels)}
            self.packed = {v: Packed(rows[at], bound) for v, at in self.members.items()}
        else:
            self.packed = Packed(rows, bound)

    def id_of(self, at: int) -> int | None:
        return int(self.ids[at]) if self.known[at] else None


def _positives(anchors: pa.Table, candidates: pa.Table, scale: float, wanted: int) -> Iterator[tuple]:
    """(anchor key, id, score) of the best ``wanted`` rows of each anchor's label."""
    own = quantised(anchors.column("vec"), scale)
    block = _Block(candidates, scale, own, by_label=True)
    for key, label, vector in zip(anchors.column("key").to_pylist(), anchors.column("label").to_pylist(), block.anchors):
        if label not in block.members:
            continue
        at = block.members[label]
        scores = block.packed[label].scores(vector)
        others = block.at[at] != key
        at, scores = at[others], scores[others]
        for i in _best(scores, wanted):
            yield key, block.id_of(at[i]), int(scores[i])


def _best(scores: np.ndarray, wanted: int) -> np.ndarray:
    """Positions of the highest scores, earlier ones first among equals."""
    near = np.arange(len(scores))
    if len(scores) > wanted:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - wanted)[len(scores) - wanted])
    return near[np.lexsort((near, ~scores[near]))][:wanted]  # ~x falls as x rises, without overflow at the ends


def _negatives(anchors: pa.Table, candidates: pa.Table, scale: float, wanted: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor key, number of the positive, id, score) of the best rows of other labels within each positive's band."""
    own = quantised(anchors.column("vec"), scale)
    block = _Block(candidates, scale, own, by_label=False)
    for key, label, bands, vector in zip(anchors.column("key").to_pylist(), anchors.column("label").to_pylist(), anchors.column("bands").to_pylist(), block.anchors):
        # low * positive <= 100 * negative <= high * positive, in whole numbers
        bands = [(b["no"], -(-low * b["score"] // 100), high * b["score"] // 100) for b in bands]
        floor, ceiling = min(b[1] for b in bands), max(b[2] for b in bands)
        if floor > HIGH or ceiling < LOW:
            continue
        scores = block.packed.scores(vector)
        near = np.flatnonzero((scores >= max(floor, LOW)) & (scores <= min(ceiling, HIGH)) & (block.labels != label))
        near = near[np.lexsort((near, ~scores[near]))]
        falling = ~scores[near]
        for no, least, most in bands:
            if least > most or least > HIGH or most < LOW:
                continue
            start, end = np.searchsorted(falling, ~min(most, HIGH), side="left"), np.searchsorted(falling, ~max(least, LOW), side="right")
            for i in near[start : min(end, start + wanted)]:
                yield key, no, block.id_of(i), int(scores[i])


def _met(anchors: DataFrame, rows: DataFrame, groups: int, shards: int, find, schema: str) -> DataFrame:
    """Each block of anchors with each block of rows, in a group of bounded size."""
    left = anchors.toDF(*anchors.columns).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # fresh columns: both sides come from one table
    right = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    names = [part.split()[0] for part in schema.split(", ")]
    types = [pa.int32() if part.endswith(" int") else pa.int64() for part in schema.split(", ")]

    def met(a: pa.Table, c: pa.Table) -> pa.Table:
        found = list(find(a, c)) if a.num_rows and c.num_rows else []
        columns = zip(*found) if found else [()] * len(names)
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, columns, types)})

    return left.groupBy("_group", "_shard").cogroup(right.groupBy("_group", "_shard")).applyInArrow(met, schema)


def hard_negatives(
    vectors: DataFrame, id_column: str, label: Column, vector_column: str, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``low`` and ``high`` are per cent of the positive's score between which a negative's must lie.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    counts = named.agg(F.count("*").alias("n"), F.count_if("_anchor").alias("a")).first()
    # smaller blocks for small tables, so that all cores have work; results do not depend on it
    shards = max(1, -(-counts["n"] // BLOCK), min(4 * cores, counts["n"] // 512))
    groups = max(1, -(-counts["a"] // BLOCK))
    numbered = stored(named.filter(sound).withColumn("at", F.monotonically_increasing_id()), "vectors")
    rows = numbered.select("id", "label", "vec", "at", F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("_shard"))
    anchors = numbered.filter("_anchor").select("id", "label", "vec", F.col("at").alias("key"), F.pmod(F.xxhash64("at", F.lit(1)), F.lit(groups)).cast("int").alias("_group"))

    found = _met(anchors.select("key", "label", "vec", "_group"), rows, groups, shards, lambda a, c: _positives(a, c, scale, positives), "key long, id long, score long")
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    first = found.withColumn("no", F.row_number().over(best)).filter(F.col("no") <= positives)
    chosen = stored(first.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("key", "anchor_id", "no", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    bands = chosen.groupBy("key").agg(F.collect_list(F.struct("no", F.col("positive_score").alias("score"))).alias("bands"))  # as many as ``positives``
    asking = anchors.select("key", "label", "vec", "_group").join(bands, "key")
    hard = _met(asking, rows, groups, shards, lambda a, c: _negatives(a, c, scale, negatives, low, high), "key long, no int, id long, score long")
    order = Window.partitionBy("key", "no").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return top.join(chosen, ["key", "no"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
