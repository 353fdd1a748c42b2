"""Near-duplicate documents: MinHash, banding, signature and full-set verification, connected components.

1. Each text gives its set of word shingles, 128 universal-hash minima (``a*x + b`` modulo 2**64), 32 band
   keys of four minima, and a 128-bit signature (the lowest bit of each minimum).
2. Texts with the same set form one class, named by its smallest id; only classes go on.
3. Band keys are grouped. In each, members meet the one that shares most buckets with others. Signatures screen, full sets
   confirm, and large-star and small-star connect.
4. What is left are buckets whose members lie in different components. Pairs that share a shingle which
   few members have (``most``) are looked up by it. A pair that shares none can have only the other shingles in common, which bounds
   its similarity: members that can reach nothing in a bucket leave it, and of the others only pairs across components
   that can still link are screened and confirmed. Pairs within a component change nothing and are never formed.

So a link is lost only if its pair shares no band (chance 5e-6 at similarity 0.75, less above) or its
signatures differ by over ``max_bits`` (16 expected at 0.75; 36 is over five deviations away).
Only classes, keys and pairs are shuffled besides one pass of the candidates' texts, whose sets are stored once.

Defined cases: empty texts (null, or without words) are linked with nothing; rows that share an id count as one
document; a null id has no component and is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stored
from attestry.llm.components import components
from attestry.llm.words import STEPS, mix, pieces, shingle_sets
from attestry.session import cut_lineage

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
_A = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * STEPS[2]) | np.uint64(1)
_B = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * STEPS[3])
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bits_a long, bits_b long, bands array<long>"


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per document: set size, the set's identity, signature bits and band keys (null for an empty set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, cuts in pieces(batch.column(1)):
                sets, starts = shingle_sets(data, cuts, width)
                size = np.diff(starts)
                full = np.flatnonzero(size)
                heads = starts[:-1][full]
                minima = np.empty((len(full), MINIMA), dtype=np.uint64)
                room = np.empty_like(sets)
                if len(full):
                    for k in range(MINIMA):
                        np.multiply(sets, _A[k], out=room)
                        room += _B[k]
                        minima[:, k] = np.minimum.reduceat(room, heads)
                mixed = mix(minima)
                bits = np.packbits((mixed & np.uint64(1)).astype(np.uint8), axis=1).reshape(-1, 2, 8).copy().view(np.int64).reshape(-1, 2)
                bands = np.zeros((len(full), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    bands = mix(bands * STEPS[r] + mixed[:, r::ROWS])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * STEPS[4]).view(np.int64)
                n = last - first
                ids = np.zeros((n, 4), dtype=np.int64)
                if len(full):
                    ids[full, 0] = np.add.reduceat(mix(sets + STEPS[0]), heads).view(np.int64)
                    ids[full, 1] = np.add.reduceat(mix(sets ^ STEPS[1]), heads).view(np.int64)
                    ids[full, 2:] = bits
                empty = size == 0
                offsets = np.concatenate(([0], np.cumsum(np.where(empty, 0, BANDS)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array(size, pa.int64()), *(pa.array(ids[:, k], pa.int64(), mask=empty) for k in range(4)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1), pa.int64())),
                ], names=[c.split()[0] for c in SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SKETCH)


def shingle_table(docs: DataFrame, ids: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, members) for the asked ids: the full shingle sets, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, cuts in pieces(batch.column(1)):
                sets, starts = shingle_sets(data, cuts, width)
                packed = [sets[starts[i] : starts[i + 1]].tobytes() for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(packed, pa.binary())], names=["doc_id", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(ids, "doc_id", "left_semi").mapInArrow(pack, "doc_id long, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= share * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(left.as_buffer(), dtype=np.uint64), np.frombuffer(right.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= share * max(len(a), len(b)) else 0
                good.append(both > 0 and 100 * both >= share * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("members").alias("set_u")), "u")
    two = one.join(sets.select(F.col("doc_id").alias("v"), F.col("members").alias("set_v")), "v")
    return two.select("u", "v", "set_u", "set_v").mapInArrow(check, "u long, v long").distinct()


def rare_shingles(sets: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(shingle, doc_id) of the shingles that at most ``most`` of these sets have."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([s.as_buffer().size // 8 for s in batch.column(1)], dtype=np.int64)
            for begin in range(0, batch.num_rows, 1000):
                part = slice(begin, begin + 1000)
                own = np.repeat(batch.column(0).to_numpy()[part], size[part])
                flat = np.frombuffer(b"".join(s.as_py() for s in batch.column(1)[part]), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(flat, pa.int64())], names=["doc_id", "shingle"])

    rows = sets.join(ids, "doc_id", "left_semi").select("doc_id", "members").mapInArrow(unpack, "doc_id long, shingle long")
    few = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("shingle")
    return rows.join(few, "shingle")


def _differing(a: str, b: str):
    return F.bit_count(F.col(f"{a}.bits_a").bitwiseXOR(F.col(f"{b}.bits_a"))) + F.bit_count(F.col(f"{a}.bits_b").bitwiseXOR(F.col(f"{b}.bits_b")))


def near_duplicates(docs: DataFrame, share: int = 75, width: int = 5, max_bits: int = 36, most: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable, its own included), kept."""
    found = stored(sketches(docs, width), "minhash-sketches")
    named = found.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class")))
    # Ids that stand for several sets (repeated ids) and copies are links without a search.
    same = cut_lineage(named.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "class").distinct())
    nodes = named.join(same.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bits = cut_lineage(nodes.select("doc_id", "n_shingles", "bits_a", "bits_b").dropDuplicates())
    members = nodes.select("doc_id", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = cut_lineage(members.join(shared, "key").select("key", "doc_id", "n").distinct())
    weight = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    pivots = buckets.join(weight, "doc_id").groupBy("key").agg(F.max_by("doc_id", "weight").alias("pivot"))
    stars = buckets.join(pivots, "key").filter("doc_id <> pivot").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).distinct()

    sizes = F.col("a.n_shingles"), F.col("b.n_shingles")
    alike = (_differing("a", "b") <= max_bits) & (100 * F.least(*sizes) >= share * F.greatest(*sizes))

    def screened(pairs: DataFrame) -> DataFrame:
        a, b = bits.alias("a"), bits.alias("b")
        near = pairs.join(a, F.col("u") == F.col("a.doc_id")).join(b, F.col("v") == F.col("b.doc_id")).filter(alike)
        return near.select(*pairs.columns)

    stars = cut_lineage(screened(stars))
    sets = stored(shingle_table(docs, buckets.select("doc_id").distinct(), width), "minhash-sets")

    links = cut_lineage(confirmed(stars.select("u", "v"), sets, share))
    joined = cut_lineage(components(links))

    def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose ends are not connected yet."""
        a = comp.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        b = comp.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        open_ = pairs.join(a, "u", "left").join(b, "v", "left").filter(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
        return open_.select("u", "v")

    placed = buckets.select("key", "doc_id").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = cut_lineage(placed)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    wide = cut_lineage(placed.join(mixed, "key", "left_semi").join(bits, "doc_id"))
    rare = cut_lineage(rare_shingles(sets, wide.select("doc_id").distinct(), most))
    alone = rare.groupBy("doc_id").agg(F.count("*").alias("alone"))
    a, b = rare.alias("a"), rare.alias("b")
    near = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).distinct()
    near = across(screened(near), joined)
    wide = wide.join(alone, "doc_id", "left").withColumn("able", F.col("n_shingles") - F.coalesce("alone", F.lit(0)))
    least = wide.groupBy("key").agg(F.min("n_shingles").alias("least"))
    # a pair without a rare shingle in common shares at most ``able``: with no partner this small in the bucket, none can reach the share
    wide = cut_lineage(wide.join(least, "key").filter((100 + share) * F.col("able") - share * F.col("n_shingles") >= share * F.col("least")).drop("alone", "least"))
    major = wide.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("major"), F.count("*").alias("parts"))
    wide = cut_lineage(wide.join(major.filter("parts > 1").drop("parts"), "key"))
    wide = wide.join(wide.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "doc_id")  # at most one key per band
    # every pair across components has an end outside the bucket's largest one
    a, b = wide.filter("component <> major").alias("a"), wide.alias("b")
    common = F.least("a.able", "b.able")
    once = (F.col("b.component") == F.col("b.major")) | (F.col("a.component") < F.col("b.component"))
    reach = 100 * common >= share * (F.col("a.n_shingles") + F.col("b.n_shingles") - common)
    first_key = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")  # a pair is formed in one bucket only
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & once & reach & alike & first_key)
    pairs = cut_lineage(pairs.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).union(near).distinct())
    links = links.union(confirmed(pairs, sets, share))

    copies = same.select(F.col("doc_id").alias("u"), F.col("class").alias("v"))
    comp = components(links.union(copies.filter("u <> v")))
    out = found.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
