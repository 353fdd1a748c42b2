"""N-gram language model scoring with a log-frequency Bloom filter.

Training counts word n-grams exactly (pre-aggregated blocks of fingerprints, shuffled by bucket). A
count c is stored as its level ``1 + floor(log_b c)``: the pair (n-gram, j) is a member of a Bloom
filter for every j up to the level. The filter lies in segments, one for each bucket of fingerprints; a count comes back by
probing j = 1, 2, ... until the first miss, so an overestimate by k levels has a chance that falls with the k-th power of
the false-positive rate. Probabilities are smoothed with the shorter n-gram's:

    P(w)    = (c(w) + 1) / (N + V + 1)
    P(w|h)  = (min(c(hw), c(h), c(w)) + K * P(w | shorter h)) / (c(h) + K)

The filter has one bit for each byte of training text, at most ``max_filter_bytes`` if that is given (no n-gram is dropped beyond it;
the false-positive rate, returned in ``filter_fp``, grows instead). No task and no driver holds more than one segment of it: texts are dealt
into parts, each part asks every bucket for its different n-grams once, and the answers meet the part's texts again. What is asked for are
fingerprints; an answer is a level and, for a word, its exact count, which the base score needs. The most frequent words (a fixed number)
are broadcast and not asked for.

Defined cases: a null or empty text has one token (the end). A null id counts as the empty text in the
held-out rule. Repeated rows are scored each on its own. Without training rows N and V are 0.
Rows are never keyed by their id, so ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import bucket_count, stored
from attestry.llm.words import STEPS, mix, pieces, words

START, END = np.uint64(0x1F0E3DCB5A497887), np.uint64(0x7A6B5C4D3E2F1809)
BLOCK_SCHEMA = "bucket int, kind int, n long, keys binary, counts binary"
MODEL_SCHEMA = "bucket int, tokens long, distinct_words long, entries long, keys binary, counts binary, hot_keys binary, hot_counts binary, hot_levels binary, bits binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    order: int = 2
    base: float = 1.5            # of the count levels
    probes: int = 4              # hash functions per member
    smoothing: float = 4.0       # K
    max_filter_bytes: int | None = None
    hot_words: int = 1 << 18     # words whose exact counts are broadcast
    bucket_bytes: int = 8 << 20  # text bytes per bucket, and per part
    flush_tokens: int = 2_000_000


def grams(data: np.ndarray, cuts: np.ndarray, order: int):
    """For each text: start mark, start mark, words, end mark. Fingerprints per order, position by position.

    Position 0 of a text belongs to no n-gram; position 1 is the start mark itself.
    """
    prints, first = words(data, cuts)
    n = len(cuts) - 1
    size = np.diff(first) + 3
    at = np.concatenate(([0], np.cumsum(size)))
    tokens = np.full(at[-1], START, dtype=np.uint64)
    tokens[np.arange(len(prints)) + np.repeat(3 * np.arange(n) + 2, size - 3)] = prints
    tokens[at[1:] - 1] = END
    out = [tokens]
    for k in range(1, order):
        longer = np.empty_like(tokens)
        longer[0] = START
        longer[1:] = mix(out[-1][:-1] * STEPS[k] + tokens[1:])
        out.append(longer)
    return out, at


def part_grams(texts: pa.Array, order: int):
    """``grams`` of all texts of a part. Positions without an n-gram hold the start mark, so the set of n-grams is the same in whatever order texts come."""
    found, at = [[] for _ in range(order)], [np.zeros(1, dtype=np.int64)]
    for _, _, data, cuts in pieces(texts):
        by_order, own = grams(data, cuts, order)
        for k in range(order):
            for j in range(k):
                by_order[k][own[:-1] + j] = START
            found[k].append(by_order[k])
        at.append(own[1:] + at[-1][-1])
    return [np.concatenate(f) for f in found], np.concatenate(at)


def _edges(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each bucket's run of sorted keys begins, and the end."""
    inner = np.searchsorted(keys, np.arange(1, segments, dtype=np.uint64) << np.uint64(64 - max(1, segments.bit_length() - 1)))
    return np.concatenate(([0], inner, [len(keys)]))


def _within(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place in the sorted ``held``, and whether it is there."""
    if not len(held):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    spot = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return spot, held[spot] == keys


def _levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def _expected(level: np.ndarray, base: float) -> np.ndarray:
    """The middle of the counts that share a level."""
    low = np.ceil(base ** (level - 1) - 1e-9)
    high = np.maximum(low, np.ceil(base**level - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _places(keys: np.ndarray, level: int, probes: int, segments: int, bits: int) -> Iterator[np.ndarray]:
    """Bit numbers of the members (key, level); the key's top bits name the segment, so one task builds it whole."""
    segment = (keys >> np.uint64(64 - max(1, segments.bit_length() - 1))).astype(np.int64) if segments > 1 else np.zeros(len(keys), dtype=np.int64)
    member = mix(keys + np.uint64(level * int(STEPS[3]) % 2**64))
    step = mix(member + STEPS[4]) | np.uint64(1)
    for _ in range(probes):
        yield segment * bits + (member % np.uint64(bits)).astype(np.int64)
        member = member + step


def count_blocks(texts: DataFrame, column: str, segments: int, s: Settings) -> DataFrame:
    """Pre-aggregated n-gram counts of each stretch of text, cut by bucket. kind 1: single tokens, 2: longer n-grams."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush():
            for kind in (0, 1):
                if not held[kind]:
                    continue
                keys, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                held[kind].clear()
                edges = _edges(keys, segments)
                full = np.flatnonzero(np.diff(edges))
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int32()), pa.array(np.full(len(full), kind + 1), pa.int32()), pa.array(np.diff(edges)[full], pa.int64()),
                    pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                    pa.array([counts[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                ], names=["bucket", "kind", "n", "keys", "counts"])

        for batch in batches:
            for _, _, data, cuts in pieces(batch.column(0)):
                by_order, at = grams(data, cuts, s.order)
                used = np.ones(at[-1], dtype=bool)
                used[at[:-1]] = False
                held[0].append(by_order[0][used])
                for k in range(1, s.order):
                    if k > 1:
                        used[at[:-1] + k - 1] = False
                    held[1].append(by_order[k][used])
                size += at[-1]
                if size >= s.flush_tokens:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.select(F.col(column).cast("string").alias("text")).mapInArrow(blocks, BLOCK_SCHEMA)


def train(texts: DataFrame, column: str, segments: int, filter_bits: int, s: Settings) -> DataFrame:
    """One row per bucket: exact word counts, the most frequent of them, and the bucket's segment of the filter."""
    bits = max(64, filter_bits // segments // 8 * 8)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, row, field = int(frame["bucket"].iloc[0]), {}, np.zeros(bits, dtype=bool)
        entries = 0
        for kind in (1, 2):
            own = frame[frame["kind"] == kind]
            keys = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in own["keys"]] or [np.zeros(0, np.uint64)])
            counts = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in own["counts"]] or [np.zeros(0, np.uint32)]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            counts = np.add.reduceat(counts, heads) if len(heads) else counts
            keys = keys[heads]
            levels = _levels(counts, s.base) if len(keys) else np.zeros(0, np.int64)
            entries += int(levels.sum())
            for level in range(1, int(levels.max(initial=0)) + 1):
                for place in _places(keys[levels >= level], level, s.probes, segments, bits):
                    field[place - bucket * bits] = True
            if kind == 1:
                real = keys != START
                keys, counts = keys[real], counts[real]
                hot = np.sort(np.argsort(-counts, kind="stable")[: max(1, s.hot_words // segments)])
                row = {"tokens": int(counts.sum()), "distinct_words": len(keys), "keys": keys.tobytes(), "counts": counts.tobytes(),
                       "hot_keys": keys[hot].tobytes(), "hot_counts": counts[hot].tobytes()}
        row |= {"bucket": bucket, "entries": entries, "bits": np.packbits(field, bitorder="little").tobytes()}
        row["hot_levels"] = Filter([row], segments, filter_bits, s).levels(np.frombuffer(row["hot_keys"], dtype=np.uint64)).tobytes()
        return pd.DataFrame([row])[[c.split()[0] for c in MODEL_SCHEMA.split(", ")]]

    return count_blocks(texts, column, segments, s).groupBy("bucket").applyInPandas(build, MODEL_SCHEMA)


class Filter:
    """Neighbouring segments of the filter, as a task holds them to look counts up."""

    def __init__(self, rows: list, segments: int, filter_bits: int, s: Settings):
        self.segments, self.settings = segments, s
        self.bits = max(64, filter_bits // segments // 8 * 8)
        self.first = min((r["bucket"] for r in rows), default=0)
        self.field = np.zeros((max((r["bucket"] for r in rows), default=0) - self.first + 1) * self.bits // 8, dtype=np.uint8)
        for row in rows:
            start = (row["bucket"] - self.first) * self.bits // 8
            self.field[start : start + self.bits // 8] = np.frombuffer(row["bits"], dtype=np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels from repeated membership probes, one after the other. All keys belong to these segments."""
        unique, back = np.unique(keys, return_inverse=True)
        level, alive = np.zeros(len(unique), dtype=np.uint8), np.arange(len(unique))
        j = 1
        while len(alive) and j <= 200:  # base ** 200 exceeds any count, even with a saturated filter
            member = np.ones(len(alive), dtype=bool)
            for place in _places(unique[alive], j, self.settings.probes, self.segments, self.bits):
                place = place - self.first * self.bits
                member &= (self.field[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            alive = alive[member]
            level[alive] = j
            j += 1
        return level[back]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Expected counts."""
        return _expected(self.levels(keys).astype(np.int64), self.settings.base)


def log_probabilities(seen: list[np.ndarray], tokens: int, words: int, s: Settings) -> np.ndarray:
    """log10 P of every position from the counts of its n-grams, per order; those of start marks mean nothing."""
    chance = (seen[0] + 1) / (tokens + words + 1)
    for k in range(1, len(seen)):
        history = np.concatenate(([0.0], seen[k - 1][:-1]))
        joint = np.minimum(np.minimum(seen[k], history), seen[k - 1])
        chance = (joint + s.smoothing * chance) / (history + s.smoothing)
    return np.log10(chance)


def score(docs: DataFrame, held_out, s: Settings = Settings()) -> DataFrame:
    """Scores every text with a model of the rows that are not held out. Columns: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score, filter_fp."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    total_size, size = (n or 0 for n in rows.agg(F.sum(F.octet_length("text")), F.sum(F.when(~F.col("held_out"), F.octet_length("text")))).first())
    segments, parts = bucket_count(size, s.bucket_bytes), bucket_count(total_size, s.bucket_bytes)
    filter_bits = max(size, 1 << 13) if s.max_filter_bytes is None else min(max(size, 1 << 13), 8 * s.max_filter_bytes)
    model = stored(train(rows.filter(~F.col("held_out")), "text", segments, filter_bits, s), "lm-model")
    tokens, distinct, entries = (n or 0 for n in model.agg(F.sum("tokens"), F.sum("distinct_words"), F.sum("entries")).first())
    bits = max(64, filter_bits // segments // 8 * 8)
    false_positives = float((1 - np.exp(-s.probes * entries / (segments * bits))) ** s.probes)  # the chance that a pair never stored seems to be a member
    frequent = model.select("bucket", "hot_keys", "hot_counts", "hot_levels").orderBy("bucket").collect()  # hot_words at most, in the order of their fingerprints
    joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], dtype=kind) for r in frequent] or [np.zeros(0, kind)])
    shared = spark.sparkContext.broadcast((joined("hot_keys", np.uint64), joined("hot_counts", np.int64), joined("hot_levels", np.uint8)))
    # one exchange of the texts serves both the asking and the scoring
    texts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))

    def ask(key: tuple, own: pa.Table) -> pa.Table:
        by_order, _ = part_grams(own.column("text"), s.order)
        keys = np.unique(np.concatenate(by_order))
        keys = keys[~_within(shared.value[0], keys)[1]]
        edges = _edges(keys, segments)
        full = np.flatnonzero(np.diff(edges))
        return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array(np.full(len(full), key[0].as_py()), pa.int32()), "keys": pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary())})

    def settle(asked: pa.Table, held: pa.Table) -> pa.Table:
        """Levels and exact counts (0 for what is no word) of all keys asked of a bucket."""
        bucket, part, runs = asked.column("bucket").to_pylist(), asked.column("part"), asked.column("keys").to_pylist()
        ends = np.cumsum([0] + [len(r) // 8 for r in runs])
        keys = np.frombuffer(b"".join(runs), dtype=np.uint64)
        level, exact = np.zeros(len(keys), dtype=np.uint8), np.zeros(len(keys), dtype=np.int64)
        for row in held.to_pylist():  # one, or none where the bucket holds nothing
            level = Filter([row], segments, filter_bits, s).levels(keys)
            spot, found = _within(np.frombuffer(row["keys"], dtype=np.uint64), keys)
            exact[found] = np.frombuffer(row["counts"], dtype=np.int64)[spot[found]]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.table({"part": part, "bucket": pa.array(bucket, pa.int32()), "levels": cut(level), "exact": cut(exact)})

    def total(own: pa.Table, answers: pa.Table) -> pa.Table:
        by_order, at = part_grams(own.column("text"), s.order)
        keys, back = np.unique(np.concatenate(by_order), return_inverse=True)
        hot_keys, hot_counts, hot_levels = shared.value
        spot, hot = _within(hot_keys, keys)
        level, exact = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        level[hot], exact[hot] = hot_levels[spot[hot]], hot_counts[spot[hot]]
        answers = answers.sort_by("bucket")
        level[~hot] = np.frombuffer(b"".join(answers.column("levels").to_pylist()), dtype=np.uint8)
        exact[~hot] = np.frombuffer(b"".join(answers.column("exact").to_pylist()), dtype=np.int64)
        real = np.ones(at[-1], dtype=bool)
        real[at[:-1]] = real[at[:-1] + 1] = False
        logs = log_probabilities(np.split(_expected(level, s.base)[back], s.order), tokens, distinct, s)
        counts = exact[back[: at[-1]]]
        per_text = lambda x: np.add.reduceat(np.where(real, x, 0), at[:-1])
        n_tokens = np.diff(at) - 2
        base = per_text(np.log10(counts + 1.0)) - n_tokens * np.log10(tokens + 1.0 * (distinct + 1))
        return pa.table({"doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(per_text(counts > 0), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(per_text(logs), pa.float64())})

    asked = texts.groupBy("part").applyInArrow(ask, "bucket int, part int, keys binary")
    held = model.select("bucket", "keys", "counts", "bits")
    answers = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(settle, "part int, bucket int, levels binary, exact binary")
    done = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(total, SCORE_SCHEMA)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", F.lit(false_positives).alias("filter_fp"))
