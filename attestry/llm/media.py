"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

Sound (8-bit samples) is cut into overlapping frames; a frame's spectrum is folded onto the twelve pitch classes. Over the image of
pitch classes by time, 16 rectangular filters are evaluated by an integral image; each gives two Gray-coded bits, so every
frame carries a packed 32-bit integer. Recordings with equal fingerprints form a class.

Search: frames whose hash is least among their neighbours are anchors, the same ones wherever a stretch of sound occurs.
A copy rarely starts on a multiple of the hop, so a query is fingerprinted at several phases of it. Its anchors meet all anchors
in a join; a histogram of offsets per pair of classes and phase offers alignments, and the share of different bits along the overlap is taken
at each of them before the best of a pair is kept.

Defined cases: short sound (less than one filter's width) has no frames and no match, its class is that of equal sounds; null sound has its own class; rows that share an id and
the sound get the same answer; silence has the code of an even spectrum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stored
from attestry.llm.words import STEPS, mix

FRAME, HOP, RATE, WIDTH = 128, 32, 8000, 8
PITCHES = 12
STEP = 0.08  # distance of the two outer thresholds from 0
ROOM = 1 << 21  # frames compared at once
PHASED = "class_id long, phase int, frames binary"
PRINTS = "clip_id long, clip_hash long, n_frames long, class_a long, class_b long, frames binary"


def _folding() -> np.ndarray:
    """Spectrum bins to pitch classes, from 110 Hz up."""
    matrix = np.zeros((FRAME // 2 + 1, PITCHES), dtype=np.float32)
    for k in range(FRAME // 2 + 1):
        hertz = k * RATE / FRAME
        if 110 <= hertz <= 3520:
            matrix[k, round(PITCHES * np.log2(hertz / 440)) % PITCHES] = 1
    return matrix


def _filters() -> list[tuple[int, int, int, int]]:
    """(shape, lowest pitch, pitches, frames) of the 16 filters, by rule: four shapes at four places and sizes."""
    return [(shape, (3 * place) % PITCHES, 2 + 2 * (place % 2) if shape else 3, WIDTH if place < 2 else WIDTH // 2) for shape in range(4) for place in range(4)]


def codes(image: np.ndarray) -> np.ndarray:
    """The packed integers of an image (frames by pitch classes, two turns of the classes side by side); one for each full window."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, image.shape[1] + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[t1 : t1 + n, y1] - total[t0 : t0 + n, y1] - total[t1 : t1 + n, y0] + total[t0 : t0 + n, y0]

    out = np.zeros(n, dtype=np.uint32)
    for shape, y, h, w in _filters():
        if shape == 0:  # the band against all pitches
            a, b = area(0, w, y, y + h) * PITCHES, area(0, w, 0, PITCHES) * h
        elif shape == 1:  # lower against upper half
            a, b = area(0, w, y, y + h // 2), area(0, w, y + h // 2, y + h)
        elif shape == 2:  # earlier against later half
            a, b = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        else:  # checkerboard
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = area(w // 2, w, y, y + h // 2) + area(0, w // 2, y + h // 2, y + h)
        value = np.log((1e-6 + a) / (1e-6 + b))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprint(samples: np.ndarray, room: int = 4096) -> np.ndarray:
    """All packed integers of one recording of 8-bit samples, however long."""
    frames = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if frames < WIDTH:
        return np.zeros(0, dtype=np.uint32)
    fold, window, images = _folding(), np.hanning(FRAME).astype(np.float32), []
    for begin in range(0, frames, room):  # bounded memory for very long sound
        count = min(room, frames - begin)
        part = samples[begin * HOP : (begin + count - 1) * HOP + FRAME].astype(np.float32) - 128
        cut = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        energy = np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * window)) @ fold
        images.append(np.tile(energy / np.maximum(energy.sum(axis=1, keepdims=True), 1e-9), 2))
    return codes(np.concatenate(images))


def fingerprints(clips: DataFrame) -> DataFrame:
    """``clips`` has (clip_id, sound binary). One row each, with the packed frames and the class of equal fingerprints."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                own = batch.slice(begin, 256)
                prints = [fingerprint(np.frombuffer(s.as_buffer() or b"", dtype=np.uint8)) if s.is_valid else np.zeros(0, np.uint32) for s in own.column(1)]
                spread = [mix(p.astype(np.uint64) + np.arange(1, len(p) + 1, dtype=np.uint64) * STEPS[0]) for p in prints]
                a = np.array([x.sum(dtype=np.uint64) for x in spread], dtype=np.uint64).view(np.int64)
                b = np.array([np.bitwise_xor.reduce(mix(x + STEPS[1])) if len(x) else np.uint64(0) for x in spread], dtype=np.uint64).view(np.int64)
                bare = np.array([len(p) == 0 for p in prints], dtype=bool)  # classes by the sound itself
                a = np.where(bare, own.column(2).to_numpy(zero_copy_only=False), a)
                b = np.where(bare, np.array([len(s.as_buffer()) if s.is_valid else 0 for s in own.column(1)], dtype=np.int64), b)
                null = np.array([not s.is_valid for s in own.column(1)], dtype=bool)
                yield pa.RecordBatch.from_arrays([
                    own.column(0), own.column(2), pa.array([len(p) for p in prints], pa.int64()), pa.array(a, mask=null), pa.array(b, mask=null), pa.array([p.tobytes() for p in prints], pa.binary()),
                ], names=[c.split()[0] for c in PRINTS.split(", ")])

    rows = clips.select(F.col("clip_id").cast("long"), F.col("sound").cast("binary"), F.xxhash64("sound").alias("clip_hash"))
    return rows.mapInArrow(scan, PRINTS)


def phased(clips: DataFrame, phases: int) -> DataFrame:
    """(class_id, phase, frames) of (class_id, sound): the packed frames as if the sound began ``phase`` samples later."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sound in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                samples = np.frombuffer(sound.as_buffer(), dtype=np.uint8)
                starts = range(0, HOP, max(1, HOP // phases))
                frames = [fingerprint(samples[s:]).tobytes() for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(frames), pa.int64()), pa.array(starts, pa.int32()), pa.array(frames, pa.binary())], names=["class_id", "phase", "frames"])

    return clips.select("class_id", "sound").mapInArrow(scan, PHASED)


def anchors(classes: DataFrame, reach: int) -> DataFrame:
    """(class_id, phase, key, at): hashes of three frames, where they are least among ``reach`` neighbours to both sides."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, turns, keys, places = [], [], [], []
            for name, turn, packed in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                p = np.frombuffer(packed.as_buffer(), dtype=np.uint32).astype(np.uint64)
                if len(p) < 3:
                    continue
                key = mix(p[:-2] * STEPS[0] + mix(p[1:-1] * STEPS[1] + p[2:] * STEPS[2]))
                wide = np.concatenate((np.full(reach, 2**64 - 1, np.uint64), key, np.full(reach, 2**64 - 1, np.uint64)))
                least = np.flatnonzero(key == np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1).min(axis=1))
                least = least[np.concatenate(([True], key[least][1:] != key[least][:-1]))]  # a held tone has one anchor
                names.append(np.full(len(least), name)), turns.append(np.full(len(least), turn))
                keys.append(key[least].view(np.int64)), places.append(least)
            if names:
                cells = ((names, pa.int64()), (turns, pa.int32()), (keys, pa.int64()), (places, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in cells], names=["class_id", "phase", "key", "at"])

    return classes.select("class_id", "phase", "frames").mapInArrow(pick, "class_id long, phase int, key long, at long")


def flat(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All frames of a column of packed frames, with the first place and the number of each row's."""
    edges = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 4
    data = packed.buffers()[2]
    return np.frombuffer(data, dtype=np.uint32, count=int(edges[-1])) if data is not None else np.zeros(0, np.uint32), edges[:-1], np.diff(edges)


def aligned(clips: DataFrame, is_query: Column, reach: int = 2, phases: int = 16, min_votes: int = 1, max_bits: float = 0.3, min_overlap: float = 0.5) -> DataFrame:
    """One row per clip: clip_id, n_frames, class_id, is_query, and for a query its matches among all other classes.

    n_matches counts the classes that align at any offset (at least ``min_votes`` anchors at one offset, ``min_overlap`` of the shorter recording,
    at most ``max_bits`` of the bits different); best_* describe the one with the fewest different bits.
    """
    found = stored(fingerprints(clips), "media-prints")
    full = found.filter("n_frames > 0 and clip_id is not null")
    key = ["class_a", "class_b", "n_frames"]
    named = found.filter("class_a is not null and clip_id is not null").groupBy(*key).agg(F.min("clip_id").alias("class_id"), F.max(is_query.cast("int")).alias("asked"))
    held = full.join(named.withColumnRenamed("class_id", "clip_id"), [*key, "clip_id"]).select(F.col("clip_id").alias("class_id"), "n_frames", "frames", "asked").dropDuplicates(["class_id", "n_frames"])
    held = stored(held, "media-classes")
    index = anchors(held.withColumn("phase", F.lit(0)), reach).drop("phase")
    # one asked clip speaks for each class
    asking = full.withColumn("_asks", F.coalesce(is_query, F.lit(False))).filter("_asks").join(named.select(*key, "class_id"), key)
    asking = asking.groupBy("class_id").agg(F.min(F.struct("clip_id", "clip_hash")).alias("c")).select("class_id", "c.clip_id", "c.clip_hash")
    sounds = clips.filter(is_query).select(F.col("clip_id").cast("long").alias("clip_id"), F.col("sound").cast("binary").alias("sound"))
    sounds = sounds.withColumn("clip_hash", F.xxhash64("sound")).join(asking, ["clip_id", "clip_hash"]).dropDuplicates(["class_id"])
    turned = stored(phased(sounds, phases), "media-queries")
    q = anchors(turned, reach).select(F.col("class_id").alias("query"), "phase", "key", F.col("at").alias("q_at"))
    votes = q.join(index, "key").filter("query <> class_id").groupBy("query", "phase", "class_id", (F.col("at") - F.col("q_at")).alias("shift")).agg(F.count("*").alias("votes"))
    offers = votes.filter(F.col("votes") >= min_votes).groupBy("query", "phase", "class_id").agg(F.collect_set("shift").alias("shifts"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifts = batch.column(3).flatten().to_numpy()
            (a, a_first, a_size), (b, b_first, b_size) = flat(batch.column(4)), flat(batch.column(5))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
            late, early = np.maximum(0, -shifts), np.maximum(0, shifts)
            n = np.maximum(0, np.minimum(a_size[row] - late, b_size[row] - early))
            wrong, ends = np.ones(len(n)), np.cumsum(n)
            begin = 0
            while begin < len(n):  # bounded memory, however many offsets
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - n[begin] + ROOM, side="right")))
                own = begin + np.flatnonzero(n[begin:end])
                if len(own):
                    heads = np.cumsum(n[own]) - n[own]
                    step = np.arange(n[own].sum())
                    different = np.bitwise_count(a[step + np.repeat(a_first[row[own]] + late[own] - heads, n[own])] ^ b[step + np.repeat(b_first[row[own]] + early[own] - heads, n[own])])
                    wrong[own] = np.add.reduceat(different, heads, dtype=np.int64) / (32 * n[own])
                begin = end
            fit = np.flatnonzero(wrong <= max_bits)
            who = pa.array(row[fit])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(who), batch.column(2).take(who), pa.array(shifts[fit]), batch.column(1).take(who), pa.array(wrong[fit], pa.float64()), pa.array(n[fit], pa.int64()),
            ], names=["query", "class_id", "shift", "phase", "errors", "overlap"])

    left = turned.select(F.col("class_id").alias("query"), "phase", F.col("frames").alias("q_frames"))
    pairs = offers.join(left, ["query", "phase"]).join(held.select("class_id", "frames"), "class_id")
    checked = pairs.select("query", "phase", "class_id", "shifts", "q_frames", "frames").mapInArrow(compare, "query long, class_id long, shift long, phase int, errors double, overlap long")
    sizes = held.select("class_id", "n_frames")
    fits = checked.join(sizes.withColumnsRenamed({"class_id": "query", "n_frames": "q_n"}), "query").join(sizes, "class_id").filter(F.col("overlap") >= min_overlap * F.least("q_n", "n_frames"))
    good = fits.groupBy("query", "class_id").agg(F.min(F.struct("errors", "shift", "phase")).alias("b")).select("query", "class_id", "b.*")
    per = good.groupBy("query").agg(F.count("*").alias("n_matches"), F.min(F.struct("errors", "class_id", "shift", "phase")).alias("b")).select(F.col("query").alias("class_id"), "n_matches", F.col("b.class_id").alias("best_class"), (F.col("b.shift") * HOP - F.col("b.phase")).alias("best_offset"), F.col("b.errors").alias("best_errors"))
    rows = found.join(named.select(*key, "class_id"), key, "left").withColumn("class_id", F.coalesce("class_id", "clip_id")).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    out = rows.join(per, "class_id", "left")
    asked = lambda c: F.when(F.col("is_query"), F.col(c))
    return out.select(
        "clip_id", "n_frames", "class_id", "is_query", F.when(F.col("is_query"), F.coalesce("n_matches", F.lit(0))).cast("long").alias("n_matches"),
        asked("best_class").alias("best_class"), asked("best_offset").alias("best_offset"), asked("best_errors").alias("best_errors"),
    )
