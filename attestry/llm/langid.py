"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn from its code point.
An n-gram's vector binds its letters by multiplying them, each rotated by its place; a text's vector
bundles (adds) those of all its n-grams; a language's prototype bundles those of its training texts.
A text gets the language whose prototype is nearest by cosine. Bundles are sums of whole numbers, so they
do not depend on the order of the rows.

Training uses every labelled row it is given. Prototypes are summed per task, then per language and salt,
then per language; only they (one vector per language, at most ``max_languages``) reach the driver and are broadcast.

Defined cases: a text without a letter (or null) is ``und`` with score 0; rows without a language do not
train; ties go to the language that sorts first; without training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.words import STEPS, mix, pieces

UNKNOWN = "und"
GRAMS = 8192  # n-grams whose vectors are held at a time
GAP = 32
_tables: dict = {}


def _letters() -> np.ndarray:
    """For every code point its lower-cased letter, or the gap if it is no letter."""
    if "letters" not in _tables:
        table = np.full(0x110000, GAP, dtype=np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _tables["letters"] = table
    return _tables["letters"]


def _letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """One row of +1 and -1 for each code point, the same in every process."""
    blocks = np.arange(dims // 64, dtype=np.uint64)
    bits = mix(mix(points.astype(np.uint64) * STEPS[0] + STEPS[1])[:, None] + blocks * STEPS[2])
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def bundles(column: pa.Array, dims: int, n: int, size: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, vector of each text, whether it has a letter) for runs of rows."""
    table = _letters()
    for first, last, data, cuts in pieces(column, size):
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[cuts]  # in code points
        rows = last - first
        # One gap before each text; it also ends the text before. Of a run of gaps the last one stays.
        code = np.full(len(chars) + rows + 1, GAP, dtype=np.uint32)
        row = np.repeat(np.arange(rows + 1), np.append(np.diff(begins) + 1, 1))
        code[np.arange(len(chars)) + row[np.arange(len(chars)) + np.repeat(np.arange(rows), np.diff(begins)) + 1] + 1] = table[chars]
        full = code != GAP
        has = np.bincount(row[full], minlength=rows)[:rows] > 0
        keep = full.copy()
        keep[:-1] |= full[1:]
        keep[-1] = True
        code, row, full = code[keep], row[keep], full[keep]
        seen = np.zeros(len(table), dtype=bool)
        seen[code] = True
        alphabet = np.flatnonzero(seen)
        rank = np.zeros(len(table), dtype=np.int32)
        rank[alphabet] = np.arange(len(alphabet))
        letter = rank[code].astype(np.int64)
        m = max(0, len(code) - n + 1)
        key = np.zeros(m, dtype=np.int64)
        for k in range(n):
            key = key * len(alphabet) + letter[k : k + m]
        own = row[:m]
        inside = (own == row[n - 2 : n - 2 + m]) & ((own == row[n - 1 : n - 1 + m]) | ~full[n - 1 : n - 1 + m])
        key, own = key[inside], own[inside]
        out = np.zeros((rows, dims), dtype=np.float32)
        if len(key):
            if len(alphabet) ** n <= 1 << 22:  # the same numbering, without a sort
                grams = np.flatnonzero(np.bincount(key, minlength=len(alphabet) ** n))
                place = np.zeros(len(alphabet) ** n, dtype=np.int64)
                place[grams] = np.arange(len(grams))
                back = place[key]
            else:
                grams, back = np.unique(key, return_inverse=True)
            vectors = _letter_vectors(alphabet, dims)
            order = np.argsort(back, kind="stable") if len(grams) > GRAMS else None
            for at in range(0, len(grams), GRAMS):  # few grams at a time: their vectors take ``GRAMS * dims`` numbers
                some = grams[at : at + GRAMS]
                bound = np.ones((len(some), dims), dtype=np.int8)
                rest = some
                for k in range(n):  # the last letter is rotated least
                    bound *= np.roll(vectors, k, axis=1)[rest % len(alphabet)]
                    rest = rest // len(alphabet)
                if order is None:
                    _add(out, own, back, bound.astype(np.float32))
                else:
                    mine = np.sort(order[np.searchsorted(back, at, sorter=order) : np.searchsorted(back, at + len(some), sorter=order)])
                    _add(out, own[mine], back[mine] - at, bound.astype(np.float32))
        yield first, last, out, has


def _add(out: np.ndarray, own: np.ndarray, back: np.ndarray, bound: np.ndarray) -> None:
    """Adds to each row the vectors of its grams; ``own``, the row of each gram, rises."""
    grams = len(bound)
    step = max(1, (1 << 22) // grams)
    edges = np.searchsorted(own, np.arange(0, len(out) + step, step))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        block = min(step, len(out) - i * step)
        if hi > lo:
            times = np.bincount((own[lo:hi] - i * step) * grams + back[lo:hi], minlength=block * grams)
            out[i * step : i * step + block] += times.reshape(block, -1).astype(np.float32) @ bound


def profiles(labelled: DataFrame, text: str, lang: str, dims: int = 1024, n: int = 3, salts: int = 64) -> DataFrame:
    """(lang, vector): each language's prototype, from all rows with a language."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for first, last, vectors, _ in bundles(batch.column(0), dims, n):
                own = langs[first:last]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + vectors[own == name].sum(axis=0, dtype=np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].astype(np.int64).tobytes() for x in names], pa.binary())], names=["lang", "vector"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, dtype=np.int64) for v in frame["vector"]], axis=0)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "vector": [total.tobytes()]})

    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string"))
    parts = rows.mapInArrow(partial, "lang string, vector binary").withColumn("salt", F.spark_partition_id() % salts)
    return parts.groupBy("lang", "salt").applyInPandas(added, "lang string, vector binary").groupBy("lang").applyInPandas(added, "lang string, vector binary")


def predict(docs: DataFrame, text: str, prototypes: DataFrame, keep: list[Column], dims: int = 1024, n: int = 3, max_languages: int = 4096) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score`` (the cosine, 0 if negative)."""
    known = sorted(prototypes.limit(max_languages + 1).collect(), key=lambda r: r["lang"])
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages, which bounds the broadcast")
    names = [r["lang"] for r in known]
    matrix = np.array([np.frombuffer(r["vector"], dtype=np.int64) for r in known], dtype=np.float64).reshape(len(names), dims)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = source.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        pool = np.array([*names, UNKNOWN], dtype=object)
        for batch in batches:
            got, scores = [], []
            for _, _, vectors, has in bundles(batch.column(batch.num_columns - 1), dims, n):
                if names:
                    cosine = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
                    best = np.argmax(cosine, axis=1)
                    value = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
                else:
                    best, value = np.zeros(len(has), dtype=np.int64), np.zeros(len(has))
                got.append(np.where(has, best, len(names)))
                scores.append(np.where(has, value, 0.0))
            which = np.concatenate(got) if got else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(pool[which], pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                names=schema.fieldNames(),
            )

    return source.mapInArrow(label, schema)
