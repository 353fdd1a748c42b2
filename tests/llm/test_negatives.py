"""Hard negatives against brute force over whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, at string"


def brute(rows, positives=5, wanted=5, low=80, high=100, scale=256):
    rows = [(i, [math.floor(scale * x) for x in v], k) for i, v, k in rows if v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, k) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, m) for o, (j, w, m) in enumerate(rows) if o != n]
        order = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for p, j, _ in [x for x in order if x[2] == k][:positives]:
            band = [x for x in order if x[2] != k and low * p <= 100 * x[0] <= high * p][:wanted]
            out += [(i, j, r, x[1], p, x[0]) for r, x in enumerate(band, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    got = negatives.hard_negatives(df, "vec_id", F.col("label").cast("long"), "embedding", F.col("vec_id") % 100 == 0, **how)
    return sorted(map(tuple, got.collect()), key=str)


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_ties_copies_nulls_and_ragged_vectors(spark):
    rng = random.Random(3)
    rows = [(100 * (i % 4) if i % 9 == 0 else i, f32(rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(6)), rng.randrange(3)) for i in range(120)]
    rows += [(200, f32([1.0] * 6), 1)] * 3 + [(None, f32([1.0] * 6), 1), (None, f32([0.9] * 6), 2), (7, None, 1), (8, [0.5, None, 0.1, 0.2, 0.3, 0.4], 1), (9, [float("nan")] * 6, 1),
                                              (11, [float("inf")] * 6, 2), (12, f32([0.5] * 6), None), (300, [], 0), (13, f32([0.5, 0.5]), 0), (400, f32([0.0] * 6), 2)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [3, 40])
def test_blocks_do_not_change_results(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    rows = [(int(i), f32(rng.normal(size=8)), int(rng.integers(3))) for i in range(0, 1500, 5)]
    monkeypatch.setattr(negatives, "BLOCK", block)
    assert mined(spark, rows) == brute(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == brute([(100, [1.0], 1), (1, [1.0], 1), (2, f32([0.9]), 2)])


@pytest.mark.parametrize("size", [1, 10**3, 10**9, 2**40, 2**70])
def test_packed_products_are_exact_at_any_magnitude(size):
    rng = random.Random(size)
    kind = object if size > 2**60 else np.int64
    rows = np.array([[rng.randint(-size, size) for _ in range(5)] for _ in range(2100)], dtype=kind)
    anchor = np.array([rng.randint(-size, size) for _ in range(5)], dtype=kind)
    got = negatives.Packed(rows, size).scores(anchor)
    want = [max(min(sum(int(x) * int(y) for x, y in zip(r, anchor)), 2**63 - 1), -(2**63)) for r in rows]
    assert got.tolist() == want
