"""Importance resampling and its radix sort against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestry.llm import resample

DOCS = "doc_id long, text string, score long, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, own = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(spark, docs, target, **how):
    d = spark.createDataFrame([(*r, 5, "clash") for r in docs], DOCS)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted(map(tuple, resample.resampled(d, t, **how).collect()), key=str)


@pytest.mark.parametrize("longest, block", [(1, 1 << 18), (3, 7)])
def test_draw_matches_brute_force(spark, longest, block):
    rng = random.Random(8)
    vocabulary = ["Apfel", "straße", "the", "of", "x1", "中文", "İ", "naïve", "A_b", "tab\tbed", "o'clock"]
    docs = [(rng.choice([i, -i, 10**12 + i]), " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(120)]
    docs += [(5, "same " * 30)] * 4 + [(None, "same " * 30), (None, None), (3, None), (4, ""), (6, "-- !!"), (2**63 - 1, "the " * 25), (-(2**63), "the " * 25), (8, "long " * 200_000)]
    target = ["the of the", None, "", "straße 中文 x1"]
    assert drawn(spark, docs, target, longest=longest, block=block, percent=40) == brute(docs, target, longest=longest, percent=40)


def test_empty_tables(spark):
    assert drawn(spark, [], ["a b"]) == []
    docs = [(1, "word " * 30), (2, "other " * 30)]
    assert drawn(spark, docs, [], percent=100) == brute(docs, [], percent=100)


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_radix_sort_orders_unsigned_keys(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([0, 1, 2**40 + rng.randrange(5), -1, -(2**63)]), rng.randrange(-(2**63), 2**63), i) for i in range(60)] + [(0, 0, 99)] * 5
    df = spark.createDataFrame(rows, "a long, b long, name long").repartition(3)
    got = sorted((r["position"], r["a"], r["b"]) for r in resample.radix_ranked(df, ["a", "b"], block).collect())
    unsigned = lambda x: x % 2**64
    assert [g[0] for g in got] == list(range(len(rows)))
    assert [g[1:] for g in got] == sorted(((a, b) for a, b, _ in rows), key=lambda r: (unsigned(r[0]), unsigned(r[1])))


def test_rows_without_a_difference_get_dense_positions(spark):
    df = spark.range(50).select(F.lit(7).cast("long").alias("a"))
    assert sorted(r["position"] for r in resample.radix_ranked(df, ["a"], 4).collect()) == list(range(50))
