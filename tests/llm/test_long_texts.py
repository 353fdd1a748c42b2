"""Texts of many megabytes and matches: bounded memory, no square growth."""

import random
import resource
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import langid, secret_scan


@pytest.mark.parametrize("grams", [7, 8192])
def test_bundles_do_not_depend_on_the_block(monkeypatch, grams):
    texts = pa.array(["the cat sat", None, "", "zażółć gęślą jaźń " * 40, "天地玄黃 宇宙洪荒", "a", "12"])
    want = [v.copy() for _, _, v, _ in langid.bundles(texts, 256, 3)]
    monkeypatch.setattr(langid, "GRAMS", grams)
    got = [v for _, _, v, _ in langid.bundles(texts, 256, 3)]
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_a_long_text_of_many_letters_takes_bounded_memory():
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1_500_000))  # 4.5 MB, nearly every trigram once
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _, _, vectors, has in langid.bundles(pa.array([text]), 1024, 3):
        assert has.all() and np.isfinite(vectors).all()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 900  # MB; all vectors at once would take 7,000


def test_many_matches_in_one_text(spark):
    n = 20_000
    token = lambda i: f"Tok{i:05d}abcdefGHIJKLMN"
    text = " ".join(f"password={i:06d} x {token(i)}" for i in range(n))
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    begun = time.time()
    row = secret_scan.candidates(df, F.col("doc_id"), F.col("source")).select(F.size("base").alias("b"), F.size("other").alias("o"), F.element_at("base", -1).alias("last"), F.element_at("other", -1).alias("end")).first()
    assert (row["b"], row["o"]) == (n, n) and time.time() - begun < 60
    assert text[row["last"]["start"] : row["last"]["end"]] == f"password={n - 1:06d}" and text[row["end"]["start"] : row["end"]["end"]] == token(n - 1)
