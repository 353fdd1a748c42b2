import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import analytics as A


@pytest.mark.parametrize("block", [3, 70, 4096])
def test_gaps_of_a_grid_match_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(A, "AXIS_BLOCK", block)
    cells = {(f"r{rng.randrange(12)}", f"c{rng.randrange(150)}") for _ in range(700)}
    rows, cols = {r for r, _ in cells} | {"bare"}, {c for _, c in cells} | {"unused"}
    one = lambda values, name: spark.createDataFrame([(v,) for v in sorted(values)], f"{name} string")
    got = A.unset_cells(spark.createDataFrame(sorted(cells), "r string, c string"), one(rows, "r"), one(cols, "c"), "r", "c").collect()
    assert sorted(map(tuple, got)) == sorted((r, c) for r in rows for c in cols if (r, c) not in cells)


def test_coverage_counts_papers_once_and_empty_input_has_no_cells(spark):
    e = spark.createDataFrame([("p", "t1", "f1"), ("p", "t1", "f1"), ("q", "t1", "f1"), ("q", "t2", "f2"), ("q", None, "f1")], "slug string, task string, family string")
    assert {tuple(r) for r in A.coverage(e).collect()} == {("t1", "f1", 2), ("t1", "f2", 0), ("t2", "f1", 0), ("t2", "f2", 1)}
    assert A.coverage(e.filter("false")).count() == A.empty_cells(e.filter(F.lit(False))).count() == 0
