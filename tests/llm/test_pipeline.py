"""The corpus pipeline, stage by stage and as a whole."""

import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from attestry.llm import mix
from test_llm import brute_groups, feistel, simulated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from attestry.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", None, None), (9002, "12 !!", "en", "s", 1), (None, "a text without an id", "en", "src1", 2), (9004, "one row twice in here", "en", "src2", 1),
                                 (9004, "one row twice in here", "en", "src2", 1)], docs.schema)
    frames = [docs.unionByName(odd).withColumn("position", F.lit(0)).withColumn("key", F.lit("k"))]
    for name, stage in cp.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF), f"test-{name}"))
    return frames


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert all(f.columns == cp.COLUMNS for f in stages[1:-1])
    assert set(cp.COLUMNS) <= set(stages[-1].columns)


def test_language_stage_drops_what_has_no_letter(stages):
    assert sorted(map(str, rows(stages[1]))) == sorted(str(x) for x in rows(stages[0]) if any(c.isalpha() for c in x[1] or ""))


def test_dedup_stage_keeps_one_of_each_group(stages):
    groups = brute_groups(rows(stages[1]))
    assert sorted(i for i, _ in rows(stages[2]) if i is not None) == sorted(set(groups.values()))
    assert sum(i is None for i, _ in rows(stages[2])) == 1


def test_dedup_stage_keeps_the_texts_of_repeated_and_missing_ids(spark):
    old = "the miller kept an old wheel turning through the winter while the river froze around the stones below"
    other = "nobody in the harbour could say why the red boats came home a day before the storm was seen at sea"
    near = old + " again"
    third = "a quiet orchard on the southern slope gave more plums that year than all the farms of the valley together"
    rows_ = [(5, old), (5, other), (5, other), (7, other), (8, near), (None, third), (None, third), (None, old), (9, third + " they said"), (None, "one more text of its own without any copy anywhere"), (11, None), (12, None), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows_)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = sorted(rows(cp.drop_near_duplicates(spark, docs, SF)), key=str)
    texts = {text for _, text in got}
    # one of each group: {5 old, 8, null old}, {5 other or 7}, {9, null third}, the text of its own, and the empty ones
    assert len(got) == 6 and (9, third + " they said") in got and (11, None) in got and (12, None) in got
    assert {old, other} <= texts or {near, other} <= texts
    assert sum(i is None for i, _ in got) == 1


def test_mixing_stage_places_many_equal_rows(spark):
    docs = spark.createDataFrame([(None, "same", "en", "src0", 4)] * 300 + [(1, "b", "en", "src1", 1), (1, "b", "en", "src1", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    out = cp.mix_sources(spark, docs, SF).collect()
    assert len(out) == 302 and sum(r["doc_id"] == 1 for r in out) == 2


def test_decontamination_stage_drops_verbatim_text_with_an_altered_value(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) >= 40).rstrip(". ")
    words = item.split()
    held = " ".join([*words[:18], "12", *words[18:22], "12", *words[22:]])
    altered = " ".join([*words[:18], "12", *words[18:22], "13", *words[22:]])
    docs = spark.createDataFrame([(1, altered, "en", "s", 1), (2, "a text of its own", "en", "s", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(1, held)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert [r["doc_id"] for r in cp.decontaminate(spark, docs, at).collect()] == [2]


def test_mixing_stage_writes_the_order(spark, stages):
    from attestry.llm.shard import numbered_by_file

    ordered = sorted(numbered_by_file(stages[4]).collect(), key=lambda r: r["row_number"])
    assert [r["row_number"] for r in ordered] == list(range(stages[3].count()))
    names = list(cp.TARGETS)
    pool = lambda s: s if s in cp.TARGETS else mix.OTHERS
    counts = dict.fromkeys(names, 0)
    for r in ordered:
        counts[pool(r["source"])] += 1
    want = [s for s in simulated({s: -(-n // 64) for s, n in counts.items()}, cp.TARGETS)]
    got, left = [], dict(counts)
    at = 0
    while at < len(ordered):
        s = pool(ordered[at]["source"])
        n = min(64, left[s])
        assert {pool(r["source"]) for r in ordered[at : at + n]} == {s}
        got.append(s)
        left[s] -= n
        at += n
    assert got == want


def test_sharding_stage_permutes_the_mixed_order(stages):
    total = stages[4].count()
    for r in stages[5].collect():
        p = feistel(r["row_number"], total, cp.SEED)
        assert (r["shard"], r["slot"]) == (p % cp.SHARDS, p // cp.SHARDS)
    assert stages[5].count() == total


def test_run_is_the_stages(spark):
    out = cp.run(spark, SF)
    assert out.count() == out.select("shard", "slot").distinct().count() > 0
