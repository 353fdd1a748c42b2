"""Findings of round 4: each test fails on the code before it."""

import json
import os

from pyspark.sql import functions as F

from attestry.llm import lm
from attestry.sources import scans as C


def test_f13_golden_paths_are_unique_and_no_paper_is_lost(spark, tmp_path):
    field = {"path": "a.b", "family": "a", "status": "VERIFIED", "value": 1}
    papers = {"ok": [field], "twice": [field, field], "none": None, "text": "x", "bare": [field, {"family": "a"}, 5], "empty": []}
    for name, fields in papers.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"paper": {"id": name}, "fields": fields}))
    (tmp_path / "lost.json").write_text('{"paper": {"id": "lost"}}')
    rows, bad = C.scan_golden(spark, str(tmp_path))
    assert [(r["paper_id"], r["path"]) for r in rows.collect()] == [("ok", "a.b")]
    assert sorted((r["file"], r["rule"], r["key"]) for r in bad.collect()) == [
        ("bare", "path_missing", "bare"), ("lost", "fields_missing", "lost"), ("none", "fields_missing", "none"), ("text", "fields_missing", "text"), ("twice", "path_repeated", "twice/twice/a.b")]


def test_f1_op1_filter_stays_in_its_buckets(spark, monkeypatch):
    """The driver builds no part of the filter, and one segment answers as the whole filter does."""
    docs = spark.range(40).selectExpr("id as doc_id", "concat('w', id % 7, ' x', id % 5, ' y', id) as text")
    s = lm.Settings(bucket_bytes=64, hot_words=2)
    whole = lm.score(docs, F.lit(False), lm.Settings()).select("doc_id", "n_known", F.round("base_score", 9)).collect()
    model = lm.train(docs, "text", 8, 1 << 13, s).collect()
    held = lm.Filter(model, 8, 1 << 13, s)
    for row in model:
        keys = lm.np.frombuffer(row["keys"], dtype=lm.np.uint64)
        assert (lm.Filter([row], 8, 1 << 13, s).counts(keys) == held.counts(keys)).all() and (held.counts(keys) > 0).all()

    driver, real = os.getpid(), lm.Filter

    def watched(*a):
        assert os.getpid() != driver, "the filter was built on the driver"
        return real(*a)

    monkeypatch.setattr(lm, "Filter", watched)
    got = lm.score(docs, F.lit(False), s).select("doc_id", "n_known", F.round("base_score", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))


EXPERIMENT = "slug string, ord long, task string, family string, method string, datasets array<string>, variable string, reported array<string>, metrics array<string>"
PARSED = "question_id long, understood boolean, task array<string>, family array<string>, dataset_group array<string>, variable array<string>, method array<string>"


def moved_rows(plan):
    """Rows that the exchanges of an executed plan moved."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return moved_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return moved_rows(plan.plan())
    kids = plan.children()
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(moved_rows(kids.apply(i)) for i in range(kids.size()))


def test_f4_to_f9_what_fits_is_counted_where_it_lies(spark):
    from attestry.operators import ask as K

    e = spark.createDataFrame([("p", i, "the", f"f{i}", None, [], "v", [], []) for i in range(150)], EXPERIMENT)
    names = [f"f{k}" for k in range(150)]
    p = spark.createDataFrame([(i, True, ["the"], [*names, f"g{i}"], [], ["v"], []) for i in range(150)], PARSED)
    fits = K._fitting_shapes(p, e)[0]
    assert {r["n_experiments"] for r in fits.collect()} == {150}
    run = fits._jdf.queryExecution()
    run.toRdd().count()
    assert moved_rows(run.executedPlan()) < 3000


def test_f4_to_f9_blocks_give_what_one_block_gives(spark, monkeypatch):
    from attestry.operators import ask as K, fits

    rows = [(f"s{i % 4}", i, f"t{i % 3}" if i % 7 else None, f"f{i % 5}", f"m{i % 4}", ["ERA5", "CMIP6"][: i % 3], f"v{i % 2}", [], []) for i in range(90)]
    e = spark.createDataFrame(rows, EXPERIMENT)
    asked = [(i, True, [f"t{i % 3}", "x"][: i % 3], [f"f{i % 5}"] if i % 2 else [], ["CMIP6"] if i % 5 == 0 else [], [f"v{i % 2}"], [f"m{i % 4}"] if i % 4 else []) for i in range(30)]
    p = spark.createDataFrame(asked, PARSED).withColumns({"asks_for_results": F.lit(True), "fields": F.array(F.lit("a"), F.lit("b"))})
    values = e.select("slug", "ord", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("field")).filter("field = 'a' or ord % 2 = 0")
    whole = lambda: [sorted(map(str, df.collect())) for df in (K.match_experiments(p, e), K.training_values(p, e, values, 3).select("question_id", "field", "slug", "ord", "rank"), K.result_values(p, e, e.selectExpr("slug", "ord", "0 as pos"), None).select("question_id", "slug", "ord"))]
    one = whole()
    monkeypatch.setattr(fits, "BLOCK", 20)
    assert all(one) and whole() == one
    first = [(r["slug"], r["ord"]) for r in K.training_values(p, e, values, 3).filter("question_id = 1 and field = 'b'").orderBy("rank").collect()]
    assert first == sorted((x[0], x[1]) for x in rows if x[1] % 2 == 0 and x[2] == "t1" and (x[3] == "f1" or x[4] == "m1") and x[6] == "v1")[:3]


DOCUMENTS = ["1", "{}", "[]", '{"a": {"page_pdf": 1, "quote": "x[{"}}', '[[{"page_pdf": 2, "value": 3}], 5, {"b": [1, [true, null]]}]', '"a{["', '{"a": "\\\\", "b": [{"c": "\\"]"}]}', '{"x": {"page_pdf": "q"}, "y": [], "z": {}}',
             "null", '{"s": {"page_pdf": 4, "value": {"page_pdf": 5, "quote": "in"}}}', '{"a<b": {"c>`": [{}]}}', '{"VARIANT": [[1]]}', '{"m": [1, [2], {"k": [[3]]}]}']


def test_f2_f3_the_deepest_record_is_found_by_schemas(spark):
    from attestry.operators import walk

    nested = lambda x: 1 + max([nested(y) for y in (x.values() if isinstance(x, dict) else x)], default=0) if isinstance(x, (dict, list)) else 0
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(DOCUMENTS)], "slug string, d string").withColumn("v", F.parse_json("d"))
    for i, d in enumerate(DOCUMENTS):
        assert walk.deepest(df.filter(F.col("slug") == str(i))) == nested(json.loads(d)), d
    assert walk.deepest(df) == max(nested(json.loads(d)) for d in DOCUMENTS) and walk.deepest(df.filter("false")) == 0
    got = walk.walk_anywhere(df).select("slug", "path", F.to_json("node")).collect()
    assert sorted((r[0], r[1]) for r in got) == [("3", "a"), ("4", "[0][0]"), ("9", "s"), ("9", "s.value")]


def test_f2_f3_plain_values_make_no_rows(spark):
    from attestry.operators import walk

    one = json.dumps({"source": {f"k{i}": i for i in range(200)}, "r": [{"page_pdf": 1, "quote": "q", **{f"t{i}": "x" for i in range(200)}}]})
    df = spark.createDataFrame([("a", one)], "slug string, d string").withColumn("v", F.parse_json("d"))
    run = walk.walk_anywhere(df)._jdf.queryExecution()
    assert run.toRdd().count() == 1

    def rows(plan):
        name, kids = plan.getClass().getSimpleName(), plan.children()
        if name == "AdaptiveSparkPlanExec":
            return rows(plan.executedPlan())
        own = plan.metrics().apply("numOutputRows").value() if name == "GenerateExec" else 0
        return own + sum(rows(kids.apply(i)) for i in range(kids.size()))

    assert rows(run.executedPlan()) < 30
