"""What the findings of round 3 named: what plans move, and the same results as SQL."""

import pytest  # noqa: F401

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def broadcast_parts(df):
    """The plans below each broadcast, as text."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [line]
            for other in lines[i + 1:]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            out.append("\n".join(below))
    return out


def test_f1_mentions_are_not_broadcast(spark):
    df = entry.queries()["entity_evidence"](spark, SF)
    assert [p for p in broadcast_parts(df) if "Generate" in p] == []


def test_f1_an_entity_that_nobody_mentions_stays(spark):
    from attestry.operators import research as R

    m = spark.createDataFrame([("DOMAIN", "a", "m1", "p1", "f", None, [{"page": 2}])], "entity_type string, normalized_key string, mention_id string, paper_id string, field_path string, alternative_index int, evidence array<struct<page:int>>")
    e = spark.createDataFrame([("DOMAIN", "a", "A", "1"), ("DOMAIN", "b", "B", "2")], "entity_type string, normalized_key string, canonical_name string, entity_id string")
    rows = R.entity_mentions(e, m).select("normalized_key", "entity_id", "mention_id", "page").collect()
    assert sorted(tuple(r) for r in rows) == [("a", "1", "m1", 2), ("b", "2", None, None)]


def test_f2_papers_of_entities_are_not_broadcast(spark):
    df = entry.queries()["entity_gather"](spark, SF)
    assert [p for p in broadcast_parts(df) if "Generate" in p] == []


def moved_bytes(plan):
    """Bytes that the exchanges of an executed plan moved."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return moved_bytes(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return moved_bytes(plan.plan())
    children = plan.children()
    own = plan.metrics().apply("dataSize").value() if "Exchange" in name else 0
    return own + sum(moved_bytes(children.apply(i)) for i in range(children.size()))


EXPERIMENT = "slug string, ord long, task string, family string, method string, datasets array<string>, variable string, reported array<string>, metrics array<string>"
PARSED = "question_id long, understood boolean, task array<string>, family array<string>, dataset_group array<string>, variable array<string>, method array<string>"


def test_f3_to_f8_filters_do_not_move_once_for_each_name(spark):
    from attestry.operators import ask as K

    e = spark.createDataFrame([("p", i, "the", f"f{i}", None, [], "v", [], []) for i in range(150)], EXPERIMENT)
    p = spark.createDataFrame([(i, True, ["the", *(f"t{i}_{k}" for k in range(40))], [f"f{i}", *(f"g{i}_{k}" for k in range(40))], [], ["v", *(f"v{i}_{k}" for k in range(40))], []) for i in range(150)], PARSED)
    run = K._fitting_shapes(p, e)[0]._jdf.queryExecution()
    assert run.toRdd().count() == 150
    assert moved_bytes(run.executedPlan()) < 1 << 20


def test_f3_to_f8_filters_fit_as_by_brute_force(spark):
    import random

    from attestry.functions.rules import dataset_group
    from attestry.operators import ask as K
    from pyspark.sql import functions as F

    rng = random.Random(3)
    some = lambda names, most: rng.sample(names, rng.randrange(most + 1))
    names = {k: [f"{k[0]}{i}" for i in range(4)] for k in ("task", "family", "variable", "method")}
    sets = ["ERA5 hourly", "CMIP6 runs", "other set"]
    rows = [(f"s{i % 3}", i, *(rng.choice([*names[k], None]) for k in ("task", "family", "method")), some(sets, 3), rng.choice([*names["variable"], None]), [], ["M"]) for i in range(120)]
    e = spark.createDataFrame(rows, EXPERIMENT)
    groups = {r.ord: set(g for g in r.g if g) for r in e.select("ord", F.transform("datasets", lambda d: dataset_group(d)).alias("g")).collect()}
    every = sorted(set().union(*groups.values()))
    asked = [(i, True, some(names["task"], 3), some(names["family"], 2), some(every, 2) if i % 3 == 0 else [], some(names["variable"], 3), some(names["method"], 2)) for i in range(80)]
    asked += [(100 + i, True, [], [], g, [], []) for i, g in enumerate([every, every[:1], every[-1:], []])]
    p = spark.createDataFrame(asked, PARSED)
    found = K._signature(p).join(K.match_experiments(p, e), "signature").groupBy("question_id").agg(F.sum("n_experiments").alias("n")).collect()
    fits = lambda q, x: ((not q[2] or x[2] in q[2]) and (not (q[3] or q[6]) or x[3] in q[3] or x[4] in q[6]) and (not q[4] or bool(groups[x[1]] & set(q[4]))) and (not q[5] or x[6] in q[5]))
    want = {q[0]: n for q in asked if (n := sum(fits(q, x) for x in rows))}
    assert len(every) > 1 and {r.question_id: r.n for r in found} == want


def test_f6_limitations_of_papers_in_order_reach_the_limit(spark):
    from attestry.operators import ask as K
    from pyspark.sql import functions as F

    e = spark.createDataFrame([(s, i, "t", "f", None, [], "v", [], []) for i, s in enumerate("abcd")], EXPERIMENT)
    p = spark.createDataFrame([(i, True, ["t"], [], [], [], []) for i in range(2)], PARSED).withColumns({"asks_for_limitations": F.lit(True), "themes": F.when(F.col("question_id") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("X")))})
    li = spark.createDataFrame([(s, i, "X" if i % 3 else "Y", 1) for s in "abcd" for i in range(4)], "slug string, pos long, theme string, page int")
    got = K.limitation_values(p, e, li, 7).orderBy("question_id", "rank").collect()
    every = [(s, i) for s in "abcd" for i in range(4)]
    assert [(r.slug, r.pos) for r in got if r.question_id == 0] == every[:7]
    assert [(r.slug, r.pos) for r in got if r.question_id == 1] == [x for x in every if x[1] % 3][:7]


def joined_columns(df):
    """The names of the columns that enter each join of two growing sides."""
    out = []

    def walk(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            out.extend(k.output().apply(i).name() for k in kids for i in range(k.output().size()))
        for k in kids:
            walk(k)

    walk(df._jdf.queryExecution().optimizedPlan())
    return set(out)


def test_f19_f22_f34_values_and_evidence_stay_where_they_are(spark):
    for name in ("landing_drilldown", "landing_samples", "landing_totals"):
        columns = joined_columns(entry.queries()[name](spark, SF))
        assert "paper_id" in columns and not columns & {"sources", "value_json", "conflict_values"}


def test_f22_first_of_few_is_first_n(spark):
    from attestry.operators.keyed import first_n, first_of_few
    from pyspark.sql import functions as F

    df = spark.range(400).selectExpr("if(id % 5 = 0, null, id % 5) as k", "if(id % 7 = 0, null, (id * 37) % 101) as a", "id as b")
    for n, buckets in ((1, 1), (3, 2), (9, 4), (25, 1024), (500, 8)):
        few = first_of_few(df, ["k"], ["a", "b"], n, total="t", buckets=buckets).collect()
        assert {r["t"] for r in few} == {80}
        assert sorted(map(str, (tuple(r)[:4] for r in few))) == sorted(map(str, (tuple(r) for r in first_n(df, ["k"], [F.col("a"), F.col("b")], n).collect())))


def test_f36_an_outline_reads_the_records_once(spark):
    from attestry.operators import walk

    df = entry.queries()["record_outline"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    r = spark.sql("""select 'a' as slug, parse_json('{"methods": [{"canonical_name": "M"}, {"canonical_name": "M"}, {"role": "r"}], "conflicts": 3}') as v union all select 'b', parse_json('{"methods": [{"canonical_name": "N"}]}')""")
    rows = walk.outline(r, (("methods", "canonical_name"), ("conflicts", "field"))).collect()
    assert [tuple(x) for x in rows] == [("methods", 4, 2), ("conflicts", 0, 0)]
    assert [tuple(x) for x in walk.outline(r.filter("slug = 'c'"), (("datasets", "canonical_name"),)).collect()] == [("datasets", 0, 0)]


def test_rows_of_one_row_group_are_dealt_though_there_are_many_splits(spark, tmp_path):
    """splits are cut by bytes, but one of them holds all rows of a row group."""
    from pyspark.sql import functions as F

    from attestry.session import spread

    path = str(tmp_path / "one")
    spark.range(20000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = spread(scan, most=500).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 40 and max(r["count"] for r in sizes) < 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rules_are_listed_without_a_higher_order_function(spark):
    """one such function around the list keeps Spark from compiling every rule in it."""
    from pyspark.sql import functions as F

    from attestry.operators.validate import row_rules

    rows = spark.createDataFrame([(1, ["a"], 5), (2, [], 5), (3, None, None)], "k int, xs array<string>, n int")
    out = row_rules(rows, "E", F.col("k"), [("none", ~F.exists("xs", lambda x: x == "a"), "m"), ("big", F.col("n") > 4, "")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    listed = [line for line in plan.splitlines() if "Generate explode" in line]
    assert listed and not any("lambda" in line for line in listed)
    assert sorted(map(tuple, out.select("rule", "key", "message").collect())) == [("big", "1", ""), ("big", "2", ""), ("none", "2", "m")]


def test_field_counts_of_papers_come_from_one_pass(spark):
    """fields, their mentions, papers and relations are read once each."""
    plan = entry.queries()["research_view"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4


def test_field_counts_equal_the_rows_they_count(spark):
    """empty lists, text that is no list, silent fields and conflicts with and without alternatives."""
    from pyspark.sql import functions as F

    from attestry.functions import evidence as E
    from attestry.operators import research as R

    cases = [("results.a", "[1, 2, 3]", [], "VERIFIED"), ("results.b", "[]", [], "VERIFIED"), ("results.c", "[1,", [], "VERIFIED"), ("results.d", None, [], "NOT_REPORTED"), ("results.e", None, ["1", "2"], "CONFLICT"),
             ("limitations.a", None, [], "CONFLICT"), ("limitations.b", None, None, "CONFLICT"), ("limitations.c", '"x"', [], None), ("training.a", "1", [], "VERIFIED"), (None, "[1]", [], "VERIFIED")]
    rows = [(paper, 0, *case) for paper, own in ((1, cases), (2, cases[8:]), (None, cases[:3]), *((10 + i, [c]) for i, c in enumerate(cases))) for case in own]
    states = spark.createDataFrame(rows, "paper_id long, edition_id long, field_path string, value_json string, conflict_values array<string>, status string").withColumns(
        {"provenance_type": F.lit("AUTHOR_REPORTED_FACT"), "sources": F.array().cast(f"array<{E.SOURCE}>")})
    none = spark.createDataFrame([], "paper_id long")
    got = R.research_view(states, none, none, none)
    parts = {"field_states": states, "hyperparameters": R.hyperparameters(states), "results": R.typed_rows(states, "results"), "statements": R.statements(states)}
    want = {(r["paper_id"], part, r["count"]) for part, df in parts.items() for r in df.groupBy("paper_id").count().collect()}
    assert {tuple(r) for r in got.collect()} == want
