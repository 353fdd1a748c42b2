import random

from pyspark.sql import functions as F

from attestry.operators import gate as G
from attestry.operators.keyed import exact_median, previous_row

WORDS = "alpha beta gamma delta sea ice wave model data set the of in on a".split()


def brute(needles, pages):
    return {(n, p) for n in set(needles) if n for p, text in pages if n in text}


def test_occurrences_equal_brute_force_with_hot_copies(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(n))
    pages = [(i, text(60)) for i in range(60)]
    hot = text(80)
    pages += [(i, hot) for i in range(60, 100)]  # a third and more are copies
    pages.append((100, ""))
    needles = []
    for _, t in pages[:70]:
        if t:
            a = rng.randrange(len(t) - 40)
            needles += [t[a:a + rng.choice([1, 3, 5, 9, 17, 33])].strip(), t[a:a + 30].strip() + "zz"]
    needles += [hot[5:50]] * 50 + ["lph", "a b", "ve mo", "nowhere to be found at all here", ""]
    got = G.find_occurrences(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(pages, "page int, page_norm string").repartition(7), ["page"])
    rows = [(r.needle, r.page) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(needles, pages)


def test_report_counts_copies_and_empty_needles(spark):
    quotes = spark.createDataFrame([(1, "Sea ice"), (2, "…"), (3, "absent thing")], "q int, text string")
    pages = spark.createDataFrame([(7, "the sea ice."), (8, "the sea ice."), (9, "other")], "p int, text string")
    assert {tuple(r) for r in G.quote_report(quotes, pages, "q", "p").collect()} == {(1, 2, 7), (2, 3, 7), (3, 0, -1)}


def test_gate_cases(spark):
    pages = spark.createDataFrame([("f", 1, "Intro. The para-\nmeter is ﬁxed at −2.5."), ("f", 2, "Second page with the learning rate 0.50"), ("f", 3, ""), ("g", 1, "para- meter")], "source_file string, page int, text string")
    rows = [
        ("r", "a", "f", 1, 1, 0, "parameter is fixed", '"fixed"'), ("r", "b", "f", 2, 4, 1, "learning rate 0.50", "0.5"), ("r", "c", "f", 1, None, 0, "learning rate", '"x"'),
        ("r", "d", "f", 9, None, 0, "nothing like it", '"x"'), ("r", "e", "f", 3, None, 0, "—", "null"), ("r", "f", "f", 9, None, 0, "—", "null"), ("r", "g", "f", 2, None, 0, "learning rate", "7"),
    ]
    q = spark.createDataFrame(rows, "slug string, path string, source_file string, page_pdf int, page_printed int, page_offset int, quote string, v string").withColumn("value", F.parse_json("v"))
    out = {r.path: r for r in G.gate_report(q, pages).collect()}
    assert [out[p].located for p in "abcdefg"] == [True, True, False, False, True, False, True]
    assert (out["c"].found_on, out["c"].first_found) == (1, 2) and out["d"].found_on == 0 and out["f"].found_on == 3
    assert out["b"].pagination_warning and not out["a"].pagination_warning
    assert out["g"].support_warning and not out["b"].support_warning and not out["c"].support_warning
    s = G.gate_summary(G.gate_report(q, pages)).first()
    assert (s.checked, s.located, s.support_warnings, s.ok) == (7, 4, 1, False)


def test_previous_row_is_independent_of_blocks_and_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randrange(50), i, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at int, id int, v string").repartition(5)
    want, last = {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = last.get(k)
        last[k] = v
    for width in (1, 7, 100):
        got = previous_row(df, ["k"], ["at", "id"], ["v"], F.floor(F.col("at") / width))
        assert {r.id: r.previous_v for r in got.collect()} == want


def test_median_is_exact_for_large_skewed_groups(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.randrange(1000)) if rng.random() < 0.5 else 7.0) for _ in range(9000)] + [("odd", 3.0), ("odd", 1.0), ("odd", 2.0), ("even", 1.0), ("even", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.median_value) for r in exact_median(df, ["k"], "v", accuracy=200).collect()}
    import statistics

    want = {}
    for k in ("hot", "odd", "even"):
        vs = [v for kk, v in rows if kk == k]
        want[k] = (len(vs), statistics.median(vs))
    assert got == want
