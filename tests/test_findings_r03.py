"""What the findings of round 3 named, on small tables of their own."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestry.functions import numbers as N
from parity import TABLES, compare

SF = "/root/testdata/sf0.001"


def against_sql(spark, folder, name, **changed):
    """Compares a query with its SQL where some tables are replaced by the given frames."""
    con = duckdb.connect()
    for t in TABLES:
        source = spark.read.parquet(f"{SF}/{t}.parquet") if t not in changed else changed[t]
        source.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    text, ok, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(folder))
    assert ok, text


def test_f17_six_digits_round_by_the_exact_value(spark):
    rng = random.Random(7)
    texts = ["5551225", "5551235", "12345.25", "0.1234565", "9584625", "8.373485e6", "-2.000005", "1e999", "0", "9999995", "1234565e20", "1.234565e-20", "1.234565e250", "7.654325e-120"]
    texts += [f"{rng.randrange(10**5, 10**6)}5e{rng.randrange(-200, 200)}" for _ in range(3000)] + [f"{rng.randrange(10**5, 10**6)}5e{rng.randrange(-20, 12)}" for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.six_digits(F.col("t").cast("double")).alias("s")).collect()
    assert [(r.t, r.s) for r in rows if r.s != f"{float(r.t):.5e}".replace("inf", "Infinity")] == []


def test_f16_pages_that_share_a_url_stay_rows_of_their_own(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60)
    again = pages.withColumns({"page_id": F.col("page_id") + 100003, "html": F.concat(F.lit("copyright issn "), "html")})
    against_sql(spark, tmp_path, "edition_evidence_check", pages=pages.unionByName(again))


def test_f18_a_path_is_repeated_where_both_fields_break_a_rule(spark, tmp_path):
    labels = spark.createDataFrame([(330, 1, 0), (660, 0, 1), (66, 1, 1), (7, 1, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents = documents.limit(1).drop("doc_id").crossJoin(labels.select("doc_id")).select(documents.columns)
    against_sql(spark, tmp_path, "prediction_rules", labels=labels, documents=documents)


def test_f13_the_walk_knows_how_deep_records_are(spark):
    from attestry.operators import walk as W

    deep = '{"page_pdf":1,"quote":"}]{[ \\" {{","n":[{"page_pdf":2,"value":1}]}'
    for _ in range(9):
        deep = f'{{"a":[{deep}]}}'
    rows = spark.createDataFrame([("plain", "1"), ("none", "{}"), ("text", '"[[{"'), ("deep", deep)], "slug string, doc string").withColumn("v", F.parse_json("doc"))
    assert {r.slug: r.d for r in rows.select("slug", W.depth(F.col("v")).alias("d")).collect()} == {"plain": 0, "none": 1, "text": 0, "deep": 21}
    found = W.walk_anywhere(rows, levels=4).select("slug", "path").collect()
    start = ".".join(["a[0]"] * 9)
    assert sorted(tuple(r) for r in found) == [("deep", start), ("deep", f"{start}.n[0]")]


def test_f9_to_f12_a_scan_opens_its_files_once(spark, tmp_path):
    from attestry.sources import scans as C

    place = tmp_path / "in"
    place.mkdir()
    for name, text in (("a", '{"paper": {}}'), ("b", "{"), ("c", '{"slug": "x"}')):
        (place / f"{name}.json").write_text(text)
    rows, refusals = C.scan_records(spark, str(place))
    place.rename(tmp_path / "away")
    assert [r.slug for r in rows.collect()] == ["a"]
    assert sorted((r.file, r.rule) for r in refusals.collect()) == [("b", "not_json"), ("c", "other_slug")]
