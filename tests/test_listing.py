"""Pages of a listing at any depth."""

from pyspark.sql import functions as F

from attestry.operators.keyed import page
from attestry.operators.listing import listed


def test_pages_are_the_slices_of_the_order(spark):
    rows = [(i, i % 7, None if i % 5 == 0 else f"n{i % 3}") for i in range(997)]
    df = spark.createDataFrame(rows, "id long, k int, position string").withColumnRenamed("position", "name").repartition(5)
    order = [F.desc("k"), F.col("name").asc_nulls_last(), F.col("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = listed(df, order)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.total == 997 and len(found.files) > 1 and sum(n for _, _, n in found.files) == 997
    for limit, offset in ((10, 0), (50, 480), (997, 0), (40, 980), (5, 997), (5, 5000), (0, 3)):
        got = sorted((r["position"], r["id"], r["total"]) for r in found.page(limit, offset).collect())
        assert got == [(i, want[i], 997) for i in range(offset, min(997, offset + limit))]
    assert [r["id"] for r in page(df, order, 20, 100).collect()] == [r["id"] for r in found.page(20, 100).orderBy("position").collect()]


def test_a_page_reads_only_the_files_that_hold_it(spark):
    found = listed(spark.range(4000).withColumn("x", F.rand(1)), [F.col("id")])
    _, first, n = found.files[len(found.files) // 2]
    assert len(found.files) > 1

    def read(df):
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        return plan.collectLeaves().head().metrics().apply("numFiles").value()

    assert read(found.page(min(5, n), first)) == 1 and read(found.positions()) == len(found.files)


def test_an_empty_table_has_empty_pages(spark):
    found = listed(spark.createDataFrame([], "id long"), [F.col("id")])
    assert found.total == 0 and found.page(10).collect() == [] and found.page(10).columns == ["id", "position", "total"]
