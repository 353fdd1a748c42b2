from pyspark.sql import functions as F

from attestry.operators import staging as G
from attestry.operators import states as T
from attestry.sources import sheets, sinks


def test_upsert_tests_apply_in_order(spark):
    incoming = spark.createDataFrame([("new", "a"), ("same", "a"), ("prot", "old"), ("back", "old"), ("upd", "b")], "key string, fingerprint string")
    stored = spark.createDataFrame([("same", "a", False), ("prot", "x", True), ("back", "x", False), ("upd", "x", False), ("gone", "x", False)], "key string, fingerprint string, protected boolean")
    versions = spark.createDataFrame([("back", "old"), ("prot", "old")], "key string, fingerprint string")
    plan = lambda **k: {r.key: r.action for r in G.plan_upsert(incoming, stored, versions, **k).collect()}
    want = {"new": "created", "same": "unchanged", "prot": "skipped_protected", "back": "stale", "upd": "updated", "gone": "absent"}
    assert plan() == want and plan(allow_revert=True) == {**want, "back": "reverted"}


def test_reimport_changes_nothing_and_keeps_birth(spark):
    incoming = spark.createDataFrame([("a", "1", False, "t2"), ("b", "2", False, "t2")], "key string, fingerprint string, protected boolean, created_at string")
    stored = spark.createDataFrame([("a", "0", False, "t1"), ("z", "9", False, "t1")], "key string, fingerprint string, protected boolean, created_at string")
    none = incoming.select("key", "fingerprint").filter("false")
    once = G.apply_upsert(incoming, stored, G.plan_upsert(incoming, stored, none))
    assert {(r.key, r.fingerprint, r.created_at) for r in once.collect()} == {("a", "1", "t1"), ("b", "2", "t2"), ("z", "9", "t1")}
    assert {r.action for r in G.plan_upsert(incoming, once, none).collect()} == {"unchanged", "absent"}


def test_title_never_merges_two_dois(spark):
    cols = "paper_id string, doi_key string, title_key string, year string"
    stored = spark.createDataFrame([("P1", "10.1/a", "sea", "2020"), ("P2", None, "ice", None)], cols)
    incoming = spark.createDataFrame([("X1", "10.1/b", "sea", "2020"), ("X2", None, "sea", "2020"), ("X3", "10.1/c", "ice", None), ("X4", "10.1/a", "other", "1"), ("P1", None, "x", "1"), ("A", None, "q", "1")], cols)
    aliases = spark.createDataFrame([("A", "P2")], "alias_id string, paper_id string")
    got = {r.paper_id: (r.target_id, r.matched_on) for r in G.resolve_papers(incoming, stored, aliases).collect()}
    assert got == {"X1": ("X1", None), "X2": ("P1", "title_year"), "X3": ("P2", "title_year"), "X4": ("P1", "doi"), "P1": ("P1", "paper_id"), "A": ("P2", "alias")}


def test_supplement_counting_conventions(spark):
    claims = spark.createDataFrame([("p1", None, "B04"), ("p1", "NOT_REPORTED", "B03"), ("p2", "NOT_EXTRACTED", "B08")], "paper_id string, extraction_status string, batch_id string")
    index = spark.createDataFrame([("p1",), ("p2",)], "paper_id string")
    coverage = spark.createDataFrame([("p1", "DETAILED"), ("p2", "INDEX_ONLY")], "paper_id string, coverage_level string")

    def rules(**declared):
        start = spark.createDataFrame([(k.replace("_", " "), str(v)) for k, v in declared.items()], "label string, text string")
        return {(r.rule, r.severity) for r in G.supplement_totals(start, claims, index, coverage, index.filter("false")).collect()}

    assert rules(Papers_indexed=2, Claims_total=3) == set()
    assert ("declared_count", "error") in rules(Papers_indexed=2, Claims_total=4)
    assert ("totals_undeclared", "error") in rules(Papers_indexed=2)
    assert ("totals_do_not_add_up", "error") in rules(Papers_indexed=2, Claims_total=3, Claims_before=1, Claims_added=1)
    traded = spark.createDataFrame([("Papers indexed", "2"), ("Claims total", "3"), ("Lignes extraites / historiques", "2"), ("Champs manquants hérités", "1")], "label string, text string")
    assert {(r.rule, r.severity) for r in G.supplement_totals(traded, claims, index, coverage, index.filter("false")).collect()} == {("markers_counted_as_rows", "warn")}


def test_optional_columns_do_not_change_a_fingerprint(spark):
    row = spark.createDataFrame([("c", "v")], "claim_id string, value string")
    wide = row.withColumn("unit", F.lit(None).cast("string"))
    assert row.select(G.claim_row_fingerprint(row)).first()[0] == wide.select(G.claim_row_fingerprint(wide)).first()[0]


def test_field_status_keeps_absence_and_claim_side_by_side(spark):
    claims = spark.createDataFrame([("p", "a", "NOT_VERIFIED")], "paper_id string, field_path string, scientific_status string")
    markers = spark.createDataFrame([("p", "a", "NOT_VERIFIED", "NOT_REPORTED"), ("p", "b", "NOT_VERIFIED", "NOT_EXTRACTED"), ("p", "c", "CONFLICT", "NOT_EXTRACTED")], "paper_id string, field_path string, scientific_status string, extraction_status string")
    contract = spark.createDataFrame([("a",), ("b",), ("d",)], "field_path string")
    out = T.field_statuses(claims, markers, contract)
    assert {r.field_path: (r.status, r.contracted) for r in out.collect()} == {"a": ("NOT_REPORTED_CANDIDATE|NOT_VERIFIED", True), "b": ("NOT_EXTRACTED", True), "c": ("CONFLICT", False)}
    assert tuple(T.field_totals(out, claims.select("paper_id"), contract).first()) == ("p", 1, 2)


def test_unpublished_runs_stay_invisible(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3)
    sinks.publish_snapshot(spark, {"t": df}, root, "r1", "2025-01-01")
    df.write.parquet(f"{root}/r2/t")
    assert sinks.read_snapshot(spark, root, "t").count() == 3
    sinks.publish_snapshot(spark, {"t": spark.range(5)}, root, "r3", "2025-01-02")
    assert sinks.read_snapshot(spark, root, "t").count() == 5


def test_sheet_headers(spark, tmp_path):
    path = tmp_path / "COVERAGE.csv"
    path.write_text('paper_id,claim_count, ,paper_id\n" P1 ",3,x,y\n"  ",,,\nP2,"a ""q"", b",,\n')
    issues = {(r.rule, r.key) for r in sheets.header_issues(spark, "COVERAGE", str(path)).collect()}
    assert issues == {("column_repeated", "paper_id"), ("column_missing", "coverage_level"), ("column_missing", "audit_state")}
    assert {tuple(r) for r in sheets.read_sheet(spark, str(path)).collect()} == {("P1", "3"), ("P2", 'a "q", b')}
