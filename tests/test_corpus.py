import shutil

import pytest
from pyspark.sql import functions as F

from attestry.sources import corpus as C

INDEX = "paper_id string, title string, year int, doi string, scientific_audit_status string"
CLAIMS = "claim_id string, paper_id string, field_path string, scientific_status string, value string, extraction_status string, independent_audit string, claim_type string"


def package(spark, papers, claims, gaps=(("Sea ice?", "x"),), name="book"):
    index = spark.createDataFrame([(i, t, y, d, None) for i, t, y, d in papers], INDEX)
    records = index.select("paper_id", F.to_json(F.struct("paper_id")).alias("record_json"))
    rows = spark.createDataFrame([(c, p, f, "NOT_VERIFIED", v, m, None, "AUTHOR_REPORTED_FACT") for c, p, f, v, m in claims], CLAIMS)
    return C.Package(index, records, rows, spark.createDataFrame(list(gaps), "candidate_topic string, status string"), name, name)


PAPERS = [("P1", "One", 2001, "10.1234/a"), ("P2", "Two", 2002, None)]
ROWS = [("C1", "P1", "a.b", "1", None), ("C2", "P2", "a.b", "2", None), ("M1", "P2", "a.c", "NOT_REPORTED", "NOT_REPORTED")]


def actions(outcome):
    return {(r["entity"], r["action"]): r["n"] for r in outcome.counts.collect()}


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    out = C.import_package(C.open_corpus(spark, str(tmp_path_factory.mktemp("corpus") / "c"), 4), package(spark, PAPERS, ROWS), "r1", "t1")
    assert out.status == "imported"
    return out


@pytest.fixture
def first(spark, imported, tmp_path):
    """The outcome of the first import, with a corpus of the test's own."""
    shutil.copytree(imported.corpus.root, tmp_path / "c")
    return C.Outcome(imported.status, C.open_corpus(spark, str(tmp_path / "c")), imported.counts, imported.violations)


def test_import_then_the_same_again_changes_nothing(spark, first):
    assert actions(first) == {("papers", "created"): 2, ("claims", "created"): 2, ("markers", "created"): 1, ("gaps", "created"): 1}
    again = C.import_package(first.corpus, package(spark, PAPERS, ROWS), "r2", "t2")
    assert actions(again) == {("papers", "unchanged"): 2, ("claims", "unchanged"): 2, ("markers", "unchanged"): 1, ("gaps", "unchanged"): 1}
    assert again.corpus.parts == first.corpus.parts  # not one bucket was written
    assert C.import_package(again.corpus, package(spark, PAPERS, ROWS), "r2", "t3").status == "already_imported"
    assert [r["run_id"] for r in again.corpus.log("runs").orderBy("run_id").collect()] == ["r1", "r2"]
    assert again.corpus.log("row_versions").count() == 6


def test_a_change_writes_its_buckets_only_and_an_older_package_is_refused(spark, first):
    newer = package(spark, PAPERS, [("C1", "P1", "a.b", "9", None), *ROWS[1:]])
    out = C.import_package(first.corpus, newer, "r2", "t2")
    assert actions(out)["claims", "updated"] == 1
    assert [t for (t, _), run in out.corpus.parts.items() if run == "r2"] == ["claims"]
    row = out.corpus.table("claims").filter("claim_id = 'C1'").first()
    assert (row["import_run_id"], row["created_at"], row["updated_at"]) == ("r2", "t1", "t2") and '"value":"9"' in row["row_json"]
    older = C.import_package(out.corpus, package(spark, PAPERS, ROWS), "r3", "t3")
    assert older.status == "stale" and {r["key"] for r in older.violations.filter("rule = 'row_older_than_stored'").collect()} == {"claims:C1"}
    assert C.open_corpus(spark, out.corpus.root).seq == out.corpus.seq
    assert C.import_package(out.corpus, package(spark, PAPERS, ROWS), "r3", "t3", dry_run=True, allow_revert=True).status == "planned"
    back = C.import_package(out.corpus, package(spark, PAPERS, ROWS), "r3", "t3", allow_revert=True)
    assert actions(back)["claims", "reverted"] == 1
    assert back.violations.filter("rule = 'row_reverted'").count() == 1


def test_attested_rows_stay(spark, first):
    done = C.attest(first.corpus, spark.createDataFrame([("C1", "VERIFIED", None), ("nobody", "VERIFIED", None)], "claim_id string, scientific_status string, independent_audit string"), "a1", "t2")
    out = C.import_package(done, package(spark, PAPERS, [("C1", "P1", "a.b", "9", None), ("C2", "P2", "a.b", "8", None), ROWS[2]]), "r2", "t3")
    assert actions(out)["claims", "skipped_protected"] == 1 and actions(out)["claims", "updated"] == 1
    kept = {r["claim_id"]: r["scientific_status"] for r in out.corpus.table("claims").collect()}
    assert kept == {"C1": "VERIFIED", "C2": "NOT_VERIFIED"}
    assert [r["key"] for r in out.violations.filter("rule = 'attested_row_kept'").collect()] == ["claims:C1"]


def test_known_works_keep_their_id_and_leave_an_alias(spark, first):
    out = C.import_package(first.corpus, package(spark, [("X9", "Another title", 2009, "https://doi.org/10.1234/A")], [("C9", "X9", "a.b", "1", None)]), "r2", "t2")
    assert [tuple(r)[:3] for r in out.corpus.log("aliases").collect()] == [("X9", "P1", "doi")]
    assert {r["paper_id"] for r in out.corpus.table("papers").collect()} == {"P1", "P2"}
    assert out.corpus.table("claims").filter("claim_id = 'C9'").first()["paper_id"] == "P1"
    assert actions(out)["papers", "absent"] == 1


@pytest.mark.parametrize("papers, rows, rules", [
    (PAPERS, [("C1", "P2", "a.b", "1", None), ("C2", "P2", "a.b", "NOT_REPORTED", "NOT_REPORTED"), ("C5", "P8", "a.b", "1", None)], {"claim_identity_changed", "claim_paper_unknown"}),
    ([("P1", "One", 2001, None), ("P2", "Two", 2002, "10.1234/a"), ("P7", "x", 1, "10.1234/a")], [], {"doi_held_by_other", "doi_repeated", "paper_target_repeated"}),
])
def test_what_conflicts_is_refused_whole(spark, first, papers, rows, rules):
    out = C.import_package(first.corpus, package(spark, papers, rows), "r2", "t2")
    assert out.status == "rejected" and {r["rule"] for r in out.violations.filter("severity = 'error'").collect()} == rules
    assert C.open_corpus(spark, first.corpus.root).seq == first.corpus.seq


def test_files_without_a_manifest_row_are_invisible_and_replaced(spark, first):
    newer = package(spark, PAPERS, [("C1", "P1", "a.b", "9", None), *ROWS[1:]])
    lost = C.Corpus(spark, first.corpus.root, 4, 99, first.corpus.parts, first.corpus.logs)
    with pytest.raises(C.Conflict):  # dies after its files, before its manifest row
        C.import_package(lost, newer, "r2", "t2")
    assert '"value":"1"' in C.open_corpus(spark, first.corpus.root).table("claims").filter("claim_id = 'C1'").first()["row_json"]
    out = C.import_package(C.open_corpus(spark, first.corpus.root), newer, "r2", "t2")
    assert out.status == "imported" and out.corpus.table("claims").count() == 2
    assert first.corpus.table("claims").filter("row_json like '%\"1\"%'").count() == 1  # a reader of the first run still sees it
