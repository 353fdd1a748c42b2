import json

from attestry.sources import scans as C


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text if isinstance(text, str) else json.dumps(text))
    return str(tmp_path)


def refusals(pair):
    return sorted((r["file"], r["rule"], r["key"]) for r in pair[1].collect())


def test_an_empty_folder_is_refused_by_every_scan(spark, tmp_path):
    for scan in (C.scan_records, C.scan_golden, C.scan_predictions, C.scan_manifest):
        rows, bad = scan(spark, str(tmp_path))
        assert rows.count() == 0 and [r["rule"] for r in bad.collect()] == ["empty_set"]


def test_golden_ids_are_unique_over_files(spark, tmp_path):
    paper = lambda i: {"paper": {"id": i}, "fields": [{"path": "a.b", "family": "a", "status": "VERIFIED", "value": 1}]}
    rows, bad = C.scan_golden(spark, folder(tmp_path, one=paper("x"), two=paper("x"), three=paper("y"), four={"paper": {}}, five="{", six="null"))
    assert [(r["paper_id"], r["path"]) for r in rows.collect()] == [("y", "a.b")]
    assert refusals((rows, bad)) == [("five", "not_json", ""), ("four", "id_missing", ""), ("one", "id_repeated", "x"), ("six", "not_an_object", ""), ("two", "id_repeated", "x")]


def test_prediction_keys_at_every_level(spark, tmp_path):
    field = {"path": "a.b", "status": "NOT_REPORTED"}
    whole = lambda **k: {"schema_version": 1, "predictions": [{"paper_id": "p", "fields": [field]}], **k}
    pair = C.scan_predictions(spark, folder(
        tmp_path, ok=whole(), top=whole(model="m"), inner={"predictions": [{"paper_id": "p", "fields": [field | {"x": None}], "y": 1}]},
        twice={"predictions": [{"paper_id": "p", "fields": [field, field]}]}, bare={}))
    assert refusals(pair) == [("inner", "key_unknown", "x"), ("inner", "key_unknown", "y"), ("top", "key_unknown", "model"), ("twice", "path_repeated", "twice/p/a.b")]
    assert [(r["paper_id"], r["path"]) for r in pair[0].collect()] == [("p", "a.b")]


def test_manifest_entries(spark, tmp_path):
    pair = C.scan_manifest(spark, folder(tmp_path, a=[{"doi": "1", "status": "BLOCKED", "k": [1]}, {"doi": "2", "status": "?"}], b=[{"doi": "3", "status": "BLOCKED"}, {"doi": None, "status": "BLOCKED"}], c=[{"doi": "3", "status": "BLOCKED"}], d={}))
    assert refusals(pair) == [("a", "state_unknown", "2"), ("b", "doi_repeated", "3"), ("c", "doi_repeated", "3"), ("d", "not_a_list", "")]
    assert sorted(r["doi"] or "" for r in pair[0].collect()) == ["", "1"]


def test_ledger_run_replaces_itself_only(spark, tmp_path):
    events = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "event_id long, body string")
    root = str(tmp_path / "l")
    for run, ids in (("a", (1, 2)), ("b", (2, 3)), ("b", (2, 4)), ("c", (1, 2, 4))):
        C.append_run(events(*ids), root, run)
    got = C.ledger(spark, root, "event_id long, body string, run_id string").select("event_id", "run_id").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "a"), (4, "b")]
