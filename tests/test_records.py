import json

import pytest
from pyspark.sql import functions as F

from attestry.operators import ledger as L
from attestry.operators import research as S
from attestry.operators import walk as W
from attestry.sources import records as R

RECORD = {
    "source": {"file": "a.pdf", "edition": "PREPRINT", "edition_evidence": {"page_pdf": 1, "quote": "arXiv"}}, "paper": {"title": "T", "year": 2020},
    "methods": [{"method_id": "m", "canonical_name": "Net", "family": "GNN", "evidence": [{"page_pdf": 2, "quote": "a net"}]}],
    "experiments": [{"experiment_id": "e", "task": "T1", "method_id": "m", "training": {
        "note": "text", "lr": {"value": 0.1, "page_pdf": 3, "quote": ""}, "seed": {"value": None, "page_pdf": 3}, "loss": {"value": ["a", "b"], "page_pdf": 3, "quote": "a b", "extra_evidence": [{"claim": "x", "page_pdf": 4, "quote": "xx"}]}}}],
    "results": [{"experiment_id": "e", "metric": "RMSE", "value": 1, "page_pdf": 5, "page_printed": 0, "quote": "one"}, {"metric": "MAE", "value": 2.0, "page_pdf": None, "quote": "no page"}],
    "excluded": None,
}


def load(spark, *docs):
    rows = [(f"s{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return R.parse_records(spark.createDataFrame(rows, "slug string, doc string"), "doc")


def test_claims_cover_exactly_the_evidenced_nodes(spark):
    out = {r.path: r for r in W.claims(load(spark, RECORD)).collect()}
    assert set(out) == {"methods[0].evidence[0]", "experiments[0].training.lr", "experiments[0].training.loss", "experiments[0].training.loss.extra_evidence[0]", "results[0]"}
    lr, loss, result = out["experiments[0].training.lr"], out["experiments[0].training.loss"], out["results[0]"]
    assert lr.evidence_status == "VALUE_READ_NO_SAFE_QUOTE" and loss.value_json == '["a","b"]' and loss.method == "Net" and loss.task == "T1"
    assert result.value_json == "1" and result.kind == "RESULT" and out["experiments[0].training.loss.extra_evidence[0]"].kind == "TRAINING_EXTRA"
    assert lr.fingerprint != loss.fingerprint


def test_generic_walk_agrees_at_any_depth(spark):
    df = load(spark, RECORD)
    paths = lambda d: {r.path for r in d.collect()}
    assert paths(W.walk_anywhere(df)) == paths(W.claims(df, provenance=True))
    assert paths(W.walk_anywhere(df, levels=1)) == paths(W.walk_anywhere(df))
    deep = {"page_pdf": 1, "quote": "q", "value": 1}
    for _ in range(25):
        deep = {"a": [deep]}
    assert paths(W.walk_anywhere(load(spark, deep))) == {".".join(["a[0]"] * 25)}


def test_records_without_arrays_and_broken_files(spark):
    df = load(spark, {"paper": {"title": "x"}}, "{broken", "[1]")
    assert W.claims(df).count() == 0
    assert tuple(R.validity(df).first()) == (3, 1, 2)


def test_verdict_goes_stale_when_value_or_quote_changes(spark):
    claims = W.claims(load(spark, RECORD))
    now = claims.select("claim_id", F.lit("ACCEPTED").alias("decision"), "fingerprint")
    assert {r.audit_state for r in L.attach_verdicts(claims, now).collect()} == {"ACCEPTED"}
    changed = json.loads(json.dumps(RECORD))
    changed["results"][0]["value"] = 9
    states = {r.path: r.audit_state for r in L.attach_verdicts(W.claims(load(spark, changed)), now).collect()}
    assert states.pop("results[0]") == "STALE" and set(states.values()) == {"ACCEPTED"}


def test_recheck_follows_a_moved_claim_only_when_unique(spark):
    cols = "claim_id string, slug string, value_json string, quote string"
    checked = spark.createDataFrame([("s::a", "s", "1", "q"), ("s::b", "s", "2", "r"), ("s::c", "s", "3", None)], cols)
    claims = spark.createDataFrame([("s::a2", "s", "1", "q"), ("s::b1", "s", "2", "r"), ("s::b2", "s", "2", "r"), ("s::c", "s", "3", None)], cols)
    assert {r.claim_id: r.now_id for r in L.reattach(checked, claims).collect()} == {"s::a": "s::a2", "s::b": None, "s::c": "s::c"}


def test_field_rules(spark):
    def field(path, **given):
        doc = {}
        node = doc
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = given
        return doc

    ev = {"page": 1, "evidence": "e", "origin": "PRIMARY_PAPER"}
    cases = [
        (field("training.batch_size", value=32, status="VERIFIED", source=ev), set()), (field("training.batch_size", value=32.0, status="NOT_VERIFIED"), {"value_type"}), (field("training.mixed_precision", value=False, status="NOT_VERIFIED"), set()),
        (field("training.optimizer", value=" ", status="NOT_VERIFIED"), {"value_type"}), (field("training.optimizer", value="a", status="VERIFIED"), {"verified_evidence"}), (field("data.inputs", value=["a", ""], status="NOT_VERIFIED"), {"value_type"}),
        (field("training.optimizer", conflict_values=["a", "b"], status="CONFLICT", source={**ev, "claimed_value": "a"}, sources=[{**ev, "claimed_value": "b"}]), set()),
        (field("training.optimizer", conflict_values=["a", "b"], status="CONFLICT", source={**ev, "claimed_value": "a"}), {"conflict_uncovered"}), (field("training.optimizer", value="a"), {"absent_with_value"}),
        (field("limitations.data", value=["x"], status="NOT_VERIFIED", provenance_type="TEAM_NOTE"), {"limitation_provenance"}), (field("training.optimizer", value="a", status="VERIFIED", provenance_type="TEAM_NOTE", source=ev), {"verified_provenance", "fact_provenance"}),
    ]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "paper_id int, doc string").select("paper_id", F.lit("e").alias("edition_id"), F.parse_json("doc").alias("v"))
    found = {}
    for r in S.field_rules(S.field_states(rows)).collect():
        found.setdefault(int(r.key.split("/")[0]), set()).add(r.rule)
    assert {i: found.get(i, set()) for i in range(len(cases))} == {i: want for i, (_, want) in enumerate(cases)}


def test_every_path_of_the_walk_reads_back(spark):
    node = {"page_pdf": 1, "quote": "q"}
    docs = [("a", {"x": {"y": [node, {"z": node}]}, "w": node}), ("b", {"x.y": [node], "k[0]": node, "": node, "é": node, "a'b\"": [[node]]}), ("c", {})]
    r = spark.createDataFrame([(s, json.dumps(d)) for s, d in docs], "slug string, doc string").select("slug", F.parse_json("doc").alias("v"))
    walked = W.walk_anywhere(r).select("slug", "path", F.to_json("node").alias("want"))
    got = W.read_back(r, walked).select("slug", "path", "want", F.to_json("node").alias("got")).collect()
    assert len(got) == 8 and all(json.loads(g["want"]) == json.loads(g["got"]) for g in got)
    lost = W.read_back(r, spark.createDataFrame([("a", "x.no"), ("a", "x.y[9]"), ("zz", "x"), ("a", "x.y[1].z")], "slug string, path string")).select("path", F.to_json("node").alias("n")).collect()
    assert {g["path"]: g["n"] is not None for g in lost} == {"x.no": False, "x.y[9]": False, "x": False, "x.y[1].z": True}


def test_tallies_count_proposed_or_novel_methods_of_kept_records(spark):
    docs = [
        {"methods": [{"family": "A", "role": "PROPOSED"}, {"family": "B", "role": "BASELINE"}, {"family": "B", "role": "BASELINE", "is_novel_in_paper": True}, {"role": "PROPOSED"}], "datasets": [{"canonical_name": "x" * 50}]},
        {"methods": [{"family": "A", "role": "PROPOSED"}], "excluded": {"reason": "review"}}, {"results": [{"metric": "M"}, {}], "source": {"edition": "E"}}, {}]
    r = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "slug string, doc string").select("slug", F.parse_json("doc").alias("v"))
    assert {tuple(x) for x in W.category_tallies(r).collect()} == {("family", "A", 1), ("family", "B", 1), ("dataset", "x" * 46, 1), ("metric", "M", 1), ("edition", "E", 1)}
