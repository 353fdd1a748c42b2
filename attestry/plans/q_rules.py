"""One faulty row for each rule over fields, labels and predictions: a sound row changed so that it breaks that rule and no other.

Every order is a paper; its number picks the rule. The SQL knows only which rule was picked, so it shares nothing with the rules.
"""

from pyspark.sql import functions as F

from attestry.functions import evidence as E
from attestry.functions import vocabulary as V
from attestry.operators import research as R
from attestry.operators import scoring as B
from attestry.plans.registry import query, spread_table

_NONE = "cast(array() as array<string>)"
_NO_SOURCE = f"cast(array() as array<{E.SOURCE}>)"


def _source(claimed="null", evidence="'seen'"):
    return f"named_struct('section', 'Methods', 'page', 2, 'locator', cast(null as string), 'evidence', cast({evidence} as string), 'origin', 'PRIMARY_PAPER', 'edition_key', cast(null as string), 'claimed_json', cast({claimed} as string))"


def _sources(*each):
    return f"array({', '.join(each)})"


_A, _B = "'\"a\"'", "'\"b\"'"
_ONE = _sources(_source())
_BOTH = {"value_json": "cast(null as string)", "conflict_values": f"array({_A}, {_B})", "sources": _sources(_source(_A), _source(_B)), "status": "'CONFLICT'"}
_TWICE = {**_BOTH, "conflict_values": f"array({_A}, {_A})", "sources": _sources(_source(_A))}
_SILENT = {"value_json": "cast(null as string)", "sources": _NO_SOURCE}

_FIELD = {"field_path": "'training.optimizer'", "value_json": _A, "conflict_values": _NONE, "status": "'VERIFIED'", "provenance_type": "'AUTHOR_REPORTED_FACT'", "sources": _ONE}
FIELD_MUTANTS = {
    "": {},
    "path_unknown": {"field_path": "'training.unheard'"},
    "value_type": {"value_json": "'32'"},
    "alternative_type": {**_BOTH, "conflict_values": f"array({_A}, '1')", "sources": _sources(_source(_A), _source("'1'"))},
    "claim_without_value": {"status": "'NOT_VERIFIED'", **_SILENT},
    "verified_provenance": {"field_path": "'limitations.ai_interpretation'", "value_json": "'[\"x\"]'", "provenance_type": "'AI_INTERPRETATION'"},
    "verified_evidence": {"sources": _NO_SOURCE},
    "conflict_with_value": {**_BOTH, "value_json": _A},
    "conflict_alternatives": _TWICE,
    "conflict_unbound": {**_BOTH, "sources": _sources(_source(_A), _source(_B), _source())},
    "conflict_stray_claim": {**_BOTH, "sources": _sources(_source(_A), _source(_B), _source("'\"z\"'"))},
    "conflict_uncovered": {**_BOTH, "sources": _sources(_source(_A), _source(_B, "null"))},
    "alternatives_without_conflict": {"conflict_values": f"array({_A}, {_B})"},
    "binding_without_conflict": {"sources": _sources(_source(_A))},
    "absent_with_value": {"status": "'NOT_REPORTED'", "sources": _NO_SOURCE},
    "fact_provenance": {"provenance_type": "'AUTHOR_REPORTED_LIMITATION'"},
    "limitation_provenance": {"field_path": "'limitations.data'", "value_json": "'[\"x\"]'", "status": "'NOT_VERIFIED'", "provenance_type": "'TEAM_NOTE'"},
}

_PREDICTED = {"value_json": _A, "conflict_values": _NONE, "status": "'NOT_VERIFIED'", "sources": _ONE}
PREDICTION_MUTANTS = {
    "": {},
    "silent_with_claim": {"status": "'EXTRACTION_ERROR'", "sources": _NO_SOURCE},
    "silent_with_evidence": {"status": "'NOT_REPORTED'", "value_json": "cast(null as string)"},
    "claim_without_value": {"value_json": "cast(null as string)"},
    "alternatives_without_conflict": {"conflict_values": f"array({_A}, {_B})"},
    "conflict_with_value": {**_BOTH, "value_json": _A},
    "conflict_alternatives": _TWICE,
    "path_repeated": {"copies": "2"},
}

_VERSIONED = "'https://arxiv.org/abs/2401.00001v1'"
_GOLD = {"family": "'training'", "value_json": _A, "conflict_values": _NONE, "status": "'VERIFIED'", "sources": _ONE, "confidence": "1.0D", "provenance_type": "'AUTHOR_REPORTED_FACT'",
         "source_url": _VERSIONED, "absence_search_scope": _NONE, "verified_by": "'ann'", "verified_at": "'2025-01-01T00:00:00Z'"}
_ABSENT = {**_SILENT, "status": "'NOT_REPORTED'", "confidence": "0.95D", "source_url": "cast(null as string)", "absence_search_scope": "array('all pages')"}
GOLD_MUTANTS = {
    "": {},
    "family_differs": {"family": "'data'"},
    "confidence": {"confidence": "0.5D"},
    "absent_with_claim": {**_ABSENT, "value_json": _A},
    "absent_with_evidence": {**_ABSENT, "sources": _ONE},
    "absent_without_scope": {**_ABSENT, "absence_search_scope": _NONE},
    "verified_without_value": {"value_json": "cast(null as string)"},
    "verified_with_alternatives": {"conflict_values": f"array({_A}, {_B})"},
    "verified_evidence": {"sources": _NO_SOURCE},
    "verified_with_binding": {"sources": _sources(_source(_A))},
    "url_missing": {"source_url": "cast(null as string)"},
    "url_unpinned": {"source_url": "'https://arxiv.org/abs/2401.00001'"},
    "scope_on_claim": {"absence_search_scope": "array('all pages')"},
    "conflict_with_value": {**_BOTH, "value_json": _A},
    "conflict_alternatives": _TWICE,
    "conflict_evidence": {**_BOTH, "sources": _sources(_source(_A), _source(_B), _source(_B, "null"))},
    "conflict_unbound": {**_BOTH, "sources": _sources(_source(_A))},
    "provenance": {"provenance_type": "'TEAM_NOTE'"},
    "auditor_missing": {"verified_by": "' '"},
    "audit_time": {"verified_at": "'2025-01-01'"},
    "path_repeated": {"copies": "2"},
    "required_paths_missing": {"left_out": "'results.headline'"},
    "no_absence_label": {"left_out": "'data.units'"},
}
_CHANGED = "training.batch_size"  # the label that is changed; not one of the required


def mutated(rows, base, mutants):
    """Adds the columns of ``base`` to rows(paper_id), changed as the paper's number says."""
    pick = f"pmod(paper_id, {len(mutants)})"
    column = lambda name, sound: f"case {pick} " + " ".join(f"when {i} then {change[name]}" for i, change in enumerate(mutants.values()) if name in change) + f" else {sound} end as {name}"
    changed = {name for change in mutants.values() for name in change}
    return rows.selectExpr("*", *[column(n, sound) if n in changed else f"{sound} as {n}" for n, sound in base.items()])


def _papers(spark, sf):
    return spread_table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("paper_id"))


def _picked(mutants, key):
    """The rule each order was given, in SQL. Rules over papers name the paper alone."""
    names = ", ".join(f"({i}, '{rule}')" for i, rule in enumerate(mutants) if rule)
    return f"select rule, {key} as key from orders join (values {names}) as m(i, rule) on o_orderkey % {len(mutants)} = i"


def _found(violations):
    return violations.select("rule", "key")


@query("field_rule_mutants", _picked(FIELD_MUTANTS, """o_orderkey || '/' || case rule when 'path_unknown' then 'training.unheard' when 'verified_provenance' then 'limitations.ai_interpretation'
 when 'limitation_provenance' then 'limitations.data' else 'training.optimizer' end"""))
def field_rule_mutants(spark, sf):
    return _found(R.field_rules(mutated(_papers(spark, sf), _FIELD, FIELD_MUTANTS)))


@query("prediction_rule_mutants", _picked(PREDICTION_MUTANTS, "o_orderkey || '/training.optimizer'"))
def prediction_rule_mutants(spark, sf):
    rows = mutated(_papers(spark, sf), {**_PREDICTED, "copies": "1", "path": "'training.optimizer'"}, PREDICTION_MUTANTS)
    return _found(B.prediction_rules(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")))


@query("golden_rule_mutants", _picked(GOLD_MUTANTS, f"o_orderkey || case when rule in ('required_paths_missing', 'no_absence_label') then '' else '/{_CHANGED}' end"))
def golden_rule_mutants(spark, sf):
    """Every paper has all required labels, one of an absence, and the one that is changed."""
    changed = mutated(_papers(spark, sf), {**_GOLD, "copies": "1", "left_out": "''"}, GOLD_MUTANTS)
    sound = changed.select("paper_id", "left_out").selectExpr("*", *[f"{v} as {c}" for c, v in {**_GOLD, "copies": "1"}.items() if c not in ("family", "provenance_type")])
    paths = F.explode(F.array(*[F.lit(p) for p in V.REQUIRED_GOLD_PATHS]))
    required = sound.withColumn("path", paths).withColumn("family", F.substring_index("path", ".", 1)).withColumn("provenance_type", F.expr("if(family = 'limitations', 'AUTHOR_REPORTED_LIMITATION', 'AUTHOR_REPORTED_FACT')"))
    absent = changed.select("paper_id", "left_out").selectExpr("*", *[f"{v} as {c}" for c, v in {**_GOLD, **_ABSENT, "copies": "1", "family": "'data'", "path": "'data.units'"}.items()])
    rows = changed.withColumn("path", F.lit(_CHANGED)).unionByName(required).unionByName(absent)
    # an absence among the changed labels does not matter: the paper without one has a sound claim there
    rows = rows.filter("path <> left_out").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies", "left_out")
    return _found(B.golden_rules(rows))
