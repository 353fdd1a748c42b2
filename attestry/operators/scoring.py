"""Extraction benchmark: predictions against audited golden labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import evidence as E
from attestry.functions import vocabulary as V
from attestry.functions.identity import unpinned_arxiv
from attestry.functions.numbers import ratio
from attestry.operators.keyed import repeated
from attestry.operators.validate import all_violations, broken, row_rules

KEY = ["paper_id", "path"]


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def _locations(sources: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.array_sort(F.transform(F.filter(sources, E.is_supplied), lambda s: F.concat_ws("\u0001", text(s["page"]), text(s["section"]), text(s["locator"]))))


def compare(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold(paper_id, path, family, status, value_json, conflict_values, sources) with the outcome
    of its prediction. A missing prediction is a miss; location is judged on right values only."""
    p = predicted.select(*KEY, F.col("status").alias("_s"), F.col("value_json").alias("_v"), F.col("conflict_values").alias("_c"), F.col("sources").alias("_src"))
    rows = gold.join(p, KEY, "left")
    verified = (F.col("status") == "VERIFIED") & (F.col("_s") == "NOT_VERIFIED") & (F.col("value_json") == F.col("_v"))
    conflict = (F.col("status") == "CONFLICT") & (F.col("_s") == "CONFLICT") & _same_set(F.col("conflict_values"), F.col("_c"))
    match = F.coalesce(verified, F.lit(False)) | F.coalesce(conflict, F.lit(False))
    claim = F.col("status").isin("VERIFIED", "CONFLICT")
    said = F.coalesce(F.col("_s").isin("NOT_VERIFIED", "CONFLICT"), F.lit(False))
    silent = ~claim & F.coalesce(F.col("_s") == "NOT_REPORTED", F.lit(False))
    located = match & F.coalesce(_locations(F.col("sources")) == _locations(F.col("_src")), F.lit(False))
    return rows.select(*KEY, "family", claim.alias("gold_claim"), said.alias("predicted_claim"), match.alias("match"), silent.alias("silent"), located.alias("located"))


def score(compared: DataFrame) -> DataFrame:
    """(family, metric, numerator, denominator, value), one family ``*`` for all fields, in one pass."""
    n = lambda c: F.count_if(c)
    c = F.col
    counts = compared.groupingSets([[], ["family"]], "family").agg(
        n(c("match")).alias("exact"), n(c("predicted_claim")).alias("predicted"), n(c("gold_claim")).alias("gold"), F.count("*").alias("fields"),
        n(c("match") | c("silent")).alias("exact_fields"), n(c("predicted_claim") & ~c("match")).alias("unsupported"), n(~c("gold_claim")).alias("absent"),
        n(c("silent")).alias("silent"), n(c("located")).alias("located"), F.grouping("family").alias("_all"))
    metric = lambda name, a, b: F.struct(F.lit(name).alias("metric"), c(a).alias("numerator"), c(b).alias("denominator"))
    metrics = F.array(metric("precision", "exact", "predicted"), metric("recall", "exact", "gold"), metric("exact_match", "exact_fields", "fields"),
                      metric("unsupported_claim_rate", "unsupported", "predicted"), metric("not_reported_accuracy", "silent", "absent"), metric("evidence_location_accuracy", "located", "gold"))
    rows = counts.select(F.when(c("_all") == 1, "*").otherwise(c("family")).alias("family"), F.explode(metrics).alias("m")).select("family", "m.*")
    return rows.withColumn("value", ratio(c("numerator"), c("denominator")))


def unknown_predictions(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions for papers or paths the golden set does not have; these are refused."""
    return all_violations([
        broken(predicted.select("paper_id").distinct().join(gold.select("paper_id").distinct(), "paper_id", "left_anti"), "paper_unknown", "PREDICTION", F.col("paper_id")),
        broken(predicted.join(gold.select("paper_id").distinct(), "paper_id", "left_semi").join(gold.select(*KEY), KEY, "left_anti"), "path_unknown", "PREDICTION", F.concat_ws("/", *KEY)),
    ])


def prediction_rules(predicted: DataFrame) -> DataFrame:
    c = F.col
    silent = c("status").isin("NOT_REPORTED", "EXTRACTION_ERROR")
    claims = c("value_json").isNotNull() | (F.size("conflict_values") > 0)
    rows = row_rules(predicted, "PREDICTION", F.concat_ws("/", *KEY), [
        ("silent_with_claim", silent & claims, ""), ("silent_with_evidence", silent & F.exists("sources", E.is_supplied), ""),
        ("claim_without_value", (c("status") == "NOT_VERIFIED") & c("value_json").isNull(), ""), ("alternatives_without_conflict", (c("status") == "NOT_VERIFIED") & (F.size("conflict_values") > 0), ""),
        ("conflict_with_value", (c("status") == "CONFLICT") & c("value_json").isNotNull(), ""), ("conflict_alternatives", (c("status") == "CONFLICT") & (F.size(F.array_distinct("conflict_values")) < 2), "")])
    return rows.unionByName(broken(repeated(predicted, KEY), "path_repeated", "PREDICTION", F.concat_ws("/", *KEY)))


def golden_rules(gold: DataFrame) -> DataFrame:
    """gold(..., confidence, provenance_type, source_url, absence_search_scope, verified_by, verified_at)."""
    from attestry.operators.states import zoned_time

    c = F.col
    claims = c("value_json").isNotNull() | (F.size("conflict_values") > 0)
    supplied = F.filter("sources", E.is_supplied)
    distinct = F.array_distinct("conflict_values")
    bound = F.array_distinct(F.array_compact(F.transform(supplied, lambda s: s["claimed_json"])))
    scope = F.coalesce(F.size("absence_search_scope") > 0, F.lit(False))
    absent, verified, conflict = (c("status") == s for s in ("NOT_REPORTED", "VERIFIED", "CONFLICT"))
    wanted = F.when(absent, 0.95).otherwise(1.0)
    rows = row_rules(gold, "GOLDEN", F.concat_ws("/", *KEY), [
        ("family_differs", c("family") != F.substring_index("path", ".", 1), ""), ("confidence", c("confidence").isNotNull() & (c("confidence") != wanted), ""),
        ("absent_with_claim", absent & claims, ""), ("absent_with_evidence", absent & ((F.size(supplied) > 0) | c("source_url").isNotNull()), ""), ("absent_without_scope", absent & ~scope, ""),
        ("verified_without_value", verified & c("value_json").isNull(), ""), ("verified_with_alternatives", verified & (F.size("conflict_values") > 0), ""),
        ("verified_evidence", verified & ~E.has_exact_evidence(c("sources")), ""), ("verified_with_binding", verified & (F.size(bound) > 0), ""),
        ("url_missing", (verified | conflict) & c("source_url").isNull(), ""), ("url_unpinned", F.coalesce(unpinned_arxiv(c("source_url")), F.lit(False)), "names no version"), ("scope_on_claim", (verified | conflict) & scope, ""),
        ("conflict_with_value", conflict & c("value_json").isNotNull(), ""), ("conflict_alternatives", conflict & (F.size(distinct) < 2), ""),
        ("conflict_evidence", conflict & ~F.forall(supplied, lambda s: E.qualifies(s) & s["claimed_json"].isNotNull()), ""), ("conflict_unbound", conflict & ~_same_set(distinct, bound), ""),
        ("provenance", c("provenance_type") != F.when(c("family") == "limitations", "AUTHOR_REPORTED_LIMITATION").otherwise("AUTHOR_REPORTED_FACT"), ""),
        ("auditor_missing", F.coalesce(F.trim("verified_by"), F.lit("")) == "", ""), ("audit_time", zoned_time(c("verified_at")).isNull(), "needs a time zone")])
    needed = F.array(*[F.lit(p) for p in V.REQUIRED_GOLD_PATHS])
    per_paper = gold.groupBy("paper_id").agg(F.array_except(needed, F.collect_set(F.when(c("path").isin(*V.REQUIRED_GOLD_PATHS), c("path")))).alias("_missing"), F.bool_or(absent).alias("_absence"))
    return all_violations([
        rows, broken(repeated(gold, KEY), "path_repeated", "GOLDEN", F.concat_ws("/", *KEY)),
        broken(per_paper.filter(F.size("_missing") > 0), "required_paths_missing", "GOLDEN", c("paper_id"), F.array_join("_missing", ", ")),
        broken(per_paper.filter(~F.col("_absence")), "no_absence_label", "GOLDEN", c("paper_id"))])
