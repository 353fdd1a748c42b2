"""Field-path mappings: import, proposal with guards, audit packets, effective view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.identity import stable_id
from attestry.functions.text import blank_to_null
from attestry.operators.keyed import newest
from attestry.operators.states import zoned_time
from attestry.operators.validate import row_rules


def import_mappings(candidates: DataFrame, contract: DataFrame) -> DataFrame:
    """candidates(field_path, canonical_category): an exact contract path maps to itself, a
    category alone is ambiguous, nothing is unmapped. One row per path."""
    rows = candidates.select(F.trim("field_path").alias("original_path"), blank_to_null(F.col("canonical_category")).alias("category")).filter("original_path <> ''")
    once = rows.groupBy("original_path").agg(F.max("category").alias("category"))
    known = contract.select(F.col("field_path").alias("original_path"), F.lit(True).alias("_exact")).distinct()
    out = once.join(known, "original_path", "left")
    exact = F.col("_exact").isNotNull()
    return out.select("original_path", F.when(exact, F.col("original_path")).alias("canonical_path"),
                      F.when(exact, "MAPPED").when(F.col("category").isNotNull(), "AMBIGUOUS").otherwise("UNMAPPED").alias("decision"))


def omitted_paths(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Paths in use that the map does not list."""
    return claims.select("field_path").distinct().join(candidates.select("field_path"), "field_path", "left_anti")


def path_usage(claims: DataFrame) -> DataFrame:
    """Per path: claims, papers, the distinct claim types (a small vocabulary), and what its scopes forbid."""
    scope = F.col("subject_scope")
    return claims.groupBy("field_path").agg(
        F.count("*").alias("n_claims"), F.countDistinct("paper_id").alias("n_papers"),
        F.array_sort(F.collect_set("claim_type")).alias("types"), 
        F.coalesce(F.bool_or(scope.isin(*V.BLOCKING_SCOPES)), F.lit(False)).alias("blocked_scope"),
        F.coalesce(F.bool_or(F.contains(F.lower(scope), F.lit("review")) & ~F.contains(F.lower(scope), F.lit("reviewed_"))), F.lit(False)).alias("review_scope"))


def _guard(target: Column, types: Column, blocked: Column, review: Column) -> Column:
    """Why a path may not be projected into the target, or null."""
    only = lambda *allowed: F.size(F.array_except(types, F.array(*[F.lit(a) for a in allowed]))) == 0
    limitation = F.startswith(target, F.lit("limitations."))
    is_future = target == "limitations.future_work"
    return (
        F.when(blocked, "BLOCKED_SCOPE")
        .when(F.startswith(target, F.lit("interpretation.")), F.when(~only("AI_INTERPRETATION"), F.lit("INTERPRETATION_NEEDS_AI_CLAIMS")))
        .when(F.array_contains(types, "AI_INTERPRETATION"), "AI_CLAIM_IN_AUTHOR_FIELD")
        .when(limitation & ~is_future, F.when(~(only("AUTHOR_REPORTED_LIMITATION") & (F.size(types) > 0)), F.lit("NEEDS_LIMITATION_CLAIMS")).when(review, F.lit("REVIEW_LEVEL_LIMITATION")))
        .when(is_future, F.when(~only("AUTHOR_REPORTED_FACT", "AUTHOR_REPORTED_FUTURE_WORK"), F.lit("UNEXPECTED_TYPES")))
        .when(~only("AUTHOR_REPORTED_FACT"), "NON_FACT_CLAIMS")
        .when(F.startswith(target, F.lit("results.")) & review, "REVIEW_LEVEL_RESULT")
    )


def propose_mappings(mappings: DataFrame, synonyms: DataFrame, unmapped: DataFrame, dissents: DataFrame, contract: DataFrame, claims: DataFrame) -> DataFrame:
    """Proposed decision per path.

    Identity rules stay; refused paths stay unmapped; synonyms(original_path, target) pass
    the guards over all claims of the path; a reviewer's dissent returns a mapping to
    ambiguous. Unlisted limitation paths aim at the author-reported limitations.
    """
    usage = path_usage(claims).withColumnRenamed("field_path", "original_path")
    rows = (
        mappings.join(usage, "original_path", "left").join(synonyms, "original_path", "left")
        .join(unmapped.select("original_path", F.lit(True).alias("_refused")), "original_path", "left")
        .join(dissents.select("original_path", F.lit(True).alias("_dissent")), "original_path", "left")
        .join(contract.select(F.col("field_path").alias("original_path"), F.lit(True).alias("_known")).distinct(), "original_path", "left"))
    empty = F.array().cast("array<string>")
    limitation = F.startswith("original_path", F.lit("limitations.")) & F.col("_known").isNull()
    target = F.coalesce("target", F.when(limitation, F.lit("limitations.author_reported")))
    rows = rows.withColumns({"target": target, "types": F.coalesce("types", empty), "blocked_scope": F.coalesce("blocked_scope", F.lit(False)), "review_scope": F.coalesce("review_scope", F.lit(False)), "n_claims": F.coalesce("n_claims", F.lit(0)), "n_papers": F.coalesce("n_papers", F.lit(0))})
    guard = _guard(F.col("target"), F.col("types"), F.col("blocked_scope"), F.col("review_scope"))
    reason = (
        F.when(F.col("decision") == "MAPPED", "IDENTITY").when(F.col("_refused"), "REFUSED").when(F.col("n_claims") == 0, "NO_CLAIMS")
        .when(F.col("target").isNotNull(), F.coalesce(guard, F.lit("SYNONYM"))).otherwise("NO_TARGET"))
    rows = rows.withColumn("reason", reason)
    maps = F.col("reason").isin("IDENTITY", "SYNONYM")
    dissent = maps & F.coalesce("_dissent", F.lit(False))
    decision = F.when(dissent, "AMBIGUOUS").when(maps, "MAPPED").when(F.col("reason") == "REFUSED", "UNMAPPED").otherwise("AMBIGUOUS")
    goal = F.when(F.col("reason") == "IDENTITY", F.col("original_path")).otherwise(F.col("target"))
    blocked = dissent | ~F.col("reason").isin("IDENTITY", "SYNONYM", "REFUSED", "NO_CLAIMS", "NO_TARGET")
    return rows.select(
        "original_path", F.col("decision").alias("source_decision"), decision.alias("proposed_decision"), F.when(decision == "MAPPED", goal).alias("proposed_path"),
        F.when(dissent, "DISSENT").otherwise(F.col("reason")).alias("reason"), F.when(blocked, goal).alias("blocked_candidate"), "n_claims", "n_papers", "types")


def decision_crosstab(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("source_decision").pivot("proposed_decision", list(V.MAPPING_DECISIONS)).count().na.fill(0)


def audit_packets(proposals: DataFrame, claims: DataFrame, version_id: str, producer_id: str) -> DataFrame:
    """A packet per path: the proposal and a digest of all claims under it, bound by one hash.

    The claims themselves are not gathered: each is hashed, and order-free sums of the
    hashes bind the set, so a path with very many claims needs no list.
    """
    digest = F.sha2(F.concat_ws("\u0001", "claim_id", "fingerprint"), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(38,0)"))
    sets = claims.groupBy(F.col("field_path").alias("original_path")).agg(F.count("*").alias("_n"), part(1).alias("_a"), part(13).alias("_b"), part(25).alias("_c"))
    rows = proposals.join(sets, "original_path", "left")
    claims_digest = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("_n", "_a", "_b", "_c")]), 256)
    rows = rows.withColumns({"version_id": F.lit(version_id), "producer_id": F.lit(producer_id), "claims_digest": claims_digest, "claims": F.coalesce("_n", F.lit(0))})
    packet = stable_id(F.col("version_id"), F.col("producer_id"), F.col("original_path"), F.col("proposed_decision"), F.col("proposed_path"), F.col("claims_digest"))
    return rows.select(packet.alias("packet_sha256"), "version_id", "producer_id", "original_path", "proposed_decision", "proposed_path", "claims", "claims_digest")


def packet_claims(packets: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims of every packet as rows (packet_sha256, original_path, and the columns of the claim): a path with very many claims stays many rows."""
    keyed = packets.select("packet_sha256", "original_path")
    return keyed.join(claims, F.col("original_path") == F.col("field_path")).drop("field_path")


def packet_claim_faults(packets: DataFrame, claims: DataFrame, reviewed: DataFrame) -> DataFrame:
    """What keeps packets from being built: the stored claims of a path must be those of its pre-review(original_path, claim_id), and every
    path that was reviewed must have a packet. One join, both ways; repeated rows count once."""
    stored = packets.select("original_path").join(claims.select(F.col("field_path").alias("original_path"), "claim_id"), "original_path").distinct()
    wanted = reviewed.select("original_path", "claim_id").distinct()
    both = stored.withColumn("_stored", F.lit(True)).join(wanted.withColumn("_wanted", F.lit(True)), ["original_path", "claim_id"], "full")
    known = both.join(packets.select("original_path", F.lit(True).alias("_packet")).distinct(), "original_path", "left")
    key = F.concat_ws("/", "original_path", "claim_id")
    return row_rules(known, "PACKET", key, [
        ("claim_not_reviewed", F.col("_wanted").isNull(), "the pre-review does not have this claim"),
        ("claim_not_stored", F.col("_stored").isNull() & F.col("_packet").isNotNull(), "the pre-review has it, the store does not"),
        ("packet_missing", F.col("_packet").isNull(), "a reviewed path without a packet")])


def mapping_audit_rules(reports: DataFrame, packets: DataFrame, contract: DataFrame) -> DataFrame:
    """What keeps an independent mapping audit out.

    reports(event_id, packet_sha256, original_path, decision, canonical_path, review_status,
    auditor_id, audited_at, justification, evidence, locator, sources) where sources is an
    array of (name, edition, sha256).
    """
    p = packets.select("packet_sha256", F.col("original_path").alias("_path"), F.col("producer_id").alias("_producer"), F.col("proposed_decision").alias("_decision"),
                       F.col("proposed_path").alias("_target"), F.lit(True).alias("_known"))
    known_path = contract.select(F.col("field_path").alias("canonical_path"), F.lit(True).alias("_in_contract")).distinct()
    rows = reports.withColumn("packet_sha256", F.lower("packet_sha256")).join(p, "packet_sha256", "left").join(known_path, "canonical_path", "left")
    c, known = F.col, F.col("_known").isNotNull()
    blank = lambda n: blank_to_null(c(n)).isNull()
    pinned = lambda s: (F.trim(s["name"]) != "") & (F.trim(s["edition"]) != "") & F.lower(s["sha256"]).rlike("^[0-9a-f]{64}$")
    return row_rules(rows, "MAPPING_AUDIT", c("event_id"), [
        ("packet_unknown", ~known | ~c("_path").eqNullSafe(c("original_path")), "hash and path name no stored packet"),
        ("auditor_missing", blank("auditor_id"), ""), ("auditor_is_producer", known & (F.trim("auditor_id") == c("_producer")), "must be independent"),
        ("decision_unknown", ~F.coalesce(F.upper("decision").isin(*V.MAPPING_DECISIONS), F.lit(False)), ""),
        ("review_status_unknown", ~F.coalesce(F.upper("review_status").isin("VALIDATED", "REJECTED"), F.lit(False)), ""),
        ("target_and_decision_disagree", (F.upper("decision") == "MAPPED") != blank_to_null(c("canonical_path")).isNotNull(), "only MAPPED carries a path"),
        ("target_outside_contract", (F.upper("decision") == "MAPPED") & c("canonical_path").isNotNull() & c("_in_contract").isNull(), ""),
        ("validated_differs", known & (F.upper("review_status") == "VALIDATED") & ~(F.upper("decision").eqNullSafe(c("_decision")) & c("canonical_path").eqNullSafe(c("_target"))), "VALIDATED repeats the proposal exactly"),
        ("statement_missing", blank("justification") | blank("evidence") | blank("locator"), ""), ("time_invalid", zoned_time(c("audited_at")).isNull(), "needs a time zone"),
        ("sources_not_pinned", c("sources").isNull() | (F.size("sources") < 1) | ~F.forall("sources", lambda s: F.coalesce(pinned(s), F.lit(False))), "sources need name, edition and sha256"),
    ])


def current_version(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The mapping version of the newest import run (one row)."""
    dated = versions.join(runs.select(F.col("id").alias("import_run_id"), "imported_at"), "import_run_id")
    return dated.agg(F.max_by("version_id", F.struct("imported_at", "version_id")).alias("version_id"))


def effective_mappings(mappings: DataFrame, audits: DataFrame, current: DataFrame) -> DataFrame:
    """Each mapping under its newest independent audit.

    mappings(version_id, original_path, decision, canonical_path, review_status);
    audits(..., proposed_decision, proposed_path, at, created_at, event_id).
    """
    key = ["version_id", "original_path"]
    last = newest(audits, key, ["at", "created_at", "event_id"])
    dissent = ((F.col("review_status") == "REJECTED") | (F.col("decision") != F.col("proposed_decision")) | ~F.col("canonical_path").eqNullSafe(F.col("proposed_path")))
    a = last.select(*key, F.lit(True).alias("_audited"), F.col("decision").alias("_d"), F.col("canonical_path").alias("_p"), F.col("review_status").alias("_r"), dissent.alias("_dissent"))
    rows = mappings.join(a, key, "left").join(current.select("version_id", F.lit(True).alias("_current")), "version_id", "left")
    by = F.col("_audited").isNotNull()
    pick = lambda audit, own: F.when(by, F.col(audit)).otherwise(F.col(own))
    return rows.select(
        *key, pick("_r", "review_status").alias("effective_review_status"), pick("_d", "decision").alias("effective_decision"),
        pick("_p", "canonical_path").alias("effective_canonical_path"), (by & F.col("_current").isNotNull()).alias("effective_current"), F.coalesce("_dissent", F.lit(False)).alias("dissent"))


def audit_staleness(audits: DataFrame, current: DataFrame) -> DataFrame:
    """Every mapping audit with the reason it no longer counts, or null."""
    key = ["version_id", "original_path"]
    order = ["at", "created_at", "event_id"]
    last = newest(audits.select(*key, *order), key, order).withColumn("_last", F.lit(True))
    rows = audits.join(last, [*key, *order], "left").join(current.select("version_id", F.lit(True).alias("_current")), "version_id", "left")
    stale = F.when(F.col("_current").isNull(), "MAPPING_VERSION_SUPERSEDED").when(F.col("_last").isNull(), "SUPERSEDED_BY_LATER_MAPPING_AUDIT")
    return rows.withColumn("stale_reason", stale).drop("_last", "_current")
