"""Audit ledgers: verdicts pinned to what was audited, re-checks, queues and progress.

Ledgers are append-only event tables. The state of a claim is the newest event about it,
and it turns stale when the claim's fingerprint has moved on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.identity import stable_id
from attestry.functions.rules import rank_in
from attestry.functions.text import blank_to_null
from attestry.operators.keyed import lookup, newest, page, previous_row


# --- recording --------------------------------------------------------------------------

def verdict_problems(requests: DataFrame) -> DataFrame:
    """Requests(claim_id, decision, note, auditor) that may not be recorded, with the first reason."""
    code = (
        F.when(~F.coalesce(F.col("decision").isin(*V.DECISIONS), F.lit(False)), "INVALID_DECISION")
        .when(F.col("decision").isin(*V.DECISIONS_WITH_REASON) & blank_to_null(F.col("note")).isNull(), "REASON_REQUIRED")
        .when(blank_to_null(F.col("auditor")).isNull(), "AUDITOR_REQUIRED")
    )
    return requests.withColumn("code", code).filter("code is not null")


def record_verdicts(requests: DataFrame, claims: DataFrame, order: Sequence[str]) -> DataFrame:
    """Valid requests as verdict events, pinned to the claim as it stands now."""
    known = claims.select("claim_id", "slug", "path", "fingerprint", F.col("value_json").alias("audited_value"),
                          F.col("quote").alias("audited_quote"), "page_pdf")
    bad = verdict_problems(requests).select("claim_id", *order)
    return (
        requests.join(bad, ["claim_id", *order], "left_anti")
        .join(known, "claim_id")
        .withColumn("note", blank_to_null(F.col("note")))
        .withColumn("auditor", F.trim("auditor"))
    )


def with_superseded(events: DataFrame, target: str, order: Sequence[str], block: Column) -> DataFrame:
    """Each verdict with the decision, auditor and time of the one it replaces."""
    return previous_row(events, [target], order, ["decision", "auditor", "decided_at"], block, prefix="supersedes_")


def append_once(incoming: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """Events not yet stored. Replaying a batch, or repeating an event inside it, adds nothing."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def content_event_id(df: DataFrame, columns: Sequence[str]) -> Column:
    """Event id from the whole content, so that any correction is a new event."""
    return stable_id(*[F.col(c) for c in columns])


# --- current state ----------------------------------------------------------------------

def current_verdicts(events: DataFrame, key: str = "claim_id", order: Sequence[str] = ("decided_at", "event_id")) -> DataFrame:
    return newest(events, [key], order)


def attach_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds ``audit_state``: UNAUDITED, STALE, or the decision of verdicts(claim_id, decision, fingerprint)."""
    now = verdicts.select("claim_id", F.col("decision").alias("_decision"), F.col("fingerprint").alias("_audited"))
    out = claims.join(now, "claim_id", "left")
    state = (
        F.when(F.col("_decision").isNull(), "UNAUDITED")
        .when(~F.col("_audited").eqNullSafe(F.col("fingerprint")), "STALE")
        .otherwise(F.col("_decision"))
    )
    return out.withColumn("audit_state", state).drop("_decision", "_audited")


def attach_rechecks(claims: DataFrame, entries: DataFrame, triage: DataFrame) -> DataFrame:
    """Adds ``recheck_state``. A flag that has been ruled on is shown with the ruling."""
    checked = entries.select("claim_id", F.col("verdict").alias("_verdict"), F.col("fingerprint").alias("_checked"))
    ruled = triage.select("claim_id", F.col("decision").alias("_ruling"))
    out = claims.join(checked, "claim_id", "left").join(ruled, "claim_id", "left")
    state = (
        F.when(F.col("_verdict").isNull(), F.lit("NOT_RECHECKED"))
        .when(~F.col("_checked").eqNullSafe(F.col("fingerprint")), F.lit("STALE"))
        .when((F.col("_verdict") == "SUSPECT") & F.col("_ruling").isNotNull(), F.concat(F.lit("SUSPECT_"), F.col("_ruling")))
        .otherwise(F.col("_verdict"))
    )
    return out.withColumn("recheck_state", state).drop("_verdict", "_checked", "_ruling")


def event_history(events: DataFrame, targets: DataFrame, target: str, order: Sequence[str]) -> DataFrame:
    """Every event with ``current`` (its fingerprint still holds) and ``is_latest``."""
    last = newest(events.select(target, *order), [target], order)
    marked = events.join(last.withColumn("is_latest", F.lit(True)), [target, *order], "left")
    out = marked.join(targets.select(target, F.col("fingerprint").alias("_now")), target, "left")
    return out.withColumn("is_latest", F.coalesce("is_latest", F.lit(False))).withColumn(
        "current", F.coalesce(F.col("target_fingerprint") == F.col("_now"), F.lit(False))).drop("_now")


def verification_state(decision: Column, current: Column) -> Column:
    return F.when(decision.isNull(), "NOT_VERIFIED").when(~current, "STALE_AUDIT").otherwise(decision)


# --- progress ---------------------------------------------------------------------------

def audit_progress(decorated: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("audit_state").isin(*s))
    return decorated.agg(
        F.count("*").alias("claims"), n(*V.DECISIONS).alias("audited"), n("ACCEPTED").alias("accepted"),
        n("NEEDS_FIX").alias("needs_fix"), n("REJECTED").alias("rejected"), n("STALE").alias("stale"),
        n("UNAUDITED").alias("unaudited"),
    )


def auditors(verdicts: DataFrame) -> DataFrame:
    """(auditor, claims): who stands behind the current verdicts."""
    return verdicts.groupBy("auditor").agg(F.count("*").alias("claims"))


def audit_progress_by(decorated: DataFrame, by: str = "slug") -> DataFrame:
    return decorated.groupBy(by).agg(
        F.count("*").alias("claims"),
        F.count_if(~F.col("audit_state").isin("UNAUDITED", "STALE")).alias("audited"),
        F.count_if(F.col("audit_state") == "ACCEPTED").alias("accepted"),
    )


def recheck_progress(decorated: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("recheck_state").isin(*s))
    return decorated.agg(
        F.count("*").alias("claims"),
        F.count_if(~F.col("recheck_state").isin("NOT_RECHECKED", "STALE")).alias("rechecked"),
        n("CONFIRMED").alias("confirmed"), n("SUSPECT", "SUSPECT_APPLIED", "SUSPECT_KEPT").alias("flagged"),
        n("SUSPECT_APPLIED").alias("corrected"), n("SUSPECT_KEPT").alias("flag_dismissed"),
        n("SUSPECT").alias("outstanding"), n("UNREADABLE").alias("unreadable"), n("STALE").alias("stale"),
        n("NOT_RECHECKED").alias("not_rechecked"),
    )


def review_queue(decorated: DataFrame, limit: int, offset: int = 0, slug: str | None = None, kind: str | None = None) -> DataFrame:
    """Claims still to be audited, unquoted ones first, then by kind; ``total`` is uncut."""
    pending = decorated.filter(F.col("audit_state").isin("UNAUDITED", "STALE"))
    if slug:
        pending = pending.filter(F.col("slug") == slug)
    if kind:
        pending = pending.filter(F.col("kind") == kind)
    quoted = F.coalesce(F.length("quote") > 0, F.lit(False))
    order = [quoted, rank_in(F.col("kind"), V.CLAIM_KINDS, missing=9), F.col("slug"), F.col("path"), F.col("claim_id")]
    return page(pending, order, limit, offset)


# --- re-check reports -------------------------------------------------------------------

def report_completeness(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Per slug of reports(slug, path): claims that were not re-checked and paths nobody knows."""
    ours = claims.select("slug", "path").distinct().join(reports.select("slug").distinct(), "slug", "left_semi").withColumn("_ours", F.lit(True))
    theirs = reports.select("slug", "path").distinct().withColumn("_theirs", F.lit(True))
    both = ours.join(theirs, ["slug", "path"], "full")
    return both.groupBy("slug").agg(
        F.count_if(F.col("_theirs").isNull()).alias("missing"), F.count_if(F.col("_ours").isNull()).alias("unknown"),
        F.min(F.when(F.col("_theirs").isNull(), F.col("path"))).alias("first_missing"),
        F.min(F.when(F.col("_ours").isNull(), F.col("path"))).alias("first_unknown"),
    )


def reattach(checked: DataFrame, claims: DataFrame) -> DataFrame:
    """Where each checked claim stands today, judged by content.

    checked(claim_id, slug, value_json, quote) is the snapshot that was checked. A claim
    that kept its id and content stays; one that moved is followed when exactly one claim of
    the slug has its content; otherwise ``now_id`` is null. ``candidates`` tells why.
    """
    content = ["slug", "value_json", "quote"]
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    tagged = lambda df: df.withColumn("_content", stable_id(*[F.col(c) for c in content]))
    today = tagged(claims.select("claim_id", *content)).select("claim_id", F.col("_content").alias("_today"))
    by_content = tagged(claims.select("claim_id", *content)).groupBy("_content").agg(
        F.count("*").alias("candidates"), F.min("claim_id").alias("_only"))
    out = tagged(checked).join(today, "claim_id", "left").join(by_content, "_content", "left")
    stayed = F.col("_today").isNotNull() & same("_today", "_content")
    return out.withColumn("candidates", F.coalesce("candidates", F.lit(0))).withColumn(
        "now_id", F.when(stayed, F.col("claim_id")).when(F.col("candidates") == 1, F.col("_only"))
    ).drop("_content", "_today", "_only")


def ingest_rechecks(reports: DataFrame, snapshot: DataFrame, claims: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger entries after the reports, problems).

    reports(slug, path, verdict, reason, correct_reading, checked_at, checker); snapshot(slug,
    path, value_json, quote) is what the checker was handed; stored is the ledger so far.
    """
    claim_id = F.concat_ws("::", "slug", "path")
    known = claims.select("claim_id", "fingerprint")
    rows = reports.withColumn("claim_id", claim_id)
    handed = reattach(snapshot.withColumn("claim_id", claim_id).select("claim_id", "slug", "value_json", "quote"), claims)
    placed = rows.join(handed.select("claim_id", "now_id", "candidates"), "claim_id", "left")
    placed = placed.withColumn("now_id", F.when(F.col("candidates").isNull(), F.col("claim_id")).otherwise(F.col("now_id")))
    valid = F.coalesce(F.col("verdict").isin(*V.RECHECK_VERDICTS), F.lit(False))
    resolved = lookup(placed.drop("claim_id").withColumnRenamed("now_id", "claim_id"), known, "claim_id")
    fresh = resolved.filter(valid & F.col("fingerprint").isNotNull()).select(*stored.columns)
    kept = stored.join(known.select("claim_id"), "claim_id", "left_semi").join(fresh.select("claim_id"), "claim_id", "left_anti")
    entries = kept.unionByName(newest(fresh, ["claim_id"], ["checked_at", "path"]))
    problem = lambda df, key, what: df.select(F.col(key).alias("key"), F.lit(what).alias("problem"))
    problems = (
        problem(placed.filter("now_id is null"), "claim_id", "checked claim is gone or ambiguous")
        .unionByName(problem(resolved.filter(F.col("fingerprint").isNotNull() & ~valid), "claim_id", "unknown verdict"))
        .unionByName(problem(stored.join(known, "claim_id", "left_anti"), "claim_id", "claim no longer exists"))
    )
    gaps = report_completeness(claims, reports)
    problems = problems.unionByName(problem(gaps.filter("missing > 0"), "slug", "claims not re-checked"))
    return entries, problems.unionByName(problem(gaps.filter("unknown > 0"), "slug", "unknown paths"))
