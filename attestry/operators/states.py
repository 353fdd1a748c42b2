"""Audit events and the states they give to claims, markers, fields and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.text import blank_to_null
from attestry.operators.analytics import unset_cells
from attestry.operators.keyed import newest, repeated
from attestry.operators.ledger import verification_state
from attestry.operators.staging import not_pending
from attestry.operators.validate import all_violations, broken, row_rules

_DATE = r"^\d{4}-\d{2}-\d{2}$"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def _instant(text: Column, shape: str) -> Column:
    with_seconds = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.when(F.coalesce(text.rlike(shape), F.lit(False)), F.try_to_timestamp(with_seconds))


def audited_at(text: Column) -> Column:
    """The instant an ISO-8601 date or zoned time stands for; null when it is neither."""
    return _instant(text, f"{_DATE}|{_ZONED}")


def zoned_time(text: Column) -> Column:
    """As ``audited_at``, but a bare date will not do."""
    return _instant(text, _ZONED)


def audit_event_rules(events: DataFrame, targets: DataFrame) -> DataFrame:
    """What keeps an audit event out.

    targets(target_kind, target_id, fingerprint, reviewed_json, claim_type, experiment_id,
    extraction_status) is the union of claims, markers and papers; ``reviewed_json`` is the
    content an auditor must have seen.
    """
    t = targets.select("target_kind", "target_id", F.col("reviewed_json").alias("_expected"), F.col("claim_type").alias("_type"),
                       F.col("experiment_id").alias("_experiment"), F.col("extraction_status").alias("_extraction"), F.lit(True).alias("_known"))
    up = {c: F.upper(c) for c in ("target_kind", "decision", "provenance_type", "source_kind")}
    rows = events.withColumns(up).join(t, ["target_kind", "target_id"], "left")
    c = F.col
    blank = lambda n: blank_to_null(c(n).cast("string")).isNull()
    unknown = lambda n, names: ~F.coalesce(c(n).isin(*names), F.lit(False))
    verified = c("decision").isin("VERIFIED", "PARTIALLY_VERIFIED")
    is_claim, known = c("target_kind") == "CLAIM", c("_known").isNotNull()
    scope = F.trim(F.coalesce("search_scope", F.lit("")))
    missing = blank("target_kind")
    for name in ("target_id", "decision", "justification", "auditor_id", "audited_at", "provenance_type", "source_kind", "source_edition"):
        missing = missing | blank(name)
    return row_rules(rows, "AUDIT_EVENT", c("event_id"), [
        ("field_missing", missing, "a required field is blank"),
        ("target_kind_unknown", unknown("target_kind", V.AUDIT_TARGETS), ""), ("decision_unknown", unknown("decision", V.AUDIT_DECISIONS), ""),
        ("provenance_unknown", unknown("provenance_type", V.PROVENANCE), ""), ("source_unknown", unknown("source_kind", V.AUDIT_SOURCES), ""),
        ("time_invalid", audited_at(c("audited_at")).isNull(), "not an ISO-8601 date or zoned time"),
        ("verified_without_author_provenance", verified & unknown("provenance_type", V.AUTHOR_PROVENANCE), ""),
        ("verified_without_primary_source", verified & unknown("source_kind", V.AUDIT_PRIMARY_SOURCES), ""),
        ("verified_without_located_evidence", verified & (blank("evidence") | (c("page").isNull() & (F.coalesce("section", F.lit("")) == "") & (F.coalesce("locator", F.lit("")) == ""))), ""),
        ("absence_on_value", (c("decision") == "NOT_REPORTED") & (c("target_kind") != "MARKER"), "absence needs a marker"),
        ("absence_scope_thin", (c("decision") == "NOT_REPORTED") & ((F.length(scope) < 30) | F.lower(scope).rlike("keyword|mot-clé")), "absence needs a documented search"),
        ("paper_scope_thin", (c("target_kind") == "PAPER") & (c("decision") == "VERIFIED") & (F.length(scope) < 30), ""),
        ("page_invalid", c("page") < 1, ""), ("target_missing", ~known, "no such claim, marker or paper"),
        ("reviewed_differs", known & ~c("reviewed_json").eqNullSafe(c("_expected")), "reviewed content is not the stored content"),
        ("provenance_differs", known & is_claim & verified & ~c("_type").eqNullSafe(c("provenance_type")), "differs from the imported claim"),
        ("review_label_as_experiment", known & is_claim & verified & F.contains(F.coalesce("_experiment", F.lit("")), F.lit("SOURCE_REVIEW")), ""),
        ("absence_on_other_marker", known & (c("target_kind") == "MARKER") & (c("decision") == "NOT_REPORTED") & ~c("_extraction").eqNullSafe(F.lit("NOT_REPORTED")), ""),
    ])


def audit_report_rules(reports: DataFrame, sources: DataFrame, items: DataFrame, papers: DataFrame, claims: DataFrame) -> DataFrame:
    """What keeps an independent audit report out.

    reports(report_id, report_kind, paper_id, doi); sources(report_id, name, source_kind,
    sha256, actual_sha256): pinned files, the last column being the hash of what is on disk;
    items(report_id, claim_id, corroborating_kind, corroborating_sha256). A report names one
    paper by its own DOI, repeats no claim, and pins every source it leans on.
    """
    known = papers.select("paper_id", F.lower("doi").alias("_doi"))
    heads = row_rules(reports.join(known, "paper_id", "left"), "AUDIT_REPORT", F.col("report_id"), [
        ("report_kind", ~F.col("report_kind").eqNullSafe(F.lit("INDEPENDENT_SCIENTIFIC_AUDIT")), ""),
        ("doi_differs", ~F.lower("doi").eqNullSafe(F.col("_doi")), "report DOI is not the paper's"),
    ])
    files = row_rules(sources, "AUDIT_REPORT", F.concat_ws("/", "report_id", "name"), [("source_hash", ~F.col("sha256").eqNullSafe(F.col("actual_sha256")), "file is missing or has changed")])
    named = F.concat_ws("/", "report_id", "claim_id")
    pins = sources.select("report_id", F.col("source_kind").alias("corroborating_kind"), F.col("sha256").alias("corroborating_sha256"))
    loose = items.filter(F.coalesce("corroborating_kind", F.lit("")) != "").join(pins, ["report_id", "corroborating_kind", "corroborating_sha256"], "left_anti")
    owners = claims.select("claim_id", F.col("paper_id").alias("_owner"))
    placed = items.join(reports.select("report_id", "paper_id"), "report_id").join(owners, "claim_id", "left")
    return all_violations([
        heads, files, broken(loose, "corroboration_not_pinned", "AUDIT_REPORT", named), broken(repeated(items, ["report_id", "claim_id"]), "claim_repeated", "AUDIT_REPORT", named),
        row_rules(placed, "AUDIT_REPORT", named, [("claim_of_other_paper", ~F.col("_owner").eqNullSafe(F.col("paper_id")), "")]),
    ])


def latest_audits(events: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Newest audit per target by absolute time, with ``current``: the audited content still stands.

    events(target_kind, target_id, decision, at, created_at, event_id, target_fingerprint, ...).
    """
    last = newest(events, ["target_kind", "target_id"], ["at", "created_at", "event_id"])
    now = fingerprints.select("target_kind", "target_id", F.col("fingerprint").alias("_now"))
    out = last.join(now, ["target_kind", "target_id"], "left")
    return out.withColumn("current", F.coalesce(F.col("target_fingerprint") == F.col("_now"), F.lit(False))).drop("_now")


def promotion_faults(rows: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """rows(target_id, fingerprint, status, independent_audit) whose status no audit carries.

    A verified status must repeat the newest decision on the present content; any attested
    audit marker needs at least one such audit.
    """
    final = ["VERIFIED", "PARTIALLY_VERIFIED"] + (["NOT_REPORTED"] if kind == "MARKER" else [])
    mine = events.filter(F.col("target_kind") == kind).join(
        rows.select("target_id", F.col("fingerprint").alias("target_fingerprint")), ["target_id", "target_fingerprint"], "left_semi")
    last = newest(mine.select("target_id", "decision", "at", "created_at", "event_id"), ["target_id"], ["at", "created_at", "event_id"])
    out = rows.join(last.select("target_id", F.col("decision").alias("_decision")), "target_id", "left")
    wrong = F.col("status").isin(*final) & ~F.col("_decision").eqNullSafe(F.col("status"))
    bare = not_pending(F.nullif("independent_audit", F.lit(""))) & F.col("_decision").isNull()
    return out.select("target_id", F.when(F.coalesce(wrong, F.lit(False)), "STATUS_NOT_AUDITED").when(bare, "AUDIT_MARKER_WITHOUT_AUDIT").alias("fault")).filter("fault is not null")


def binding_faults(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Audits on a claim's present content whose reviewed text is not that content."""
    now = claims.select(F.col("claim_id").alias("target_id"), F.col("fingerprint").alias("target_fingerprint"), F.col("reviewed_json").alias("_bound"))
    rows = events.filter("target_kind = 'CLAIM'").join(now, ["target_id", "target_fingerprint"])
    return rows.filter(~F.col("reviewed_json").eqNullSafe(F.col("_bound"))).select("event_id", "target_id")


# --- papers -----------------------------------------------------------------------------

def operational_states(papers: DataFrame, claims: DataFrame, markers: DataFrame, latest: DataFrame, coverage: DataFrame) -> DataFrame:
    """Extraction, verification and blocker state per paper, from one pass over each table.

    claims(claim_id, paper_id, scientific_status, evidence_review, located); markers(paper_id);
    latest is ``latest_audits``; coverage(paper_id, coverage_level, evidence_basis,
    review_scope_documented, follow_up) is the newest row per paper.
    """
    audits = latest.filter("target_kind = 'CLAIM'").select(F.col("target_id").alias("claim_id"), "decision", "current")
    decided = lambda *d: F.count_if(F.col("current") & F.col("decision").isin(*d))
    disputed = (F.col("scientific_status") == "CONFLICT") | F.coalesce(F.startswith("evidence_review", F.lit("CONFLICT_REVIEW")), F.lit(False))
    per_claim = claims.join(audits, "claim_id", "left").groupBy("paper_id").agg(
        F.count("*").alias("claims"), F.count_if("current").alias("reviewed"), decided("VERIFIED").alias("verified"),
        decided("PARTIALLY_VERIFIED").alias("partially_verified"), F.count_if(~F.col("current")).alias("stale"),
        F.count_if(disputed).alias("_disputed"), decided("CONFLICT").alias("_conflicts"), decided("BLOCKED", "EXTRACTION_ERROR").alias("_blocked"),
        F.count_if("located").alias("locatable"))
    per_marker = markers.groupBy("paper_id").agg(F.count("*").alias("markers"))
    attested = latest.filter("target_kind = 'PAPER' and current and decision = 'VERIFIED'").filter(F.length(F.trim("search_scope")) >= 30).select(
        F.col("target_id").alias("paper_id"), F.lit(True).alias("_attested"))
    out = papers.select("paper_id").join(per_claim, "paper_id", "left").join(per_marker, "paper_id", "left").join(attested, "paper_id", "left").join(
        coverage.select("paper_id", "coverage_level", "evidence_basis", "review_scope_documented", "follow_up"), "paper_id", "left")
    counts = ["claims", "reviewed", "verified", "partially_verified", "stale", "_disputed", "_conflicts", "_blocked", "locatable", "markers"]
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts} | {"_attested": F.coalesce("_attested", F.lit(False))})
    c = F.col
    conflict, blocker = (c("_disputed") + c("_conflicts")) > 0, (c("stale") + c("_blocked")) > 0
    primary = F.coalesce(c("evidence_basis").rlike("FULLTEXT|CODE"), F.lit(False))
    scoped = F.coalesce(c("review_scope_documented") == "YES", F.lit(False))
    candidate = (c("claims") > 0) & scoped & primary & (c("locatable") > 0)
    return out.select(
        "paper_id",
        F.when(c("claims") == 0, "NOT_EXTRACTED").when(candidate, "READY_FOR_AUDIT").otherwise("PARTIAL").alias("extraction_state"),
        F.when((c("claims") > 0) & (c("verified") == c("claims")) & (c("markers") == 0) & ~conflict & ~blocker & c("_attested"), "FULLY_VERIFIED")
        .when((c("verified") + c("partially_verified")) > 0, "PARTIALLY_VERIFIED").otherwise("NOT_VERIFIED").alias("verification_state"),
        F.when(conflict, "CONFLICT").when(blocker, "BLOCKED").otherwise("CLEAR").alias("conflict_blocker_state"),
        candidate.alias("audit_candidate"), c("_attested").alias("completion_candidate"), F.nullif("coverage_level", F.lit("")).alias("declared_coverage"),
        blank_to_null(c("follow_up")).alias("follow_up"), "claims", "reviewed", "verified", "partially_verified", "markers", "stale", "locatable")


def paper_catalogue(papers: DataFrame, states: DataFrame, text: str | None = None, **wanted: str | None) -> DataFrame:
    """Papers with their states under optional filters; ``text`` looks at title and DOI."""
    out = papers.join(states, "paper_id")
    if text:
        needle = F.lit(text.lower())
        out = out.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), needle) | F.contains(F.lower(F.coalesce("doi", F.lit(""))), needle))
    for column, value in wanted.items():
        if value:
            out = out.filter(F.col(column) == value)
    return out


# --- fields -----------------------------------------------------------------------------

def field_statuses(claims: DataFrame, markers: DataFrame, contract: DataFrame) -> DataFrame:
    """Status of every field a paper has a claim or a marker for, and whether the contract knows it.

    All claim statuses, the markers' own non-default statuses, and a candidate absence are
    shown together, sorted. Fields with neither stay NOT_EXTRACTED; ``field_totals`` counts them.
    """
    c = claims.select("paper_id", "field_path", F.col("scientific_status").alias("status"), F.lit(1).alias("_claim"))
    own = F.when(F.col("scientific_status") != "NOT_VERIFIED", F.col("scientific_status"))
    absent = F.when(F.col("extraction_status") == "NOT_REPORTED", F.lit("NOT_REPORTED_CANDIDATE"))
    m = markers.select("paper_id", "field_path", F.explode(F.array(own, absent)).alias("status"), F.lit(None).cast("int").alias("_claim"))
    rows = c.unionByName(m).groupBy("paper_id", "field_path").agg(
        F.array_join(F.array_sort(F.collect_set("status")), "|").alias("_statuses"), F.count("_claim").alias("n_claims"))
    known = contract.select("field_path", F.lit(True).alias("_known"))
    return rows.join(known, "field_path", "left").select(
        "paper_id", "field_path", F.coalesce(F.nullif("_statuses", F.lit("")), F.lit("NOT_EXTRACTED")).alias("status"), "n_claims",
        F.coalesce("_known", F.lit(False)).alias("contracted"))


def field_totals(statuses: DataFrame, papers: DataFrame, contract: DataFrame) -> DataFrame:
    """Populated and not-extracted contract fields per paper."""
    size = contract.agg(F.count("*").alias("_size"))
    n = statuses.filter("contracted").groupBy("paper_id").agg(
        F.count_if(F.col("n_claims") > 0).alias("populated"), F.count_if(F.col("status") != "NOT_EXTRACTED").alias("_seen"))
    out = papers.select("paper_id").join(n, "paper_id", "left").crossJoin(F.broadcast(size))  # size: one row
    return out.select("paper_id", F.coalesce("populated", F.lit(0)).alias("populated"), (F.col("_size") - F.coalesce("_seen", F.lit(0))).alias("not_extracted"))


def paper_fields(contract: DataFrame, slots: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of papers in contract order: those a record slot names first, then by declared path.

    One row per (paper, field, claim) with ``place``; claims outside the contract come with a
    null position.
    """
    slotted = slots.join(claims.select("paper_id", "claim_id"), ["paper_id", "claim_id"]).select("paper_id", "claim_id", "field_path", F.lit("slot").alias("place"))
    loose = claims.join(slots.select("paper_id", "claim_id"), ["paper_id", "claim_id"], "left_anti").select("paper_id", "claim_id", "field_path", F.lit("path").alias("place"))
    return slotted.unionByName(loose).join(contract.select("field_path", "position"), "field_path", "left")


def contract_view(contract: DataFrame, papers: DataFrame, slots: DataFrame, claims: DataFrame, markers: DataFrame, latest: DataFrame) -> DataFrame:
    """Every contract field of every paper with what it holds, and what a paper holds outside the contract.

    One row per (paper, field, item): (paper_id, field_path, position, status, kind, item_id, place, verification_state). ``kind`` is
    claim, marker, or empty for a contract field with neither, which are filled in from the gaps of each paper's fields. Claims stand
    where a record slot names them, else at their own path; one in a slot outside the contract is not shown. ``position`` is null
    outside the contract.
    """
    audits = latest.select("target_kind", F.col("target_id").alias("item_id"), "decision", "current")
    state = verification_state(F.col("decision"), F.col("current")).alias("verification_state")
    own = claims.select("paper_id", "claim_id", "scientific_status")
    placed = paper_fields(contract, slots, claims).filter("place = 'path' or position is not null").join(own, ["paper_id", "claim_id"])
    status = field_statuses(placed, markers, contract).select("paper_id", "field_path", "status")
    items = placed.select("paper_id", "field_path", F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("item_id"), "place").unionByName(
        markers.select("paper_id", "field_path", F.lit("marker").alias("kind"), F.col("marker_id").cast("string").alias("item_id"), F.lit("path").alias("place")))
    judged = items.withColumn("target_kind", F.upper("kind")).join(audits, ["target_kind", "item_id"], "left")
    shown = judged.join(status, ["paper_id", "field_path"]).select("paper_id", "field_path", "status", "kind", "item_id", "place", state)
    filled = items.select("paper_id", "field_path").distinct()
    none = F.lit(None).cast("string")
    empty = unset_cells(filled, papers.select("paper_id").distinct(), contract.select("field_path").distinct(), "paper_id", "field_path").select(
        "paper_id", "field_path", F.lit("NOT_EXTRACTED").alias("status"), F.lit("empty").alias("kind"), none.alias("item_id"), none.alias("place"), none.alias("verification_state"))
    return shown.unionByName(empty).join(contract.select("field_path", "position"), "field_path", "left")


def claim_view(claims: DataFrame, latest: DataFrame) -> DataFrame:
    """Claims as served: parsed value beside the raw one, and the state of their audit."""
    from attestry.functions.text import claim_value

    audits = latest.filter("target_kind = 'CLAIM'").select(F.col("target_id").alias("claim_id"), "decision", "current")
    out = claims.join(audits, "claim_id", "left")
    return out.withColumns({"value_json": claim_value(F.col("value")), "verification_state": verification_state(F.col("decision"), F.col("current"))}).drop("decision", "current")
