"""Staging packages: repair, validate, resolve identities, plan the merge, publish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.identity import doi_key, row_fingerprint
from attestry.functions.text import split_keys, status_token, title_key
from attestry.operators.keyed import lookup, repeated
from attestry.operators.validate import all_violations, broken, row_rules


# --- predicates -------------------------------------------------------------------------

def is_marker(status: Column) -> Column:
    """The row says a field was looked for and not found; it carries no value."""
    return F.coalesce(status.isin(*V.MARKER_STATUSES), F.lit(False))


def not_pending(audit: Column) -> Column:
    return F.coalesce(~audit.isin(*V.PENDING_AUDIT), F.lit(False))


def is_attested(status: Column, audit: Column) -> Column:
    """An independent audit stands behind the row, so an import may not replace it."""
    return F.coalesce(status.isin(*V.ATTESTED_STATUSES), F.lit(False)) | F.coalesce(~audit.isin("", *V.PENDING_AUDIT), F.lit(False))


def claim_row_fingerprint(claims: DataFrame) -> Column:
    """Fingerprint of a claim row. JSON drops nulls, so an empty optional column is no content."""
    return row_fingerprint(F.struct(*sorted(claims.columns)))


# --- repair -----------------------------------------------------------------------------

def realign_gaps(gaps: DataFrame) -> DataFrame:
    """Undo one recognised column shift; the cells as supplied stay in ``realigned_from``."""
    ids = lambda c: F.coalesce(F.col(c).rlike(V.PAPER_ID_LIST), F.lit(False))
    shifted = F.coalesce(F.col("candidate_topic").rlike(V.GAP_ID), F.lit(False)) & ids("testable_question") & ~ids("basis_paper_ids")
    supplied = F.when(shifted, F.to_json(F.struct("candidate_topic", "testable_question", "basis_paper_ids")))
    swap = lambda a, b: F.when(shifted, F.col(b)).otherwise(F.col(a)).alias(a)
    rest = [c for c in gaps.columns if c not in ("testable_question", "basis_paper_ids")]
    return gaps.select(*rest, swap("testable_question", "basis_paper_ids"), swap("basis_paper_ids", "testable_question"), supplied.alias("realigned_from"))


def split_marker_reasons(claims: DataFrame) -> DataFrame:
    """A marker whose value reads ``STATUS: reason`` keeps the status; the cell stays in ``value_as_supplied``."""
    head = F.concat("extraction_status", F.lit(":"))
    reason = F.trim(F.substr("value", F.length(head) + 1))
    fits = is_marker(F.col("extraction_status")) & F.startswith("value", head) & (reason != "")
    fits = F.coalesce(fits, F.lit(False))
    return claims.withColumns({"value_as_supplied": F.when(fits, F.col("value")), "value": F.when(fits, F.col("extraction_status")).otherwise(F.col("value"))})


# --- rules ------------------------------------------------------------------------------

def declared_counts(start_here: DataFrame, actual: DataFrame, labels: dict[str, str]) -> DataFrame:
    """start_here(label, text) against actual(sheet, n): a declared count must be the row count."""
    spark = start_here.sparkSession
    names = spark.createDataFrame(list(labels.items()), "label string, sheet string")
    declared = start_here.filter(F.trim("text").rlike("^[0-9]+$")).select("label", F.trim("text").cast("bigint").alias("declared"))
    wrong = declared.join(F.broadcast(names), "label").join(actual, "sheet").filter("declared <> n")  # names: a fixed list
    return broken(wrong, "declared_count", "START_HERE", F.col("label"), F.concat_ws(" vs ", "declared", "n"))


def contract_rules(contract: DataFrame) -> DataFrame:
    rows = row_rules(contract, "FIELD_CONTRACT", F.col("field_path"), [
        ("contract_path_missing", F.coalesce(F.col("field_path"), F.lit("")) == "", "row without field_path"),
        ("contract_path_mismatch", F.col("field_path") != F.concat_ws(".", F.coalesce("group", F.lit("None")), F.coalesce("field_name", F.lit("None"))), "is not group.field_name"),
    ])
    return rows.unionByName(broken(repeated(contract, ["field_path"]), "contract_path_repeated", "FIELD_CONTRACT", F.col("field_path")))


def paper_identity_rules(index: DataFrame) -> DataFrame:
    """paper_index(paper_id, title, year, doi, scientific_audit_status): one id, DOI and title/year per work."""
    keyed = index.select("paper_id", doi_key(F.col("doi")).alias("doi_key"), title_key(F.col("title")).alias("title_key"),
                         F.coalesce(F.col("year").cast("string"), F.lit("None")).alias("year"), "scientific_audit_status")
    rows = row_rules(keyed, "PAPER_INDEX", F.col("paper_id"), [
        ("paper_id_missing", F.coalesce(F.col("paper_id"), F.lit("")) == "", "row without paper_id"),
        ("paper_audit_not_pending", not_pending(F.col("scientific_audit_status")), "a package cannot carry an attestation"),
    ])
    twice = lambda cols, rule, key: broken(repeated(keyed, cols), rule, "PAPER_INDEX", key)
    return all_violations([
        rows, twice(["paper_id"], "paper_id_repeated", F.col("paper_id")), twice(["doi_key"], "doi_repeated", F.col("doi_key")),
        twice(["title_key", "year"], "title_year_repeated", F.concat_ws("/", "title_key", "year")),
    ])


def claim_rules(claims: DataFrame, index: DataFrame) -> DataFrame:
    """Rules every claim row must pass, whatever the layout."""
    status, value, extraction = F.col("scientific_status"), F.col("value"), F.col("extraction_status")
    marker = is_marker(extraction)
    named = claims.filter(F.coalesce("claim_id", F.lit("")) != "")
    rows = row_rules(named, "SCIENTIFIC_CLAIMS", F.col("claim_id"), [
        ("claim_path_missing", F.coalesce("field_path", F.lit("")) == "", "no field_path"),
        ("claim_status_refused", status.isin(*V.REFUSED_STATUSES), "status a staging package cannot carry"),
        ("claim_status_unknown", status.isNull() | ~status.isin(*V.ALLOWED_STATUSES, *V.REFUSED_STATUSES), "unknown status"),
        ("claim_value_missing", value.isNull(), "no value"),
        ("claim_audit_not_pending", not_pending(F.col("independent_audit")), "a package cannot carry an attestation"),
        ("extraction_status_unknown", extraction.isNotNull() & ~extraction.isin("EXTRACTED", *V.MARKER_STATUSES), "unknown extraction status"),
        ("marker_with_value", marker & ~value.eqNullSafe(extraction), "a marker carries another value than its status"),
        ("status_word_as_value", (extraction.isNull() | (extraction == "EXTRACTED")) & status_token(value).isin(*V.STATUS_WORDS), "a missing field must be a marker row"),
    ])
    orphans = named.join(index.select("paper_id").distinct(), "paper_id", "left_anti")
    return all_violations([
        rows, broken(claims.filter(F.coalesce("claim_id", F.lit("")) == ""), "claim_id_missing", "SCIENTIFIC_CLAIMS", F.lit("")),
        broken(repeated(claims, ["claim_id"]), "claim_id_repeated", "SCIENTIFIC_CLAIMS", F.col("claim_id")),
        broken(orphans, "claim_paper_unknown", "SCIENTIFIC_CLAIMS", F.col("claim_id"), F.col("paper_id")),
    ])


def slot_rules(claims: DataFrame, slots: DataFrame, contract: DataFrame) -> DataFrame:
    """Claims, record slots(paper_id, field_path, claim_id) and the contract must agree."""
    declared = claims.select("claim_id", F.col("paper_id").alias("_paper"), F.col("field_path").alias("_path")).filter(F.coalesce("claim_id", F.lit("")) != "")
    filed = slots.filter("claim_id is not null")
    one = filed.groupBy("claim_id").agg(F.count("*").alias("_n"), F.max(F.struct("paper_id", "field_path")).alias("_slot"))
    both = declared.join(one, "claim_id", "full")
    elsewhere = ~F.col("_slot.paper_id").eqNullSafe(F.col("_paper")) | ~F.col("_slot.field_path").eqNullSafe(F.col("_path"))
    rows = row_rules(both, "PAPER_RECORDS", F.col("claim_id"), [
        ("claim_in_several_slots", F.col("_n") > 1, "referenced by several record fields"),
        ("claim_without_slot", F.col("_n").isNull(), "not referenced by any record field"),
        ("claim_in_other_slot", F.col("_n").isNotNull() & F.col("_path").isNotNull() & elsewhere, "filed under another paper or field"),
        ("slot_without_claim", F.col("_path").isNull() & F.col("_paper").isNull(), "record references a claim that does not exist"),
    ])
    outside = declared.join(contract.select(F.col("field_path").alias("_path")), "_path", "left_anti")
    return rows.unionByName(broken(outside, "claim_outside_contract", "SCIENTIFIC_CLAIMS", F.col("claim_id"), F.col("_path")))


def record_field_rules(slots: DataFrame, contract: DataFrame) -> DataFrame:
    """Each record has exactly the contract's fields."""
    wanted = contract.select("field_path").distinct()
    size = wanted.agg(F.count("*").alias("_size"))
    marked = slots.select("paper_id", "field_path").distinct().join(wanted.withColumn("_in", F.lit(1)), "field_path", "left")
    counts = marked.groupBy("paper_id").agg(F.count("_in").alias("_known"), F.count_if(F.col("_in").isNull()).alias("_extra"))
    wrong = counts.crossJoin(F.broadcast(size)).filter("_known <> _size or _extra > 0")  # size: one row
    return broken(wrong, "record_fields_differ", "PAPER_RECORDS", F.col("paper_id"), F.concat(F.lit("missing "), F.col("_size") - F.col("_known"), F.lit(", extra "), "_extra"))


def index_record_rules(index: DataFrame, records: DataFrame) -> DataFrame:
    """Index and records list the same papers and agree on title, DOI and year, compared as text."""
    cols = ("title", "doi", "year", "scientific_audit_status")
    side = lambda df, tag: df.select("paper_id", F.lit(True).alias(f"_{tag}"), *[F.col(c).cast("string").alias(f"_{tag}_{c}") for c in cols])
    both = side(index, "i").join(side(records, "r"), "paper_id", "full")
    shared = F.col("_i").isNotNull() & F.col("_r").isNotNull()
    differs = lambda c: shared & ~F.col(f"_i_{c}").eqNullSafe(F.col(f"_r_{c}"))
    errors = row_rules(both, "PAPER_RECORDS", F.col("paper_id"), [
        ("paper_only_in_index", F.col("_r").isNull(), ""), ("paper_only_in_records", F.col("_i").isNull(), ""),
        *[(f"{c}_differs", differs(c), "index and record disagree") for c in cols[:3]],
    ])
    warnings = row_rules(both, "PAPER_RECORDS", F.col("paper_id"), [("audit_state_differs", differs(cols[3]), "both states are preserved, neither is chosen")], "warn")
    repeats = broken(repeated(records, ["paper_id"]), "record_repeated", "PAPER_RECORDS", F.col("paper_id"))
    return all_violations([errors, warnings, repeats])


def gap_rules(gaps: DataFrame, index: DataFrame) -> DataFrame:
    topic, question = F.col("candidate_topic"), F.col("testable_question")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    rows = row_rules(gaps, "RESEARCH_GAPS", topic, [
        ("gap_topic_missing", blank(topic), ""),
        ("gap_question_missing", blank(question) | question.rlike(V.PAPER_ID_LIST), "columns may be shifted"),
        ("gap_status_validated", blank(F.col("status")) | status_token(F.col("status")).rlike(V.ASSERTS_VALIDATION), "a candidate must carry a not-validated status"),
    ])
    cited = gaps.select("candidate_topic", F.explode(split_keys(F.col("basis_paper_ids"))).alias("paper_id"))
    unknown = cited.join(index.select("paper_id").distinct(), "paper_id", "left_anti")
    topics = gaps.select(title_key(topic).alias("topic_key"))
    return all_violations([
        rows, broken(unknown, "gap_paper_unknown", "RESEARCH_GAPS", topic, F.col("paper_id")),
        broken(repeated(topics, ["topic_key"]), "gap_topic_repeated", "RESEARCH_GAPS", F.col("topic_key")),
    ])


def coverage_rules(coverage: DataFrame, index: DataFrame, claims: DataFrame) -> DataFrame:
    """coverage(paper_id, claim_count) against the rows: a count may exceed the claims by marker rows only."""
    ids = coverage.select("paper_id").distinct().withColumn("_c", F.lit(1)).join(index.select("paper_id").distinct().withColumn("_i", F.lit(1)), "paper_id", "full")
    membership = row_rules(ids, "COVERAGE", F.col("paper_id"), [("coverage_only", F.col("_i").isNull(), ""), ("index_only", F.col("_c").isNull(), "")])
    marker = is_marker(F.col("extraction_status"))
    actual = claims.groupBy("paper_id").agg(F.count_if(~marker).alias("_claims"), F.count_if(marker).alias("_markers"))
    rows = lookup(coverage, actual, "paper_id")
    n, extra, said = F.coalesce("_claims", F.lit(0)), F.coalesce("_markers", F.lit(0)), F.col("claim_count")
    within = (said > n) & (said <= n + extra)
    wrong = row_rules(rows, "COVERAGE", F.col("paper_id"), [("coverage_count", ~said.eqNullSafe(n) & ~F.coalesce(within, F.lit(False)), "claims and markers do not explain the count")])
    noted = row_rules(rows, "COVERAGE", F.col("paper_id"), [("coverage_counts_markers", within, "the count includes marker rows")], "warn")
    return all_violations([membership, wrong, noted, broken(repeated(coverage, ["paper_id"]), "coverage_repeated", "COVERAGE", F.col("paper_id"))])


def supplement_totals(start_here: DataFrame, claims: DataFrame, index: DataFrame, coverage: DataFrame, detailed: DataFrame) -> DataFrame:
    """Declared totals of a supplement under its three counting conventions.

    A count holds when it equals the rows; when it follows the formula definitions (markers
    counted as rows, inherited markers only, detailed papers of COVERAGE) it holds with a
    note; extracted and marker counts may also trade marker rows as long as they add up.
    """
    marker = is_marker(F.col("extraction_status"))
    c = claims.agg(F.count("*").alias("rows"), F.count_if(marker).alias("markers"),
                   F.count_if(marker & (F.col("batch_id") == "B03")).alias("inherited"), F.countDistinct(F.when(~marker, F.col("paper_id"))).alias("detailed"))
    v = coverage.agg(F.count_if(F.col("coverage_level") == "INDEX_ONLY").alias("index_only"), F.count_if(F.col("coverage_level").isin("DETAILED", "DETAILED_PARTIAL")).alias("levelled"))
    facts = c.crossJoin(v).crossJoin(index.agg(F.count("*").alias("papers"))).crossJoin(detailed.agg(F.count("*").alias("fresh")))  # one row each
    facts = facts.withColumn("extracted", F.col("rows") - F.col("markers"))
    said = lambda label: F.max(F.when((F.col("label") == label) & F.trim("text").rlike("^[0-9]+$"), F.trim("text").cast("bigint")))
    flags = start_here.agg(
        said("Lignes extraites / historiques").alias("_x"), said("Champs manquants hérités").alias("_m"),
        F.coalesce(F.bool_or(F.col("label") == "Niveaux de couverture (formules)"), F.lit(False)).alias("_formula"),
        said("Papers indexed").alias("_p"), F.coalesce(said("Claims total"), said("Lignes SCIENTIFIC_CLAIMS")).alias("_t"),
        said("Claims before").alias("_before"), said("Claims added").alias("_added"), said("Claims total").alias("_total"))
    trade = (~F.col("_formula") & F.col("_x").isNotNull() & F.col("_m").isNotNull() & ((F.col("_x") != F.col("extracted")) | (F.col("_m") != F.col("markers")))
             & (F.col("_x") + F.col("_m") == F.col("rows")) & (F.col("_m") <= F.col("markers")))
    one = facts.crossJoin(flags).withColumn("_trade", F.coalesce(trade, F.lit(False)))
    sheet_n = {"PAPER_INDEX": "papers", "SCIENTIFIC_CLAIMS": "rows", "DETAILED_PAPERS": "detailed", "NEW_DETAILED_PAPERS": "fresh", "EXTRACTED_ROWS": "extracted", "MARKERS": "markers", "INDEX_ONLY": "index_only"}
    formula_n = {"EXTRACTED_ROWS": "rows", "MARKERS": "inherited", "DETAILED_PAPERS": "levelled"}
    pick = lambda names: F.coalesce(*[F.when(F.col("sheet") == s, F.col(n)) for s, n in names.items()])
    labels = start_here.sparkSession.createDataFrame(list(V.SUPPLEMENT_DECLARED.items()), "label string, sheet string")
    lines = start_here.filter(F.trim("text").rlike("^[0-9]+$")).select("label", F.trim("text").cast("bigint").alias("declared")).join(F.broadcast(labels), "label")
    lines = lines.crossJoin(F.broadcast(one)).withColumns({"_n": pick(sheet_n), "_f": pick(formula_n)})  # one row
    by_formula = F.col("_formula") & F.col("_f").isNotNull()
    exempt = F.col("_trade") & F.col("sheet").isin("EXTRACTED_ROWS", "MARKERS")
    fits = F.when(by_formula, F.col("declared") == F.col("_f")).otherwise(exempt | (F.col("declared") == F.col("_n")) | F.coalesce(F.col("declared") == F.col("_f"), F.lit(False)))
    noted = fits & ~exempt & (F.col("declared") != F.col("_n"))
    return all_violations([
        row_rules(lines, "START_HERE", F.col("label"), [("declared_count", ~fits, "the workbook has another count")]),
        row_rules(lines, "START_HERE", F.col("label"), [("declared_by_formula", noted, "follows the formula definition")], "warn"),
        row_rules(one, "START_HERE", F.lit("totals"), [
            ("totals_undeclared", F.col("_p").isNull() | F.col("_t").isNull(), "paper and claim totals must be declared"),
            ("totals_do_not_add_up", F.col("_before") + F.col("_added") != F.col("_total"), "before + added differs from total")]),
        row_rules(one, "START_HERE", F.lit("totals"), [("markers_counted_as_rows", F.col("_trade"), "markers are imported as markers")], "warn"),
    ])


def type_warnings(claims: DataFrame) -> DataFrame:
    """Markers per kind and claim types outside the provenance classes: kept as supplied, reported."""
    marker = claims.filter(is_marker(F.col("extraction_status"))).groupBy("extraction_status").agg(F.count("*").alias("n"))
    other = claims.filter(F.col("claim_type").isNull() | ~F.col("claim_type").isin(*V.PROVENANCE)).groupBy("claim_type").agg(F.count("*").alias("n"))
    return broken(marker, "markers_present", "SCIENTIFIC_CLAIMS", F.col("extraction_status"), F.col("n"), "warn").unionByName(
        broken(other, "claim_type_outside_classes", "SCIENTIFIC_CLAIMS", F.col("claim_type"), F.col("n"), "warn"))


# --- identity ---------------------------------------------------------------------------

def identity_columns(index: DataFrame) -> DataFrame:
    return index.withColumns({"doi_key": doi_key(F.col("doi")), "title_key": title_key(F.col("title")), "year": F.col("year").cast("string")})


def resolve_papers(incoming: DataFrame, stored: DataFrame, aliases: DataFrame) -> DataFrame:
    """incoming(paper_id, doi_key, title_key, year) to its stored paper: by id, alias, DOI, then title and year.

    A title and year never merge two works that both have a DOI. ``target_id`` is the stored
    id, or the incoming one for a new work; ``matched_on`` is null then.
    """
    ids = stored.select("paper_id", F.col("paper_id").alias("_id"))
    by_alias = aliases.select(F.col("alias_id").alias("paper_id"), F.col("paper_id").alias("_alias"))
    by_doi = stored.filter("doi_key is not null").groupBy("doi_key").agg(F.min("paper_id").alias("_doi"))
    work = lambda: F.when(F.col("title_key").isNotNull(), F.concat_ws("\u0001", "title_key", F.coalesce("year", F.lit("\u0002"))))
    by_title = stored.withColumn("_work", work()).filter("_work is not null").groupBy("_work").agg(F.min(F.struct("paper_id", "doi_key")).alias("_t"))
    out = lookup(incoming.join(ids, "paper_id", "left").join(by_alias, "paper_id", "left"), by_doi, "doi_key")
    out = lookup(out.withColumn("_work", work()), by_title, "_work")
    same = F.when(F.col("_t.doi_key").isNull() | F.col("doi_key").isNull(), F.col("_t.paper_id"))
    matched = (F.when(F.col("_id").isNotNull(), "paper_id").when(F.col("_alias").isNotNull(), "alias").when(F.col("_doi").isNotNull(), "doi")
               .when(same.isNotNull(), "title_year"))
    return out.select(*incoming.columns, F.coalesce("_id", "_alias", "_doi", same, "paper_id").alias("target_id"), matched.alias("matched_on"))


def new_aliases(resolved: DataFrame) -> DataFrame:
    """Ids to remember: a known work that arrived under another name."""
    return resolved.filter(F.col("matched_on").isin("doi", "title_year") & (F.col("target_id") != F.col("paper_id"))).select(
        F.col("paper_id").alias("alias_id"), F.col("target_id").alias("paper_id"), "matched_on")


def canonical_ids(df: DataFrame, aliases: DataFrame, key: str = "paper_id") -> DataFrame:
    """Replaces alias ids by the id they stand for."""
    a = aliases.select(F.col("alias_id").alias(key), F.col("paper_id").alias("_canonical"))
    return lookup(df, a, key).withColumn(key, F.coalesce("_canonical", key)).drop("_canonical")


def doi_conflicts(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming papers whose DOI another stored paper holds."""
    owners = stored.filter("doi_key is not null").select("doi_key", F.col("paper_id").alias("owner"))
    return resolved.filter("doi_key is not null").join(owners, "doi_key").filter("owner <> target_id").select("paper_id", "doi_key", "owner")


def linked_records(papers: DataFrame, store: DataFrame) -> DataFrame:
    """Stored record with the same DOI, per staged paper."""
    by_doi = store.filter("doi is not null").groupBy(F.lower("doi").alias("doi_key")).agg(F.min("id").alias("linked_id"))
    return lookup(papers, by_doi, "doi_key")


def supplement_membership(incoming: DataFrame, stored: DataFrame, aliases: DataFrame) -> DataFrame:
    """A supplement names stored papers only and may add nothing to their identity but a missing DOI."""
    known = stored.select("paper_id", "paper_id", "doi_key", "title_key", "year").toDF("paper_id", "_id", "_doi", "_title", "_year")
    by_alias = aliases.join(known.drop("_id"), "paper_id").select(F.col("alias_id").alias("paper_id"), F.col("paper_id").alias("_id"), "_doi", "_title", "_year")
    names = known.unionByName(by_alias.join(known.select("paper_id"), "paper_id", "left_anti"))
    out = incoming.join(names, "paper_id", "left")
    changed = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    other = changed("title_key", "_title") | changed("year", "_year")
    fills = changed("doi_key", "_doi") & ~other & F.col("_doi").isNull() & F.col("doi_key").isNotNull()
    holders = stored.filter("doi_key is not null").groupBy("doi_key").agg(F.min("paper_id").alias("_holder"), F.max("paper_id").alias("_holder2"))
    out = lookup(out, holders, "doi_key")
    held = F.col("_holder").isNotNull() & ((F.col("_holder") != F.col("_id")) | (F.col("_holder2") != F.col("_id")))
    verdict = (F.when(F.col("_id").isNull(), "UNKNOWN_PAPER").when(fills & held, "DOI_HELD_BY_OTHER").when(fills, "DOI_ADDED")
               .when(other | changed("doi_key", "_doi"), "IDENTITY_CHANGED").otherwise("SAME"))
    return out.select("paper_id", verdict.alias("verdict"))


def marker_overlap(claims: DataFrame) -> DataFrame:
    """Markers on a field that also has an extracted claim; both are kept and shown."""
    marker = is_marker(F.col("extraction_status"))
    extracted = claims.filter(~marker).select("paper_id", "field_path")
    return claims.filter(marker).join(extracted, ["paper_id", "field_path"], "left_semi")


def claim_identity(incoming: DataFrame, stored_claims: DataFrame, stored_markers: DataFrame) -> DataFrame:
    """Ids that return under another paper, field or kind."""
    stored = stored_claims.select("claim_id", F.lit("claim").alias("_kind"), F.col("paper_id").alias("_paper"), F.col("field_path").alias("_path")).unionByName(
        stored_markers.select(F.col("marker_id").alias("claim_id"), F.lit("marker").alias("_kind"), F.col("paper_id").alias("_paper"), F.col("field_path").alias("_path")))
    kind = F.when(is_marker(F.col("extraction_status")), "marker").otherwise("claim")
    rows = incoming.withColumn("kind", kind).join(stored, "claim_id")
    moved = ~(F.col("kind").eqNullSafe(F.col("_kind")) & F.col("paper_id").eqNullSafe(F.col("_paper")) & F.col("field_path").eqNullSafe(F.col("_path")))
    return rows.filter(moved).select("claim_id", "kind", F.col("_kind").alias("stored_kind"), "paper_id", F.col("_paper").alias("stored_paper"), "field_path", F.col("_path").alias("stored_path"))


# --- merge ------------------------------------------------------------------------------

def plan_upsert(incoming: DataFrame, stored: DataFrame, versions: DataFrame, key: str = "key", allow_revert: bool = False) -> DataFrame:
    """What an import does to each row: (key, action).

    incoming(key, fingerprint); stored(key, fingerprint, protected); versions(key,
    fingerprint) ever stored. The tests apply in this order: not stored yet, same content,
    attested, content seen before (stale, or reverted where allowed), anything else. Stored
    rows the package lacks are ``absent`` and stay.
    """
    new = incoming.select(key, F.col("fingerprint").alias("_new"))
    old = stored.select(key, F.col("fingerprint").alias("_old"), "protected")
    seen = versions.select(key, F.col("fingerprint").alias("_new"), F.lit(True).alias("_seen")).distinct()
    rows = new.join(old, key, "full").join(seen, [key, "_new"], "left")
    action = (
        F.when(F.col("_new").isNull(), "absent").when(F.col("_old").isNull(), "created").when(F.col("_new") == F.col("_old"), "unchanged")
        .when(F.col("protected"), "skipped_protected").when(F.col("_seen"), "reverted" if allow_revert else "stale").otherwise("updated"))
    return rows.select(key, action.alias("action"), F.coalesce("_new", "_old").alias("fingerprint"))


def import_counts(plans: dict[str, DataFrame]) -> DataFrame:
    """(entity, action, n) over the plans of a package."""
    return all_rows({name: p.groupBy("action").agg(F.count("*").alias("n")) for name, p in plans.items()}, "entity")


def all_rows(frames: dict[str, DataFrame], column: str) -> DataFrame:
    from attestry.operators.analytics import union
    return union([df.select(F.lit(name).alias(column), *df.columns) for name, df in frames.items()])


def apply_upsert(incoming: DataFrame, stored: DataFrame, plan: DataFrame, key: str = "key") -> DataFrame:
    """The next snapshot: written rows from the package, the others as they were. ``created_at`` survives updates."""
    written = plan.filter(F.col("action").isin("created", "updated", "reverted")).select(key)
    born = stored.select(key, F.col("created_at").alias("_born"))
    fresh = incoming.join(written, key, "left_semi").join(born, key, "left").withColumn("created_at", F.coalesce("_born", "created_at")).drop("_born")
    return stored.join(written, key, "left_anti").unionByName(fresh.select(*stored.columns))


def record_versions(versions: DataFrame, plan: DataFrame, table: str, run_id: str, key: str = "key") -> DataFrame:
    """Version rows to append: every content now stored that was not known before."""
    now = plan.filter(F.col("action").isin("created", "updated", "reverted", "unchanged"))
    rows = now.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), "fingerprint", F.lit(run_id).alias("import_run_id"))
    return rows.join(versions.select("table_name", "row_key", "fingerprint"), ["table_name", "row_key", "fingerprint"], "left_anti")


def changed_in_place(before: DataFrame, after: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """Rows of an append-only table that were edited or removed between two snapshots."""
    mark = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*payload)), 256).alias("_h"))
    rows = mark(before).join(mark(after).withColumnRenamed("_h", "_now"), key, "left")
    fault = F.when(F.col("_now").isNull(), "REMOVED").when(F.col("_now") != F.col("_h"), "EDITED")
    return rows.select(key, fault.alias("fault")).filter("fault is not null")


# --- reads ------------------------------------------------------------------------------

def staging_summary(papers: DataFrame, claims: DataFrame, markers: DataFrame) -> DataFrame:
    """(metric, key, n): table sizes, status histograms, and claims with a page."""
    n = lambda df, metric, key: df.groupBy(F.lit(metric).alias("metric"), F.coalesce(key, F.lit("None")).alias("key")).agg(F.count("*").alias("n"))
    return all_violations([
        n(papers, "papers", F.lit("all")), n(claims, "claims", F.lit("all")), n(claims, "claim_status", F.col("scientific_status")),
        n(claims, "claim_audit", F.col("independent_audit")), n(markers, "markers", F.col("extraction_status")),
        n(claims.filter(F.get_json_object("row_json", "$.pdf_page").isNotNull()), "claims_with_page", F.lit("all")),
    ])


def list_claims(claims: DataFrame, **wanted: str | None) -> DataFrame:
    """Claims under the filters that are set."""
    out = claims
    for column, value in wanted.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def research_gaps(gaps: DataFrame) -> DataFrame:
    """Gap candidates as served: basis ids split, provenance from the status, never author-reported."""
    provenance = F.when(F.coalesce(F.startswith("status", F.lit("AI_INTERPRETATION")), F.lit(False)), "AI_INTERPRETATION").otherwise("TEAM_NOTE")
    return gaps.withColumns({"basis": split_keys(F.col("basis_paper_ids")), "provenance_type": provenance})


def latest_coverage(coverage: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest coverage row per paper, by the time of the run that brought it."""
    dated = coverage.join(runs.select(F.col("id").alias("import_run_id"), "imported_at"), "import_run_id")
    rest = [c for c in coverage.columns if c != "paper_id"]
    return dated.groupBy("paper_id").agg(F.max_by(F.struct(*rest), F.struct("imported_at", "import_run_id")).alias("r")).select("paper_id", "r.*")


