"""From canonical records to field states, entities, mentions and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import evidence as E
from attestry.functions import vocabulary as V
from attestry.functions.identity import canonical_json, stable_id
from attestry.functions.text import contains_ignore_case, entity_key
from attestry.operators.keyed import lookup
from attestry.operators.validate import row_rules
from attestry.session import kept

_V = F.try_variant_get


# --- field states -----------------------------------------------------------------------

def field_states(records: DataFrame, v: str = "v") -> DataFrame:
    """records(paper_id, edition_id, v) to one row per canonical field, in record order."""
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("field_path"), _V(v, f"$.{p}", "variant").alias("f")) for i, p in enumerate(V.FIELD_TYPES)])
    rows = records.select("paper_id", "edition_id", F.explode(cells).alias("c")).select("paper_id", "edition_id", "c.*")
    text = lambda p: _V("f", f"$.{p}", "string")
    value = _V("f", "$.value", "variant")
    source = "struct<section:string,page:int,locator:string,evidence:string,origin:string,source_edition_key:string,claimed_value:variant>"
    many = F.coalesce(_V("f", "$.sources", f"array<{source}>"), F.array().cast(f"array<{source}>"))
    alternatives = F.coalesce(_V("f", "$.conflict_values", "array<variant>"), F.array().cast("array<variant>"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    claimed = lambda s: F.when(~F.coalesce(F.is_variant_null(s["claimed_value"]), F.lit(True)), canonical_json(s["claimed_value"]))
    shape = lambda s: F.struct(
        blank(s["section"]).alias("section"), s["page"].alias("page"), blank(s["locator"]).alias("locator"), blank(s["evidence"]).alias("evidence"),
        s["origin"].alias("origin"), blank(s["source_edition_key"]).alias("edition_key"), claimed(s).alias("claimed_json"))
    default = (F.when(F.col("field_path") == "limitations.ai_interpretation", "AI_INTERPRETATION").when(F.col("field_path") == "limitations.team_note", "TEAM_NOTE")
               .when(F.startswith("field_path", F.lit("limitations.")), "AUTHOR_REPORTED_LIMITATION").otherwise("AUTHOR_REPORTED_FACT"))
    return rows.select(
        "paper_id", "edition_id", "pos", "field_path",
        F.when(value.isNotNull() & ~F.is_variant_null(value), canonical_json(value)).alias("value_json"), F.transform(alternatives, lambda a: canonical_json(a)).alias("conflict_values"),
        F.coalesce(text("status"), F.lit("NOT_REPORTED")).alias("status"), F.coalesce(text("provenance_type"), default).alias("provenance_type"),
        F.coalesce(_V("f", "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.transform(F.concat(F.array_compact(F.array(_V("f", "$.source", source))), many), shape).alias("sources"),
        text("verified_by").alias("verified_by"), text("verified_at").alias("verified_at"))


def value_kind(value_json: Column) -> Column:
    """JSON type of a canonical value; integers and other numbers differ."""
    return (F.when(F.startswith(value_json, F.lit('"')), "string").when(F.startswith(value_json, F.lit("[")), "list").when(F.startswith(value_json, F.lit("{")), "object")
            .when(value_json.isin("true", "false"), "boolean").when(value_json.rlike("^-?[0-9]+$"), "integer").when(value_json.isNotNull(), "number"))


def field_rules(states: DataFrame) -> DataFrame:
    """Status, value, evidence and provenance must fit together, in every field."""
    c = F.col
    types = F.create_map(*[F.lit(x) for pair in V.FIELD_TYPES.items() for x in pair])
    states = states.withColumn("_expected", F.try_element_at(types, c("field_path")))  # looked up once a row
    expected = c("_expected")
    strings = lambda j: F.forall(F.coalesce(_V(F.try_parse_json(j), "$", "array<variant>"), F.array().cast("array<variant>")),
                                 lambda i: (F.schema_of_variant(i) == "STRING") & (F.trim(_V(i, "$", "string")) != ""))
    fits = lambda j: ((value_kind(j) == expected) & ((expected != "list") | strings(j)) & ((expected != "string") | (F.trim(E.plain(j)) != "")))
    author = c("provenance_type").isin(*V.AUTHOR_PROVENANCE)
    conflict = c("status") == "CONFLICT"
    supplied = F.filter("sources", E.is_supplied)
    distinct = F.array_distinct("conflict_values")
    claimed = F.transform(F.filter(supplied, lambda s: s["claimed_json"].isNotNull()), lambda s: s["claimed_json"])
    covered = F.transform(F.filter("sources", lambda s: E.qualifies(s) & s["claimed_json"].isNotNull()), lambda s: s["claimed_json"])
    fact_section = ~F.startswith("field_path", F.lit("limitations."))
    limitation = F.when(c("field_path") == "limitations.ai_interpretation", "AI_INTERPRETATION").when(c("field_path") == "limitations.team_note", "TEAM_NOTE").otherwise("AUTHOR_REPORTED_LIMITATION")
    checked = c("status").isin("VERIFIED", "PARTIALLY_VERIFIED")
    return row_rules(states, "FIELD", F.concat_ws("/", "paper_id", "field_path"), [
        ("path_unknown", expected.isNull(), "not a canonical field"),
        ("value_type", c("value_json").isNotNull() & ~fits(c("value_json")), "values are never coerced"),
        ("alternative_type", ~F.forall("conflict_values", lambda j: F.coalesce(fits(j), F.lit(False))), ""),
        ("claim_without_value", c("status").isin(*V.CLAIM_STATUSES) & ~E.has_value(c("value_json")), ""),
        ("verified_provenance", (checked | conflict) & ~author, "needs author-reported provenance"),
        ("verified_evidence", checked & ~E.has_exact_evidence(c("sources")), "needs located primary evidence"),
        ("conflict_with_value", conflict & c("value_json").isNotNull(), ""), ("conflict_alternatives", conflict & (F.size(distinct) < 2), "needs two distinct alternatives"),
        ("conflict_unbound", conflict & F.exists(supplied, lambda s: s["claimed_json"].isNull()), "every source names its alternative"),
        ("conflict_stray_claim", conflict & (F.size(F.array_except(claimed, distinct)) > 0), ""), ("conflict_uncovered", conflict & (F.size(F.array_except(distinct, covered)) > 0), ""),
        ("alternatives_without_conflict", ~conflict & (F.size("conflict_values") > 0), ""), ("binding_without_conflict", ~conflict & (F.size(claimed) > 0), ""),
        ("absent_with_value", (c("status") == "NOT_REPORTED") & c("value_json").isNotNull(), ""),
        ("fact_provenance", fact_section & (checked | conflict) & (c("provenance_type") != "AUTHOR_REPORTED_FACT"), ""),
        ("limitation_provenance", ~fact_section & (c("provenance_type") != limitation), ""),
    ])


def evidence_rows(states: DataFrame, editions: DataFrame | None = None, key: Sequence[str] = ("paper_id", "edition_id", "field_path")) -> DataFrame:
    """Supplied evidence of every field as ordered rows, bound to its source edition.

    editions(paper_id, edition_key, id): an edition a source names must exist; ``bound`` is
    false otherwise. Sources that name none belong to the field's own edition.
    """
    rows = states.select(*key, F.posexplode(F.filter("sources", E.is_supplied)).alias("evidence_order", "s")).select(*key, "evidence_order", "s.*")
    if editions is None:
        return rows
    known = editions.select(F.concat_ws("\u0001", "paper_id", "edition_key").alias("_named"), F.col("id").alias("_edition"))
    named = rows.withColumn("_named", F.when(F.col("edition_key").isNotNull(), F.concat_ws("\u0001", "paper_id", "edition_key")))
    out = lookup(named, known, "_named")
    return out.withColumns({"source_edition_id": F.coalesce("_edition", F.when(F.col("_named").isNull(), F.col("edition_id"))),
                            "bound": F.col("_named").isNull() | F.col("_edition").isNotNull()}).drop("_named", "_edition")


# --- entities ---------------------------------------------------------------------------

def _alternatives(states: DataFrame) -> DataFrame:
    """One row per alternative (its index, else null) with its JSON text."""
    conflict = F.col("status") == "CONFLICT"
    options = F.when(conflict, F.transform("conflict_values", lambda v, i: F.struct(i.alias("i"), v.alias("j")))).otherwise(
        F.array(F.struct(F.lit(None).cast("int").alias("i"), F.col("value_json").alias("j"))))
    return states.select("*", F.explode(options).alias("o")).select("*", F.col("o.i").alias("alternative_index"), F.col("o.j").alias("claimed")).drop("o").filter("claimed is not null")


def _items(claimed: Column) -> Column:
    """List items, or the value itself, as VARIANTs."""
    v = F.try_parse_json(claimed)
    return F.when(F.startswith(claimed, F.lit("[")), _V(v, "$", "array<variant>")).otherwise(F.array(v))


def mentions(states: DataFrame) -> DataFrame:
    """Entities a paper names: one row per distinct value, list item or alternative.

    Only author-reported fields count; blank and non-text items are dropped. ``evidence`` of
    an alternative is what is bound to it.
    """
    of = lambda k: F.create_map(*[F.lit(x) for row in V.ENTITY_FIELDS for x in (row[0], row[k])])
    rows = states.filter(F.col("field_path").isin(*[r[0] for r in V.ENTITY_FIELDS]) & (F.col("status") != "EXTRACTION_ERROR") & F.col("provenance_type").isin(*V.AUTHOR_PROVENANCE))
    # texts are taken out before the lists are exploded: a VARIANT column counts 2 KB a row in size estimates
    texts = F.transform(_items(F.col("claimed")), lambda i: F.when(F.schema_of_variant(i) == "STRING", F.trim(_V(i, "$", "string"))))
    named = _alternatives(rows).select("*", F.explode(texts).alias("wording")).filter("wording <> ''")
    supplied = F.filter("sources", E.is_supplied)
    own = F.when(F.col("status") == "CONFLICT", F.filter(supplied, lambda s: s["claimed_json"] == F.col("claimed"))).otherwise(supplied)
    return named.select(
        "paper_id", "edition_id", "field_path", F.element_at(of(1), F.col("field_path")).alias("entity_type"), F.element_at(of(2), F.col("field_path")).alias("relationship"),
        entity_key(F.col("wording")).alias("normalized_key"), "wording", "status", "provenance_type", "alternative_index", "claimed", own.alias("evidence"),
    ).withColumn("mention_id", stable_id(*[F.col(c) for c in ("paper_id", "edition_id", "field_path", "entity_type", "normalized_key", "alternative_index")]))


def entities(mention_rows: DataFrame, seen: str = "paper_id") -> DataFrame:
    """One entity per (type, key); the name it was first seen with is kept."""
    out = mention_rows.groupBy("entity_type", "normalized_key").agg(F.min_by("wording", F.struct(seen, "field_path", "wording")).alias("canonical_name"))
    return out.withColumn("entity_id", stable_id(F.col("entity_type"), F.col("normalized_key")))


def merge_entities(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored entities stay as they are; new keys are added."""
    return stored.unionByName(fresh.join(stored.select("entity_id"), "entity_id", "left_anti").select(*stored.columns))


def entity_list(entity_rows: DataFrame, mention_rows: DataFrame, entity_type: str | None = None, text: str | None = None) -> DataFrame:
    """Entities with their paper and mention counts; entities without a mention count zero."""
    out = entity_rows
    if entity_type:
        out = out.filter(F.col("entity_type") == entity_type)
    if text:
        out = out.filter(contains_ignore_case(F.col("canonical_name"), text) | contains_ignore_case(F.col("normalized_key"), text))
    n = mention_rows.groupBy("entity_type", "normalized_key").agg(F.countDistinct("paper_id").alias("paper_count"), F.count("*").alias("mention_count"))
    return out.join(n, ["entity_type", "normalized_key"], "left").na.fill(0, ["paper_count", "mention_count"])


def by_name(name: str = "canonical_name", tie: str = "entity_id") -> list[Column]:
    """Case-blind name order."""
    return [F.lower(name), F.col(tie)]


def entity_mentions(entity_rows: DataFrame, mention_rows: DataFrame) -> DataFrame:
    """Entities with every mention and its evidence in order, as long rows.

    Mentions come from exploded lists, so their size is estimated far too low and they would be
    broadcast. Entities and the keys that are mentioned are stored first: their size is then known.
    """
    key = ["entity_type", "normalized_key"]
    known = kept(entity_rows, "entities")
    m = mention_rows.select(*key, "mention_id", "paper_id", "field_path", "alternative_index", F.posexplode_outer("evidence").alias("evidence_order", "s"))
    named = known.join(m, key).select(*known.columns, *[c for c in m.columns if c not in (*key, "s")], "s.*")
    silent = known.join(kept(mention_rows.select(*key).distinct(), "mentioned"), key, "left_anti")
    return named.unionByName(silent, allowMissingColumns=True)


def typed_rows(states: DataFrame, section: str) -> DataFrame:
    """``results.*`` or ``limitations.*`` as one row per list item or alternative; a silent field gives one empty row."""
    rows = states.filter(F.startswith("field_path", F.lit(f"{section}.")))
    # items of a list; alternatives of a conflict stay whole
    parts = F.when(F.col("status") == "CONFLICT", F.col("conflict_values")).when(
        F.startswith("value_json", F.lit("[")), F.transform(_items(F.col("value_json")), lambda i: canonical_json(i))).otherwise(F.array("value_json"))
    parts = F.when(F.size(parts) == 0, F.array(F.lit(None).cast("string"))).otherwise(parts)
    first = F.get(F.filter("sources", lambda s: F.length(s["evidence"]) > 0), F.lit(0))["evidence"]
    out = rows.select("paper_id", "edition_id", "field_path", "status", "provenance_type", first.alias("_evidence"), F.posexplode(parts).alias("item", "value_json"))
    return out.withColumn("wording", F.coalesce(E.plain(F.col("value_json")), "_evidence")).drop("_evidence")


def hyperparameters(states: DataFrame) -> DataFrame:
    rows = states.filter(F.startswith("field_path", F.lit("training.")))
    value = F.when(F.col("status") == "CONFLICT", F.concat(F.lit("["), F.array_join("conflict_values", ","), F.lit("]"))).otherwise(F.col("value_json"))
    return rows.select("paper_id", "edition_id", F.substring_index("field_path", ".", -1).alias("name"), value.alias("value_json"), "status", "provenance_type")


def statements(states: DataFrame) -> DataFrame:
    kind = F.when(F.col("field_path") == "limitations.future_work", "FUTURE_WORK").otherwise("LIMITATION")
    return typed_rows(states, "limitations").withColumn("statement_type", kind)


def refresh_projection(stored: DataFrame, fresh: DataFrame, scope: DataFrame) -> DataFrame:
    """Replaces the rows of the (paper_id, edition_id) pairs in ``scope``; the rest stays."""
    same = [stored[c].eqNullSafe(scope[c]) for c in ("paper_id", "edition_id")]
    return stored.join(scope, same, "left_anti").unionByName(fresh.select(*stored.columns))


def research_view(states: DataFrame, mention_rows: DataFrame, editions: DataFrame, relations: DataFrame) -> DataFrame:
    """What is known of each paper as long rows (paper_id, part, n)."""
    from attestry.operators.analytics import union

    n = lambda df, part: df.groupBy("paper_id").agg(F.count("*").alias("n")).select("paper_id", F.lit(part).alias("part"), "n")
    under = lambda section: F.startswith("field_path", F.lit(f"{section}."))
    typed = lambda section: F.sum(F.when(under(section), _typed_count()))
    # all that is counted of the fields in one pass, instead of one pass and one hash table per part
    of_fields = states.groupBy("paper_id").agg(
        F.count("*").alias("field_states"), F.count_if(under("training")).alias("hyperparameters"), typed("results").alias("results"), typed("limitations").alias("statements"))
    fields = of_fields.unpivot("paper_id", ["field_states", "hyperparameters", "results", "statements"], "part", "n").filter("n > 0")
    return union([n(editions, "editions"), fields, n(mention_rows, "mentions"), n(relations, "relationships")])


def _typed_count() -> Column:
    """How many rows ``typed_rows`` makes of a field."""
    n = F.when(F.col("status") == "CONFLICT", F.size("conflict_values")).when(F.startswith("value_json", F.lit("[")), F.size(_items(F.col("value_json")))).otherwise(1)
    return F.when(n >= 0, F.greatest(n, F.lit(1))).otherwise(0)


def research_rows(states: DataFrame, mention_rows: DataFrame, editions: DataFrame, relations: DataFrame) -> DataFrame:
    """All that is known of each paper, row by row: (paper_id, part, item, status, detail). ``editions`` has edition_id, ``relations`` edge_id and status."""
    from attestry.operators.analytics import union

    none = F.lit(None).cast("string")

    def part(df: DataFrame, name: str, item: Column, status: Column = none, detail: Column = none) -> DataFrame:
        return df.select("paper_id", F.lit(name).alias("part"), item.cast("string").alias("item"), status.cast("string").alias("status"), detail.cast("string").alias("detail"))

    place = F.concat_ws("#", "field_path", "item")
    status, wording = F.col("status"), F.col("wording")
    return union([
        part(editions, "editions", F.col("edition_id")), part(states, "field_states", F.col("field_path"), status, F.col("value_json")),
        part(mention_rows, "mentions", F.concat_ws("/", "field_path", "entity_type"), none, F.col("normalized_key")),
        part(hyperparameters(states), "hyperparameters", F.col("name"), status, F.col("value_json")), part(typed_rows(states, "results"), "results", place, status, wording),
        part(statements(states), "statements", place, status, wording), part(relations, "relationships", F.col("edge_id"), status)])


def evidence_gather(mention_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """For every entity the rows of every paper that mentions it, each paper once: two hops, from entities to papers and to what they hold."""
    papers = mention_rows.select("entity_type", "normalized_key", "paper_id").distinct()
    return papers.hint("merge").join(rows, "paper_id")  # both grow with the papers, whatever their estimates


# --- relationships ----------------------------------------------------------------------

def relationship_rules(edges: DataFrame) -> DataFrame:
    c = F.col
    checked = c("status").isin("VERIFIED", "PARTIALLY_VERIFIED")
    return row_rules(edges, "RELATIONSHIP", c("edge_id"), [
        ("not_a_claim", c("status").isin("NOT_REPORTED", "EXTRACTION_ERROR"), ""),
        ("evidence_not_located", (F.size("evidence") < 1) | ~F.forall("evidence", E.is_locatable), ""),
        ("evidence_binds_alternative", F.exists("evidence", lambda s: s["claimed_json"].isNotNull()), ""),
        ("verified_without_primary", checked & ~F.exists("evidence", E.is_primary), ""),
        ("verified_provenance", checked & ~c("provenance_type").isin(*V.AUTHOR_PROVENANCE), ""),
    ])


def add_relationships(edges: DataFrame, entity_rows: DataFrame, editions: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to append, refused edges). Both ends and the named edition must exist; edges come
    from statements only, never from co-occurrence, and a repeated edge adds nothing."""
    ids = entity_rows.select("entity_id")
    end = lambda c: ids.select(F.col("entity_id").alias(c), F.lit(True).alias(f"_{c}"))
    rows = edges.join(end("subject_id"), "subject_id", "left").join(end("object_id"), "object_id", "left")
    named = editions.select(F.concat_ws("\u0001", "paper_id", "edition_key").alias("_named"), F.lit(True).alias("_edition"))
    rows = lookup(rows.withColumn("_named", F.when(F.col("edition_key").isNotNull(), F.concat_ws("\u0001", "paper_id", "edition_key"))), named, "_named")
    code = (F.when(F.col("_subject_id").isNull() | F.col("_object_id").isNull(), "ENTITY_UNKNOWN")
            .when(F.col("_named").isNotNull() & F.col("_edition").isNull(), "EDITION_UNKNOWN"))
    rows = rows.withColumns({"code": code, "relationship_id": stable_id(*[F.col(c) for c in ("paper_id", "edition_key", "subject_id", "predicate", "object_id", "source_wording", "status")])})
    rows = rows.drop("_subject_id", "_object_id", "_named", "_edition")
    good = rows.filter("code is null").drop("code").dropDuplicates(["relationship_id"]).join(stored.select("relationship_id"), "relationship_id", "left_anti")
    return good, rows.filter("code is not null")


# --- comparison -------------------------------------------------------------------------

def compare_pairs(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(left_id, right_id) side by side, one row per field of the compared sections."""
    sections = "|".join(V.COMPARISON_SECTIONS)
    rows = states.filter(F.col("field_path").rlike(rf"^({sections})\."))
    cell = lambda side: rows.select(F.col("paper_id").alias(f"{side}_id"), "field_path", F.struct("value_json", "status", "provenance_type").alias(f"{side}_cell"))
    left, right = pairs.join(cell("left"), "left_id"), pairs.join(cell("right"), "right_id")
    both = left.join(right, ["left_id", "right_id", "field_path"], "full")
    return both.withColumn("section", F.substring_index("field_path", ".", 1))


# --- intake -----------------------------------------------------------------------------

def register_editions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome per incoming edition(paper_id, edition_key, content_hash, identity): registered, repeated, or why not."""
    key = ["paper_id", "edition_key"]
    same = stored.select(*key, F.col("identity").alias("_identity"))
    owners = stored.filter("content_hash is not null").groupBy("content_hash").agg(F.min("paper_id").alias("_low"), F.max("paper_id").alias("_high"))
    rows = lookup(incoming.join(same, key, "left"), owners, "content_hash")
    foreign = F.col("_low").isNotNull() & ((F.col("_low") != F.col("paper_id")) | (F.col("_high") != F.col("paper_id")))
    outcome = (F.when(F.col("_identity") == F.col("identity"), "IDENTICAL").when(F.col("_identity").isNotNull(), "KEY_TAKEN").when(foreign, "HASH_TAKEN").otherwise("REGISTERED"))
    return rows.select(*incoming.columns, outcome.alias("outcome"))


def resolve_intake(incoming: DataFrame, identifiers: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming(request_id, identity_key, fingerprint, identifiers array) against the store.

    identifiers(value, paper_id); stored(paper_id, identity_key, fingerprint). All known
    identifiers of a request must name one paper.
    """
    named = incoming.select("request_id", F.explode("identifiers").alias("value")).join(identifiers, "value").groupBy("request_id").agg(
        F.min("paper_id").alias("_low"), F.max("paper_id").alias("_high"))
    by_key = stored.select("identity_key", F.col("paper_id").alias("_by_key"))
    rows = incoming.join(named, "request_id", "left").join(by_key, "identity_key", "left").withColumn("paper_id", F.coalesce("_low", "_by_key"))
    prints = stored.select("paper_id", F.col("fingerprint").alias("_stored"))
    rows = lookup(rows, prints, "paper_id")
    outcome = (F.when(F.col("_low") != F.col("_high"), "IDENTIFIERS_DISAGREE").when(F.col("paper_id").isNull(), "CREATED")
               .when(F.col("_stored") == F.col("fingerprint"), "UNCHANGED").otherwise("DIFFERENT_CONTENT"))
    return rows.select("request_id", F.when(outcome != "IDENTIFIERS_DISAGREE", F.col("paper_id")).alias("paper_id"), outcome.alias("outcome"))


def merge_workflow(old: Column, new: Column) -> Column:
    """The status further along; on a tie the stored one stays."""
    rank = F.create_map(*[F.lit(x) for pair in V.WORKFLOW_RANK.items() for x in pair])
    return F.when(F.element_at(rank, new) > F.element_at(rank, old), new).otherwise(old)


def merge_warnings(old: Column, new: Column) -> Column:
    """The stored warnings in their order, then the new ones not among them; each once. A missing list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))


def upgrade_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """Field by field, what a controlled upgrade keeps: the extraction, the stored metadata
    where the extraction is silent, or a conflict that stops the upgrade."""
    key = ["paper_id", "field_path"]
    side = lambda df, tag: df.select(*key, F.col("status").alias(f"_{tag}s"), F.col("value_json").alias(f"_{tag}v"), F.sha2(F.to_json(F.struct("value_json", "conflict_values", "status", "provenance_type", "confidence", "sources")), 256).alias(f"_{tag}h"), E.has_primary_evidence(F.col("sources")).alias(f"_{tag}p"))
    rows = side(old, "o").join(side(new, "n"), key, "full")
    silent = lambda t: F.coalesce(F.col(f"_{t}s"), F.lit("NOT_REPORTED")) == "NOT_REPORTED"
    bibliography = F.startswith("field_path", F.lit("paper.")) & F.coalesce("_np", F.lit(False))
    keep = (F.when(silent("n"), "STORED").when(silent("o") | (F.col("_oh") == F.col("_nh")) | bibliography, "INCOMING").otherwise("CONFLICT"))
    return rows.select(*key, keep.alias("keep"), F.when(keep == "STORED", F.col("_ov")).when(keep == "INCOMING", F.col("_nv")).alias("value_json"))


def may_upgrade(old: DataFrame, new: DataFrame, workflow: DataFrame) -> DataFrame:
    """Papers whose stored record is bibliography only and whose new record has primary evidence."""
    bare = old.groupBy("paper_id").agg(F.every((F.col("status") == "NOT_REPORTED") | F.startswith("field_path", F.lit("paper."))).alias("_bare"))
    backed = new.groupBy("paper_id").agg(F.bool_or(E.has_primary_evidence(F.col("sources"))).alias("_backed"))
    steps = workflow.filter("old_status = 'INGESTED' and new_status = 'EXTRACTED'").select("paper_id")
    return steps.join(bare.filter("_bare"), "paper_id", "left_semi").join(backed.filter("_backed"), "paper_id", "left_semi")


def fill_bibliography(states: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata fills bibliographic fields that are silent; a different value is reported, not used.

    metadata(paper_id, field_path, value_json, origin).
    """
    m = metadata.filter("value_json is not null and value_json <> '[]'").select("paper_id", "field_path", F.col("value_json").alias("_m"))
    rows = states.join(m, ["paper_id", "field_path"], "left")
    silent = F.col("status") == "NOT_REPORTED"
    outcome = F.when(F.col("_m").isNull(), "KEPT").when(silent, "FILLED").when(F.col("_m").eqNullSafe(F.col("value_json")), "KEPT").otherwise("DIFFERS")
    return rows.select("paper_id", "field_path", F.when(outcome == "FILLED", F.col("_m")).otherwise(F.col("value_json")).alias("value_json"),
                       F.when(outcome == "FILLED", "NOT_VERIFIED").otherwise(F.col("status")).alias("status"), outcome.alias("outcome"))


def backfill_identifiers(papers: DataFrame) -> DataFrame:
    """Identifier rows of papers(paper_id, doi, arxiv, identity_key), each with how many papers claim it."""
    from attestry.functions.identity import valid_arxiv, valid_doi

    tail = lambda prefix: F.when(F.startswith("identity_key", F.lit(prefix)), F.substr("identity_key", F.lit(len(prefix) + 1)))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    ids = F.array(pair("DOI", valid_doi(F.coalesce("doi", tail("doi:")))), pair("ARXIV", valid_arxiv(F.coalesce("arxiv", tail("arxiv:")))))
    rows = papers.select("paper_id", F.explode(ids).alias("i")).select("paper_id", "i.*").filter("value is not null").distinct()
    owners = rows.groupBy("kind", "value").agg(F.count("*").alias("owners"))
    return rows.join(owners, ["kind", "value"])


def normalised_write_back(papers: DataFrame) -> DataFrame:
    """Domains replaced by the vocabulary; the wording as read is kept once."""
    from attestry.functions.rules import normalise_domains

    raw = F.coalesce(F.when(F.size("domains_raw") > 0, F.col("domains_raw")), "domains")
    kept, _ = normalise_domains(F.col("_raw"))
    rows = papers.withColumn("_raw", raw).withColumn("_kept", kept)
    changed = ~F.col("_kept").eqNullSafe(F.col("domains"))
    return rows.withColumns({"domains_raw": F.when(changed, F.col("_raw")).otherwise(F.col("domains_raw")), "domains": F.col("_kept"), "changed": changed}).drop("_raw", "_kept")


def request_rules(requests: DataFrame) -> DataFrame:
    """Intake requests(request_id, doi, metadata, parsed_paper, pdf_path, pdf_url, title, origin)."""
    c = F.col
    given = lambda n: c(n).isNotNull()
    return row_rules(requests, "REQUEST", c("request_id"), [
        ("doi_blank", F.trim("doi") == "", ""), ("source_missing", ~(given("doi") | given("metadata") | given("parsed_paper") | given("pdf_path") | given("pdf_url")), ""),
        ("record_and_file", given("parsed_paper") & (given("pdf_path") | given("pdf_url")), "one source of content only"),
        ("title_blank", F.trim("title") == "", ""), ("origin_not_metadata", given("origin") & ~c("origin").isin(*V.METADATA_ORIGINS), "")])


def manifest_rules(entries: DataFrame) -> DataFrame:
    c = F.col
    blank = (F.trim("doi") == "") | (F.trim("arxiv") == "") | (F.trim("title") == "")
    return row_rules(entries, "MANIFEST", c("manifest_id"), [
        ("identity_missing", F.coalesce("doi", "arxiv", "title").isNull(), "needs a DOI, arXiv id or title"), ("identity_blank", F.coalesce(blank, F.lit(False)), "")])
