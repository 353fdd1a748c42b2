"""Corpus overview: totals, tallies with samples, a year histogram, and the rows behind a count.

Inputs are field states in long form and papers(paper_id, seq, title, year, workflow_status);
``seq`` is the listing order and decides which samples come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import evidence as E
from attestry.functions import vocabulary as V
from attestry.functions.text import drill_path
from attestry.operators.analytics import union
from attestry.operators.keyed import first_of_few


def landing_fields(states: DataFrame, papers: DataFrame) -> DataFrame:
    """Scientific fields with the paper's listing columns and the predicates every tally uses.

    What a field says of itself is decided before the join, so only the columns a caller reads are moved, not evidence and values.
    """
    value = E.has_value(F.col("value_json"))
    exact = E.has_exact_evidence(F.col("sources"))
    claim = F.col("status").isin(*V.CLAIM_STATUSES)
    named = F.col("field_path").isin(*NAMED.values())
    scientific = states.filter(~F.startswith("field_path", F.lit("paper."))).withColumns({
        "section": F.substring_index("field_path", ".", 1),
        "valued": value, "claimed": value | (F.size("conflict_values") > 0), "exact": value & claim & F.col("provenance_type").isin(*V.AUTHOR_PROVENANCE) & exact,
        "usable_fact": value & claim & (F.col("provenance_type") == "AUTHOR_REPORTED_FACT") & exact,
        "usable_limitation": value & claim & (F.col("provenance_type") == "AUTHOR_REPORTED_LIMITATION") & exact, "single_value": F.when(named, _single_value())})
    listed = papers.select("paper_id", "seq", "title", "year", "workflow_status").withColumn("processed", F.col("workflow_status").isin(*V.PROCESSED_WORKFLOW))
    # States often come from exploded lists, whose estimated size would have them broadcast. Papers, one row each, are the side held; states stay unsorted.
    return scientific.join(listed.hint("shuffle_hash"), "paper_id")


def totals(fields: DataFrame, papers: DataFrame, as_of_year: int, invalid: int = 0) -> DataFrame:
    """(metric, n). ``as_of_year`` separates future-dated papers; ``invalid`` records count as papers."""
    audited = F.col("processed") & F.col("status").isin("VERIFIED", "PARTIALLY_VERIFIED")
    counts = {"extracted_scientific_fields": F.col("claimed"), "scientific_record_fields": F.col("processed"), "values_with_exact_evidence": F.col("exact"), "audited_fields": audited}
    # counted per paper first: one pass, and the join has brought a paper's fields together already
    per_paper = fields.groupBy("paper_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    f = per_paper.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], F.count_if(F.col("extracted_scientific_fields") > 0).alias("papers_with_extracted_fields"))
    p = papers.agg(F.count("*").alias("readable_papers"), F.count_if(F.col("workflow_status").isin(*V.PROCESSED_WORKFLOW)).alias("processed_papers"), F.count_if(F.col("year") > as_of_year).alias("future_dated_papers"))
    p = p.withColumns({"papers": F.col("readable_papers") + invalid, "indexed_not_processed": F.col("readable_papers") - F.col("processed_papers")})
    long = lambda df: df.unpivot([], df.columns, "metric", "n")
    return union([long(f), long(p)])


def state_of(total: Column, invalid: Column) -> Column:
    return F.when(invalid > 0, "partial").when(total == 0, "empty").otherwise("ready")


def _tally(rows: DataFrame, key: str, dimension: str) -> DataFrame:
    """(dimension, key, n, drill)."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(
        F.lit(dimension).alias("dimension"), "key", "n", drill_path(dimension, F.col("key").cast("string")).alias("drill"))


def status_tally(fields: DataFrame) -> DataFrame:
    return _tally(fields.filter("processed"), "status", "status")


def section_tally(fields: DataFrame) -> DataFrame:
    return _tally(fields.filter("processed and claimed"), "section", "section")


def workflow_tally(papers: DataFrame) -> DataFrame:
    return _tally(papers, "workflow_status", "workflow")


def samples(rows: DataFrame, key: str, n: int = 3, order: tuple[str, ...] = ("seq", "pos")) -> DataFrame:
    """First n rows behind each value of a tally, in listing order."""
    return first_of_few(rows, [key], order, n)


def year_histogram(fields: DataFrame, papers: DataFrame, as_of_year: int) -> DataFrame:
    """Papers per year with extracted fields and with bibliography only; future years are left out."""
    any_claim = fields.groupBy("paper_id").agg(F.bool_or("claimed").alias("_any"))
    dated = papers.filter(F.col("year") <= as_of_year).join(any_claim, "paper_id", "left").withColumn("_any", F.coalesce("_any", F.lit(False)))
    return dated.groupBy("year").agg(F.count_if("_any").alias("papers_with_extracted_fields"), F.count_if(~F.col("_any")).alias("bibliography_only"))


NAMED = {"architecture": "architecture.family", "dataset": "data.datasets"}


def _single_value() -> Column:
    """The one value of a field whose evidence shows it, else null. A list of several values has no
    source for each of them, so only single values count."""
    first = F.get_json_object(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "$.v[0]")
    text = F.trim(F.when(F.startswith("value_json", F.lit("[")), first).otherwise(E.plain(F.col("value_json"))))
    return F.when(E.display_source(F.col("sources"), F.col("value_json"), for_one_value=True).isNotNull() & (text != ""), text)


def named_values(fields: DataFrame, path: str) -> DataFrame:
    """Distinct values per paper of a field with usable evidence."""
    rows = fields.filter((F.col("field_path") == path) & F.col("processed") & F.col("usable_fact"))
    return rows.withColumn("matched_value", F.col("single_value") if path in NAMED.values() else _single_value()).filter("matched_value is not null")


def named_tally(fields: DataFrame, path: str, dimension: str) -> DataFrame:
    return _tally(named_values(fields, path), "matched_value", dimension)


def tally_order() -> list[Column]:
    """Most papers first, then the label without case."""
    return [F.desc("n"), F.lower("key"), F.col("key")]


def limitation_tally(fields: DataFrame) -> DataFrame:
    names = [f"limitations.{n}" for n in V.SHOWN_LIMITATIONS]
    rows = fields.filter(F.col("field_path").isin(*names) & F.col("processed") & F.col("usable_limitation"))
    return _tally(rows.withColumn("name", F.substring_index("field_path", ".", -1)), "name", "limitation")


def best_showcase(fields: DataFrame) -> DataFrame:
    """The first paper with the most usable training fields, at least three; its fields."""
    rows = fields.filter(F.col("field_path").isin(*V.SHOWCASE_PATHS) & F.col("processed") & F.col("usable_fact"))
    best = rows.groupBy("paper_id", "seq").agg(F.count("*").alias("n")).filter("n >= 3").agg(F.max_by("paper_id", F.struct("n", -F.col("seq"))).alias("paper_id"))
    return rows.join(F.broadcast(best), "paper_id", "left_semi")  # best: one row


def first_conflict(fields: DataFrame) -> DataFrame:
    """The first plausible conflict in listing and field order."""
    rows = fields.filter("processed and status = 'CONFLICT'").filter(E.plausible_conflict(F.col("field_path"), F.col("conflict_values"), F.col("sources")))
    return rows.orderBy("seq", "pos").limit(1)


def _behind(dimension: str, key: str) -> Column:
    """Whether a row of a processed paper's fields (a paper row, for workflow and years) is counted under this key."""
    c = F.col
    if dimension == "workflow":
        return c("workflow_status") == key
    if dimension in ("year_extracted", "year_bibliographic"):
        year = int(key) if key.lstrip("-").isdigit() else None
        return c("year") == F.lit(year)
    if dimension == "status":
        return c("status") == key
    if dimension == "section":
        return F.startswith(c("field_path"), F.lit(key)) & (c("section") == key) & c("claimed")
    if dimension == "limitation":
        return (c("field_path") == f"limitations.{key}") & c("usable_limitation")
    return (c("field_path") == NAMED[dimension]) & c("usable_fact") & (c("single_value") == key)


PAPER_DIMENSIONS = ("workflow", "year_extracted", "year_bibliographic")


def drilldowns(fields: DataFrame, papers: DataFrame, wanted: Sequence[tuple[str, str]], limit: int, offset: int = 0) -> DataFrame:
    """One page of the evidence or paper rows behind each wanted (dimension, key); ``total`` is uncut.

    Every row is tagged with the counts it stands behind; rows behind none leave before the join of fields and papers.
    Whether a paper has claimed fields is asked only of the papers of a wanted year.
    """
    columns = ["dimension", "key", "paper_id", "field_path", "seq", "pos"]

    def tagged(df: DataFrame, some: Sequence[tuple[str, str]], *columns: Column | str) -> DataFrame:
        tags = F.array_compact(F.array(*[F.when(_behind(d, k), F.struct(F.lit(d).alias("dimension"), F.lit(k).alias("key"))) for d, k in some]))
        behind = df.filter(reduce(lambda a, b: a | b, [_behind(d, k) for d, k in some]))
        return behind.select(*columns, F.explode(tags).alias("t")).select("t.*", "paper_id", "field_path", "seq", "pos")

    def of_papers(rows: DataFrame, some: Sequence[tuple[str, str]]) -> DataFrame:
        return tagged(rows, some, "paper_id", F.lit("").alias("field_path"), "seq", F.lit(0).alias("pos"))

    parts = []
    by_field = [w for w in wanted if w[0] not in PAPER_DIMENSIONS]
    if by_field:
        parts.append(tagged(fields.filter("processed"), by_field, "paper_id", "field_path", "seq", "pos"))
    by_workflow = [w for w in wanted if w[0] == "workflow"]
    if by_workflow:
        parts.append(of_papers(papers, by_workflow))
    for dimension, how in (("year_extracted", "left_semi"), ("year_bibliographic", "left_anti")):
        by_year = [w for w in wanted if w[0] == dimension]
        if by_year:
            claimed = fields.filter(F.col("claimed") & reduce(lambda a, b: a | b, [_behind(*w) for w in by_year])).select("paper_id")
            parts.append(of_papers(papers, by_year).join(claimed.hint("merge"), "paper_id", how))
    found = union([p.select(*columns) for p in parts])
    return first_of_few(found, ["dimension", "key"], ["seq", "pos"], offset + limit, "_place", total="total").filter(F.col("_place") > offset).select(*columns, "total")


def drilldown(fields: DataFrame, papers: DataFrame, dimension: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """The evidence or paper rows behind one count of the overview; ``total`` is uncut."""
    return drilldowns(fields, papers, [(dimension, key)], limit, offset).drop("dimension", "key").orderBy("seq", "pos")
