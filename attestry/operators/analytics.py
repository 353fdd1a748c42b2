"""Corpus analytics over the typed tables.

experiments(slug, ord, experiment_id, task, family, method, datasets, variable, reported,
metrics): one row per experiment with its data set names, the settings it reports, and the
metrics of its results. All lists are short and belong to one experiment.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.rules import dataset_group
from attestry.functions.text import any_key_or_value_contains
from attestry.operators.keyed import exact_median, first_n
from attestry.session import cut_lineage


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def experiment_rows(experiments: DataFrame, methods: DataFrame, datasets: DataFrame, training: DataFrame, results: DataFrame, papers: DataFrame) -> DataFrame:
    """Joins the silver tables of kept papers into ``experiments`` rows."""
    kept = papers.filter("excluded is null").select("slug")
    names = (
        experiments.select("slug", "ord", F.posexplode("dataset_ids").alias("k", "dataset_id"))
        .join(datasets.select("slug", "dataset_id", F.col("canonical_name").alias("name")), ["slug", "dataset_id"])
        .filter("name is not null").groupBy("slug", "ord").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("d"))
    )
    per_experiment = ["slug", "experiment_id"]
    # the lists below hold items of one experiment, which came from one record document
    reported = training.filter(F.col("field").isin(*V.TRAINING_ORDER)).groupBy(*per_experiment).agg(F.collect_set("field").alias("reported"))
    measured = results.groupBy(*per_experiment).agg(F.collect_list(F.struct("metric"))["metric"].alias("metrics"))  # a result without a metric counts too
    empty = F.array().cast("array<string>")
    return (
        experiments.join(kept, "slug", "left_semi")
        .join(methods.select("slug", "method_id", "family", F.col("canonical_name").alias("method")), ["slug", "method_id"], "left")
        .join(names, ["slug", "ord"], "left").join(reported, per_experiment, "left").join(measured, per_experiment, "left")
        .select("slug", "ord", "experiment_id", "task", "family", "method", F.coalesce("d.name", empty).alias("datasets"),
                F.col("target_variable").alias("variable"), F.coalesce("reported", empty).alias("reported"), F.coalesce("metrics", empty).alias("metrics"))
    )


# --- counts -----------------------------------------------------------------------------

def corpus_counters(papers: DataFrame, experiments: DataFrame, results: DataFrame, conflicts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Long (counter, n). Experiments, results and conflicts count kept papers only."""
    kept = papers.filter("excluded is null").select("slug")
    of = lambda df, name: df.join(kept, "slug", "left_semi").agg(F.lit(name).alias("counter"), F.count("*").alias("n"))
    p = papers.agg(F.count_if(F.col("excluded").isNull()).alias("papers"), F.count_if(F.col("excluded").isNotNull()).alias("excluded"))
    return union([
        p.unpivot([], ["papers", "excluded"], "counter", "n"), of(experiments, "experiments"), of(results, "results"),
        of(conflicts, "conflicts"), quotes.agg(F.lit("quotes").alias("counter"), F.count("*").alias("n")),
    ])


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of the values of several columns as (category, value, n), in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).filter("p.value is not null").groupBy("p.category", "p.value").agg(F.count("*").alias("n"))


def reporting_rate(experiments: DataFrame, keys: Sequence[str] = V.TRAINING_ORDER) -> DataFrame:
    """(field, reported, of): how many experiments report each setting."""
    counts = experiments.agg(*[F.count_if(F.array_contains("reported", k)).alias(k) for k in keys], F.count("*").alias("of"))
    return counts.unpivot(["of"], list(keys), "field", "reported").select("field", "reported", "of")


def numeric_summary(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """values(*keys, number, text): min, exact median and max where at least two numbers
    exist; where there is no number, up to four distinct texts, cut to 22 characters."""
    keys = list(keys)
    stats = exact_median(values, keys, "number").filter("n >= 2")
    seen = values.groupBy(*keys).agg(F.count("*").alias("n_values"), F.count("number").alias("n_numbers"))
    worded = values.join(seen.filter("n_numbers = 0").select(*keys), keys, "left_semi")
    short = worded.select(*keys, F.left("text", F.lit(22)).alias("text")).filter("text is not null").distinct()
    few = first_n(short, keys, [F.col("text")], 4).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("text")), ", ").alias("texts"))
    return seen.join(stats.drop("n"), keys, "left").join(few, keys, "left")


AXIS_BLOCK = 4096  # values of an axis in one row, about


def unset_cells(filled: DataFrame, keys: DataFrame, axis: DataFrame, rows: str, cols: str) -> DataFrame:
    """(rows, cols) of the grid ``keys`` x ``axis`` (distinct each) that ``filled(rows, cols)`` lacks, each pair once.

    The column axis is coded: blocks of a bounded number of names, by hash, each name with its place. A row keeps one bit for each
    name it has, 64 to a number; the empty cells are the places without a bit. So no axis is gathered whole, and the grid is
    made from its gaps, not by joining all pairs to what is there.
    """
    blocks = max(1, -(-axis.count() // AXIS_BLOCK))
    coded = axis.groupBy(F.pmod(F.xxhash64(cols), F.lit(blocks)).alias("_b")).agg(F.array_sort(F.collect_list(cols)).alias("_names"))
    coded = cut_lineage(coded)  # the axis once, in blocks
    places = coded.select("_b", F.posexplode("_names").alias("_at", cols))
    words = filled.join(places, cols).groupBy(rows, "_b", F.shiftright("_at", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, _at & 63)")).alias("_bits"))
    held = words.groupBy(rows, "_b").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_held"))  # AXIS_BLOCK / 64 numbers, about
    grid = keys.select(rows, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_b"))
    bits = lambda i: F.coalesce(F.try_element_at("_held", F.shiftright(i, 6)), F.lit(0).cast("long"))
    gaps = F.filter("_names", lambda name, i: F.getbit(bits(i), i.bitwiseAND(63)) == 0)
    return grid.join(coded, "_b").join(held, [rows, "_b"], "left").select(rows, F.explode(gaps).alias(cols))


def _empty(filled: DataFrame, rows: str, cols: str) -> DataFrame:
    return unset_cells(filled, filled.select(rows).distinct(), filled.select(cols).distinct(), rows, cols)


def _cells(experiments: DataFrame, rows: str, cols: str, paper: str) -> DataFrame:
    return experiments.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull()).groupBy(rows, cols).agg(F.countDistinct(paper).alias("papers"))


def coverage(experiments: DataFrame, rows: str = "task", cols: str = "family", paper: str = "slug") -> DataFrame:
    """Distinct papers per (task, family), empty cells included. Both axes may be of any size."""
    filled = cut_lineage(_cells(experiments, rows, cols, paper))  # one row a cell
    return filled.unionByName(_empty(filled.select(rows, cols), rows, cols).withColumn("papers", F.lit(0).cast("long")))


def empty_cells(experiments: DataFrame, rows: str = "task", cols: str = "family", paper: str = "slug") -> DataFrame:
    return _empty(cut_lineage(_cells(experiments, rows, cols, paper).select(rows, cols)), rows, cols)


def comparison_cells(results: DataFrame, cell: Sequence[str], paper: str = "slug") -> DataFrame:
    """Papers per (data set, metric, unit); values compare across papers only inside a cell."""
    return results.groupBy(*cell).agg(F.countDistinct(paper).alias("papers"), F.count("*").alias("results"))


def comparable_cells(results: DataFrame, cell: Sequence[str], paper: str = "slug") -> DataFrame:
    return comparison_cells(results, cell, paper).filter("papers >= 2")


def missing_fields(not_reported: DataFrame, k: int = 10) -> DataFrame:
    """The k settings most often documented as absent, by the last segment of their path."""
    counts = not_reported.groupBy(F.substring_index("field", ".", -1).alias("field")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "field").limit(k)


def figures_only(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Kept papers without a single measured result."""
    return papers.filter("excluded is null").join(results.select("slug"), "slug", "left_anti")


def access_report(manifest: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return manifest.agg(
        F.count("*").alias("indexed"), n("DOWNLOADED", "ALREADY_PRESENT", "DUPLICATE").alias("reachable"), n("BLOCKED").alias("blocked"),
        n("NO_OA_PDF").alias("no_oa"), n("UNRESOLVED").alias("unresolved"), n("BLOCKED", "NO_OA_PDF", "UNRESOLVED").alias("unreachable"))


def domain_count(papers: DataFrame, domains: str = "domains") -> DataFrame:
    return papers.select(F.explode(domains).alias("d")).agg(F.countDistinct("d").alias("domains"))


# --- entities ---------------------------------------------------------------------------

def entity_experiments(experiments: DataFrame) -> DataFrame:
    """One row per (entity, experiment): an experiment belongs to its family, task, data
    sets, data set groups, variable and method."""
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), F.nullif(c, F.lit("")).alias("name")))
    many = lambda kind, cs: F.transform(cs, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    groups = F.array_distinct(F.array_compact(F.transform("datasets", lambda n: dataset_group(n))))
    entities = F.concat(
        one("family", F.col("family")), one("task", F.col("task")), many("dataset", F.col("datasets")),
        many("dataset_group", groups), one("variable", F.col("variable")), one("method", F.col("method")))
    out = experiments.select("*", F.explode(entities).alias("entity"))
    return out.select("entity.kind", "entity.name", *experiments.columns).filter("name is not null")


def entity_rollup(experiments: DataFrame) -> DataFrame:
    """(kind, name, papers, experiments, results) for every entity."""
    return entity_experiments(experiments).groupBy("kind", "name").agg(
        F.countDistinct("slug").alias("papers"), F.count("*").alias("experiments"), F.sum(F.size("metrics")).alias("results"))


def entity_reporting(experiments: DataFrame) -> DataFrame:
    """(kind, name, field, reported, of): the reporting rate inside every entity."""
    rows = entity_experiments(experiments)
    counts = rows.groupBy("kind", "name").agg(
        *[F.count_if(F.array_contains("reported", k)).alias(k) for k in V.TRAINING_ORDER], F.count("*").alias("of"))
    return counts.unpivot(["kind", "name", "of"], list(V.TRAINING_ORDER), "field", "reported")


def entity_facets(experiments: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent neighbours of every entity as (kind, name, facet, value, n, rank).

    Tasks and families are complete; data sets, variables, methods and metrics keep the
    ``top`` most frequent. Ties go to the value met first.
    """
    cell = lambda facet, c: F.struct(F.lit(facet).alias("facet"), c.alias("value"))
    each = lambda facet, cs: F.transform(cs, lambda v: cell(facet, v))
    facets = F.concat(
        F.array(cell("tasks", F.col("task")), cell("families", F.col("family")), cell("variables", F.col("variable")), cell("methods", F.col("method"))),
        each("datasets", F.col("datasets")), each("metrics", F.array_compact("metrics")))
    # Experiments are put in order before each becomes some fifty rows: a position is one number,
    # so counts and firsts stay in a hash table that is filled before the shuffle.
    needed = experiments.select("slug", "ord", "task", "family", "method", "variable", "datasets", "metrics")
    # Rows of one (slug, ord) share a position, so that their values tie; the sort has them together already.
    placed = needed.orderBy("slug", "ord").withColumn("_row", F.monotonically_increasing_id())
    placed = placed.withColumn("_pos", F.min("_row").over(Window.partitionBy("slug", "ord"))).drop("_row")
    rows = entity_experiments(placed).select("kind", "name", "_pos", F.explode(facets).alias("f")).filter("f.value is not null")
    counted = rows.groupBy("kind", "name", "f.facet", "f.value").agg(F.count("*").alias("n"), F.min("_pos").alias("_first"))
    order = [F.desc("n"), F.col("_first"), F.col("value")]
    vocabulary = F.col("facet").isin("tasks", "families")  # few values each, so all of them are ranked
    key = ["kind", "name", "facet"]
    complete = counted.filter(vocabulary).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return first_n(counted.filter(~vocabulary), key, order, top).unionByName(complete).drop("_first")


def problems(limitations: DataFrame) -> DataFrame:
    """Items and distinct papers per limitation theme."""
    theme = F.coalesce("theme", F.lit("OTHER")).alias("theme")
    return limitations.groupBy(theme).agg(F.count("*").alias("items"), F.countDistinct("slug").alias("papers"))


def entity_papers(experiments: DataFrame, papers: DataFrame, kind: str, name: str) -> DataFrame:
    """Papers of one entity, newest first, with how many experiments each contributes."""
    mine = entity_experiments(experiments).filter((F.col("kind") == kind) & (F.col("name") == name))
    counts = mine.groupBy("slug").agg(F.count("*").alias("experiments"))
    return papers.select("slug", "title", "year").join(counts, "slug").orderBy(F.coalesce("year", F.lit(0)).desc(), "slug")


def entity_experiment_list(experiments: DataFrame, kind: str, name: str) -> DataFrame:
    """The experiments of one entity, each once."""
    return entity_experiments(experiments).filter((F.col("kind") == kind) & (F.col("name") == name)).drop("kind", "name")


def entity_problems(experiments: DataFrame, limitations: DataFrame, kind: str, name: str) -> DataFrame:
    mine = entity_experiments(experiments).filter((F.col("kind") == kind) & (F.col("name") == name)).select("slug").distinct()
    return limitations.join(mine, "slug", "left_semi")


# --- search -----------------------------------------------------------------------------

def paper_summaries(papers: DataFrame, experiments: DataFrame, results: DataFrame, claims: DataFrame) -> DataFrame:
    """Papers with their tasks, families and counts, ready for search."""
    e = experiments.groupBy("slug").agg(
        F.array_sort(F.collect_set("task")).alias("tasks"), F.array_sort(F.collect_set("family")).alias("families"), F.count("*").alias("experiment_count"))
    n = lambda df, name: df.groupBy("slug").agg(F.count("*").alias(name))
    out = papers.join(e, "slug", "left").join(n(results, "result_count"), "slug", "left").join(n(claims, "claim_count"), "slug", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        *papers.columns, F.coalesce("tasks", empty).alias("tasks"), F.coalesce("families", empty).alias("families"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("experiment_count", "result_count", "claim_count")])


def search(summaries: DataFrame, text: str | None = None, task: str | None = None, family: str | None = None) -> DataFrame:
    """Text over the whole summary (key names too), then task, then family."""
    out = summaries
    if text:
        out = out.filter(any_key_or_value_contains(F.struct(*summaries.columns), text))
    if task:
        out = out.filter(F.array_contains("tasks", task))
    if family:
        out = out.filter(F.array_contains("families", family))
    return out


def facets(summaries: DataFrame) -> DataFrame:
    """Distinct tasks and families of a filtered set, sorted."""
    return summaries.select(F.explode(F.concat(
        F.transform("tasks", lambda t: F.struct(F.lit("task").alias("facet"), t.alias("value"))),
        F.transform("families", lambda f: F.struct(F.lit("family").alias("facet"), f.alias("value"))))).alias("f")).select("f.*").distinct()


def catalogue(summaries: DataFrame, progress: DataFrame, limit: int, offset: int = 0, **filters: str | None) -> DataFrame:
    """One page of the searched papers with their audit counts; ``total`` is uncut."""
    from attestry.operators.keyed import page

    hits = page(search(summaries, **filters), [F.col("slug")], limit, offset)
    return hits.join(progress, "slug", "left")
