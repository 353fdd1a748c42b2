"""Questions over the corpus: parsed into filters, answered with counts over stored claims.

A vocabulary entry is a run of words, so questions are
cut into runs of the lengths the vocabulary uses and looked up; filters meet blocks of
experiments where they lie (``fits``), so that no pair of a filter and an experiment is ever moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.text import fold_question
from attestry.operators.analytics import entity_experiments
from attestry.operators.fits import first_fitting, fitting_papers
from attestry.operators.gate import _asked
from attestry.session import kept

MOST_BITS = 1 << 22  # of the set that screens words of questions: 512 KB, whatever the corpus
KINDS = ("task", "family", "dataset_group", "variable", "method")


def vocabulary(experiments: DataFrame, synonyms: bool = True) -> DataFrame:
    """(kind, key, name): every entity name of the corpus by its folded form, and fixed synonyms."""
    names = entity_experiments(experiments).filter(F.col("kind").isin(*KINDS)).select("kind", "name").distinct()
    out = names.select("kind", fold_question(F.col("name")).alias("key"), "name")
    if synonyms:
        fixed = [("task", word, name) for name, word in V.TASK_WORDS.items()] + [("family", word, name) for word, name in V.FAMILY_WORDS.items()]
        out = out.unionByName(experiments.sparkSession.createDataFrame(fixed, "kind string, key string, name string"))
    return out.distinct()


def _mentions(folded: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(folded, F.lit(word))
    return hit


def _named(folded: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.array_compact(F.array(*[F.when(_mentions(folded, words), F.lit(name)) for name, words in table.items()]))


def parse(questions: DataFrame, words: DataFrame, shortest: int = 3) -> DataFrame:
    """questions(question_id, text) with what was understood: settings, themes, one list of
    names per kind, and three intents.

    Vocabulary keys match whole words; setting, theme and intent words match anywhere, as
    they are stems.
    """
    folded = questions.select("question_id", fold_question(F.coalesce("text", F.lit(""))).alias("folded"))
    keys = words.filter(F.length("key") >= shortest)
    longest = keys.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1  # one number
    tokens = folded.select("question_id", F.split("folded", " ").alias("t"))
    runs = F.concat(*[
        F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))).otherwise(F.array().cast("array<string>"))
        for n in range(1, longest + 1)])
    cut = tokens.select("question_id", F.explode(F.array_distinct(runs)).alias("key"))
    known = _asked(keys.select(F.xxhash64("key").alias("key")), MOST_BITS)
    cut = cut if known is None else cut.filter(known(F.xxhash64("key")))  # most runs are in no vocabulary and stay where they are
    hits = cut.join(keys, "key").select("question_id", "kind", "name")
    found = hits.groupBy("question_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in KINDS])
    f = F.col("folded")
    out = folded.join(found, "question_id", "left").select(
        "question_id", _named(f, V.FIELD_WORDS).alias("fields"), _named(f, V.THEME_WORDS).alias("themes"),
        *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in KINDS],
        _mentions(f, V.LIMITATION_WORDS).alias("_limits"), _mentions(f, V.RESULT_WORDS).alias("asks_for_results"), _mentions(f, V.RANKING_WORDS).alias("asks_for_ranking"))
    out = out.withColumn("asks_for_limitations", F.col("_limits") | (F.size("themes") > 0)).drop("_limits")
    named = F.lit(False)
    for c in ("fields", "themes", *KINDS):
        named = named | (F.size(c) > 0)
    # a ranking word alone says nothing about what to look for
    return out.withColumn("understood", named | F.col("asks_for_limitations") | F.col("asks_for_results"))


def _signature(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("signature", F.unhex(F.md5(F.to_json(F.struct(*KINDS)))))


def match_experiments(parsed: DataFrame, experiments: DataFrame) -> DataFrame:
    """(signature, slug, shape counts): how many experiments fit each distinct set of filters, per paper."""
    fits, free, shapes = _fitting_shapes(parsed, experiments)
    per_paper = shapes.groupBy("slug").agg(*[F.sum(c).alias(c) for c in shapes.columns if c.startswith("n_")])
    return fits.unionByName(per_paper.crossJoin(free).select(*fits.columns))


def _fitting_shapes(parsed: DataFrame, experiments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signature, slug, counts) of what fits each distinct set of filters, the signature of the empty set, and all shapes.

    Tasks AND (families OR methods) AND groups AND variables. Experiments are first counted
    per shape (the facets a filter can see, per paper); a filter meets the shapes where it lies, and only sums per paper move.
    """
    shapes = kept(experiment_shapes(experiments), "shapes")  # read several times
    filters = _signature(parsed.filter("understood")).select("signature", *KINDS)
    fits = fitting_papers(filters.filter(_filtered()), shapes, "signature")
    # the empty filter, at most one row however many questions share it, covers the whole corpus
    return fits, F.broadcast(filters.filter(~_filtered()).select("signature").distinct()), shapes


def experiment_shapes(experiments: DataFrame) -> DataFrame:
    """Experiments counted per paper and visible facets: how many, how many report each setting, results."""
    out = _faceted(experiments).groupBy(*SHAPE)
    return out.agg(F.count("*").alias("n_experiments"), F.sum(F.size("metrics")).alias("n_results"), *[F.count_if(F.array_contains("reported", f)).alias(f"n_{f}") for f in V.FIELD_WORDS])


SHAPE = ["slug", "_task", "_family", "_method", "_variable", "_groups"]


def _faceted(experiments: DataFrame) -> DataFrame:
    """Experiments with the facets a filter can see."""
    from attestry.functions.rules import dataset_group

    groups = F.array_sort(F.array_distinct(F.array_compact(F.transform("datasets", lambda d: dataset_group(d)))))
    facets = {"_task": F.col("task"), "_family": F.col("family"), "_method": F.col("method"), "_variable": F.col("variable"), "_groups": groups}
    return experiments.withColumns(facets)


def answers(parsed: DataFrame, experiments: DataFrame, limitations: DataFrame, shared_cells: DataFrame | None = None) -> DataFrame:
    """Blocks per question as long rows (question_id, block, item, n, of).

    ``matched`` gives experiments and papers; ``training`` how many of them report each
    setting asked for; ``results`` and ``limitations`` the uncut counts; ``experiments`` when
    nothing else was asked. Questions that were not understood get no rows.
    ``shared_cells`` (one row, column ``shared``) is the measured number of comparable cells:
    a ranking is declined while it is zero.
    """
    # questions with their filters, and the papers each distinct filter meets: both are read
    # several times below and neither holds text
    asked = kept(_signature(parsed.filter("understood")).withColumn("filtered", _filtered()).drop(*KINDS), "asked")
    hits = kept(match_experiments(parsed, experiments), "hits")
    sums = hits.groupBy("signature").agg(F.count("*").alias("papers"), F.sum("n_experiments").alias("experiments"), F.sum("n_results").alias("results"), *[F.sum(f"n_{f}").alias(f"n_{f}") for f in V.FIELD_WORDS])
    rows = asked.join(sums, "signature", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    block = lambda b, item, n, of: F.struct(F.lit(b).alias("block"), F.lit(item).alias("item"), z(n).cast("bigint").alias("n"), z(of).cast("bigint").alias("of"))
    c = F.col
    only = (F.size("fields") == 0) & ~c("asks_for_results") & ~c("asks_for_limitations")
    blocks = F.array_compact(F.array(
        block("matched", "experiments", c("experiments"), c("papers")),
        *[F.when(F.array_contains("fields", f), block("training", f, c(f"n_{f}"), c("experiments"))) for f in V.FIELD_WORDS],
        F.when(c("asks_for_results"), block("results", "measured", c("results"), c("experiments"))), F.when(only, block("experiments", "listed", c("experiments"), c("papers")))))
    out = rows.select("question_id", F.explode(blocks).alias("b")).select("question_id", "b.*")
    return out.unionByName(_limitation_block(asked, hits, limitations))


def _limitation_block(asked: DataFrame, hits: DataFrame, limitations: DataFrame) -> DataFrame:
    """Limitation items in scope. Without filters all papers count, excluded ones too."""
    wants = asked.filter("asks_for_limitations")
    combos = wants.select("signature", "themes", "filtered").distinct().withColumn("combo", F.sha2(F.to_json(F.struct("signature", "themes")), 256))
    per_paper = limitations.groupBy("slug", "theme").agg(F.count("*").alias("items"))
    fits = lambda df: df.filter((F.size("themes") == 0) | F.array_contains("themes", F.col("theme")))
    scoped = fits(combos.filter("filtered").join(hits.select("signature", "slug"), "signature").join(per_paper, "slug")).groupBy("combo").agg(F.sum("items").alias("n"))
    themes = per_paper.groupBy("theme").agg(F.sum("items").alias("items"))
    # unfiltered: theme totals, a vocabulary; a question names its themes or takes all
    everything = themes.agg(F.sum("items").alias("n"))
    named = combos.filter("not filtered and size(themes) > 0").select("combo", F.explode("themes").alias("theme")).join(themes, "theme").groupBy("combo").agg(F.sum("items").alias("n"))
    free = combos.filter("not filtered and size(themes) = 0").select("combo").crossJoin(F.broadcast(everything))  # one row
    n = scoped.unionByName(named).unionByName(free)
    keyed = wants.withColumn("combo", F.sha2(F.to_json(F.struct("signature", "themes")), 256)).select("question_id", "combo")
    return keyed.join(n, "combo", "left").select("question_id", F.lit("limitations").alias("block"), F.lit("items").alias("item"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("of"))


def caveats(parsed: DataFrame, blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """(question_id, caveat). shared(shared) holds the measured number of comparable cells, one row."""
    asked = parsed.filter("understood").select("question_id", "asks_for_ranking", "asks_for_results", "asks_for_limitations").crossJoin(F.broadcast(shared))  # one row
    c = F.col
    codes = F.array_compact(F.array(
        F.when(c("asks_for_ranking") & (c("shared") == 0), F.lit("RANKING_NOT_COMPUTABLE")), F.when(c("asks_for_ranking") & (c("shared") > 0), F.lit("RANKING_ONLY_INSIDE_SHARED_CELLS")),
        F.when(c("asks_for_results"), F.lit("RESULTS_DO_NOT_COMPARE")), F.when(c("asks_for_limitations"), F.lit("ONLY_STATED_LIMITATIONS"))))
    missing = blocks.filter("block = 'training' and n < of").select("question_id", F.lit("SETTING_NOT_REPORTED_BY_ALL").alias("caveat")).distinct()
    return asked.select("question_id", F.explode(codes).alias("caveat")).unionByName(missing).unionByName(parsed.filter("not understood").select("question_id", F.lit("NOTHING_UNDERSTOOD").alias("caveat")))


def _scope(parsed: DataFrame, want: Column, *columns: Column | str) -> DataFrame:
    """The understood questions that ask for a block: question_id, signature, their filters, whether there are any, and the given columns."""
    asked = _signature(parsed.filter("understood").filter(want))
    return asked.select("question_id", "signature", *KINDS, _filtered().alias("_filtered"), *columns)


def _filtered() -> Column:
    return sum((F.size(k) for k in KINDS), F.lit(0)) > 0


def _listed(asked: DataFrame, held: DataFrame, keys: list[str], order: list[str], limit: int | None) -> DataFrame:
    """For each question of ``asked`` the first rows of ``held`` (which carry their experiment's facets) that agree in ``keys``.

    Rows come from the experiments that fit the question's filters, or from all of them if it
    has none. Rows are numbered in order once; without filters the first rows overall serve every question.
    """
    from attestry.operators.keyed import first_n

    by = [F.col(c) for c in order]
    tasks = max(1, held.sparkSession.sparkContext.defaultParallelism)
    numbered = kept(held.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    facets = [*SHAPE[1:], "_id"]
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    filters = asked.filter("_filtered").select("question_id", *keys, *KINDS, key.alias("_key"), F.col("signature").alias("_same"))
    found = first_fitting(filters, numbered.select("slug", *facets, key.alias("_key")), ["question_id", *keys], limit)
    some = found.join(numbered.drop(*SHAPE[1:], *keys), "_id").drop("_id")
    plain = numbered.drop(*facets)
    first = plain if limit is None or keys else plain.orderBy(*by).limit(limit)
    free = first_n(first, keys, by, limit)
    bare = asked.filter("not _filtered").select("question_id", *keys)
    bare = bare.join(free, keys) if keys else bare.crossJoin(free)  # the block itself, ``limit`` rows a question
    return some.unionByName(bare)


def _placed(rows: DataFrame, experiments: DataFrame) -> DataFrame:
    """Rows of experiments with the facets of their experiment."""
    return rows.join(_faceted(experiments).select("ord", *SHAPE), ["slug", "ord"])


def training_values(parsed: DataFrame, experiments: DataFrame, settings: DataFrame, limit: int | None = 40) -> DataFrame:
    """The reported values behind a training block, at most ``limit`` (None: all) per question and field.

    The counts in ``answers`` are never cut. settings(slug, ord, field, value_json, unit, page, quote).
    """
    asked = _scope(parsed, F.lit(True), F.explode("fields").alias("field"))
    return _listed(asked, _placed(settings, experiments), ["field"], ["slug", "ord"], limit)


def result_values(parsed: DataFrame, experiments: DataFrame, results: DataFrame, limit: int | None = 40) -> DataFrame:
    """The measured values behind a results block. results(slug, ord, pos, metric, value, unit, page, quote, ...)."""
    asked = _scope(parsed, F.col("asks_for_results"))
    return _listed(asked, _placed(results, experiments), [], ["slug", "ord", "pos"], limit)


def experiment_values(parsed: DataFrame, experiments: DataFrame, limit: int | None = 40) -> DataFrame:
    """The experiments behind a question that names nothing but filters, with the settings that each reports."""
    c = F.col
    plain = (F.size("fields") == 0) & ~c("asks_for_results") & ~c("asks_for_limitations")
    asked = _scope(parsed, plain)
    held = _faceted(experiments).select("ord", "task", "family", "method", "datasets", "variable", "reported", *SHAPE)
    return _listed(asked, held, [], ["slug", "ord"], limit)


def limitation_values(parsed: DataFrame, experiments: DataFrame, limitations: DataFrame, limit: int | None = 40) -> DataFrame:
    """The stated limitations behind a limitations block. limitations(slug, pos, theme, page, quote).

    A question with filters sees the papers that have a fitting experiment; one without sees all. Themes
    are a small vocabulary, so the first rows of each serve every unfiltered question.
    """
    from attestry.operators.keyed import first_n

    by = [F.col("slug"), F.col("pos")]
    asked = _scope(parsed, F.col("asks_for_limitations"), "themes").withColumn("combo", F.sha2(F.to_json(F.struct("signature", "themes")), 256))
    combos = asked.select("combo", "signature", "themes", "_filtered").distinct()
    slugs = _fitting_shapes(parsed.filter(_filtered() & F.col("asks_for_limitations")), experiments)[0].select("signature", "slug")
    fits = (F.size("themes") == 0) | F.array_contains("themes", F.col("theme"))
    papers = combos.filter("_filtered").join(slugs, "signature").select("combo", "themes", "slug")
    stated = limitations
    if limit is not None:
        # papers are listed in order, so those after the first ``limit`` items are out of reach, and of a paper no more than ``limit`` of a theme are
        n = papers.join(limitations.groupBy("slug", "theme").agg(F.count("*").alias("n")), "slug").filter(fits).groupBy("combo", "themes", "slug").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("combo").orderBy("slug").rowsBetween(Window.unboundedPreceding, -1))
        papers = n.withColumn("_before", before).filter(F.coalesce("_before", F.lit(0)) < limit).select("combo", "themes", "slug")
        stated = first_n(limitations, ["slug", "theme"], by, limit).drop("rank")
    scoped = papers.join(stated, "slug").filter(fits).select("combo", *limitations.columns)
    per_theme = first_n(limitations, ["theme"], by, limit).drop("rank")
    named = combos.filter("not _filtered").select("combo", F.explode("themes").alias("theme")).distinct().join(per_theme, "theme").select("combo", *limitations.columns)
    first = limitations if limit is None else limitations.orderBy(*by).limit(limit)
    free = combos.filter("not _filtered and size(themes) = 0").select("combo").crossJoin(first)  # one combination, ``limit`` rows
    found = first_n(scoped.unionByName(named).unionByName(free), ["combo"], by, limit)
    return asked.select("question_id", "combo").join(found, "combo").drop("combo")
