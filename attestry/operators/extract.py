"""Rule extraction from page text, and the bookkeeping around fetching sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.text import json_text, section_before, sentences

EDGES = r"^[ ;:,.\x{a0}]+|[ ;:,.\x{a0}]+$"


def readable_sources(pages: DataFrame, source: str = "source_file") -> DataFrame:
    """Sources with their page count; ``readable`` is false where no page has any text."""
    return pages.groupBy(source).agg(F.count("*").alias("pages"), F.bool_or(F.length(F.trim("text")) > 0).alias("readable"))


def page_sentences(pages: DataFrame, sections: bool = True) -> DataFrame:
    """pages(source_file, page, text) to sentences with position and, if wanted, section."""
    rows = pages.select("source_file", "page", *(["text"] if sections else []), F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("section", section_before(F.col("text"), F.col("sentence"))).drop("text") if sections else rows


def _list_json(text: Column) -> Column:
    items = F.filter(F.transform(F.split(text, ",|;| and "), lambda i: F.trim(i)), lambda i: i != "")
    return F.to_json(items)


def extract(sentence_rows: DataFrame, rules=V.EXTRACTION_RULES) -> DataFrame:
    """One row per value found: (source_file, page, pos, rule, field_path, value_json, sentence).

    Values are canonical JSON text; list rules split at commas, semicolons and "and".
    """
    s = F.col("sentence")
    low = F.lower(s)
    hits = []
    for n, (pattern, path, is_list) in enumerate(rules):
        raw = F.regexp_extract(s, "(?i)" + pattern, 1)
        text = F.regexp_replace(raw, EDGES, "")
        value = _list_json(text) if is_list else (F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=.)", "")) if path == "training.batch_size" else json_text(text))
        hits.append(F.when(raw != "", F.struct(F.lit(n).alias("rule"), F.lit(path).alias("field_path"), value.alias("value_json"))))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(s, F.lit("(?i)" + pattern), F.lit(0)))
    listed = lambda n, path, when, pattern: F.when(when & (F.size(found(pattern)) > 0), F.struct(F.lit(n).alias("rule"), F.lit(path).alias("field_path"), F.to_json(found(pattern)).alias("value_json")))
    mentions = lambda words: low.rlike("|".join(words))
    k = len(rules)
    hits.append(listed(k, "architecture.activations", mentions(V.ACTIVATION_TRIGGERS), V.ACTIVATION_NAMES))
    hits.append(listed(k + 1, "architecture.family", F.lit(True), V.FAMILY_NAMES))
    hits.append(F.when(mentions(V.LIMITATION_TRIGGERS), F.struct(F.lit(k + 2).alias("rule"), F.lit("limitations.author_reported").alias("field_path"), json_text(s).alias("value_json"))))
    rows = sentence_rows.select("*", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return rows.select(*sentence_rows.columns, "h.*").filter("value_json is not null")


def fold_conflicts(values: DataFrame, source: str = "source_file") -> DataFrame:
    """Distinct values per field with their first evidence, and the field's status.

    The first value stands; a different later one turns the field into a conflict between
    all distinct values. Order is (page, sentence, rule); values stay one row each, so a
    field with very many of them is never gathered.
    """
    first = values.groupBy(source, "field_path", "value_json").agg(F.min(F.struct("page", "pos", "rule", "sentence")).alias("f"), F.count("*").alias("times"))
    rows = first.select(source, "field_path", "value_json", "f.*", "times")
    n = rows.groupBy(source, "field_path").agg(F.count("*").alias("alternatives"), F.min_by("value_json", F.struct("page", "pos", "rule")).alias("first_value"))
    out = rows.join(n, [source, "field_path"])
    return out.withColumns({"status": F.when(F.col("alternatives") > 1, "CONFLICT").otherwise("NOT_VERIFIED"), "is_first": F.col("value_json") == F.col("first_value")}).drop("first_value")


def extraction_report(pages: DataFrame, folded: DataFrame, source: str = "source_file") -> DataFrame:
    """Fields found per source; a source with none carries a warning."""
    n = folded.groupBy(source).agg(F.countDistinct("field_path").alias("fields"), F.count_if(F.col("status") == "CONFLICT").alias("conflicting_values"))
    out = readable_sources(pages, source).join(n, source, "left").na.fill(0, ["fields", "conflicting_values"])
    return out.withColumn("warning", F.when(~F.col("readable"), "NO_TEXT").when(F.col("fields") == 0, "NO_SUPPORTED_CLAIM"))


# --- fetching ---------------------------------------------------------------------------

def classify_access(works: DataFrame, attempts: DataFrame, held: DataFrame, least_bytes: int = 20_000, most_tries: int = 4) -> DataFrame:
    """Outcome per work.

    works(doi, resolved, n_urls, present); attempts(doi, ord, magic_ok, n_bytes, sha256), in
    order; held(sha256) are contents already stored. The first good file among the first
    tries decides between a duplicate and a download.
    """
    good = attempts.filter((F.col("ord") < most_tries) & F.coalesce(F.col("magic_ok"), F.lit(False)) & (F.col("n_bytes") >= least_bytes))
    first = good.groupBy("doi").agg(F.min_by("sha256", "ord").alias("sha256"))
    known = held.select("sha256").distinct().withColumn("_held", F.lit(True))
    rows = works.join(first.join(known, "sha256", "left"), "doi", "left")
    status = (F.when(~F.col("resolved"), "UNRESOLVED").when(F.col("n_urls") == 0, "NO_OA_PDF").when(F.col("present"), "ALREADY_PRESENT")
              .when(F.col("_held"), "DUPLICATE").when(F.col("sha256").isNotNull(), "DOWNLOADED").otherwise("BLOCKED"))
    return rows.select("doi", status.alias("status"))


def flatten_metadata(messages: DataFrame, v: str = "v") -> DataFrame:
    """Crossref messages(key, v) to bibliographic columns; parts of another type count as missing."""
    get = lambda p, t: F.try_variant_get(v, p, t)
    strings = lambda p: F.when(F.schema_of_variant(get(p, "variant")) == "STRING", get(p, "string"))
    first = lambda p: F.coalesce(strings(f"{p}[0]"), strings(p))
    people = F.coalesce(get("$.author", "array<struct<given:string,family:string>>"), F.array().cast("array<struct<given:string,family:string>>"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = F.filter(F.transform(people, lambda p: F.concat_ws(" ", blank(p["given"]), blank(p["family"]))), lambda n: n != "")
    links = F.filter(F.coalesce(get("$.link", "array<variant>"), F.array().cast("array<variant>")),
                     lambda l: (F.try_variant_get(l, "$['content-type']", "string") == "application/pdf") & F.try_variant_get(l, "$.URL", "string").isNotNull())
    year = "$.published['date-parts'][0][0]"
    return messages.select("key", first("$.title").alias("title"), names.alias("authors"), F.when(F.schema_of_variant(get(year, "variant")) == "BIGINT", get(year, "int")).alias("year"), first("$['container-title']").alias("venue"),
                           strings("$.DOI").alias("doi"), strings("$.URL").alias("publisher_url"), F.when(F.size(links) > 0, F.try_variant_get(F.get(links, F.lit(0)), "$.URL", "string")).alias("pdf_url"))


def fetch_worklist(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """papers(doi, record_json): DOIs to fetch, with the title of the record where it can be read."""
    title = F.try_variant_get(F.try_parse_json("record_json"), "$.paper.title.value", "string")
    rows = papers.filter(F.coalesce("doi", F.lit("")) != "").select("doi", F.left(F.coalesce(title, F.lit("")), F.lit(200)).alias("title"))
    return rows.orderBy("doi").limit(limit) if limit else rows
