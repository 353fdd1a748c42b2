"""URL filtering by association rules.

A fixed rule list judges hosts and paths by suffix and prefix. Its verdicts label the URLs that it covers, but what made a rule fit is no
evidence: a labelled URL is taken without its domain and without the host labels and path words of its own rule. Spark's FP-growth mines the
token combinations of the labelled URLs of three quarters of the hosts (by crc32); those that imply a block with enough support and confidence are
candidates. A candidate falls if a part of its tokens is already as confident, or if it is less precise than that confidence on the labelled URLs of the
hosts held out, or fits none of them. The others become rules for the URLs that the list leaves open. Rules are matched by an inverted
index: each is filed under its rarest token, a URL's tokens are joined with the index, and the rest of the rule is checked in place.

What FP-growth gathers is bounded by ``min_support``: at most 1 / min_support tokens per place in a URL are frequent.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, and is allowed unless a mined rule
fits its tokens (it has none); repeated URLs are matched once and share the answer; without labels no rule is mined.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import ascii_lower
from attestry.session import cut_lineage

BLOCK = "class:block"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, own_path, own_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host_ == own_host) | host_.endswith("." + own_host)) & path_.startswith(own_path)
        rule, verdict = F.when(fits, F.lit(own_host + own_path)).otherwise(rule), F.when(fits, F.lit(own_verdict)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct typed tokens of a URL: scheme, host labels, registered domain, path words, query keys and fragment; digits as #."""
    h = host(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    low = ascii_lower(F.regexp_replace(url, r"\d+", "#"))
    words = F.filter(F.split(F.regexp_extract(low, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), r"[/._-]+"), lambda x: x != "")
    keys = F.filter(F.transform(F.split(F.regexp_extract(low, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    tag = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind + ":"), x))
    domain = F.filter(F.array(F.substring_index(h, ".", -2)), lambda x: x != "")
    fragment = F.when(F.contains(url, F.lit("#")), F.array(F.lit("has:fragment"))).otherwise(F.array().cast("array<string>"))
    whole = F.array_distinct(F.concat(tag("host", labels), tag("domain", domain), tag("path", words), tag("key", keys), fragment))
    return F.when(F.contains(url, F.lit("://")), whole).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9) -> DataFrame:
    """(antecedent, support, confidence) of the token sets that imply a block. ``labelled`` has (tokens, block)."""
    rows = labelled.select(F.when(F.col("block"), F.array_append("tokens", BLOCK)).otherwise(F.col("tokens")).alias("items")).filter(F.size("items") > 0)
    total = rows.count()
    if not total:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, support double, confidence double, filed string")
    frequent = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    frequent = cut_lineage(frequent)
    single = frequent.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), F.col("freq").alias("alone"))
    both = frequent.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("hits"))
    rules = both.join(frequent, "items").withColumn("confidence", F.col("hits") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
    rules = rules.select(F.col("items").alias("antecedent"), (F.col("hits") / total).alias("support"), "confidence")
    token = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    filed = token.groupBy("antecedent", "support", "confidence").agg(F.min(F.struct("alone", "token"))["token"].alias("filed"))
    return filed.select("antecedent", "support", "confidence", "filed")


def evidence(tokens_: Column, rule: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The tokens of a URL that say something besides the rule that judged it."""
    own = {}
    for own_host, own_path, _ in rules:
        own[own_host + own_path] = [f"host:{x}" for x in own_host.split(".") if x] + [f"path:{x}" for x in re.split(r"[/._-]+", re.sub(r"[0-9]+", "#", own_path.lower())) if x]
    named = F.from_json(F.lit(json.dumps(own)), "map<string, array<string>>")
    said = F.coalesce(F.try_element_at(named, rule), F.array().cast("array<string>"))
    return F.array_except(F.filter(tokens_, lambda x: ~F.startswith(x, F.lit("domain:"))), said)


def shortest(rules: DataFrame) -> DataFrame:
    """Rules without a part that is a rule at least as confident."""
    general = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("of_part"), "filed")
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("filed")).join(general, "filed")
    inside = (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("of_part") >= F.col("confidence"))
    return rules.join(each.filter(inside).select("antecedent").distinct(), "antecedent", "left_anti")


def proven(rules: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Rules with their precision on held-out rows (tokens, block), where that reaches ``least``."""
    each = held.select("tokens", "block", F.explode("tokens").alias("filed"))
    fits = each.join(rules.select("antecedent", "filed"), "filed").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    right = fits.groupBy("antecedent").agg((F.count_if("block") / F.count("*")).alias("precision"))
    return rules.join(right.filter(F.col("precision") >= least), "antecedent")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The best fitting rule (most confident, then most tokens) of every distinct (url, tokens) that any rule fits."""
    each = urls.select("url", "tokens", F.explode("tokens").alias("filed"))
    fits = each.join(rules, "filed").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = fits.groupBy("url").agg(F.max(F.struct("confidence", F.size("antecedent").alias("n"), F.array_join("antecedent", " ").alias("text"), "support")).alias("b"))
    return best.select("url", F.col("b.text").alias("mined_rule"), F.col("b.confidence").alias("confidence"), F.col("b.support").alias("support"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], min_support: float = 0.005, min_confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence of every page."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict)
    known = rows.filter("given is not null").select("host", evidence(tokens(F.col("url")), F.col("rule"), rules).alias("tokens"), (F.col("given") == "block").alias("block"))
    held = F.crc32("host") % 4 == 2
    mined = shortest(mine(known.filter(~held).select("tokens", "block"), min_support, min_confidence))
    mined = cut_lineage(proven(mined, known.filter(held).select("tokens", "block"), min_confidence))
    open_ = rows.filter("given is null and url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    found = match(open_, mined)
    asked = F.col("given").isNull() & F.col("url").isNotNull()  # only these pages meet the mined rules
    settled = rows.filter(~asked).withColumns({"mined_rule": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    joined = rows.filter(asked).join(found.drop("support"), "url", "left").unionByName(settled)
    final = F.coalesce("given", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", final.alias("verdict"), "mined_rule", "confidence")
