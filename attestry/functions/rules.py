"""Ordered rules: the first that matches decides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V


def first_match(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Label of the first regular expression found in the text, or null."""
    ladder = None
    for pattern, label in rules:
        ladder = F.when(text.rlike(pattern), F.lit(label)) if ladder is None else ladder.when(text.rlike(pattern), F.lit(label))
    return ladder


def first_contained(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Label of the first keyword contained in the text, or null.

    Neighbouring rules with one label share a branch, which keeps order and shortens the
    expression. A CASE needs no join, so labels are never multiplied by rules or shuffled.
    """
    groups: list[tuple[str, list[str]]] = []
    for word, label in rules:
        if groups and groups[-1][0] == label:
            groups[-1][1].append(word)
        else:
            groups.append((label, [word]))
    ladder = None
    for label, words in groups:
        hit = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(text, F.lit(word))
        ladder = F.when(hit, F.lit(label)) if ladder is None else ladder.when(hit, F.lit(label))
    return ladder


def edition_of(quote: Column) -> Column:
    """Edition an evidence quote proves, or null when it proves none."""
    return first_match(F.lower(F.trim(F.regexp_replace(quote, r"\s+", " "))), V.EDITION_SIGNALS)


def publication_markers(page_text: Column) -> Column:
    """Names of the marks of a published article that a page shows."""
    text = F.lower(F.regexp_replace(page_text, r"\s+", " "))
    marks = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in V.PUBLICATION_MARKERS]
    return F.array_compact(F.array(*marks))


def domain_of(label: Column) -> Column:
    """Vocabulary domain of one raw label: itself, or the first keyword rule it meets."""
    token = F.trim(label)
    loose = F.replace(F.lower(token), F.lit("_"), F.lit(" "))
    return F.when(token.isin(*V.DOMAINS), token).otherwise(first_contained(loose, V.DOMAIN_RULES))


def normalise_domains(labels: Column) -> tuple[Column, Column]:
    """(distinct domains in order of first mention, labels no rule covers)."""
    kept = F.array_distinct(F.array_compact(F.transform(labels, lambda l: domain_of(l))))
    unmatched = F.transform(F.filter(labels, lambda l: domain_of(l).isNull()), lambda l: F.trim(l))
    return kept, unmatched


def dataset_group(name: Column) -> Column:
    """Source a data set name belongs to; the name itself when no keyword matches."""
    rules = [(word, group) for group, words in V.DATASET_GROUPS.items() for word in words]
    return F.coalesce(first_contained(F.lower(name), rules), F.nullif(name, F.lit("")))


def display_theme(path: Column) -> Column:
    """Theme of a field path, by its first segment."""
    head = F.substring_index(path, ".", 1)
    ladder = None
    for theme, prefixes in V.DISPLAY_THEMES.items():
        ladder = (F if ladder is None else ladder).when(head.isin(*prefixes), F.lit(theme))
    return ladder.otherwise(F.lit("Other"))


def rank_in(value: Column, order: Iterable[str], missing: int | None = None) -> Column:
    """Position of a value in a fixed order."""
    names = list(order)
    found = F.array_position(F.array(*[F.lit(n) for n in names]), value) - 1
    return F.when(F.coalesce(found, F.lit(-1)) < 0, F.lit(len(names) if missing is None else missing)).otherwise(found)
