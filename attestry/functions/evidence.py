"""Predicates over evidence fields in long form.

A field state is a row: value_json and conflict_values hold canonical JSON text (so 1, 1.0,
true and "1" stay apart), ``sources`` an array of (section, page, locator, evidence, origin,
edition_key, claimed_json), the primary source first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions import vocabulary as V

SOURCE = "struct<section:string,page:int,locator:string,evidence:string,origin:string,edition_key:string,claimed_json:string>"
RESOLUTION = (
    r"(?i)^[~≈]?[0-9][0-9.\s/+\-]*(?:°|degrees?|deg|km|m|cm|arcmin|arcsec)"
    r"(?:\s*[x×]\s*[0-9][0-9.\s/+\-]*(?:°|degrees?|deg|km|m|cm|arcmin|arcsec))?$"
)


def _given(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def is_supplied(s: Column) -> Column:
    """An intentional evidence record, not the empty shell."""
    return (_given(s["section"]) | F.coalesce(s["page"] != 0, F.lit(False)) | _given(s["locator"]) | _given(s["evidence"])
            | _given(s["origin"]) | s["claimed_json"].isNotNull())


def is_locatable(s: Column) -> Column:
    return _given(s["evidence"]) & (_given(s["section"]) | F.coalesce(s["page"] != 0, F.lit(False)) | _given(s["locator"]))


def is_primary(s: Column) -> Column:
    return F.coalesce(s["origin"].isin(*V.PRIMARY_ORIGINS), F.lit(False))


def qualifies(s: Column) -> Column:
    return is_locatable(s) & is_primary(s)


def has_value(value_json: Column) -> Column:
    return value_json.isNotNull() & ~value_json.isin("null", '""', "[]")


def has_primary_evidence(sources: Column) -> Column:
    """Any supplied evidence from the authors, located or not."""
    return F.exists(sources, lambda s: is_supplied(s) & is_primary(s))


def has_exact_evidence(sources: Column) -> Column:
    return F.exists(sources, qualifies)


def display_source(sources: Column, value_json: Column, for_one_value: bool = False) -> Column:
    """First located primary source. For one item of a list of several there is none: the
    excerpt must not vouch for each."""
    fits = F.filter(sources, qualifies)
    first = F.when(F.size(fits) > 0, F.get(fits, F.lit(0)))
    several = F.coalesce(F.json_array_length(value_json) > 1, F.lit(False))
    return F.when(~several, first) if for_one_value else first


def plain(value_json: Column) -> Column:
    """A JSON scalar as text, without quotes."""
    return F.when(F.startswith(value_json, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")).otherwise(value_json)


def plausible_conflict(path: Column, conflict_values: Column, sources: Column) -> Column:
    """A conflict fit to be shown: two to four short, distinct values of one type, each one
    bound by located primary evidence."""
    kind = lambda v: (F.when(F.startswith(v, F.lit('"')), "s").when(v.isin("true", "false", "null") | v.rlike(r"^[\[{]"), "x").when(v.rlike("[.eE]"), "f").otherwise("i"))
    kinds = F.array_distinct(F.transform(conflict_values, kind))
    shown = F.transform(conflict_values, lambda v: F.trim(plain(v)))
    low = F.transform(shown, lambda v: F.lower(v))
    short = F.forall(shown, lambda v: (v != "") & (F.length(v) <= 48) & (F.size(F.split(v, r"\s+")) <= 6) & ~F.contains(v, F.lit("\n")) & ~v.rlike(r"[.!?;:]$"))
    bound = F.transform(F.filter(sources, lambda s: qualifies(s) & s["claimed_json"].isNotNull()), lambda s: F.lower(F.trim(plain(s["claimed_json"]))))
    resolution = ~F.contains(path, F.lit("resolution")) | F.forall(shown, lambda v: v.rlike(RESOLUTION))
    return (
        F.size(conflict_values).between(2, 4) & (F.size(kinds) == 1) & ~F.array_contains(kinds, "x") & (F.size(F.array_distinct(low)) == F.size(low))
        & short & resolution & (F.size(F.array_except(low, bound)) == 0) & (F.size(F.array_except(bound, low)) == 0))
