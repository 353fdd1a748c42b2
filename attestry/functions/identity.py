"""Identifiers, canonical JSON and fingerprints."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.text import json_text

# Identifier shapes and the prefixes people paste them with.
DOI_SHAPE = r"^10\.\d{4,9}/\S+$"
ARXIV_SHAPE = r"^(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]+/\d{7})(?:v\d+)?$"
DOI_PREFIX = r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
ARXIV_PREFIX = r"^(?:https?://arxiv\.org/abs/|arxiv:)"
PREFERRED_HOSTS = ("arxiv.org", "biorxiv", "essoar", "hal.", "archimer", "zenodo", "osti.gov")


def doi_key(doi: Column) -> Column:
    """Lenient key: trimmed, lower case, no resolver prefix; blank becomes null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(doi)), DOI_PREFIX, ""), F.lit(""))


def valid_doi(doi: Column) -> Column:
    """The key where it has the shape of a DOI, else null."""
    key = F.trim(doi_key(doi))
    return F.when(key.rlike(DOI_SHAPE), key)


def valid_arxiv(identifier: Column) -> Column:
    """Versionless arXiv id where the text has that shape, else null."""
    key = F.trim(F.regexp_replace(F.lower(F.trim(identifier)), ARXIV_PREFIX, ""))
    return F.when(key.rlike(ARXIV_SHAPE), F.regexp_replace(key, r"v\d+$", ""))


def unpinned_arxiv(url: Column) -> Column:
    """An arxiv.org address whose path names no version."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return (F.try_parse_url(url, F.lit("HOST")) == "arxiv.org") & ~path.rlike(r"v\d+/?$")


def rank_hosts(urls: Column) -> Column:
    """Distinct addresses, known repositories first, otherwise in the given order."""
    known = "|".join(host.replace(".", r"\.") for host in PREFERRED_HOSTS)
    distinct = F.array_distinct(urls)
    return F.concat(F.filter(distinct, lambda u: u.rlike(known)), F.filter(distinct, lambda u: ~u.rlike(known)))


def row_fingerprint(row: Column) -> Column:
    """sha256 of a row's JSON. Null members are left out, so a new empty column changes nothing."""
    return F.sha2(F.to_json(row), 256)


# JSON values whose text is the same in every ledger: strings, integers, names, short decimals.
SETTLED = r'^(?:".*"|-?(?:0|[1-9][0-9]*)|true|false|null|-?(?:0|[1-9][0-9]{0,8})\.(?:[0-9]{0,2}[1-9]|0))$'


@F.pandas_udf(T.StringType())
def _ledger_json(values: pd.Series) -> pd.Series:
    def text(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(json.loads(value), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return value

    return values.map(text)


def ledger_json(value_json: Column) -> Column:
    """JSON as ledgers hash it: sorted keys, a space after commas and colons, shortest floats. Only lists, objects and long floats go through Arrow."""
    return F.coalesce(_ledger_json(F.when(~value_json.rlike("(?s)" + SETTLED), value_json)), value_json)


def claim_fingerprint(value_json: Column, quote: Column) -> Column:
    """Identity of what a verdict was given on: the value and the quote, nothing else."""
    payload = F.concat(
        F.lit("["), F.coalesce(ledger_json(value_json), F.lit("null")), F.lit(", "),
        json_text(F.coalesce(quote, F.lit(""))), F.lit("]"),
    )
    return F.substring(F.sha2(payload, 256), 1, 16)


def stable_id(*parts: Column) -> Column:
    """Deterministic id of ordered parts; a null part differs from an empty one."""
    marked = [F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *marked), 256)


def canonical_json(value: Column) -> Column:
    """JSON text of a VARIANT. A whole number written as a decimal keeps its point, so 1 and 1.0 differ."""
    text = F.to_json(value)
    decimal = F.schema_of_variant(value).rlike("^(DECIMAL|DOUBLE|FLOAT)") & text.rlike("^-?[0-9]+$")
    return F.when(decimal, F.concat(text, F.lit(".0"))).otherwise(text)


def typed_key(value: Column) -> Column:
    """Groupable key of a VARIANT that keeps 1, 1.0, true and "1" apart."""
    return F.concat(F.schema_of_variant(value), F.lit(":"), F.to_json(value))


def identity_key(doi: Column, arxiv: Column, content: Column) -> Column:
    """Strongest identity a paper offers: DOI, then arXiv id, then its content."""
    return F.coalesce(
        F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), arxiv),
        F.concat(F.lit("content:"), F.sha2(content, 256)),
    )
