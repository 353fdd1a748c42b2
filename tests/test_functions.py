import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from attestry.functions import evidence as E
from attestry.functions import identity as I
from attestry.functions import numbers as N
from attestry.functions import rules as R
from attestry.functions import text as X


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


TEXTS = ["para-\nmeter", "ﬁne ﬂow", "log(−2.498)", "“Curly” ‘quotes’ — dash", "é a- b- c", "x -y", "A– b", "tab\tand line", "  ", "Ünïcode Straße", "½ cup", "éte"]


def plain_norm(text):
    """Written down from the definition: NFKC, hyphen join, ASCII runs, spaces, case."""
    text = unicodedata.normalize("NFKC", text)
    for dash in "−–—":
        text = text.replace(dash, "-")
    text = re.sub(r"(\w)-\s+(\w)", r"\1\2", text)
    return " ".join(re.findall("[0-9a-zA-Z]+", text)).lower()


def test_normalise_matches_the_definition(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", X.normalise_quote(F.col("t")).alias("n")).collect():
        assert row.n == plain_norm(row.t), row.t


def test_unicode_forms_are_the_default(spark):
    texts = ["5 m² ½ x", "Škoda", "ＡＢ１２ ﬁne", "cafe\u0301 au lait", "1/12° Ⅷ ㎏", "x\u0301y", "naïve – “quoted” ℡", "海洋 sea", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalise_quote(F.col("t")).alias("n"), X.fold_question(F.col("t")).alias("f"), X.title_key(F.col("t")).alias("k"), X.entity_key(F.col("t")).alias("e")).collect()
    for row in rows:
        if row.t is None:
            assert row.n is row.f is row.k is row.e is None
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", row.t) if not unicodedata.category(c).startswith("M"))
        assert row.n == plain_norm(row.t), row.t
        assert row.f == " ".join(re.findall("[0-9a-zA-Z]+", base)).lower(), row.t
        assert row.e == unicodedata.normalize("NFKC", row.t)
    keys = {row.t: row.k for row in rows}
    assert keys["Škoda"] == "skoda" and keys["5 m² ½ x"] == "5 m2 1 2 x" and keys["ＡＢ１２ ﬁne"] == "ab12 fine"


def test_fingerprints_are_those_of_the_ledger(spark):
    import hashlib
    import json

    values = ['["a","b"]', '{"b":1,"a":2}', "0.00001", "1e-5", "1e20", "3", "-0.25", "1.50", "1.0", "123456789.125", '"a, b: é"', '["x, y", {"k": [1, 2.5e-7]}]', "true", "null", "[]", '"a\\nb"']
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", I.claim_fingerprint(F.col("v"), F.lit("the “quote”")).alias("f")).collect()
    for row in rows:
        payload = json.dumps([json.loads(row.v), "the “quote”"], ensure_ascii=False, sort_keys=True)
        assert row.f == hashlib.sha256(payload.encode()).hexdigest()[:16], row.v


def test_supports_settles_unicode_inside_lists(spark):
    row = one(spark, N.supports(F.parse_json(F.lit('["５ m²", "ﬁne"]')), F.lit("a fine 5 m2 grid")), N.supports(F.parse_json(F.lit('["５ m³"]')), F.lit("5 m2")), N.supports(F.parse_json(F.lit('["a＂b"]')), F.lit("a b")))
    assert tuple(row) == (True, False, True)


@pytest.mark.parametrize("text,numbers", [
    ("log(-2.498)", {-2.498}), ("10-5", {10.0, 5.0}), ("MLDRMSE3.83", {3.83}), ("1,000 and 5e−5", {1000.0, 5e-5}), (".5", set()), ("0.50", {0.5}), ("v1.2.3", {1.2}),
])
def test_numeric_tokens(spark, text, numbers):
    got = one(spark, N.numeric_tokens(F.lit(text)))[0]
    assert {float(g) for g in got} == numbers


@pytest.mark.parametrize("value,quote,ok", [
    ("0.5", "rate 0.50", True), ("5", "rate 0.5", False), ('"adam"', "Adam optimizer", True), ('["adam", "sgd"]', "Adam", False), ('["adam", 3]', "Adam 3 times", True), ("true", "", True), ("null", "", True),
    ('"weighted reconstruction losses"', "the reconstruction losses", True), ('"weighted reconstruction losses"', "the losses", False), ('"x"', "", False), ('"ab"', "the cab", True), ('{"a": 1}', "", True),
])
def test_supports(spark, value, quote, ok):
    assert one(spark, N.supports(F.parse_json(F.lit(value)), F.lit(quote)))[0] is ok


def test_fold_and_titles(spark):
    row = one(spark, X.fold_question(F.lit("Époques d'été")), X.title_key(F.lit(" The—Été: Straße_x ")), X.title_key(F.lit("!!")), X.fold_question(F.lit("ﬁn")))
    assert tuple(row) == ("epoques d ete", "the ete strasse x", None, "fin")


def test_identifiers(spark):
    row = one(spark, I.doi_key(F.lit(" HTTPS://doi.org/10.1234/AbC")), I.valid_doi(F.lit("doi:10.1/x")), I.valid_arxiv(F.lit("arXiv:2401.01234v3")), I.valid_arxiv(F.lit("nope")), I.unpinned_arxiv(F.lit("https://arxiv.org/abs/2401.01234v2/")))
    assert tuple(row) == ("10.1234/abc", None, "2401.01234", None, False)


def test_typed_keys_tell_types_apart(spark):
    keys = [one(spark, I.typed_key(F.parse_json(F.lit(v))))[0] for v in ("1", "1.0", "true", '"1"', "[1]")]
    assert len(set(keys)) == 5


def test_list_literals(spark):
    row = one(spark, X.claim_value(F.lit("['a', \"b c\"]")), X.claim_value(F.lit("[1, 2]")), X.claim_value(F.lit("['a', 1]")), X.claim_value(F.lit("[]")), X.claim_value(F.lit(None).cast("string")))
    assert tuple(row) == ('["a","b c"]', '"[1, 2]"', '"[\'a\', 1]"', "[]", None)


def test_sentences_and_sections(spark):
    page = "1 Introduction\nWe study the sea. It is 3 km deep.\nMethods\nThe model runs daily. ok."
    row = one(spark, X.sentences(F.lit(page)), X.section_before(F.lit(page), F.lit("The model runs daily.")))
    assert row[0] == ["1 Introduction We study the sea.", "It is 3 km deep.", "Methods The model runs daily. ok."]
    assert row[1] == "Methods"


def test_editions_take_the_first_rule(spark):
    both = "arXiv:2505.08900v6 https://doi.org/10.1029/2024"
    row = one(spark, R.edition_of(F.lit(both)), R.edition_of(F.lit("Ocean Sci., 21, 23-45, 2025")), R.edition_of(F.lit("hello")), R.dataset_group(F.lit("My ERA5 set")), R.dataset_group(F.lit("Own set")))
    assert tuple(row) == ("PREPRINT", "VERSION_OF_RECORD", None, "ERA5", "Own set")


def test_domains_keep_order_and_report_the_rest(spark):
    kept, unmatched = R.normalise_domains(F.array(*[F.lit(x) for x in ("Sea ice", "sst", "sea_ice drift", "zzz ")]))
    row = one(spark, kept, unmatched)
    assert row[0] == ["sea-ice", "sst"] and row[1] == ["zzz"]


def test_plausible_conflicts(spark):
    def source(claimed, origin="PRIMARY_PAPER"):
        return F.struct(F.lit("s").alias("section"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("locator"), F.lit("e").alias("evidence"), F.lit(origin).alias("origin"), F.lit(None).cast("string").alias("edition_key"), F.lit(claimed).alias("claimed_json"))

    def verdict(path, values, sources):
        return one(spark, E.plausible_conflict(F.lit(path), F.array(*[F.lit(v) for v in values]), F.array(*sources)))[0]

    two = [source('"a b"'), source('"c"')]
    assert verdict("x.y", ['"a b"', '"c"'], two)
    assert not verdict("x.y", ['"a b"', '"A B"'], two)
    assert not verdict("x.y", ['"a b"', "3"], two)
    assert not verdict("x.y", ['"a b"', '"c."'], [source('"a b"'), source('"c."')])
    assert not verdict("data.spatial_resolution", ['"a b"', '"c"'], two)
    assert verdict("data.spatial_resolution", ['"1/4°"', '"9 km"'], [source('"1/4°"'), source('"9 km"')])
    assert not verdict("x.y", ['"a b"', '"c"'], [source('"a b"'), source('"c"', "OTHER")])


def test_supports_reads_lists_of_any_depth(spark):
    from attestry.functions.numbers import supports

    for depth in range(1, 9):
        row = spark.range(1).select(*(supports(F.parse_json(F.lit("[" * depth + v + "]" * depth)), F.lit("the model uses adam here")) for v in ('"zzz"', '"adam"', "7"))).first()
        assert tuple(row) == (False, True, False)


def test_exact_median_keeps_the_null_key(spark):
    from attestry.operators import keyed

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "k string, v double")
    got = {r["k"]: r["median_value"] for r in keyed.exact_median(rows, ["k"], "v").collect()}
    assert got == {"a": 2.0, None: 6.0}
