"""Secret scanning with corpus-wide ownership frequency.

Base spans are those of three fixed patterns (assign, access, hex). The method looks at every other token that could
be a credential (20 or more of ``[A-Za-z0-9+/_-]``, with a digit, a lower-case and an upper-case letter) and asks the corpus who uses it:
candidate hashes are aggregated by distinct repository and owner. A candidate of one owner in at most ``max_repositories``
repositories looks live and becomes a span of kind ``owned``; what several owners hold is a copied example and is only counted.
The same frequencies sort the base spans into live ones and examples.

Positions come from native functions: a pattern's matches and the pieces between them alternate, so their
lengths add up to the starts; sums and comparisons go by chunks, so a text with n matches takes about n * sqrt(n) steps. Only hashes and counts are shuffled; the candidates are stored once in the shared folder.
Hot candidates are reduced before each shuffle, first by repository, then by owner.

Defined cases: a null text is empty and has no spans; a null owner or repository counts as one of its own; rows that repeat
count once per repository; rows with the same id, owner and text get the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import let, stored

# The base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"         # the runs of [0-9a-f]+ with 24 characters or more
LEAST_VALUE = 6
_T = "[A-Za-z0-9+/_-]"
TOKEN = rf"(?<!{_T})(?={_T}{{20}})(?={_T}*[0-9])(?={_T}*[a-z])(?={_T}*[A-Z]){_T}+"
KINDS = ("assign", "access", "hex", "owned")


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, value) for the leftmost non-overlapping matches; positions in code points."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def located(found: Column, gaps: Column, values: Column) -> Column:
        n = F.size(found)
        chunk = F.ceil(F.sqrt(n)).cast("int")  # matches to a chunk, and chunks: an array grows by no more than that many steps

        def step(state: Column, i: Column) -> Column:
            begin = state["at"] + F.length(F.get(gaps, i))
            end = begin + F.length(F.get(found, i))
            value = F.get(values, i)
            span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")))
            return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

        def one(at: Column, j: Column) -> Column:
            """Where the text goes on after chunk ``j``, and its spans."""
            places = F.sequence(j * chunk, F.least(n, (j + 1) * chunk) - 1)
            return F.aggregate(places, F.struct(at.alias("at"), empty.alias("out")), step)

        whole = F.aggregate(
            F.sequence(F.lit(0), F.ceil(n / chunk).cast("int") - 1), F.struct(F.lit(0).alias("at"), F.array(empty).alias("outs")),
            lambda state, j: let(one(state["at"], j), lambda r: F.struct(r["at"].alias("at"), F.concat(state["outs"], F.array(r["out"])).alias("outs"))),
        )
        return F.flatten(whole["outs"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    parts = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"), values.alias("values"))
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, lambda p: located(p["found"], p["gaps"], p["values"]))).otherwise(empty)


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span. Base spans come sorted; whole chunks of them are passed over by their outer ends."""

    def free(chunks: Column) -> Column:
        meets = lambda t, s: (t["start"] < s["end"]) & (s["start"] < t["end"])
        return F.filter(tokens, lambda t: ~F.exists(chunks, lambda c: F.when(meets(t, c), F.exists(c["spans"], lambda s: meets(t, s))).otherwise(False)))

    def chunked(b: Column) -> Column:
        n = F.size(b)
        m = F.ceil(F.sqrt(n)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(n / m).cast("int") - 1), lambda j: F.slice(b, j * m + 1, m))
        return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.array_max(F.transform(p, lambda s: s["end"])).alias("end"), p.alias("spans")))

    return F.when(F.size(base) == 0, tokens).otherwise(let(base, lambda b: let(chunked(b), free)))


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """doc_id, repository, owner, text_hash, base spans and other candidate spans of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), text.alias("text"))
    base = F.array_sort(F.concat(spans(F.col("text"), ASSIGN, 0, 2, LEAST_VALUE), spans(F.col("text"), ACCESS, 1), spans(F.col("text"), HEX, 2)))
    tokens = spans(F.col("text"), TOKEN, 3)
    found = rows.select("doc_id", "repository", "owner", F.xxhash64("text").alias("text_hash"), base.alias("base"), tokens.alias("tokens"))
    other = apart(F.col("tokens"), F.col("base"))
    hidden = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"], F.xxhash64(s["value"]).alias("hash")))
    return found.select("doc_id", "repository", "owner", "text_hash", hidden("base").alias("base"), hidden(other).alias("other"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every candidate in the corpus, base spans included."""
    each = found.select("repository", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "other"), lambda s: s["hash"]))).alias("hash")).distinct()
    return each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def joined_spans(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, repository: Column, owner: Column, max_repositories: int = 3) -> DataFrame:
    """Every row with its base spans, added spans, and how many of them look live or copied."""
    found = stored(candidates(docs, repository, owner), "secret-candidates")
    known = ownership(found)
    each = found.select("doc_id", "owner", "text_hash", F.explode(F.concat("base", "other")).alias("s")).distinct()
    judged = each.join(known, F.col("s.hash") == F.col("hash")).withColumn("live", (F.col("owners") == 1) & (F.col("repositories") <= max_repositories))
    marks = judged.groupBy("doc_id", "owner", "text_hash").agg(
        F.collect_set(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("owned"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example"),
    ).select(F.col("doc_id").alias("_id"), F.col("owner").alias("_owner"), F.col("text_hash").alias("_hash"), "owned", "n_live", "n_example")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("text_hash") == F.col("_hash"))
    rows = found.join(marks, same, "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    whole = F.when(F.col("owned").isNull(), F.col("base")).otherwise(F.concat("base", "owned"))
    return rows.select(
        "doc_id", "owner", "base", "owned", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        joined_spans(F.col("base")).alias("base_spans"), joined_spans(whole).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )
