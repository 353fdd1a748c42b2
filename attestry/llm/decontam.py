"""Benchmark decontamination by templates: finds benchmark passages, re-parameterised ones too.

Texts become tokens; numbers, units after a number, and names (capitalised words inside a sentence) become
typed placeholders, all else is lower-cased. Every window of ``window`` template tokens is hashed. Windows of the
benchmark are kept in a bit set of fixed size, which screens the windows of a document where they are made; those that
pass meet the benchmark in an exact hash join. Matches on one diagonal (document place minus item place) form an
alignment; along it the values in the placeholders are compared: each value of the item must always stand
for one value of the document, and different names for different names.

A window counts if at least half of it is literal, or if its values are the item's own (it is verbatim). A document is contaminated
by an item if an alignment has at least ``enough`` (all of the item's, if it has fewer) verbatim windows, whatever its other
windows hold, or as many counting windows with consistent slots. In an alignment without consistent slots only verbatim windows count.

An item with fewer tokens than the window is one window, the whole, and documents are windowed at the lengths of such items too. The code
of an item's first token depends on the text before it, which only the document has: the first window is kept with each code it can have.

Defined cases: a text without tokens (or null) has no window; an item of a word or two is held by every document with these words;
rows with the same id and text get the same answer; benchmark items with the same text are told apart by id, the smallest wins a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import let

# Units of measure and money, as words.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches yd yard yards meter meters metre metres l ml liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh "
    "dollar dollars cent cents euro euros pound pounds usd eur percent degree degrees v w kw j n pa hz"
).split()
NAME = r"\p{Lu}(?<=[\p{L},;] .)\p{Ll}+"
TOKEN = r"\x01?[\p{L}\p{M}]+|\d+(?:[.,]\d+)*"
WORDS_IN_SET = 1 << 14  # longs in the bit set: 128 KB, whatever the benchmark
NAMED, UNIT, NUMBER = 1, 2, 3  # codes of the placeholders


def tokens(text: Column) -> Column:
    """The raw tokens; names begin with \\x01."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), NAME, "\x01$0")
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def _codes(t: Column) -> Column:
    """The template, one number for each token: a placeholder's code, or the hash of the literal."""
    digit = lambda x: x < ":"  # noqa: E731  of what a token can begin with, only \x01 and digits sort before the colon
    long = lambda n: F.lit(n).cast("long")

    def code(token: Column, i: Column) -> Column:
        literal = F.xxhash64(F.lower(token))
        unit = token.isin(*UNITS) & F.coalesce(digit(F.get(t, i - 1)), F.lit(False))
        return F.when(digit(token), F.when(token < "\x02", long(NAMED)).otherwise(long(NUMBER))).when(unit, long(UNIT)).otherwise(literal)

    return F.transform(t, code)


def _screen(codes: Column, i: Column, half, last) -> Column:
    """A cheap number of a window, from three of its tokens."""
    at = lambda k: F.get(codes, i + k)
    return at(0).bitwiseXOR(F.shiftleft(at(half), 1)).bitwiseXOR(F.shiftleft(at(last), 2))


def _windows(t: Column, codes: Column, window: int, keep=None, lengths: Column | None = None) -> Column:
    """Array of (at, code, screen, raw tokens, kinds) of tokens and their codes; ``keep`` screens before the hash is taken.

    ``lengths`` names lengths under ``window``, at which windows are made too.
    """
    n = F.size(codes)
    pick = lambda c, i: F.array(*[F.get(c, i + k) for k in range(window)])
    kept = lambda at, screen: at if keep is None else F.filter(at, lambda i: keep(screen(i)))

    def long() -> Column:
        screen = lambda i: _screen(codes, i, window // 2, window - 1)
        return F.transform(kept(F.sequence(F.lit(0), n - window), screen), lambda i: F.struct(
            i.alias("at"), F.xxhash64(*[F.get(codes, i + k) for k in range(window)]).alias("code"), screen(i).alias("screen"),
            pick(t, i).alias("raw"), pick(codes, i).alias("kinds"),
        ))

    def short(m: Column) -> Column:
        screen = lambda i: _screen(codes, i, F.shiftright(m, 1), m - 1)
        part = lambda c, i: F.slice(c, i + 1, m)
        return F.transform(kept(F.sequence(F.lit(0), n - m), screen), lambda i: F.struct(
            i.alias("at"), F.xxhash64(part(codes, i)).alias("code"), screen(i).alias("screen"), part(t, i).alias("raw"), part(codes, i).alias("kinds"),
        ))

    none = F.array().cast("array<struct<at:int,code:bigint,screen:bigint,raw:array<string>,kinds:array<bigint>>>")
    whole = F.when(n >= window, long()).otherwise(none)
    return whole if lengths is None else F.concat(whole, F.flatten(F.transform(F.filter(lengths, lambda m: m <= n), short)))


def windows(raw: Column, window: int, keep, lengths: Column) -> Column:
    """The windows of a document's tokens."""
    return let(raw, lambda t: let(_codes(t), lambda c: _windows(t, c, window, keep, lengths)))


def item_windows(raw: Column, window: int) -> Column:
    """The windows of an item's tokens; an item with fewer than ``window`` is one, the whole.

    Behind other text the first token can be a name or a unit, so the first window is also there as it is then.
    """

    def of(t: Column, codes: Column) -> Column:
        n, first = F.size(t), F.get(t, 0)
        own = F.filter(F.array(n), lambda m: m.between(1, window - 1))
        begun = lambda a, b, when: F.when(when, F.filter(_windows(a, b, window, None, own), lambda w: w["at"] == 0)).otherwise(F.array())
        swapped = lambda x, c: F.concat(F.array(x), F.slice(c, F.lit(2), n))
        named = swapped(F.concat(F.lit("\x01"), first), t)
        as_name = let(named, lambda x: let(_codes(x), lambda c: begun(x, c, first.rlike(r"^\p{Lu}\p{Ll}"))))
        as_unit = let(swapped(F.lit(UNIT).cast("long"), codes), lambda c: begun(t, c, first.isin(*UNITS)))
        return F.concat(_windows(t, codes, window, None, own), as_name, as_unit)

    return let(raw, lambda t: let(_codes(t), lambda c: of(t, c)))


def _slots(item: Column, doc: Column, kinds: Column) -> Column:
    """(type, item's value, document's value) of the slots of two windows with one template."""
    pairs = F.transform(kinds, lambda k, i: F.struct(k.alias("type"), F.lower(F.get(item, i)).alias("item"), F.lower(F.get(doc, i)).alias("doc")))
    return F.filter(pairs, lambda p: p["type"].between(NAMED, NUMBER))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, enough: int = 6) -> DataFrame:
    """One row per document text and item that align: doc_id, text_hash, item_id, windows, verbatim, needed, n_slots, n_changed, consistent, contaminated."""
    items = benchmark.select("item_id", F.explode(item_windows(tokens(F.col("text")), window)).alias("w")).select("item_id", "w.*").withColumnsRenamed({"at": "place", "raw": "item_raw"}).drop("kinds")
    index = F.shiftrightunsigned("screen", 50).cast("int")
    cells = items.groupBy(index.alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("screen").bitwiseAND(63).cast("int"))).alias("cell"))
    whole = docs.sparkSession.range(WORDS_IN_SET).select(F.col("id").cast("int").alias("i")).join(cells, "i", "left")
    bits = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("cell", F.lit(0).cast("long")).alias("cell")))), lambda s: s["cell"]).alias("bits"))

    bits = bits.crossJoin(items.agg(F.collect_set(F.when(F.size("item_raw") < window, F.size("item_raw"))).alias("lengths")))

    def seen(screen: Column) -> Column:
        cell = F.get("bits", F.shiftrightunsigned(screen, 50).cast("int"))
        return F.getbit(cell, screen.bitwiseAND(63).cast("int")) == 1

    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).crossJoin(F.broadcast(bits))
    hits = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(windows(tokens(F.col("text")), window, seen, F.col("lengths"))).alias("w")).select("doc_id", "text_hash", "w.*").drop("screen")

    pairs = hits.join(items, "code")
    slots = _slots(F.col("item_raw"), F.col("raw"), F.col("kinds"))
    literal = F.size("item_raw") - F.size(slots)
    same = F.transform("item_raw", F.lower) == F.transform("raw", F.lower)
    scored = pairs.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("place")).alias("shift"), "place", slots.alias("slots"), same.alias("same"), (same | (literal * 2 >= F.size("item_raw"))).alias("counts"))
    sized = items.groupBy("item_id").agg(F.countDistinct("place").alias("n_windows"))
    aligned = scored.groupBy("doc_id", "text_hash", "item_id", "shift").agg(
        F.count_distinct(F.when(F.col("counts"), F.col("place"))).alias("counting"), F.count_distinct(F.when(F.col("same"), F.col("place"))).alias("verbatim"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    n = lambda c: F.size(F.array_distinct(c))
    name = F.filter("slots", lambda s: s["type"] == NAMED)
    one_way = n(F.transform("slots", lambda s: F.struct(s["type"], s["item"]))) == F.size("slots")
    other_way = n(F.transform(name, lambda s: s["doc"])) == F.size(name)
    changed = F.size(F.filter("slots", lambda s: s["item"] != s["doc"]))
    joined = aligned.join(sized, "item_id").withColumn("needed", F.least(F.lit(enough), "n_windows")).withColumn("consistent", one_way & other_way)
    held = F.when(F.col("consistent"), F.col("counting")).otherwise(F.col("verbatim"))
    return joined.select(
        "doc_id", "text_hash", "item_id", "shift", held.alias("windows"), "verbatim", "n_windows", "needed",
        F.size("slots").alias("n_slots"), changed.alias("n_changed"), "consistent", (held >= F.col("needed")).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, enough: int = 6) -> DataFrame:
    """doc_id and text_hash of every row, with the item that it holds most of: item_id, windows, n_windows, n_slots, n_changed,
    verdict (verbatim if it has the needed windows word for word, else reparameterised or clean)."""
    found = matches(docs, benchmark, window, enough).filter("contaminated")
    best = found.groupBy("doc_id", "text_hash").agg(
        F.max(F.struct("windows", (-F.col("n_changed")).alias("same"), (-F.col("item_id")).alias("first"), "n_windows", "n_slots", (F.col("verbatim") >= F.col("needed")).alias("exact"))).alias("b")
    ).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (-F.col("b.first")).alias("item_id"), "b.windows", "b.n_windows", "b.n_slots", (-F.col("b.same")).alias("n_changed"), F.col("b.exact").alias("_exact"))
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    joined = rows.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    verdict = F.when(F.col("item_id").isNull(), "clean").when(F.col("_exact"), "verbatim").otherwise("reparameterised")
    return joined.withColumn("verdict", verdict).drop("_exact")
