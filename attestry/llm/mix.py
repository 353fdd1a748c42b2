"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks of ``block_rows``. With weight a out of a total of Q, block k of a source
is released at slot ``floor((k - 1) * Q / a)`` and due by ``ceil(k * Q / a)``; every slot goes to the released block
with the earliest deadline. So at every slot each source is less than one block from its share.

The schedule repeats after Q slots, so one period of it is enough: it is folded once, as an SQL
expression over Q slots and the named sources, whatever the number of rows. When a source runs out, a new phase
starts with the weights of those left, until all rows are placed. Block k of a source finds its slot by arithmetic.

Sources are those named in the weights; all others, and null, form one pool. Row numbers within a source come from
buckets of a hash, so a source with a third of all rows is ranked in many tasks.

Defined cases: every row is kept, repeated rows too; a source with weight 0 goes last, in a phase of its own; ties between
sources go to the one named first; the last block of a source may be short; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import bucket_count, let

OTHERS = "*"


def _pos(period: Column, source: Column) -> Column:
    """The slots (from 0) of a source within a period."""
    return F.filter(F.sequence(F.lit(0), F.size(period) - 1), lambda i: F.get(period, i) == source)


def _period(weights: Column, sources: int) -> Column:
    """The source of each slot of one period: the earliest deadline among the released blocks. Sources of weight 0 take no slot."""

    def schedule(total: Column) -> Column:
        def step(state: Column, t: Column) -> Column:
            served = state["served"]

            def candidate(i: Column) -> Column:
                w, c = F.get(weights, i), F.get(served, i).cast("long")
                released = (w > 0) & (F.floor(c * total / w) <= t)
                return F.when(released, F.struct(F.ceil((c + 1) * total / w).alias("due"), i.alias("i")))

            pick = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(sources - 1)), candidate))["i"]
            return let(pick, lambda p: F.struct(
                F.transform(served, lambda c, i: c + F.when(i == p, 1).otherwise(0)).alias("served"),
                F.concat(state["slots"], F.array(p)).alias("slots"),
            ))

        empty = F.struct(F.array_repeat(F.lit(0), sources).alias("served"), F.array().cast("array<int>").alias("slots"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), empty, step, lambda s: s["slots"])

    return let(F.aggregate(weights, F.lit(0).cast("long"), lambda x, w: x + w), schedule)


def _phase(state: Column, weights: list[int]) -> Column:
    """One phase: the period of the sources that have blocks left, its length in slots, and what each has placed at its end."""
    n = len(weights)
    fixed = F.array(*[F.lit(w).cast("long") for w in weights])
    left = state["left"]
    some = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.get(left, i) > 0) & (F.get(fixed, i) > 0))
    active = F.transform(fixed, lambda w, i: F.when(F.get(left, i) > 0, F.when(some, w).otherwise(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))

    def with_weights(a: Column) -> Column:
        def with_period(period: Column) -> Column:
            q = F.size(period).cast("long")

            def last_slot(i: Column) -> Column:
                m, w = F.get(left, i), F.get(a, i)
                return F.when(w > 0, F.floor((m - 1) / w) * q + F.get(_pos(period, i), ((m - 1) % w).cast("int")) + 1)

            def with_length(length: Column) -> Column:
                placed = F.transform(a, lambda w, i: F.floor(length / q) * w + F.size(F.filter(F.slice(period, F.lit(1), (length % q).cast("int")), lambda s: s == i)))
                return let(placed, lambda p: F.struct(
                    F.transform(left, lambda m, i: m - F.get(p, i)).alias("left"),
                    F.transform(state["done"], lambda d, i: d + F.get(p, i)).alias("done"),
                    (state["start"] + length).alias("start"),
                    F.concat(state["phases"], F.array(F.struct(state["start"].alias("start"), state["done"].alias("done"), p.alias("placed"), a.alias("weights"), period.alias("period")))).alias("phases"),
                ))

            return let(F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), last_slot)), with_length)

        return let(_period(a, n), with_period)

    finished = ~F.exists(left, lambda m: m > 0)
    return F.when(finished, state).otherwise(let(active, with_weights))


def schedule(blocks: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(source_no, from_block, to_block, start, weight, total, offsets): where the blocks of each source go, phase by phase.

    ``blocks`` has (source_no, n_blocks), one row per named source at most. The result has at most (sources)^2 rows.
    """
    n = len(weights)
    counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("long")))
    row = blocks.agg(F.map_from_entries(F.collect_list(F.struct("source_no", F.col("n_blocks").cast("long")))).alias("found"))
    zero = F.array_repeat(F.lit(0).cast("long"), n)
    phases = "array<struct<start:bigint,done:array<bigint>,placed:array<bigint>,weights:array<bigint>,period:array<int>>>"
    start = F.struct(counts.alias("left"), zero.alias("done"), F.lit(0).cast("long").alias("start"), F.array().cast(phases).alias("phases"))
    folded = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda state, _: _phase(state, list(weights.values())), lambda s: s["phases"]).alias("phases"))
    each = folded.select(F.explode("phases").alias("p")).select("p.*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("source_no"))
    own = lambda c: F.get(c, "source_no")
    return each.filter(own("placed") > 0).select(
        "source_no", own("done").alias("from_block"), (own("done") + own("placed")).alias("to_block"), "start", own("weights").alias("weight"),
        F.size("period").cast("long").alias("total"), _pos(F.col("period"), F.col("source_no")).alias("offsets"),
    )


def mixed(rows: DataFrame, keys: list[str], source: str, weights: dict[str, int], block_rows: int = 64, per_bucket: int = 4096) -> DataFrame:
    """The key columns and the source of every row with ``block`` (within its source), ``slot`` and the gapless ``position``.

    ``keys`` should tell rows apart; rows that agree in all of them are interchangeable.
    """
    weights = dict(weights) | ({} if OTHERS in weights else {OTHERS: 0})
    names = list(weights)
    narrow = rows.select(*keys, F.col(source).cast("string").alias("_source")).withColumn("source_no", _numbered(names))
    total = rows.count()
    buckets = bucket_count(total, per_bucket)
    hashed = F.xxhash64(*keys, F.lit(7))
    groups = narrow.groupBy("source_no", *keys, "_source").agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(hashed, F.lit(buckets)))
    sums = groups.groupBy("source_no", "_bucket").agg(F.sum("_n").alias("_size"))
    before = sums.select("source_no", "_bucket", (F.sum("_size").over(Window.partitionBy("source_no").orderBy("_bucket")) - F.col("_size")).alias("_before"))
    inside = Window.partitionBy("source_no", "_bucket").orderBy(hashed, *keys, "_source")
    ranked = groups.withColumn("_rank", F.sum("_n").over(inside) - F.col("_n")).join(before, ["source_no", "_bucket"])
    ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    index = F.col("_before") + F.col("_rank") + F.col("_copy")
    placed = ranked.select(*keys, "_source", "source_no", F.call_function("div", index, F.lit(block_rows).cast("long")).alias("block"), (index % block_rows).alias("_offset"))

    per_source = sums.groupBy("source_no").agg(F.sum("_size").alias("n_rows")).withColumn("n_blocks", F.ceil(F.col("n_rows") / block_rows))
    plan = schedule(per_source.select("source_no", "n_blocks"), weights)

    def slot(block: Column) -> Column:
        m = block - F.col("from_block")
        return F.col("start") + F.call_function("div", m, F.col("weight")) * F.col("total") + F.get("offsets", (m % F.col("weight")).cast("int"))

    # One row per source (at most as many as there are weights): its phases, and after which slots a short block shifts what follows.
    short = per_source.filter(F.col("n_rows") % block_rows != 0).join(plan, "source_no").filter((F.col("n_blocks") - 1 >= F.col("from_block")) & (F.col("n_blocks") - 1 < F.col("to_block")))
    gaps = short.agg(F.collect_list(F.struct(slot(F.col("n_blocks") - 1).alias("slot"), (block_rows - F.col("n_rows") % block_rows).alias("missing"))).alias("gaps"))
    phases = plan.groupBy("source_no").agg(F.collect_list(F.struct("from_block", "to_block", "start", "weight", "total", "offsets")).alias("phases"))
    joined = placed.join(F.broadcast(phases), "source_no").crossJoin(F.broadcast(gaps))
    phase = F.get(F.filter("phases", lambda p: (p["from_block"] <= F.col("block")) & (F.col("block") < p["to_block"])), F.lit(0))
    found = joined.withColumn("_phase", phase).select("*", "_phase.*").withColumn("slot", slot(F.col("block")))
    missing = F.aggregate(F.filter("gaps", lambda g: g["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda x, g: x + g["missing"])
    return found.select(*keys, F.col("_source").alias("source"), "block", "slot", (F.col("slot") * block_rows + F.col("_offset") - missing).alias("position"))


def _numbered(names: list[str]) -> Column:
    """The place of a source among the named ones; all others share the pool's."""
    listed = F.array(*[F.lit(s) for s in names])
    at = F.coalesce(F.array_position(listed, F.col("_source")), F.lit(0).cast("long"))
    return F.when((at > 0) & (F.col("_source") != OTHERS), at - 1).otherwise(F.lit(names.index(OTHERS))).cast("int")
