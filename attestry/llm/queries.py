"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontam, langid, licences, lm, media, minhash, mix, negatives, resample, secret_scan, shard, sitetree, urls
from attestry.llm.common import id_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Target weights in blocks per round. Sources that are not named share the pool's.
TARGETS = {"src0": 16} | {f"src{i}": 8 for i in range(1, 5)} | {f"src{i}": 4 for i in range(5, 12)} | {f"src{i}": 2 for i in range(12, 20)} | {mix.OTHERS: 1}
SHARDS, SEED = 40, 2026
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_lm_scoring")
def op1(spark, sf):
    return lm.score(table(spark, sf, "documents"), id_remainder("doc_id", 7) == 2)


@query("op2_chroma_fingerprints")
def op2(spark, sf):
    """The UTF-8 bytes of each text are taken as 8-bit sound."""
    clips = table(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), F.col("text").cast("binary").alias("sound"))
    return media.aligned(clips, F.col("clip_id") % 50 == 0).withColumnRenamed("clip_id", "doc_id")


# The definition itself: full sets, every pair with a common shingle, and what is reachable over links.
_NEAR = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as (select doc_id, case when len(ws) >= 5 then list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as s from w),
sh as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (select a.doc_id as u, b.doc_id as v from sh a join sh b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach as (select doc_id as u, doc_id as v from documents union select reach.u, links.v from reach join links on links.u = reach.v)
select sets.doc_id, len(s)::bigint as n_shingles, min(v) as component_id, sets.doc_id = min(v) as kept from sets join reach on reach.u = sets.doc_id group by sets.doc_id, s"""


@query("op3_minhash_dedup", _NEAR)
def op3(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query("op4_pfair_mixing")
def op4(spark, sf):
    return mix.mixed(table(spark, sf, "documents"), ["doc_id"], "source", TARGETS)


@query("op5_licence_scan")
def op5(spark, sf):
    """Paths are derived from source and id: every eighth document is a licence file, every sixty-fourth one of the directory above."""
    docs = table(spark, sf, "documents")
    up = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 4096 as string)"))
    low = F.concat_ws("/", up, F.expr("cast(doc_id div 64 as string)"))
    path = F.when(F.col("doc_id") % 64 == 0, F.concat(up, F.lit("/LICENSE"))).when(F.col("doc_id") % 8 == 0, F.concat(low, F.lit("/LICENSE"))).otherwise(F.concat_ws("/", low, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licences.licensed(docs.select("doc_id", path.alias("path"), "text"))


@query("op6_decontamination")
def op6(spark, sf):
    return decontam.decontaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_hash")


@query("op7_url_filter")
def op7(spark, sf):
    return urls.judged(table(spark, sf, "pages"), URL_RULES)


@query("op8_secret_scan")
def op8(spark, sf):
    found = secret_scan.scanned(table(spark, sf, "documents"), F.col("doc_id"), F.col("source"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), "spans", "n_live", "n_example")


@query("op9_language_id")
def op9(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", id_remainder("doc_id", 4) == 2)
    prototypes = langid.profiles(docs.filter(~F.col("held_out")), "text", "lang")
    return langid.predict(docs, "text", prototypes, [F.col("doc_id"), F.col("held_out")])


@query("op10_feistel_sharding")
def op10(spark, sf):
    out = shard.sharded(table(spark, sf, "documents"), SHARDS, SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


_NEGATIVES = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as q
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.q, c.q)::bigint as score
  from v a, v c where a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
qualify rank <= 5"""


@query("op11_hard_negatives", _NEGATIVES)
def op11(spark, sf):
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf, "embeddings"), "vec_id", shifted, "embedding", F.col("vec_id") % 100 == 0)


# crc32 of a word's UTF-8 bytes by the usual table, built here from its polynomial
_WORDS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w"
_RESAMPLED = f"""
with poly as (select list(list_reduce([n] || range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as tab from range(256) r(n)),
words as (select 'd' as side, doc_id, rowid_ as r, {_WORDS}
  from (select *, row_number() over () as rowid_ from documents)
  union all
  select 't', null, null, {_WORDS} from benchmark),
hashed as (select w, xor(4294967295, list_reduce([4294967295] || [('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2])::bigint for i in range(octet_length(encode(w)))],
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 10000 as bucket from (select distinct w from words), poly),
n as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from words join hashed using (w) group by bucket),
g as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from n),
scored as (select r, count(*) as n_features, sum(gain)::bigint as weight from words join hashed using (w) join g using (bucket) where side = 'd' group by r),
all_docs as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint::double + 0.5) / 4294967296.0)))::bigint as score
  from (select *, row_number() over () as r from documents) left join scored using (r)),
ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as p, count(*) filter (n_features >= 20) over () as n from all_docs)
select doc_id, n_features, weight, score, case when n_features >= 20 and p <= n * 10 // 100 then p end::bigint as rank from ranked"""


@query("op12_importance_resampling", _RESAMPLED)
def op12(spark, sf):
    return resample.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_site_style_tree")
def op13(spark, sf):
    return sitetree.extracted(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))
