"""Queries over nested records. Each order becomes one record document."""

import re
import uuid

from pyspark.sql import functions as F

from attestry.operators import gate, walk
from attestry.plans import sqltext as S
from attestry.plans.registry import query, spread_table, table
from attestry.session import shared_dir
from attestry.sources import records as R
from attestry.sources import scans as C

_RECORD = """to_json(named_struct(
 'source', named_struct('file', concat('c', o_custkey), 'edition', 'PREPRINT', 'pdf_pages', 12, 'printed_page_offset', 0,
    'edition_evidence', named_struct('page_pdf', 1, 'quote', concat('arXiv ', o_orderkey))),
 'paper', named_struct('paper_id', concat('P', o_orderkey), 'title', concat('Order ', o_orderkey), 'year', year(o_orderdate), 'ocean_domains', array(o_orderpriority)),
 'methods', array(named_struct('method_id', 'm1', 'canonical_name', concat('M', o_custkey % 50), 'family', o_orderpriority, 'role', 'PROPOSED',
    'evidence', array(named_struct('field', 'family', 'page_pdf', 2, 'quote', concat('uses ', o_orderpriority))))),
 'datasets', array(named_struct('dataset_id', 'd1', 'canonical_name', concat('D', o_orderkey % 40), 'variables', array('sst'),
    'evidence', array(named_struct('page_pdf', 3, 'page_printed', 0, 'quote', concat('data D', o_orderkey % 40))))),
 'experiments', array(named_struct('experiment_id', 'e1', 'task', concat('T', o_orderkey % 5), 'method_id', 'm1', 'dataset_ids', array('d1'), 'target_variable', concat('v', o_custkey % 7),
    'training', named_struct('learning_rate', named_struct('value', o_orderkey % 10, 'page_pdf', 4, 'quote', concat('lr ', o_orderkey % 10)),
      'optimizer', named_struct('value', 'adam', 'page_pdf', 4), 'note', 'a bare string',
      'batch_size', named_struct('value', 32, 'unit', 'samples', 'page_pdf', 4, 'quote', 'batch', 'extra_evidence',
         array(named_struct('claim', 'bs', 'page_pdf', 5, 'quote', concat('again ', o_orderkey))))))),
 'results', if(o_orderkey % 2 = 0, array(
    named_struct('experiment_id', 'e1', 'dataset_id', 'd1', 'metric', 'RMSE', 'value', o_custkey, 'unit', 'K', 'page_pdf', 6, 'page_printed', o_orderkey % 3, 'quote', if(o_orderkey % 4 = 0, null, concat('rmse ', o_custkey))),
    named_struct('experiment_id', 'e9', 'dataset_id', 'd9', 'metric', 'MAE', 'value', o_orderkey % 100, 'unit', 'C', 'page_pdf', 7, 'page_printed', cast(null as bigint), 'quote', concat('mae ', o_orderkey % 100))),
   array(named_struct('experiment_id', 'e1', 'dataset_id', 'd1', 'metric', 'RMSE', 'value', o_custkey, 'unit', 'K', 'page_pdf', 6, 'page_printed', o_orderkey % 3, 'quote', concat('rmse ', o_custkey)))),
 'limitations', array(named_struct('theme', 'DATA', 'page_pdf', 8, 'quote', concat('limited ', o_orderkey))),
 'conflicts', if(o_orderkey % 5 = 0, array(named_struct('field', 'training.epochs', 'values', array(1, 2), 'sources',
    array(named_struct('page_pdf', 9, 'quote', 'one'), named_struct('page_pdf', 10, 'quote', 'two')))), null),
 'excluded', if(o_orderstatus = 'P', named_struct('reason', 'review', 'page_pdf', 1, 'quote', 'a review'), null)
))"""


def records(spark, sf):
    o = spread_table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("slug"), F.expr(_RECORD).alias("doc"))
    return R.parse_records(o, "doc")


_O = "o as (select *, 'o' || o_orderkey as slug, 'M' || (o_custkey % 50) as mname, 'D' || (o_orderkey % 40) as dname, 'T' || (o_orderkey % 5) as tname from orders)"
_CLAIMS = f"""{_O}, c as (
 select slug, 'results[0]' as path, 'RESULT' as kind, 'RMSE' as field, o_custkey::varchar as value_json, 'K' as unit, 6 as page_pdf, case when o_orderkey % 4 = 0 then null else 'rmse ' || o_custkey end as quote, 'e1' as experiment_id, tname as task, mname as method, dname as dataset from o
 union all select slug, 'results[1]', 'RESULT', 'MAE', (o_orderkey % 100)::varchar, 'C', 7, 'mae ' || (o_orderkey % 100), null, null, null, null from o where o_orderkey % 2 = 0
 union all select slug, 'experiments[0].training.learning_rate', 'TRAINING', 'learning_rate', (o_orderkey % 10)::varchar, null, 4, 'lr ' || (o_orderkey % 10), 'e1', tname, mname, null from o
 union all select slug, 'experiments[0].training.optimizer', 'TRAINING', 'optimizer', '"adam"', null, 4, null, 'e1', tname, mname, null from o
 union all select slug, 'experiments[0].training.batch_size', 'TRAINING', 'batch_size', '32', 'samples', 4, 'batch', 'e1', tname, mname, null from o
 union all select slug, 'experiments[0].training.batch_size.extra_evidence[0]', 'TRAINING_EXTRA', 'batch_size', '"bs"', null, 5, 'again ' || o_orderkey, 'e1', tname, mname, null from o
 union all select slug, 'methods[0].evidence[0]', 'METHOD', 'family', null, null, 2, 'uses ' || o_orderpriority, null, null, mname, null from o
 union all select slug, 'datasets[0].evidence[0]', 'DATASET', 'dataset', null, null, 3, 'data ' || dname, null, null, null, dname from o
 union all select slug, 'limitations[0]', 'LIMITATION', 'DATA', null, null, 8, 'limited ' || o_orderkey, null, null, null, null from o
 union all select slug, 'conflicts[0].sources[0]', 'CONFLICT', 'training.epochs', null, null, 9, 'one', null, null, null, null from o where o_orderkey % 5 = 0
 union all select slug, 'conflicts[0].sources[1]', 'CONFLICT', 'training.epochs', null, null, 10, 'two', null, null, null, null from o where o_orderkey % 5 = 0
 union all select slug, 'excluded', 'EXCLUSION', 'excluded', null, null, 1, 'a review', null, null, null, null from o where o_orderstatus = 'P')"""


@query("evidence_claims", f"""with {_CLAIMS}
select slug || '::' || path as claim_id, kind, field, coalesce(value_json, '') as value_json, coalesce(unit, '') as unit, page_pdf,
  case when quote is null then 'VALUE_READ_NO_SAFE_QUOTE' else 'QUOTED' end as evidence_status, coalesce(experiment_id, '') as experiment_id,
  coalesce(task, '') as task, coalesce(method, '') as method, coalesce(dataset, '') as dataset, {S.fingerprint('value_json', 'quote')} as fingerprint from c""")
def evidence_claims(spark, sf):
    c = walk.claims(records(spark, sf))
    blank = lambda n: F.coalesce(n, F.lit("")).alias(n)
    return c.select("claim_id", "kind", "field", blank("value_json"), blank("unit"), "page_pdf", "evidence_status",
                    *[blank(n) for n in ("experiment_id", "task", "method", "dataset")], "fingerprint")


@query("claim_kinds_per_paper", f"with {_CLAIMS} select kind, count(*) as claims, count(distinct slug) as papers, count_if(quote is null) as unquoted from c group by kind")
def claim_kinds_per_paper(spark, sf):
    return walk.claims(records(spark, sf)).groupBy("kind").agg(
        F.count("*").alias("claims"), F.countDistinct("slug").alias("papers"), F.count_if(F.col("quote").isNull()).alias("unquoted"))


@query("walk_anywhere", f"with {_CLAIMS} select slug, path from c union all select slug, 'source.edition_evidence' from o")
def walk_anywhere(spark, sf):
    return walk.walk_anywhere(records(spark, sf)).select("slug", "path")


@query("paths_read_back", f"""with {_CLAIMS} select slug, path, split_part(path, '[', 1) as head, len(regexp_extract_all(path, '[A-Za-z_][A-Za-z0-9_]*|\\[[0-9]+\\]')) as steps,
  coalesce(quote, '') as quote, coalesce(value_json, '') as value_json from c union all select slug, 'source.edition_evidence', 'source.edition_evidence', 2, 'arXiv ' || o_orderkey, '' from o""")
def paths_read_back(spark, sf):
    """Every stored claim path leads to the node it was taken from."""
    r = records(spark, sf)
    out = walk.read_back(r, walk.claims(r, provenance=True).select("slug", "path"))
    text = lambda at: F.coalesce(F.try_variant_get("node", at, "string"), F.lit(""))
    claim = F.coalesce(F.try_variant_get("node", "$.value", "variant"), F.try_variant_get("node", "$.claim", "variant"))
    steps = walk.path_steps(F.col("path"))
    return out.filter(walk.joined_steps(steps) == F.col("path")).select("slug", "path", F.substring_index("path", "[", 1).alias("head"), F.size(steps).alias("steps"), text("$.quote").alias("quote"), F.coalesce(F.to_json(claim), F.lit("")).alias("value_json"))


@query("record_papers", f"""with {_O} select slug, 'P' || o_orderkey as paper_id, 'Order ' || o_orderkey as title, year(o_orderdate) as year, o_orderpriority as domains,
  case when o_orderstatus = 'P' then 'review' else '' end as excluded, 'c' || o_custkey as source_file from o""")
def record_papers(spark, sf):
    p = walk.papers(records(spark, sf))
    return p.select("slug", "paper_id", "title", "year", F.array_join("domains", "|").alias("domains"), F.coalesce("excluded", F.lit("")).alias("excluded"), "source_file")


@query("record_results", f"""with {_O} select slug, 0 as ord, 'RMSE' as metric, o_custkey::double as value, 'K' as unit, coalesce(nullif(o_orderkey % 3, 0), 6) as page from o
union all select slug, 1, 'MAE', (o_orderkey % 100)::double, 'C', 7 from o where o_orderkey % 2 = 0""")
def record_results(spark, sf):
    r = walk.silver(records(spark, sf), "results")
    return r.select("slug", "ord", "metric", "value", "unit", walk.shown_page(F.col("page_printed"), F.col("page_pdf")).alias("page"))


@query("record_training", f"""with {_O} select slug, 'learning_rate' as field, (o_orderkey % 10)::varchar as value_json, 'QUOTED' as evidence_status, 3 as shown_at from o
union all select slug, 'optimizer', '"adam"', 'VALUE_READ_NO_SAFE_QUOTE', 2 from o union all select slug, 'batch_size', '32', 'QUOTED', 4 from o""")
def record_training(spark, sf):
    return walk.training(records(spark, sf)).select("slug", "field", "value_json", "evidence_status", "shown_at")


@query("record_outline", f"""with {_O} select 'methods' as part, count(*) as n, count(distinct mname) as names from o union all select 'datasets', count(*), count(distinct dname) from o
union all select 'experiments', count(*), count(distinct tname) from o union all select 'limitations', count(*), 1 from o union all select 'conflicts', count_if(o_orderkey % 5 = 0), 1 from o""")
def record_outline(spark, sf):
    parts = (("methods", "canonical_name"), ("datasets", "canonical_name"), ("experiments", "task"), ("limitations", "theme"), ("conflicts", "field"))
    return walk.outline(records(spark, sf), parts)


@query("record_categories", f"""with {_O}, k as (select * from o where o_orderstatus <> 'P')
select 'family' as category, o_orderpriority as value, count(*) as n from k group by 2 union all select 'dataset', dname, count(*) from k group by 2 union all select 'task', tname, count(*) from k group by 2
union all select 'metric', 'RMSE', count(*) from k having count(*) > 0 union all select 'metric', 'MAE', count(*) from k where o_orderkey % 2 = 0 having count(*) > 0 union all select 'edition', 'PREPRINT', count(*) from k having count(*) > 0""")
def record_categories(spark, sf):
    return walk.category_tallies(records(spark, sf))


@query("record_validity", """select count(*) as total, count_if(event_id % 7 not in (0, 1)) as readable, count_if(event_id % 7 in (0, 1)) as invalid from events""")
def record_validity(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("slug"), F.expr("case event_id % 7 when 0 then concat('{', props) when 1 then '[1]' else props end").alias("doc"))
    return R.validity(R.parse_records(e, "doc"))


@query("record_lookup", "select 'o' || o_orderkey as slug, 'Order ' || o_orderkey as title from orders where o_orderkey = (select max(o_orderkey) from orders)")
def record_lookup(spark, sf):
    last = table(spark, sf, "orders").agg(F.max("o_orderkey").alias("k")).select(F.concat(F.lit("o"), "k").alias("slug"))
    return walk.papers(records(spark, sf).join(last, "slug", "left_semi")).select("slug", "title")


# --- report, label and prediction scans: one document per row ---------------------------

@query("report_scan", """select 's' || doc_id as slug, 'p1' as path, case when quality = 1 then 'CONFIRMED' else 'SUSPECT' end as verdict, 'unknown' as checker from labels
union all select 's' || doc_id, 'p2', 'UNREADABLE', 'unknown' from labels""")
def report_scan(spark, sf):
    doc = """concat('{"checked_at": "2025", "claims": {"p1": {"verdict": "', if(quality = 1, 'CONFIRMED', 'SUSPECT'), '"}, "p2": {"verdict": "UNREADABLE", "reason": "dark"}}}')"""
    r = table(spark, sf, "labels").select(F.concat(F.lit("s"), "doc_id").alias("slug"), F.parse_json(F.expr(doc)).alias("v"))
    return R.explode_reports(r).select("slug", "path", "verdict", "checker")


@query("golden_scan", """select 'g' || doc_id as paper_id, 'data' as family, 'data.quality' as path, 'VERIFIED' as status, quality::varchar as value_json, 0 as n_conflict, 2 as n_sources from labels
union all select 'g' || doc_id, 'results', 'results.toxic', 'CONFLICT', '', 2, 1 from labels""")
def golden_scan(spark, sf):
    doc = """concat('{"paper": {"id": "g', doc_id, '"}, "fields": [{"path": "data.quality", "family": "data", "status": "VERIFIED", "value": ', quality, ', "source": {"page": 1, "evidence": "e"}, "sources": [{"page": 2}]}, {"path": "results.toxic", "family": "results", "status": "CONFLICT", "value": null, "conflict_values": [0, 1.0], "source": {"page": 1, "claimed_value": 0}}]}')"""
    g = R.explode_golden(table(spark, sf, "labels").select(F.parse_json(F.expr(doc)).alias("v")))
    return g.select("paper_id", "family", "path", "status", F.coalesce("value_json", F.lit("")).alias("value_json"), F.size("conflict_values").alias("n_conflict"), F.size("sources").alias("n_sources"))


@query("prediction_scan", """select 'g' || doc_id as paper_id, 'data.quality' as path, 'NOT_VERIFIED' as status, quality::varchar || '.0' as value_json from labels union all select 'h' || doc_id, 'x.y', 'NOT_REPORTED', '' from labels""")
def prediction_scan(spark, sf):
    doc = """concat('{"predictions": [{"paper_id": "g', doc_id, '", "fields": [{"path": "data.quality", "status": "NOT_VERIFIED", "value": ', quality, '.0}]}, {"paper_id": "h', doc_id, '", "fields": [{"path": "x.y", "status": "NOT_REPORTED"}]}]}')"""
    p = R.require_distinct(R.explode_predictions(table(spark, sf, "labels").select(F.parse_json(F.expr(doc)).alias("v"))).withColumn("key", F.concat_ws("/", "paper_id", "path")), "key")
    return p.select("paper_id", "path", "status", F.coalesce("value_json", F.lit("")).alias("value_json"))


# --- records through the gate -----------------------------------------------------------

_PAGE = """case page when 1 then 'A review of data D' || array_to_string(range(20, 40), ', data D') when 2 then 'It uses 1-URGENT; uses 3-MEDIUM, uses 5-LOW.'
 when 3 then 'The data D' || array_to_string(range(0, 20), ', data D') when 4 then 'Each batch: lr ' || array_to_string(range(0, 7), ', lr ')
 when 6 then 'RMSE ' || c_custkey when 7 then 'MAE ' || array_to_string(range(0, 50), '; MAE ') when 9 then 'one or two' when 10 then c_name else '' end"""


def record_pages(spark, sf):
    """Twelve pages for every customer's file. They hold some of the quotes on the cited page, some on another."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page"))
    items = lambda sep, a, b: F.array_join(F.sequence(F.lit(a), F.lit(b - 1)).cast("array<string>"), sep)
    text = (
        F.when(F.col("page") == 1, F.concat(F.lit("A review of data D"), items(", data D", 20, 40))).when(F.col("page") == 2, "It uses 1-URGENT; uses 3-MEDIUM, uses 5-LOW.")
        .when(F.col("page") == 3, F.concat(F.lit("The data D"), items(", data D", 0, 20))).when(F.col("page") == 4, F.concat(F.lit("Each batch: lr "), items(", lr ", 0, 7)))
        .when(F.col("page") == 6, F.concat(F.lit("RMSE "), F.col("c_custkey").cast("string"))).when(F.col("page") == 7, F.concat(F.lit("MAE "), items("; MAE ", 0, 50)))
        .when(F.col("page") == 9, "one or two").when(F.col("page") == 10, F.col("c_name")).otherwise("")
    )
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_file"), "page", text.alias("text"))


_RECORD_GATE = f"""{_CLAIMS},
q as (select slug, path, page_pdf, {S.norm('quote')} as needle, field = 'batch_size' and kind = 'TRAINING' as unsupported,
    case when path = 'results[0]' then o_orderkey % 3 when path = 'datasets[0].evidence[0]' then 0 end as printed, o_custkey from c join o using (slug) where quote is not null
  union all select slug, 'source.edition_evidence', 1, 'arxiv ' || o_orderkey, false, null, o_custkey from o),
p as (select c_custkey as o_custkey, page, {S.norm(_PAGE)} as t from customer, (select unnest(range(1, 13)) as page)),
l as (select q.*, coalesce(contains(p.t, needle), false) as located from q left join p on p.o_custkey = q.o_custkey and p.page = page_pdf),
f as (select slug, path, count(*) as found_on, min(p.page) as first_found from l join p on p.o_custkey = l.o_custkey and contains(p.t, needle) where not located group by 1, 2),
r as (select l.*, coalesce(found_on, 0) as found_on, coalesce(first_found, -1) as first_found, located and unsupported as support_warning, located and coalesce(printed <> page_pdf, false) as pagination_warning
  from l left join f using (slug, path))
"""


@query("record_gate", f"""with {_RECORD_GATE}
select o.slug, count(r.path) as checked, count_if(located) as located, count_if(support_warning) as support_warnings, count_if(pagination_warning) as pagination_warnings,
  coalesce(bool_and(located), true)::int as ok from o left join r using (slug) group by o.slug""")
def record_gate(spark, sf):
    _, summary = gate.record_gate(records(spark, sf), record_pages(spark, sf))
    return summary.withColumn("ok", F.col("ok").cast("int"))


@query("record_gate_failures", f"with {_RECORD_GATE} select slug, path, page_pdf, found_on, first_found from r where not located")
def record_gate_failures(spark, sf):
    report, _ = gate.record_gate(records(spark, sf), record_pages(spark, sf))
    return report.filter("not located").select("slug", "path", "page_pdf", "found_on", F.coalesce("first_found", F.lit(-1)).alias("first_found"))


# --- folders of files: each supplier writes a document, some of them bad ------------------

def written(spark, sf, document):
    """A folder with one file for every supplier. All cores write, and each task moves its own files into place."""
    where = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    files = spread_table(spark, sf, "supplier").select(F.concat(F.lit("d"), "s_suppkey").alias("slug"), F.expr(document).alias("value"))
    files.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("slug").text(where)
    return where


_K = "k as (select s_suppkey as k, 'd' || s_suppkey as file, s_suppkey % 10 as r from supplier)"


def scanned(rows, refusals, key):
    return refusals.select("file", "rule", "key").unionByName(rows.select(F.lit("").alias("file"), F.lit("accepted").alias("rule"), F.col(key).alias("key")))


@query("scan_records", f"""with {_K} select file, case r when 0 then 'not_json' when 1 then 'not_an_object' else 'other_slug' end as rule, case when r = 2 then 'x' || k else '' end as key from k where r < 3
union all select '', 'accepted', file from k where r > 2""")
def scan_records(spark, sf):
    doc = "case s_suppkey % 10 when 0 then '{\"paper\": ' when 1 then '[1]' when 2 then concat('{\"slug\": \"x', s_suppkey, '\"}') when 3 then concat('{\"slug\": \"d', s_suppkey, '\"}') else '{\"paper\": {}}' end"
    return scanned(*C.scan_records(spark, written(spark, sf, doc), "*.txt"), "slug")


@query("scan_golden", f"""with {_K}, g as (select *, case when r = 2 then 'same' else 'g' || k end as id from k where r > 2 or r = 2),
again as (select id from g group by id having count(*) > 1)
select file, case r when 0 then 'not_json' else 'id_missing' end as rule, '' as key from k where r < 2 union all select file, 'id_repeated', id from g where id in (from again)
union all select file, case r when 3 then 'path_repeated' when 4 then 'fields_missing' else 'path_missing' end, case r when 3 then file || '/' || id || '/data.quality' else id end from g where r between 3 and 5
union all select '', 'accepted', id || '/data.quality' from g where id not in (from again) and r not between 3 and 5""")
def scan_golden(spark, sf):
    field = """'{"path": "data.quality", "family": "data", "status": "VERIFIED", "value": 1}'"""
    fields = f"""case r when 3 then concat('[', {field}, ', ', {field}, ']') when 4 then '{{}}' when 5 then concat('[', {field}, ', {{"family": "data"}}]') else concat('[', {field}, ']') end"""
    doc = f"""case r when 0 then '' when 1 then '{{"fields": []}}' else concat('{{"paper": {{"id": "', if(r = 2, 'same', concat('g', s_suppkey)), '"}}, "fields": ', {fields}, '}}') end"""
    rows, refusals = C.scan_golden(spark, written(spark, sf, re.sub(r"\br\b(?= =| when)", "s_suppkey % 10", doc)), "*.txt")
    return scanned(rows.withColumn("key", F.concat_ws("/", "paper_id", "path")), refusals, "key")


@query("scan_predictions", f"""with {_K} select file, case r when 0 then 'not_an_object' when 5 then 'paper_repeated' when 6 then 'path_repeated' else 'key_unknown' end as rule,
  case r when 1 then 'model' when 2 then 'score' when 3 then 'confidence' when 5 then file || '/p' when 6 then file || '/p/a.b' else '' end as key from k where r < 7 and r <> 4
union all select file, 'path_repeated', file || '/p/a.b' from k where r = 5
union all select '', 'accepted', 'p/a.b' from k where r > 6 or r = 4""")
def scan_predictions(spark, sf):
    field = """concat('{"path": "a.b", "status": "NOT_VERIFIED", "value": 1', if(r = 3, ', "confidence": 1', ''), '}')"""
    paper = f"""concat('{{"paper_id": "p", "fields": [', {field}, if(r = 6, concat(', ', {field}), ''), ']', if(r = 2, ', "score": 1', ''), '}}')"""
    doc = f"""if(r = 0, '"text"', concat('{{"schema_version": 1, ', if(r = 1, '"model": "m", ', ''), '"predictions": [', {paper}, if(r = 5, concat(', ', {paper}), ''), ']}}'))"""
    rows, refusals = C.scan_predictions(spark, written(spark, sf, re.sub(r"\br\b(?= =)", "s_suppkey % 10", doc)), "*.txt")
    return scanned(rows.withColumn("key", F.concat_ws("/", "paper_id", "path")), refusals, "key")


@query("scan_manifest", f"""with {_K} select file, case r when 0 then 'not_json' when 1 then 'not_a_list' else 'state_unknown' end as rule, case when r = 2 then '10.1/' || k else '' end as key from k where r < 3
union all select file, 'doi_repeated', '10.1/same' from k where r = 3 and (select count(*) from k where r = 3) > 1
union all select file, 'doi_repeated', '10.1/' || k from k where r = 2
union all select '', 'accepted', case when r = 3 then '10.1/same' else '10.1/' || k end from k where r > 3 or (r = 3 and (select count(*) from k where r = 3) = 1)""")
def scan_manifest(spark, sf):
    entry = """concat('{"doi": "10.1/', if(s_suppkey % 10 = 3, 'same', cast(s_suppkey as string)), '", "status": "BLOCKED", "extra": 1}')"""
    other = """if(s_suppkey % 10 = 2, concat(', {"doi": "10.1/', s_suppkey, '", "status": "ODD"}'), '')"""
    doc = f"case s_suppkey % 10 when 0 then 'x' when 1 then '{{}}' else concat('[', {entry}, {other}, ']') end"
    rows, refusals = C.scan_manifest(spark, written(spark, sf, doc), "*.txt")
    return scanned(rows, refusals, "doi")


@query("ledger_runs", "select event_id, case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as run_id from events")
def ledger_runs(spark, sf):
    """Three overlapping runs, one of them sent twice: every event is there once, under the run that brought it."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    root = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    for run, part in (("a", "event_id % 3 = 0"), ("b", "event_id % 3 < 2"), ("b", "event_id % 3 < 2"), ("c", "true")):
        C.append_run(e.filter(part).unionByName(e.filter(part)), root, run)
    return C.ledger(spark, root, "event_id long, event_type string, run_id string").select("event_id", "run_id")
