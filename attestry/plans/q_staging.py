"""Queries over staging packages. Customers are papers, orders are claim rows; faults follow from key arithmetic."""

import uuid

from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.operators import staging as G
from attestry.operators import validate as C
from attestry.plans.registry import query, table
from attestry.session import shared_dir
from attestry.sources import corpus as P

# The same expressions make the stand-in tables in both engines.
INDEX = (
    "case when c_custkey % 307 = 0 then 'OAI-1' when c_custkey % 311 = 0 then '' else 'OAI-' || c_custkey end as paper_id",
    "case when c_custkey % 101 = 0 then 'Customer seven' else c_name end as title", "1990 + case when c_custkey % 101 = 0 then 1 else c_nationkey end as year",
    "case when c_custkey % 4 = 0 then null when c_custkey % 97 = 0 then 'doi: 10.1234/dup' else 'https://doi.org/10.1234/C' || c_custkey end as doi",
    "case when c_custkey % 89 = 0 then 'AUDITED' when c_custkey % 2 = 0 then 'NOT_AUDITED' end as scientific_audit_status", "c_custkey as k")
RECORDS = (
    "case when c_custkey % 313 = 0 then 'OAI-R' || c_custkey else 'OAI-' || c_custkey end as paper_id", "case when c_custkey % 19 = 0 then 'other' else c_name end as title",
    "case when c_custkey % 23 = 0 then null else 1990 + c_nationkey end as year", "case when c_custkey % 4 <> 0 then 'https://doi.org/10.1234/C' || c_custkey end as doi",
    "case when c_custkey % 3 = 0 then 'NOT_AUDITED' end as scientific_audit_status")
_MARK = "case when o_orderkey % 5 = 0 then 'NOT_REPORTED' when o_orderkey % 7 = 0 then 'EXTRACTED' when o_orderkey % 239 = 0 then 'WEIRD' end"
CLAIMS = (
    "case when o_orderkey % 503 = 0 then null when o_orderkey % 401 = 0 then 'C' || (o_orderkey + 1) else 'C' || o_orderkey end as claim_id",
    "case when o_orderkey % 229 = 0 then 'OAI-X' else 'OAI-' || o_custkey end as paper_id",
    "case when o_orderkey % 601 = 0 then null when o_orderkey % 227 = 0 then 'zzz.unknown' else 'data.p' || substring(o_orderpriority, 1, 1) end as field_path",
    "case when o_orderkey % 211 = 0 then 'VERIFIED' when o_orderkey % 213 = 0 then 'ODD' when o_orderkey % 217 = 0 then null when o_orderstatus = 'O' then 'CONFLICT' else 'NOT_VERIFIED' end as scientific_status",
    "case when o_orderkey % 223 = 0 then null when o_orderkey % 241 = 0 then 'else' when o_orderkey % 5 = 0 then 'NOT_REPORTED' when o_orderkey % 233 = 0 then 'not-reported' else 'v' || o_custkey end as value",
    f"{_MARK} as extraction_status", "case when o_orderkey % 251 = 0 then 'AUDITED' end as independent_audit",
    "case when o_orderkey % 9 = 0 then 'NOTE' else 'AUTHOR_REPORTED_FACT' end as claim_type", "case when o_orderkey % 10 = 0 then 'B03' else 'B04' end as batch_id", "o_orderkey as k")
CONTRACT = ("case when n_nationkey % 8 = 7 then null when n_nationkey % 8 = 6 then 'data.p1' else 'data.p' || (n_nationkey % 8) end as field_path",
            "case when n_nationkey = 3 then 'other' else 'data' end as \"group\"", "'p' || (n_nationkey % 8) as field_name")
GAPS = (
    "case when conv_id % 9 = 0 then 'B' || conv_id || '-G1' when conv_id % 31 = 0 then null else 'Topic ' || conv_id % 200 end as candidate_topic",
    "case when conv_id % 9 = 0 then 'OAI-' || conv_id || ' ; OAI-2' when conv_id % 37 = 0 then '' else 'Does it hold for ' || role || '?' end as testable_question",
    "case when conv_id % 9 = 0 then 'What about ' || role when conv_id % 41 = 0 then 'OAI-3; OAI-999999' else 'OAI-' || (conv_id + 1) || ';OAI-' || (conv_id % 50 + 1) end as basis_paper_ids",
    "case when conv_id % 43 = 0 then 'independently verified' when conv_id % 2 = 0 then 'AI_INTERPRETATION, NOT VERIFIED' else 'team idea, unvalidated' end as status")


def make(spark, sf, name, expressions):
    return table(spark, sf, name).selectExpr(*[e.replace('"', "`") for e in expressions])


def sql(name, expressions):
    return f"(select {', '.join(expressions)} from {name})"


def index(spark, sf):
    return make(spark, sf, "customer", INDEX)


def claims(spark, sf):
    return make(spark, sf, "orders", CLAIMS)


def gaps(spark, sf):
    return make(spark, sf, "conversations", GAPS)


def report(df):
    return df.groupBy("rule", "severity", "entity", "key").agg(F.count("*").alias("n"))


_REPORT = "select rule, severity, entity, coalesce(key, '') as key, count(*) as n from v group by all"
_I, _C = f"i as {sql('customer', INDEX)}", f"c as {sql('orders', CLAIMS)}"
_DOI = r"nullif(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '')"
_TITLE = r"nullif(trim(regexp_replace(lower(strip_accents(title)), '[^\p{L}\p{N}]+', ' ', 'g')), '')"


def rows(rule, entity, key, source, severity="error"):
    return f"select '{rule}' as rule, '{severity}' as severity, '{entity}' as entity, {key}::varchar as key from {source}"


def twice(rule, entity, key, source):
    return f"select '{rule}', 'error', '{entity}', {key}::varchar from {source} where {key} is not null group by {key} having count(*) > 1"


_KEYED = f"k as (select *, {_DOI} as d, {_TITLE} as t from i)"
_IDENTITY_RULES = [
    rows('paper_id_missing', 'PAPER_INDEX', 'paper_id', "k where coalesce(paper_id, '') = ''"), rows('paper_audit_not_pending', 'PAPER_INDEX', 'paper_id', "k where scientific_audit_status = 'AUDITED'"),
    twice('paper_id_repeated', 'PAPER_INDEX', 'paper_id', 'k'), twice('doi_repeated', 'PAPER_INDEX', 'd', 'k'),
    "select 'title_year_repeated', 'error', 'PAPER_INDEX', t || '/' || year from k where t is not null group by t, year having count(*) > 1"]


@query("paper_identity_rules", f"""with {_I}, {_KEYED}, v as ({' union all '.join(_IDENTITY_RULES)}) {_REPORT}""")
def paper_identity_rules(spark, sf):
    return report(G.paper_identity_rules(index(spark, sf)))


_S = "SCIENTIFIC_CLAIMS"
_TOKEN = r"regexp_replace(upper(trim(value)), '[\s\-]+', '_', 'g')"
_N = "c where coalesce(claim_id, '') <> '' and "


_CLAIM_RULES = [
    rows('claim_path_missing', _S, 'claim_id', _N + "field_path is null"), rows('claim_status_refused', _S, 'claim_id', _N + "scientific_status = 'VERIFIED'"),
    rows('claim_status_unknown', _S, 'claim_id', _N + "coalesce(scientific_status, 'ODD') = 'ODD'"), rows('claim_value_missing', _S, 'claim_id', _N + "value is null"),
    rows('claim_audit_not_pending', _S, 'claim_id', _N + "independent_audit is not null"), rows('extraction_status_unknown', _S, 'claim_id', _N + "extraction_status = 'WEIRD'"),
    rows('marker_with_value', _S, 'claim_id', _N + "extraction_status = 'NOT_REPORTED' and value is distinct from 'NOT_REPORTED'"),
    rows('status_word_as_value', _S, 'claim_id', _N + f"coalesce(extraction_status, 'EXTRACTED') = 'EXTRACTED' and {_TOKEN} in {V.STATUS_WORDS}"),
    rows('claim_id_missing', _S, "''", "c where claim_id is null"), twice('claim_id_repeated', _S, 'claim_id', 'c'),
    rows('claim_paper_unknown', _S, 'claim_id', _N + "paper_id not in (select paper_id from i)")]


@query("claim_rules", f"""with {_I}, {_C}, v as ({' union all '.join(_CLAIM_RULES)}) {_REPORT}""")
def claim_rules(spark, sf):
    return report(G.claim_rules(claims(spark, sf), index(spark, sf)))


# record slots: most claims are filed where they say, some twice, some elsewhere, some not at all
SLOTS = ("'OAI-' || case when o_orderkey % 17 = 0 then o_custkey + 1 else o_custkey end as paper_id", "'data.p' || substring(o_orderpriority, 1, 1) as field_path",
         "'C' || case when o_orderkey % 29 = 0 then o_orderkey + 1 when o_orderkey % 31 = 0 then o_orderkey + 100000000 else o_orderkey end as claim_id")
_SLOT = f"""s as {sql('orders', SLOTS)}, d as (select claim_id, paper_id as dp, field_path as df from c where claim_id is not null),
o as (select claim_id, count(*) as n, max(struct_pack(p := paper_id, f := field_path)) as slot from s group by 1),
b as (select coalesce(d.claim_id, o.claim_id) as claim_id, d.claim_id is not null as has_claim, dp, df, n, slot from d full join o on d.claim_id = o.claim_id),
k as {sql('nation', CONTRACT)}"""
_R = "PAPER_RECORDS"


@query("slot_rules", f"""with {_C}, {_SLOT}, v as ({' union all '.join([
    rows('claim_in_several_slots', _R, 'claim_id', 'b where n > 1'), rows('claim_without_slot', _R, 'claim_id', 'b where n is null'),
    rows('claim_in_other_slot', _R, 'claim_id', 'b where n is not null and df is not null and (slot.p is distinct from dp or slot.f is distinct from df)'),
    rows('slot_without_claim', _R, 'claim_id', 'b where not has_claim'),
    rows('claim_outside_contract', _S, 'claim_id', 'd where df is null or df not in (select field_path from k where field_path is not null)')])}) {_REPORT}""")
def slot_rules(spark, sf):
    return report(G.slot_rules(claims(spark, sf), make(spark, sf, "orders", SLOTS), make(spark, sf, "nation", CONTRACT)))


@query("contract_rules", f"""with k as {sql('nation', CONTRACT)}, v as ({' union all '.join([
    rows('contract_path_missing', 'FIELD_CONTRACT', 'field_path', "k where field_path is null"), rows('contract_path_mismatch', 'FIELD_CONTRACT', 'field_path', "k where field_path <> \"group\" || '.' || field_name"),
    twice('contract_path_repeated', 'FIELD_CONTRACT', 'field_path', 'k')])}) {_REPORT}""")
def contract_rules(spark, sf):
    return report(G.contract_rules(make(spark, sf, "nation", CONTRACT)))


@query("record_field_rules", """with s as (select o_custkey as p, substring(o_orderpriority, 1, 1) as f from orders union select c_custkey, '9' from customer where c_custkey % 50 = 0),
c as (select p, count_if(f <> '9') as known, count_if(f = '9') as extra from s group by 1)
select 'record_fields_differ' as rule, 'error' as severity, 'PAPER_RECORDS' as entity, p::varchar as key, 1 as n from c where known <> 5 or extra > 0""")
def record_field_rules(spark, sf):
    slots = table(spark, sf, "orders").select(F.col("o_custkey").alias("paper_id"), F.substring("o_orderpriority", 1, 1).alias("field_path"))
    slots = slots.unionByName(table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("paper_id"), F.lit("9").alias("field_path")))
    contract = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("field_path")).distinct()
    return report(G.record_field_rules(slots, contract))


_B = "b as (select coalesce(i.paper_id, r.paper_id) as id, i.paper_id as ip, r.paper_id as rp, i.title it, r.title rt, i.doi id_, r.doi rd, i.year iy, r.year ry, i.scientific_audit_status ia, r.scientific_audit_status ra from i full join r on i.paper_id = r.paper_id)"


@query("index_record_rules", f"""with {_I}, r as {sql('customer', RECORDS)}, {_B}, v as ({' union all '.join([
    rows('paper_only_in_index', _R, 'id', 'b where rp is null'), rows('paper_only_in_records', _R, 'id', 'b where ip is null'),
    rows('title_differs', _R, 'id', 'b where ip = rp and it is distinct from rt'), rows('doi_differs', _R, 'id', 'b where ip = rp and id_ is distinct from rd'),
    rows('year_differs', _R, 'id', 'b where ip = rp and iy is distinct from ry'), rows('audit_state_differs', _R, 'id', 'b where ip = rp and ia is distinct from ra', 'warn')])}) {_REPORT}""")
def index_record_rules(spark, sf):
    return report(G.index_record_rules(index(spark, sf), make(spark, sf, "customer", RECORDS)))


_IDS = r"^OAI-\d+(?:\s*;\s*OAI-\d+)*$"
_G0 = f"g0 as {sql('conversations', GAPS)}"
_G = f"""{_G0}, g as (select candidate_topic, case when sh then basis_paper_ids else testable_question end as testable_question, case when sh then testable_question else basis_paper_ids end as basis_paper_ids, status, sh
 from (select *, coalesce(regexp_matches(candidate_topic, '^B\\d+-G\\d+$') and regexp_matches(testable_question, '{_IDS}') and not coalesce(regexp_matches(basis_paper_ids, '{_IDS}'), false), false) as sh from g0)),
bs as (select candidate_topic, unnest(list_filter(list_transform(string_split(coalesce(basis_paper_ids, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) as p from g)"""
_GAP_STATUS = r"regexp_matches(regexp_replace(upper(trim(status)), '[\s\-]+', '_', 'g'), '^INDEPENDENTLY_VERIFIED')"


@query("gap_rules", f"""with {_I}, {_G}, v as ({' union all '.join([
    rows('gap_topic_missing', 'RESEARCH_GAPS', 'candidate_topic', "g where coalesce(candidate_topic, '') = ''"),
    rows('gap_question_missing', 'RESEARCH_GAPS', 'candidate_topic', f"g where coalesce(testable_question, '') = '' or regexp_matches(testable_question, '{_IDS}')"),
    rows('gap_status_validated', 'RESEARCH_GAPS', 'candidate_topic', f"g where {_GAP_STATUS}"), rows('gap_paper_unknown', 'RESEARCH_GAPS', 'candidate_topic', 'bs where p not in (select paper_id from i)'),
    twice('gap_topic_repeated', 'RESEARCH_GAPS', "lower(replace(candidate_topic, '-', ' '))", 'g')])}) {_REPORT}""")
def gap_rules(spark, sf):
    return report(G.gap_rules(G.realign_gaps(gaps(spark, sf)), index(spark, sf)))


@query("gap_rows", f"""with {_G} select coalesce(candidate_topic, '') as candidate_topic, testable_question, array_to_string(list_filter(list_transform(string_split(basis_paper_ids, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') as basis,
 case when status like 'AI_INTERPRETATION%' then 'AI_INTERPRETATION' else 'TEAM_NOTE' end as provenance_type, sh::int as realigned, count(*) as n from g group by all""")
def gap_rows(spark, sf):
    g = G.research_gaps(G.realign_gaps(gaps(spark, sf)))
    return g.groupBy(F.coalesce("candidate_topic", F.lit("")).alias("candidate_topic"), "testable_question", F.array_join("basis", "|").alias("basis"), "provenance_type",
                     F.col("realigned_from").isNotNull().cast("int").alias("realigned")).agg(F.count("*").alias("n"))


@query("marker_reasons", """with m as (select o_orderkey, case when o_orderkey % 3 = 0 then 'NOT_REPORTED' when o_orderkey % 3 = 1 then 'NOT_EXTRACTED' end as s,
  case o_orderkey % 6 when 0 then 'NOT_REPORTED: absent from ' || o_orderpriority when 1 then 'NOT_EXTRACTED:  ' when 3 then 'NOT_REPORTED' else 'NOT_REPORTED: x' end as value from orders)
select o_orderkey, case when fits then s else value end as value, case when fits then value else '' end as value_as_supplied from
 (select *, coalesce(starts_with(value, s || ':') and trim(substring(value, length(s) + 2)) <> '', false) as fits from m)""")
def marker_reasons(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 3 = 0 then 'NOT_REPORTED' when o_orderkey % 3 = 1 then 'NOT_EXTRACTED' end as extraction_status",
        "case o_orderkey % 6 when 0 then 'NOT_REPORTED: absent from ' || o_orderpriority when 1 then 'NOT_EXTRACTED:  ' when 3 then 'NOT_REPORTED' else 'NOT_REPORTED: x' end as value")
    return G.split_marker_reasons(o).select("o_orderkey", "value", F.coalesce("value_as_supplied", F.lit("")).alias("value_as_supplied"))


COVERAGE = ("case when c_custkey % 71 = 0 then 'OAI-Z' || c_custkey else 'OAI-' || c_custkey end as paper_id", "c_custkey % 15 as claim_count",
            "case when c_custkey % 3 = 0 then 'INDEX_ONLY' when c_custkey % 3 = 1 then 'DETAILED' else 'DETAILED_PARTIAL' end as coverage_level")
_V = f"""w as {sql('customer', COVERAGE)}, a as (select paper_id, count_if(coalesce(extraction_status, '') <> 'NOT_REPORTED') as nc, count_if(extraction_status = 'NOT_REPORTED') as nm from c group by 1),
x as (select w.*, coalesce(nc, 0) as nc, coalesce(nm, 0) as nm from w left join a using (paper_id))"""


@query("coverage_rules", f"""with {_I}, {_C}, {_V}, v as ({' union all '.join([
    rows('coverage_only', 'COVERAGE', 'paper_id', '(select distinct paper_id from w) w where paper_id not in (select paper_id from i)'), rows('index_only', 'COVERAGE', 'paper_id', '(select distinct paper_id from i) i where paper_id not in (select paper_id from w)'),
    rows('coverage_count', 'COVERAGE', 'paper_id', 'x where claim_count <> nc and not (claim_count > nc and claim_count <= nc + nm)'),
    rows('coverage_counts_markers', 'COVERAGE', 'paper_id', 'x where claim_count > nc and claim_count <= nc + nm', 'warn')])}) {_REPORT}""")
def coverage_rules(spark, sf):
    return report(G.coverage_rules(make(spark, sf, "customer", COVERAGE), index(spark, sf), claims(spark, sf)))


_MARKED = "extraction_status = 'NOT_REPORTED'"


@query("declared_counts", f"""with {_C}, t as (select count(*) as n, count(*) - 10 as before, 5 as added, count(*) + 1 as total, count_if({_MARKED}) as markers,
  count_if(coalesce(not ({_MARKED}), true)) + 2 as x, count_if({_MARKED}) - 2 as m from c),
n as (select 'Claims total' as label, total as said, n as has, null as other from t
  union all select 'Detailed papers now', f, (select count(distinct case when coalesce(not ({_MARKED}), true) then paper_id end) from c), f from (select count_if(c_custkey % 3 <> 0) as f from customer)),
v as ({rows('declared_count', 'START_HERE', 'label', 'n where said <> has and said is distinct from other')} union all {rows('declared_by_formula', 'START_HERE', 'label', 'n where said <> has and said = other', 'warn')}
  union all {rows('totals_undeclared', 'START_HERE', "'totals'", "t where not exists (select 1 from n where label = 'Papers indexed')")}
  union all {rows('totals_do_not_add_up', 'START_HERE', "'totals'", 't where before + added <> total')}
  union all {rows('markers_counted_as_rows', 'START_HERE', "'totals'", 't where x + m = n and m <= markers and m <> markers', 'warn')}) {_REPORT}""")
def declared_counts(spark, sf):
    """A cover sheet that breaks each of the total rules once."""
    o, c, cl = table(spark, sf, "orders"), table(spark, sf, "customer"), claims(spark, sf)
    line = lambda df, label, n: df.agg(F.lit(label).alias("label"), n.cast("string").alias("text"))
    marked = F.coalesce(F.expr(_MARKED), F.lit(False))
    start = C.all_violations([
        line(o, "Claims total", F.count("*") + 1), line(o, "Claims before", F.count("*") - 10), line(o, "Claims added", F.lit(5)),
        line(c.filter("c_custkey % 3 <> 0"), "Detailed papers now", F.count("*")),
        line(cl, "Lignes extraites / historiques", F.count_if(~marked) + 2), line(cl, "Champs manquants hérités", F.count_if(marked) - 2)])
    return report(G.supplement_totals(start, cl, c, make(spark, sf, "customer", COVERAGE), c.filter("false")))


@query("type_warnings", f"""with {_C}, v as (select 'markers_present' as rule, 'warn' as severity, '{_S}' as entity, extraction_status as key from c where extraction_status = 'NOT_REPORTED' group by extraction_status
 union all select 'claim_type_outside_classes', 'warn', '{_S}', claim_type from c where claim_type = 'NOTE' group by claim_type) {_REPORT}""")
def type_warnings(spark, sf):
    return report(G.type_warnings(claims(spark, sf)))


@query("integrity_violations", f"""with {_I}, {_C}, {_KEYED}, v as ({' union all '.join(_IDENTITY_RULES + _CLAIM_RULES)})
select rule, severity, count(*) as n, coalesce(min(key), '') as first_key from v group by 1, 2""")
def integrity_violations(spark, sf):
    v = C.all_violations([G.paper_identity_rules(index(spark, sf)), G.claim_rules(claims(spark, sf), index(spark, sf))])
    return v.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.coalesce(F.min("key"), F.lit("")).alias("first_key"))


# --- identity and merge -----------------------------------------------------------------

STORED = ("'OAI-' || c_custkey as paper_id", "case when c_custkey % 3 = 0 then null else '10.1234/c' || c_custkey end as doi_key", "'customer ' || c_custkey as title_key", "cast(1990 + c_nationkey as varchar(10)) as year")
INCOMING = ("case c_custkey % 6 when 0 then 'OAI-' || c_custkey when 1 then 'ALT-' || c_custkey else 'NEW-' || c_custkey end as paper_id",
            "case when c_custkey % 6 = 2 then '10.1234/c' || c_custkey when c_custkey % 6 = 4 then '10.9/x' || c_custkey end as doi_key",
            "case when c_custkey % 6 = 5 then 'unseen ' || c_custkey else 'customer ' || c_custkey end as title_key",
            "case when c_custkey % 13 = 0 then null else cast(1990 + c_nationkey as varchar(10)) end as year")
ALIASES = ("'ALT-' || c_custkey as alias_id", "'OAI-' || c_custkey as paper_id")


def stored_papers(spark, sf):
    return make(spark, sf, "customer", STORED)


def resolved(spark, sf):
    aliases = table(spark, sf, "customer").filter("c_custkey % 12 = 1").selectExpr(*ALIASES)
    return G.resolve_papers(make(spark, sf, "customer", INCOMING), stored_papers(spark, sf), aliases)


_RES = f"""st as {sql('customer', STORED)}, inc as {sql('customer', INCOMING)}, al as (select {', '.join(ALIASES)} from customer where c_custkey % 12 = 1),
bd as (select doi_key, min(paper_id) as p from st where doi_key is not null group by 1), bt as (select title_key, year, min(struct_pack(p := paper_id, d := doi_key)) as t from st group by 1, 2),
res as (select n.paper_id, n.doi_key, coalesce(s.paper_id, al.paper_id, bd.p, case when bt.t.d is null or n.doi_key is null then bt.t.p end, n.paper_id) as target_id,
  case when s.paper_id is not null then 'paper_id' when al.paper_id is not null then 'alias' when bd.p is not null then 'doi' when bt.t.p is not null and (bt.t.d is null or n.doi_key is null) then 'title_year' end as matched_on
  from inc n left join st s on s.paper_id = n.paper_id left join al on al.alias_id = n.paper_id left join bd on bd.doi_key = n.doi_key left join bt on bt.title_key = n.title_key and bt.year is not distinct from n.year)"""


@query("identity_resolution", f"with {_RES} select paper_id, target_id, coalesce(matched_on, '') as matched_on from res")
def identity_resolution(spark, sf):
    return resolved(spark, sf).select("paper_id", "target_id", F.coalesce("matched_on", F.lit("")).alias("matched_on"))


@query("new_aliases", f"with {_RES} select paper_id as alias_id, target_id as paper_id, matched_on from res where matched_on in ('doi', 'title_year') and target_id <> paper_id")
def new_aliases(spark, sf):
    return G.new_aliases(resolved(spark, sf))


@query("alias_fill", f"with al as (select {', '.join(ALIASES)} from customer where c_custkey % 12 = 1), o as (select o_orderkey, case when o_orderkey % 2 = 0 then 'ALT-' || o_custkey else 'OAI-' || o_custkey end as p from orders) select o_orderkey, coalesce(al.paper_id, p) as paper_id from o left join al on alias_id = p")
def alias_fill(spark, sf):
    aliases = table(spark, sf, "customer").filter("c_custkey % 12 = 1").selectExpr(*ALIASES)
    return G.canonical_ids(table(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 2 = 0 then 'ALT-' || o_custkey else 'OAI-' || o_custkey end as paper_id"), aliases)


@query("doi_conflicts", f"with st as {sql('customer', STORED)}, r as (select 'OAI-' || (c_custkey + c_custkey % 2) as target_id, 'IN-' || c_custkey as paper_id, '10.1234/c' || c_custkey as doi_key from customer) select r.paper_id, r.doi_key, st.paper_id as owner from r join st using (doi_key) where st.paper_id <> target_id")
def doi_conflicts(spark, sf):
    r = table(spark, sf, "customer").selectExpr("'OAI-' || (c_custkey + c_custkey % 2) as target_id", "'IN-' || c_custkey as paper_id", "'10.1234/c' || c_custkey as doi_key")
    return G.doi_conflicts(r, stored_papers(spark, sf))


@query("linked_records", f"with st as {sql('customer', STORED)}, s as (select lower('10.1234/C' || s_suppkey) as d, min('R' || s_suppkey) as id from supplier group by 1) select paper_id, coalesce(s.id, '') as linked_id from st left join s on s.d = st.doi_key")
def linked_records(spark, sf):
    store = table(spark, sf, "supplier").selectExpr("'R' || s_suppkey as id", "'10.1234/C' || s_suppkey as doi")
    return G.linked_records(stored_papers(spark, sf), store).select("paper_id", F.coalesce("linked_id", F.lit("")).alias("linked_id"))


SUPPLEMENT = ("case when c_custkey % 10 = 9 then 'ALT-' || c_custkey when c_custkey % 10 = 8 then 'NOPE-' || c_custkey else 'OAI-' || c_custkey end as paper_id",
              "case when c_custkey % 10 = 7 then '10.1234/c' || (c_custkey + 1) when c_custkey % 10 = 6 then '10.1234/fill' || c_custkey when c_custkey % 3 = 0 then null else '10.1234/c' || c_custkey end as doi_key",
              "case when c_custkey % 10 = 5 then 'renamed' else 'customer ' || c_custkey end as title_key", "cast(1990 + c_nationkey as varchar(10)) as year")


@query("supplement_membership", f"""with st as {sql('customer', STORED)}, al as (select {', '.join(ALIASES)} from customer where c_custkey % 4 = 1), su as {sql('customer', SUPPLEMENT)},
nm as (select paper_id as n, * from st union all select alias_id, st.* from al join st using (paper_id)),
j as (select su.paper_id as pid, nm.paper_id as id, su.doi_key is distinct from nm.doi_key as dd, su.title_key is distinct from nm.title_key or su.year is distinct from nm.year as oo, nm.doi_key as od, su.doi_key as nd,
  (select count(*) from st h where h.doi_key = su.doi_key and h.paper_id <> nm.paper_id) as holders from su left join nm on nm.n = su.paper_id)
select pid as paper_id, case when id is null then 'UNKNOWN_PAPER' when dd and not oo and od is null and nd is not null then case when holders > 0 then 'DOI_HELD_BY_OTHER' else 'DOI_ADDED' end when oo or dd then 'IDENTITY_CHANGED' else 'SAME' end as verdict from j""")
def supplement_membership(spark, sf):
    aliases = table(spark, sf, "customer").filter("c_custkey % 4 = 1").selectExpr(*ALIASES)
    return G.supplement_membership(make(spark, sf, "customer", SUPPLEMENT), stored_papers(spark, sf), aliases)


@query("marker_overlap", f"with {_C} select k, paper_id, field_path from c m where extraction_status = 'NOT_REPORTED' and exists (select 1 from c e where coalesce(e.extraction_status, '') <> 'NOT_REPORTED' and e.paper_id = m.paper_id and e.field_path = m.field_path)")
def marker_overlap(spark, sf):
    return G.marker_overlap(claims(spark, sf)).select("k", "paper_id", "field_path")


@query("claim_identity", """with s as (select 'C' || o_orderkey as id, case when o_orderkey % 5 = 0 then 'marker' else 'claim' end as kind, o_custkey as p, substring(o_orderpriority, 1, 1) as f from orders),
i as (select 'C' || o_orderkey as id, case when o_orderkey % 5 = 0 or o_orderkey % 83 = 0 then 'marker' else 'claim' end as kind, case when o_orderkey % 79 = 0 then o_custkey + 1 else o_custkey end as p, substring(o_orderpriority, 1, 1) as f from orders
  union all select 'E' || event_id, 'claim', user_id, event_type from events)
select i.id as claim_id, i.kind, s.kind as stored_kind, i.p as paper_id, s.p as stored_paper from i join s on s.id = i.id where i.kind <> s.kind or i.p <> s.p or i.f <> s.f""")
def claim_identity(spark, sf):
    o = table(spark, sf, "orders").selectExpr("'C' || o_orderkey as claim_id", "o_orderkey as k", "o_custkey as paper_id", "substring(o_orderpriority, 1, 1) as field_path")
    mark = "case when k % 5 = 0 or k % 83 = 0 then 'NOT_EXTRACTED' end as extraction_status"
    incoming = o.selectExpr("claim_id", mark, "case when k % 79 = 0 then paper_id + 1 else paper_id end as paper_id", "field_path").unionByName(
        table(spark, sf, "events").selectExpr("'E' || event_id as claim_id", "cast(null as string) as extraction_status", "user_id as paper_id", "event_type as field_path"))
    out = G.claim_identity(incoming, o.filter("k % 5 <> 0"), o.filter("k % 5 = 0").withColumnRenamed("claim_id", "marker_id"))
    return out.select("claim_id", "kind", "stored_kind", "paper_id", "stored_paper")


_V1 = "sha256(c_mktsegment || '|' || c_nationkey)"
_V2 = "sha256(case when c_custkey % 7 = 0 then 'NEW' when c_custkey % 11 = 0 then 'OLD' else c_mktsegment end || '|' || c_nationkey)"
_PLAN = f"""inc as (select c_custkey as key, {_V2} as f from customer where c_custkey % 17 <> 0 union all select c_custkey + 1000000000, {_V1} from customer where c_custkey % 23 = 0),
sto as (select c_custkey as key, {_V1} as f, c_custkey % 14 = 0 as protected from customer), ver as (select c_custkey as key, sha256('OLD|' || c_nationkey) as f from customer),
plan as (select coalesce(inc.key, sto.key) as key, case when inc.key is null then 'absent' when sto.key is null then 'created' when inc.f = sto.f then 'unchanged' when protected then 'skipped_protected'
  when ver.key is not null then 'stale' else 'updated' end as action from inc full join sto using (key) left join ver on ver.key = inc.key and ver.f = inc.f)"""


def upsert_inputs(spark, sf):
    c = table(spark, sf, "customer")
    print_of = lambda head: F.sha2(F.concat_ws("|", head, F.col("c_nationkey").cast("string")), 256).alias("fingerprint")
    incoming = c.filter("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("key"), print_of(F.expr("case when c_custkey % 7 = 0 then 'NEW' when c_custkey % 11 = 0 then 'OLD' else c_mktsegment end")))
    incoming = incoming.unionByName(c.filter("c_custkey % 23 = 0").select((F.col("c_custkey") + 1000000000).alias("key"), print_of("c_mktsegment")))
    stored = c.select(F.col("c_custkey").alias("key"), print_of("c_mktsegment"), (F.col("c_custkey") % 14 == 0).alias("protected"))
    return incoming, stored, c.select(F.col("c_custkey").alias("key"), print_of(F.lit("OLD")))


@query("upsert_plan", f"with {_PLAN} select key, action from plan")
def upsert_plan(spark, sf):
    return G.plan_upsert(*upsert_inputs(spark, sf)).select("key", "action")


@query("import_counts", f"with {_PLAN} select 'papers' as entity, action, count(*) as n from plan group by 2 union all select 'again', case when action in ('absent') then 'absent' else 'unchanged' end, count(*) from plan group by 2")
def import_counts(spark, sf):
    """A package is applied (reverts allowed) and imported again: the second run changes nothing."""
    incoming, stored, versions = upsert_inputs(spark, sf)
    plan = G.plan_upsert(incoming, stored, versions)
    stored = stored.withColumn("created_at", F.lit("t0"))
    applied = G.apply_upsert(incoming.withColumns({"protected": F.lit(False), "created_at": F.lit("t1")}), stored.withColumn("protected", F.lit(False)),
                             G.plan_upsert(incoming, stored.withColumn("protected", F.lit(False)), versions, allow_revert=True))
    return G.import_counts({"papers": plan, "again": G.plan_upsert(incoming, applied, versions)})


@query("row_versions", f"""with {_PLAN}, now as (select p.key, p.action, coalesce(inc.f, sto.f) as f from plan p left join inc using (key) left join sto using (key))
select 'papers' as table_name, key::varchar as row_key, f as fingerprint from now where action in ('created', 'updated', 'unchanged') and not exists (select 1 from ver where ver.key = now.key and ver.f = now.f)""")
def row_versions(spark, sf):
    incoming, stored, versions = upsert_inputs(spark, sf)
    known = versions.select(F.lit("papers").alias("table_name"), F.col("key").cast("string").alias("row_key"), "fingerprint")
    return G.record_versions(known, G.plan_upsert(incoming, stored, versions), "papers", "run").drop("import_run_id")


@query("append_only_check", "select event_id, case when event_id % 97 = 0 then 'REMOVED' else 'EDITED' end as fault from events where event_id % 97 = 0 or event_id % 89 = 0")
def append_only_check(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    later = e.filter("event_id % 97 <> 0").withColumn("event_type", F.expr("if(event_id % 89 = 0, concat(event_type, '!'), event_type)"))
    return G.changed_in_place(e, later, "event_id", ["event_type", "user_id"])


@query("staging_summary", f"""with {_C}, cl as (select * from c where coalesce(extraction_status, '') <> 'NOT_REPORTED'), mk as (select * from c where extraction_status = 'NOT_REPORTED')
select 'papers' as metric, 'all' as key, count(*) as n from customer union all select 'claims', 'all', count(*) from cl union all select 'claim_status', coalesce(scientific_status, 'None'), count(*) from cl group by 2
union all select 'claim_audit', coalesce(independent_audit, 'None'), count(*) from cl group by 2 union all select 'markers', extraction_status, count(*) from mk group by 2
union all select 'claims_with_page', 'all', count(*) from cl where k % 2 = 0""")
def staging_summary(spark, sf):
    c = claims(spark, sf).withColumn("row_json", F.expr("if(k % 2 = 0, concat('{\"pdf_page\": ', k, '}'), '{\"pdf_page\": null}')"))
    m = G.is_marker(F.col("extraction_status"))
    return G.staging_summary(table(spark, sf, "customer"), c.filter(~m), c.filter(m))


@query("claims_per_paper", "select o_custkey as paper_id, count(*) as n from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' group by 1")
def claims_per_paper(spark, sf):
    o = G.list_claims(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None)
    return o.groupBy(F.col("o_custkey").alias("paper_id")).agg(F.count("*").alias("n"))


@query("latest_coverage", """select o_custkey as paper_id, o_orderkey as claim_count from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def latest_coverage(spark, sf):
    o = table(spark, sf, "orders")
    runs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("imported_at"))
    cov = o.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("import_run_id"), F.col("o_orderkey").alias("claim_count"))
    return G.latest_coverage(cov, runs).select("paper_id", "claim_count")


# --- a package imported, changed, and sent again ----------------------------------------

def package(spark, sf, later):
    """Customers are papers and orders their claims. The later package lacks some rows, changes some, and brings new ones."""
    c = table(spark, sf, "customer").filter("c_custkey % 17 <> 0" if later else "true")
    domain = "case when c_custkey % 7 = 0 then 'NEW' else c_mktsegment end" if later else "c_mktsegment"
    index = c.selectExpr("'OAI-' || c_custkey as paper_id", "'Work ' || c_custkey as title", "1990 + c_nationkey as year", "case when c_custkey % 4 <> 0 then '10.1234/c' || c_custkey end as doi",
                         f"{domain} as domain", "cast(null as string) as scientific_audit_status")
    o = table(spark, sf, "orders").filter("o_orderkey % 13 <> 0 and o_custkey % 17 <> 0" if later else "true")
    kind = "case when o_orderkey % 11 = 0 then 'NOTE' else 'AUTHOR_REPORTED_FACT' end" if later else "'AUTHOR_REPORTED_FACT'"
    mark = "case when o_orderkey % 5 = 0 then 'NOT_REPORTED' end"
    row = ("'OAI-' || o_custkey as paper_id", "'data.p' || substring(o_orderpriority, 1, 1) as field_path", "'NOT_VERIFIED' as scientific_status", "cast(null as string) as independent_audit")
    claims = o.selectExpr("'C' || o_orderkey as claim_id", *row, f"coalesce({mark}, 'v' || o_custkey) as value", f"{mark} as extraction_status", f"{kind} as claim_type")
    if later:
        new = table(spark, sf, "orders").filter("o_orderkey % 23 = 0 and o_custkey % 17 <> 0")
        claims = claims.unionByName(new.selectExpr("'N' || o_orderkey as claim_id", *row, "'new' as value", "cast(null as string) as extraction_status", "'NOTE' as claim_type"))
    gaps = table(spark, sf, "nation").selectExpr("n_name as candidate_topic", "n_name as testable_question")
    return P.Package(index, index.select("paper_id", F.to_json(F.struct("paper_id")).alias("record_json")), claims, gaps, "later" if later else "first", "sha-later" if later else "sha-first")


_DROPPED, _KEPT_BY_AUDIT = "(o_orderkey % 13 = 0 or o_custkey % 17 = 0)", "(o_orderkey % 14 = 0 and o_orderkey % 5 <> 0)"


@query("import_chain", f"""with e as (select *, case when o_orderkey % 5 = 0 then 'markers' else 'claims' end as entity from orders),
r as (select 'first' as step, 'papers' as entity, 'created' as action from customer union all select 'first', entity, 'created' from e union all select 'first', 'gaps', 'created' from nation
 union all select 'second', 'papers', case when c_custkey % 17 = 0 then 'absent' when c_custkey % 7 = 0 then 'updated' else 'unchanged' end from customer
 union all select 'second', entity, case when {_DROPPED} then 'absent' when o_orderkey % 11 <> 0 then 'unchanged' when {_KEPT_BY_AUDIT} then 'skipped_protected' else 'updated' end from e
 union all select 'second', 'claims', 'created' from orders where o_orderkey % 23 = 0 and o_custkey % 17 <> 0 union all select 'second', 'gaps', 'unchanged' from nation
 union all select 'older', 'papers', case when c_custkey % 17 <> 0 and c_custkey % 7 = 0 then 'stale' else 'unchanged' end from customer
 union all select 'older', entity, case when not {_DROPPED} and o_orderkey % 11 = 0 and not {_KEPT_BY_AUDIT} then 'stale' else 'unchanged' end from e
 union all select 'older', 'claims', 'absent' from orders where o_orderkey % 23 = 0 and o_custkey % 17 <> 0 union all select 'older', 'gaps', 'unchanged' from nation)
select step, case step when 'older' then 'stale' else 'imported' end as status, entity, action, count(*) as n from r group by all""")
def import_chain(spark, sf):
    """A first import, an audit of some claims, a newer package, and the first one again: refused as older."""
    corpus = P.open_corpus(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", 16)
    first = P.import_package(corpus, package(spark, sf, False), "run-1", "2025-01-01")
    audited = first.corpus.table("claims").filter("cast(substring(claim_id, 2) as bigint) % 14 = 0").select("claim_id", F.lit("VERIFIED").alias("scientific_status"), "independent_audit")
    second = P.import_package(P.attest(first.corpus, audited, "audit-1", "2025-01-02"), package(spark, sf, True), "run-2", "2025-01-03")
    older = P.import_package(second.corpus, package(spark, sf, False), "run-3", "2025-01-04")
    steps = [o.counts.select(F.lit(step).alias("step"), F.lit(o.status).alias("status"), "entity", "action", "n") for step, o in (("first", first), ("second", second), ("older", older))]
    return G.all_violations(steps)
