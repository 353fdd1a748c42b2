"""Queries over audit events, paper states, field statuses and mapping audits."""

from pyspark.sql import functions as F

from attestry.operators import mapping as M
from attestry.operators import states as T
from attestry.operators.keyed import page
from attestry.plans.registry import as_int, query, table
from attestry.plans.q_staging import make, rows, sql

TARGETS = ("case when o_orderkey % 5 = 0 then 'MARKER' else 'CLAIM' end as target_kind", "cast(o_orderkey as varchar(20)) as target_id", "'f' || (o_orderkey % 3) as fingerprint", "'c' || o_orderkey as reviewed_json",
           "case when o_orderkey % 9 = 0 then 'TEAM_NOTE' else 'AUTHOR_REPORTED_FACT' end as claim_type", "case when o_orderkey % 37 = 0 then 'SOURCE_REVIEW_1' else 'e1' end as experiment_id",
           "case when o_orderkey % 10 = 0 then 'NOT_REPORTED' when o_orderkey % 5 = 0 then 'NOT_EXTRACTED' end as extraction_status")
PAPERS = ("'PAPER' as target_kind", "cast(c_custkey as varchar(20)) as target_id", "'f' || (c_custkey % 3) as fingerprint", "'c' || c_custkey as reviewed_json", "cast(null as varchar(20)) as claim_type", "cast(null as varchar(20)) as experiment_id", "cast(null as varchar(20)) as extraction_status")
_TID = "case when event_id % 3 = 2 then event_id % 1700 when event_id % 3 = 1 then (event_id * 5) % 15500 else (event_id * 7) % 15500 end"
EVENTS = (
    "event_id", "ts as at", "cast(ts as date) as created_at", "case event_id % 3 when 0 then 'claim' when 1 then 'MARKER' else 'PAPER' end as target_kind", f"cast({_TID} as varchar(20)) as target_id",
    "case when event_id % 53 = 0 then 'MAYBE' when event_type = 'click' then 'VERIFIED' when event_type = 'view' then 'PARTIALLY_VERIFIED' when event_type = 'signup' then 'NOT_REPORTED' when event_type = 'purchase' then 'CONFLICT' else 'BLOCKED' end as decision",
    "case when event_id % 59 = 0 then ' ' else 'because' end as justification", "'user' || user_id as auditor_id",
    "case event_id % 7 when 0 then '2025-02-30' when 1 then '2025-02-03' when 2 then '2025-02-03T10:00:00' when 3 then '2025-02-03T10:00:00Z' when 4 then '2025-02-03T10:00:00.5+02:00' when 5 then 'yesterday' else '2025-02-03 10:00+01:00' end as audited_at",
    "case when event_id % 11 = 0 then 'AI_INTERPRETATION' else 'author_reported_fact' end as provenance_type", "case when event_id % 17 = 0 then 'OTHER' when event_id % 19 = 0 then 'BLOG' else 'PRIMARY_PAPER' end as source_kind",
    "'v1' as source_edition", "case when event_id % 4 = 0 then null when event_id % 61 = 0 then 0 else 3 end as page", "case when event_id % 8 = 0 then 'Methods' end as section", "cast(null as varchar(10)) as locator",
    "case when event_id % 23 = 0 then '' else 'quoted text' end as evidence",
    "case when value > 30 then 'whole paper, supplements and code were read' when value > 10 then 'keyword search over the complete supplement' else 'short' end as search_scope",
    f"case when event_id % 13 = 0 then 'x' else 'c' || ({_TID}) end as reviewed_json", f"'f' || case when event_id % 6 = 0 then 9 else ({_TID}) % 3 end as target_fingerprint")


def targets(spark, sf):
    return make(spark, sf, "orders", TARGETS).unionByName(make(spark, sf, "customer", PAPERS))


def events(spark, sf):
    return make(spark, sf, "events", EVENTS)


_T = f"t as ({sql('orders', TARGETS)[1:-1]} union all {sql('customer', PAPERS)[1:-1]})"
_EV = f"ev as (select * replace (upper(target_kind) as target_kind, upper(provenance_type) as provenance_type) from {sql('events', EVENTS)})"
_J = "j as (select ev.*, t.target_id is not null as known, t.reviewed_json as expected, t.claim_type, t.experiment_id, t.extraction_status from ev left join t on t.target_kind = ev.target_kind and t.target_id = ev.target_id)"
_VER = "decision in ('VERIFIED', 'PARTIALLY_VERIFIED')"


def _rule(name, where):
    return rows(name, "AUDIT_EVENT", "event_id", f"j where {where}")


@query("audit_event_rules", f"""with {_T}, {_EV}, {_J}, v as ({' union all '.join([
    _rule('field_missing', "trim(justification) = ''"), _rule('decision_unknown', "decision = 'MAYBE'"), _rule('source_unknown', "source_kind = 'BLOG'"), _rule('time_invalid', 'event_id % 7 in (0, 2, 5)'),
    _rule('verified_without_author_provenance', f"{_VER} and provenance_type <> 'AUTHOR_REPORTED_FACT'"), _rule('verified_without_primary_source', f"{_VER} and source_kind <> 'PRIMARY_PAPER'"),
    _rule('verified_without_located_evidence', f"{_VER} and (evidence = '' or (page is null and section is null))"), _rule('absence_on_value', "decision = 'NOT_REPORTED' and target_kind <> 'MARKER'"),
    _rule('absence_scope_thin', "decision = 'NOT_REPORTED' and (length(search_scope) < 30 or search_scope like '%keyword%')"), _rule('paper_scope_thin', "decision = 'VERIFIED' and target_kind = 'PAPER' and length(search_scope) < 30"),
    _rule('page_invalid', 'page < 1'), _rule('target_missing', 'not known'), _rule('reviewed_differs', 'known and reviewed_json <> expected'),
    _rule('provenance_differs', f"known and target_kind = 'CLAIM' and {_VER} and claim_type <> provenance_type"), _rule('review_label_as_experiment', f"known and target_kind = 'CLAIM' and {_VER} and experiment_id = 'SOURCE_REVIEW_1'"),
    _rule('absence_on_other_marker', "known and target_kind = 'MARKER' and decision = 'NOT_REPORTED' and extraction_status <> 'NOT_REPORTED'")])})
select rule, count(*) as n, min(key::bigint) as first_event, max(key::bigint) as last_event from v group by rule""")
def audit_event_rules(spark, sf):
    v = T.audit_event_rules(events(spark, sf), targets(spark, sf))
    key = F.col("key").cast("bigint")
    return v.groupBy("rule").agg(F.count("*").alias("n"), F.min(key).alias("first_event"), F.max(key).alias("last_event"))


def latest(spark, sf):
    e = events(spark, sf).withColumn("target_kind", F.upper("target_kind"))
    return T.latest_audits(e, targets(spark, sf))


_L = f"{_T}, {_EV}, la as (select ev.*, coalesce(ev.target_fingerprint = t.fingerprint, false) as current from ev left join t on t.target_kind = ev.target_kind and t.target_id = ev.target_id qualify row_number() over (partition by ev.target_kind, ev.target_id order by ev.at desc, ev.event_id desc) = 1)"


@query("latest_audits", f"with {_L} select target_kind, target_id, event_id, decision, current::int as current from la")
def latest_audits(spark, sf):
    return latest(spark, sf).select("target_kind", "target_id", "event_id", "decision", *as_int("current"))


STATUS = ("cast(o_orderkey as varchar(20)) as target_id", "'f' || (o_orderkey % 3) as fingerprint", "case when o_orderkey % 4 = 0 then 'VERIFIED' when o_orderkey % 4 = 1 then 'PARTIALLY_VERIFIED' else 'NOT_VERIFIED' end as status", "case when o_orderkey % 6 = 0 then 'AUDITED' end as independent_audit")


@query("promotion_faults", f"""with {_EV}, c as {sql('orders', STATUS)}, last as (select ev.target_id, ev.decision from ev join c on c.target_id = ev.target_id and c.fingerprint = ev.target_fingerprint where target_kind = 'CLAIM'
 qualify row_number() over (partition by ev.target_id order by ev.at desc, ev.event_id desc) = 1)
select * from (select c.target_id, case when status <> 'NOT_VERIFIED' and decision is distinct from status then 'STATUS_NOT_AUDITED' when independent_audit is not null and decision is null then 'AUDIT_MARKER_WITHOUT_AUDIT' end as fault
 from c left join last using (target_id)) where fault is not null""")
def promotion_faults(spark, sf):
    e = events(spark, sf).withColumn("target_kind", F.upper("target_kind"))
    return T.promotion_faults(make(spark, sf, "orders", STATUS), e, "CLAIM")


@query("binding_faults", f"with {_T}, {_EV} select event_id, ev.target_id from ev join t on t.target_kind = 'CLAIM' and ev.target_kind = 'CLAIM' and t.target_id = ev.target_id and t.fingerprint = ev.target_fingerprint where ev.reviewed_json <> t.reviewed_json")
def binding_faults(spark, sf):
    c = targets(spark, sf).filter("target_kind = 'CLAIM'").withColumnRenamed("target_id", "claim_id")
    return T.binding_faults(events(spark, sf).withColumn("target_kind", F.upper("target_kind")), c)


CLAIMS = ("cast(o_orderkey as varchar(20)) as claim_id", "cast(o_custkey as varchar(20)) as paper_id", "case when o_orderkey % 47 = 0 then 'CONFLICT' else 'NOT_VERIFIED' end as scientific_status",
          "case when o_orderkey % 43 = 0 then 'CONFLICT_REVIEW: two values' when o_orderkey % 2 = 0 then 'OK' end as evidence_review", "o_orderkey % 3 = 0 as located")
COVERAGE = ("cast(c_custkey as varchar(20)) as paper_id", "case when c_custkey % 4 = 0 then '' else 'DETAILED' end as coverage_level", "case c_custkey % 3 when 0 then 'FULLTEXT_PDF' when 1 then 'ABSTRACT' else 'PUBLIC_CODE' end as evidence_basis",
            "case when c_custkey % 5 < 3 then 'YES' else 'NO' end as review_scope_documented", "case when c_custkey % 2 = 0 then ' ' else 'read supplement' end as follow_up")


def states(spark, sf):
    papers = make(spark, sf, "customer", ("cast(c_custkey as varchar(20)) as paper_id", "c_name as title", "c_mktsegment as domain", "'10.1234/' || c_custkey as doi"))
    o = table(spark, sf, "orders")
    claims = o.filter("o_orderkey % 5 <> 0").selectExpr(*CLAIMS)
    markers = o.filter("o_orderkey % 25 = 0").selectExpr("cast(o_custkey as varchar(20)) as paper_id")
    return papers, T.operational_states(papers, claims, markers, latest(spark, sf), make(spark, sf, "customer", COVERAGE))


_STATES = f"""{_L}, c as (select {', '.join(CLAIMS)} from orders where o_orderkey % 5 <> 0), mk as (select cast(o_custkey as varchar) as paper_id, count(*) as markers from orders where o_orderkey % 25 = 0 group by 1),
pc as (select c.paper_id, count(*) as claims, count_if(current) as reviewed, count_if(current and decision = 'VERIFIED') as verified, count_if(current and decision = 'PARTIALLY_VERIFIED') as partially_verified,
  count_if(not current) as stale, count_if(scientific_status = 'CONFLICT' or coalesce(evidence_review, '') like 'CONFLICT_REVIEW%') + count_if(current and decision = 'CONFLICT') as con,
  count_if(current and decision in ('BLOCKED', 'EXTRACTION_ERROR')) as blk, count_if(located) as locatable from c left join la on la.target_kind = 'CLAIM' and la.target_id = c.claim_id group by 1),
pa as (select target_id from la where target_kind = 'PAPER' and current and decision = 'VERIFIED' and length(trim(search_scope)) >= 30), cv as {sql('customer', COVERAGE)},
z as (select cv.*, coalesce(claims, 0) claims, coalesce(reviewed, 0) reviewed, coalesce(verified, 0) verified, coalesce(partially_verified, 0) partially_verified, coalesce(stale, 0) stale, coalesce(con, 0) con, coalesce(blk, 0) blk,
  coalesce(locatable, 0) locatable, coalesce(markers, 0) markers, pa.target_id is not null as att from cv left join pc using (paper_id) left join mk using (paper_id) left join pa on pa.target_id = cv.paper_id),
st as (select paper_id, case when claims = 0 then 'NOT_EXTRACTED' when review_scope_documented = 'YES' and (evidence_basis like '%FULLTEXT%' or evidence_basis like '%CODE%') and locatable > 0 then 'READY_FOR_AUDIT' else 'PARTIAL' end as extraction_state,
  case when claims > 0 and verified = claims and markers = 0 and con = 0 and blk + stale = 0 and att then 'FULLY_VERIFIED' when verified + partially_verified > 0 then 'PARTIALLY_VERIFIED' else 'NOT_VERIFIED' end as verification_state,
  case when con > 0 then 'CONFLICT' when blk + stale > 0 then 'BLOCKED' else 'CLEAR' end as conflict_blocker_state, coalesce(nullif(coverage_level, ''), '-') as declared_coverage, coalesce(nullif(trim(follow_up), ''), '-') as follow_up,
  claims, reviewed, verified, partially_verified, markers, stale, locatable, att::int as completion_candidate from z)"""


@query("operational_states", f"with {_STATES} select * from st")
def operational_states(spark, sf):
    _, s = states(spark, sf)
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return s.select("paper_id", "extraction_state", "verification_state", "conflict_blocker_state", dash("declared_coverage"), dash("follow_up"),
                    "claims", "reviewed", "verified", "partially_verified", "markers", "stale", "locatable", *as_int("completion_candidate"))


@query("operational_catalogue", f"""with {_STATES}, h as (select st.paper_id, c_mktsegment as domain, extraction_state, verification_state from st join customer on c_custkey::varchar = st.paper_id
 where contains(lower(c_name), '7') and extraction_state = 'PARTIAL' and verification_state = 'PARTIALLY_VERIFIED') select *, (select count(*) from h) as total from h order by paper_id limit 50 offset 10""")
def operational_catalogue(spark, sf):
    papers, s = states(spark, sf)
    hits = T.paper_catalogue(papers, s, text="7", extraction_state="PARTIAL", verification_state="PARTIALLY_VERIFIED")
    return page(hits, [F.col("paper_id")], 50, 10).select("paper_id", "domain", "extraction_state", "verification_state", "total")


LINES = ("l_orderkey as paper_id", "l_partkey % 40 as p", "case when l_linenumber % 3 = 0 then 'CONFLICT' when l_linenumber % 3 = 1 then 'NOT_VERIFIED' else 'EXTRACTION_ERROR' end as scientific_status",
         "case when l_suppkey % 2 = 0 then 'NOT_REPORTED' else 'NOT_EXTRACTED' end as extraction_status", "l_returnflag as rf")
_FS = f"""l as {sql('lineitem', LINES)}, s as (select paper_id, p, scientific_status as s, 1 as c from l where rf <> 'R' union all select paper_id, p, case when scientific_status <> 'NOT_VERIFIED' then scientific_status end, null from l where rf = 'R'
 union all select paper_id, p, case when extraction_status = 'NOT_REPORTED' then 'NOT_REPORTED_CANDIDATE' end, null from l where rf = 'R'),
fs as (select paper_id, 'p' || p as field_path, coalesce(string_agg(distinct s, '|' order by s), 'NOT_EXTRACTED') as status, count(c) as n_claims, p < 30 as contracted from s group by paper_id, p)"""


def statuses(spark, sf):
    li = make(spark, sf, "lineitem", LINES).withColumn("field_path", F.concat(F.lit("p"), "p"))
    return T.field_statuses(li.filter("rf <> 'R'"), li.filter("rf = 'R'"), contract(spark, sf))


def contract(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") % 30).alias("position")).distinct().withColumn("field_path", F.concat(F.lit("p"), "position"))


@query("field_status_join", f"with {_FS} select paper_id, field_path, status, n_claims, contracted::int as contracted from fs")
def field_status_join(spark, sf):
    return statuses(spark, sf).select("paper_id", "field_path", "status", "n_claims", *as_int("contracted"))


@query("paper_field_totals", f"with {_FS} select o_orderkey as paper_id, count_if(n_claims > 0) as populated, 30 - count_if(status <> 'NOT_EXTRACTED') as not_extracted from orders left join (select * from fs where contracted) f on f.paper_id = o_orderkey group by 1")
def paper_field_totals(spark, sf):
    return T.field_totals(statuses(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id")), contract(spark, sf))


@query("paper_field_view", """with c as (select o_custkey as paper_id, o_orderkey as claim_id, 'p' || o_orderkey % 40 as field_path from orders), s as (select paper_id, claim_id, 'p' || claim_id % 35 as field_path from c where claim_id % 3 = 0),
u as (select paper_id, claim_id, field_path, 'slot' as place from s union all select paper_id, claim_id, field_path, 'path' from c where claim_id % 3 <> 0)
select paper_id, claim_id, field_path, place, case when substring(field_path, 2)::int < 30 then substring(field_path, 2)::int else -1 end as position from u""")
def paper_field_view(spark, sf):
    c = table(spark, sf, "orders").selectExpr("o_custkey as paper_id", "o_orderkey as claim_id", "'p' || o_orderkey % 40 as field_path")
    slots = c.filter("claim_id % 3 = 0").selectExpr("paper_id", "claim_id", "'p' || claim_id % 35 as field_path")
    out = T.paper_fields(contract(spark, sf), slots, c)
    return out.select("paper_id", "claim_id", "field_path", "place", F.coalesce("position", F.lit(-1)).alias("position"))


_VIEW = """c as (select o_custkey as paper_id, o_orderkey as id, 'p' || o_orderkey % 40 as own, case when o_orderkey % 3 = 0 then 'p' || o_orderkey % 35 end as slot, case when o_orderstatus = 'O' then 'CONFLICT' else 'NOT_VERIFIED' end as s from orders),
p as (select paper_id, coalesce(slot, own) as field_path, s as status, 'claim' as kind, id, case when slot is null then 'path' else 'slot' end as place from c where slot is null or substring(slot, 2)::int < 30),
m as (select o_custkey as paper_id, 'p' || o_orderkey % 37 as field_path, o_orderkey as id, o_orderkey % 2 = 0 as absent, o_orderkey % 25 = 0 as disputed from orders where o_orderkey % 5 = 0),
st as (select paper_id, field_path, status from p union select paper_id, field_path, 'CONFLICT' from m where disputed union select paper_id, field_path, 'NOT_REPORTED_CANDIDATE' from m where absent),
fs as (select paper_id, field_path, string_agg(status, '|' order by status) as status from st group by 1, 2),
i as (select paper_id, field_path, kind, id, place from p union all select paper_id, field_path, 'marker', id, 'path' from m),
v as (select i.paper_id, i.field_path, coalesce(fs.status, 'NOT_EXTRACTED') as status, kind, id::varchar as item_id, place,
  case when id % 7 <> 0 then 'NOT_VERIFIED' when id % 4 = 0 then 'VERIFIED' else 'STALE_AUDIT' end as verification_state from i left join fs using (paper_id, field_path)
 union all select c_custkey, 'p' || n, 'NOT_EXTRACTED', 'empty', '', '', '' from customer, (select unnest(range(30)) as n) where not exists (select 1 from i where i.paper_id = c_custkey and i.field_path = 'p' || n))"""


@query("paper_contract_view", f"""with {_VIEW} select paper_id, field_path, status, kind, item_id, place, verification_state,
  case when substring(field_path, 2)::int < 30 then substring(field_path, 2)::int else -1 end as position from v""")
def paper_contract_view(spark, sf):
    o = table(spark, sf, "orders")
    claims = o.selectExpr("o_custkey as paper_id", "o_orderkey as claim_id", "'p' || o_orderkey % 40 as field_path", "case when o_orderstatus = 'O' then 'CONFLICT' else 'NOT_VERIFIED' end as scientific_status")
    slots = claims.filter("claim_id % 3 = 0").selectExpr("paper_id", "claim_id", "'p' || claim_id % 35 as field_path")
    markers = o.filter("o_orderkey % 5 = 0").selectExpr("o_orderkey as marker_id", "o_custkey as paper_id", "'p' || o_orderkey % 37 as field_path",
        "if(o_orderkey % 2 = 0, 'NOT_REPORTED', 'NOT_EXTRACTED') as extraction_status", "if(o_orderkey % 25 = 0, 'CONFLICT', 'NOT_VERIFIED') as scientific_status")
    audits = o.filter("o_orderkey % 7 = 0").selectExpr("explode(array('CLAIM', 'MARKER')) as target_kind", "cast(o_orderkey as string) as target_id", "'VERIFIED' as decision", "o_orderkey % 4 = 0 as current")
    fields = table(spark, sf, "nation").select(F.explode(F.sequence(F.lit(0), F.lit(29))).alias("position")).distinct().withColumn("field_path", F.concat(F.lit("p"), "position"))
    view = T.contract_view(fields, table(spark, sf, "customer").selectExpr("c_custkey as paper_id"), slots, claims, markers, audits)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return view.select("paper_id", "field_path", "status", "kind", blank("item_id"), blank("place"), blank("verification_state"), F.coalesce("position", F.lit(-1)).alias("position"))


@query("claim_view", f"""with {_L}, c as (select cast(o_orderkey as varchar) as claim_id, o_custkey, o_orderpriority from orders where o_orderkey % 5 <> 0)
select claim_id, case when o_custkey % 2 = 0 then '["' || o_orderpriority || '"]' else to_json(o_orderpriority)::varchar end as value_json,
 case when decision is null then 'NOT_VERIFIED' when not current then 'STALE_AUDIT' else decision end as verification_state from c left join la on la.target_kind = 'CLAIM' and la.target_id = claim_id""")
def claim_view(spark, sf):
    c = table(spark, sf, "orders").filter("o_orderkey % 5 <> 0").selectExpr("cast(o_orderkey as varchar(20)) as claim_id", "if(o_custkey % 2 = 0, concat('[', chr(39), o_orderpriority, chr(39), ']'), o_orderpriority) as value")
    return T.claim_view(c, latest(spark, sf)).select("claim_id", "value_json", "verification_state")


# --- mappings ---------------------------------------------------------------------------

CANDIDATES = ("p_brand || '.' || replace(p_name, ' ', '_') as field_path", "case when p_partkey % 3 = 0 then p_type else ' ' end as canonical_category")
_MAPS = f"""cand as {sql('part', CANDIDATES)}, con as (select distinct p_brand || '.' || replace(p_name, ' ', '_') as field_path from part where p_size = 7),
mp as (select field_path as original_path, case when field_path in (select * from con) then field_path end as canonical_path,
  case when field_path in (select * from con) then 'MAPPED' when max(nullif(trim(canonical_category), '')) is not null then 'AMBIGUOUS' else 'UNMAPPED' end as decision from cand group by 1)"""


def mapping_contract(spark, sf):
    return table(spark, sf, "part").filter("p_size = 7").selectExpr(CANDIDATES[0]).distinct()


def mappings(spark, sf):
    return M.import_mappings(make(spark, sf, "part", CANDIDATES), mapping_contract(spark, sf))


@query("mapping_import", f"with {_MAPS} select original_path, coalesce(canonical_path, '') as canonical_path, decision from mp")
def mapping_import(spark, sf):
    return mappings(spark, sf).select("original_path", F.coalesce("canonical_path", F.lit("")).alias("canonical_path"), "decision")


@query("mapping_omissions", "select distinct p_type as field_path from part where p_type not in (select p_type from part where p_size > 49 and p_brand = 'Brand#1')")
def mapping_omissions(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_type", "field_path")
    return M.omitted_paths(p.filter("p_size > 49 and p_brand = 'Brand#1'"), p)


LINE_CLAIMS = ("p_brand || '.' || replace(p_name, ' ', '_') as field_path", "l_orderkey as paper_id", "l_orderkey * 10 + l_linenumber as claim_id", "l_returnflag || l_quantity::int as fingerprint",
               "case when p_partkey % 11 = 0 then 'AI_INTERPRETATION' when p_partkey % 7 = 0 then 'AUTHOR_REPORTED_LIMITATION' else 'AUTHOR_REPORTED_FACT' end as claim_type",
               "case when l_suppkey % 97 = 0 then 'CONFLICT_REVIEW' when l_suppkey % 31 = 0 then 'Literature Review' when l_suppkey % 31 = 1 then 'REVIEWED_METHOD' else 'OWN' end as subject_scope")
_TARGET = "case when p_partkey % 5 = 0 then 'limitations.data' when p_partkey % 5 = 1 then 'interpretation.note' when p_partkey % 5 = 2 then 'results.headline' when p_partkey % 5 = 3 then 'limitations.future_work' else 'data.inputs' end"
_PROP = f"""{_MAPS}, lc as (select {', '.join(LINE_CLAIMS)} from lineitem join part on l_partkey = p_partkey), us as (select field_path, count(*) as n_claims, count(distinct paper_id) as n_papers, list_sort(list_distinct(list(claim_type))) as types, list_distinct(list(subject_scope)) as scopes from lc group by 1),
sy as (select {CANDIDATES[0]}, max({_TARGET}) as target from part where p_size % 2 = 0 group by 1), un as (select distinct {CANDIDATES[0]} from part where p_size = 9), di as (select distinct {CANDIDATES[0]} from part where p_size = 12),
q as (select mp.original_path, decision, un.field_path is not null as refused, di.field_path is not null as dis, sy.target, coalesce(n_claims, 0) n_claims, coalesce(n_papers, 0) n_papers, coalesce(types, []) types, coalesce(scopes, []) scopes
  from mp left join us on us.field_path = original_path left join sy on sy.field_path = original_path left join un on un.field_path = original_path left join di on di.field_path = original_path),
w as (select *, len(list_filter(scopes, lambda s: contains(lower(s), 'review') and not contains(lower(s), 'reviewed_'))) > 0 as rev, types = ['AI_INTERPRETATION'] as ai, types = ['AUTHOR_REPORTED_FACT'] as fact, types = ['AUTHOR_REPORTED_LIMITATION'] as lim from q),
g as (select *, case when list_contains(scopes, 'CONFLICT_REVIEW') then 'BLOCKED_SCOPE' when target like 'interpretation.%' then case when not ai then 'INTERPRETATION_NEEDS_AI_CLAIMS' end when list_contains(types, 'AI_INTERPRETATION') then 'AI_CLAIM_IN_AUTHOR_FIELD'
  when target = 'limitations.data' then case when not lim then 'NEEDS_LIMITATION_CLAIMS' when rev then 'REVIEW_LEVEL_LIMITATION' end when target = 'limitations.future_work' then case when not fact then 'UNEXPECTED_TYPES' end
  when not fact then 'NON_FACT_CLAIMS' when target = 'results.headline' and rev then 'REVIEW_LEVEL_RESULT' end as guard from w),
r as (select *, case when decision = 'MAPPED' then 'IDENTITY' when refused then 'REFUSED' when n_claims = 0 then 'NO_CLAIMS' when target is not null then coalesce(guard, 'SYNONYM') else 'NO_TARGET' end as reason from g),
pr as (select original_path, decision as source_decision, n_claims, n_papers, array_to_string(types, '|') as types, case when dis and reason in ('IDENTITY', 'SYNONYM') then 'DISSENT' else reason end as reason,
 case when dis and reason in ('IDENTITY', 'SYNONYM') then 'AMBIGUOUS' when reason in ('IDENTITY', 'SYNONYM') then 'MAPPED' when reason = 'REFUSED' then 'UNMAPPED' else 'AMBIGUOUS' end as proposed_decision,
 case when reason = 'IDENTITY' then original_path else target end as goal from r)"""


def line_claims(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    return li.selectExpr(*[e.replace("l_quantity::int", "cast(l_quantity as int)") for e in LINE_CLAIMS])


def proposals(spark, sf):
    p = table(spark, sf, "part")
    path = p.selectExpr(CANDIDATES[0] .replace(" as field_path", " as original_path"), "p_size", f"{_TARGET} as target")
    synonyms = path.filter("p_size % 2 = 0").groupBy("original_path").agg(F.max("target").alias("target"))
    return M.propose_mappings(mappings(spark, sf), synonyms, path.filter("p_size = 9").select("original_path").distinct(), path.filter("p_size = 12").select("original_path").distinct(), mapping_contract(spark, sf), line_claims(spark, sf))


@query("mapping_proposal", f"with {_PROP} select original_path, source_decision, proposed_decision, case when proposed_decision = 'MAPPED' then goal else '' end as proposed_path, reason, n_claims, n_papers, types from pr")
def mapping_proposal(spark, sf):
    return proposals(spark, sf).select("original_path", "source_decision", "proposed_decision", F.coalesce("proposed_path", F.lit("")).alias("proposed_path"), "reason", "n_claims", "n_papers", F.array_join("types", "|").alias("types"))


@query("mapping_crosstab", f"with {_PROP} select source_decision, count_if(proposed_decision = 'MAPPED') as \"MAPPED\", count_if(proposed_decision = 'UNMAPPED') as \"UNMAPPED\", count_if(proposed_decision = 'AMBIGUOUS') as \"AMBIGUOUS\" from pr group by 1")
def mapping_crosstab(spark, sf):
    return M.decision_crosstab(proposals(spark, sf))


@query("mapping_packets", f"""with {_PROP}, h as (select field_path, sha256(claim_id || chr(1) || fingerprint) as d from lc),
s as (select field_path, count(*) as n, sum(('0x' || substring(d, 1, 12))::bigint::hugeint) as a, sum(('0x' || substring(d, 13, 12))::bigint::hugeint) as b, sum(('0x' || substring(d, 25, 12))::bigint::hugeint) as c from h group by 1),
k as (select pr.*, coalesce(n, 0) as claims, sha256(coalesce(n::varchar, '0') || ':' || coalesce(a::varchar, '0') || ':' || coalesce(b::varchar, '0') || ':' || coalesce(c::varchar, '0')) as claims_digest from pr left join s on s.field_path = original_path)
select original_path, claims, claims_digest, sha256('+v1' || chr(1) || '+producer' || chr(1) || '+' || original_path || chr(1) || '+' || proposed_decision || chr(1) || case when proposed_decision = 'MAPPED' then '+' || goal else '-' end || chr(1) || '+' || claims_digest) as packet_sha256 from k""")
def mapping_packets(spark, sf):
    return M.audit_packets(proposals(spark, sf), line_claims(spark, sf), "v1", "producer").select("original_path", "claims", "claims_digest", "packet_sha256")


@query("mapping_packet_claims", f"with {_PROP} select original_path, claim_id, paper_id, fingerprint from pr join lc on field_path = original_path")
def mapping_packet_claims(spark, sf):
    claims = line_claims(spark, sf)
    packets = M.audit_packets(proposals(spark, sf), claims, "v1", "producer")
    return M.packet_claims(packets, claims).select("original_path", "claim_id", "paper_id", "fingerprint")


_REVIEWED = "select field_path as original_path, claim_id::varchar as claim_id from lc where paper_id % 11 <> 0 union all select field_path, 'gone-' || paper_id from lc where paper_id % 17 = 0 union all select 'unheard', claim_id::varchar from lc where paper_id % 50 = 0"


@query("mapping_packet_faults", f"""with {_PROP}, st as (select distinct original_path, claim_id::varchar as claim_id from pr join lc on field_path = original_path), rv as (select distinct * from ({_REVIEWED}))
select 'claim_not_reviewed' as rule, original_path || '/' || claim_id as key from (select * from st except select * from rv) union all
select case when original_path in (select original_path from pr) then 'claim_not_stored' else 'packet_missing' end, original_path || '/' || claim_id from (select * from rv except select * from st)""")
def mapping_packet_faults(spark, sf):
    """The pre-review lacks the claims of some papers, has some that are gone, and one path that no packet is for."""
    claims = line_claims(spark, sf).withColumn("claim_id", F.col("claim_id").cast("string"))
    part = lambda where, path, claim: claims.filter(where).selectExpr(f"{path} as original_path", f"{claim} as claim_id")
    reviewed = part("paper_id % 11 <> 0", "field_path", "claim_id").unionByName(part("paper_id % 17 = 0", "field_path", "concat('gone-', paper_id)")).unionByName(part("paper_id % 50 = 0", "'unheard'", "claim_id"))
    packets = M.audit_packets(proposals(spark, sf), claims, "v1", "producer")
    return M.packet_claim_faults(packets, claims, reviewed).select("rule", "key")


AUDITS = ("event_id", "ts as at", "cast(ts as date) as created_at", "'v' || (event_id % 3) as version_id", "'b' || ((event_id * 3) % 40) as original_path",
          "case event_type when 'click' then 'MAPPED' when 'view' then 'UNMAPPED' else 'AMBIGUOUS' end as decision", "case when event_type = 'click' then 't' || (event_id % 2) end as canonical_path",
          "case when event_id % 5 = 0 then 'REJECTED' else 'VALIDATED' end as review_status", "'MAPPED' as proposed_decision", "'t0' as proposed_path")
OWN = ("'v' || (o_orderkey % 4) as version_id", "'b' || (o_orderkey % 50) as original_path")
_CUR = "cur as (select max_by('v' || (o_custkey % 3), (o_orderdate, 'v' || (o_custkey % 3))) as version_id from orders)"


def current(spark, sf):
    o = table(spark, sf, "orders")
    versions = o.selectExpr("'v' || (o_custkey % 3) as version_id", "o_orderkey as import_run_id")
    return M.current_version(versions, o.selectExpr("o_orderkey as id", "o_orderdate as imported_at"))


_LAST = f"au as {sql('events', AUDITS)}, last as (select * from au qualify row_number() over (partition by version_id, original_path order by au.at desc, event_id desc) = 1)"


@query("mapping_effective", f"""with {_LAST}, {_CUR}, own as (select distinct {', '.join(OWN)} from orders)
select own.version_id, own.original_path, coalesce(review_status, 'PENDING') as effective_review_status, coalesce(decision, 'AMBIGUOUS') as effective_decision, coalesce(canonical_path, '') as effective_canonical_path,
 (last.event_id is not null and own.version_id = (select version_id from cur))::int as effective_current, (last.event_id is not null and (review_status = 'REJECTED' or decision <> 'MAPPED' or canonical_path is distinct from 't0'))::int as dissent
from own left join last using (version_id, original_path)""")
def mapping_effective(spark, sf):
    own = make(spark, sf, "orders", OWN).distinct().selectExpr("*", "'AMBIGUOUS' as decision", "cast(null as string) as canonical_path", "'PENDING' as review_status")
    e = M.effective_mappings(own, make(spark, sf, "events", AUDITS), current(spark, sf))
    return e.select("version_id", "original_path", "effective_review_status", "effective_decision", F.coalesce("effective_canonical_path", F.lit("")).alias("effective_canonical_path"), *as_int("effective_current", "dissent"))


@query("mapping_audit_history", f"""with {_LAST}, {_CUR} select au.event_id, case when au.version_id <> (select version_id from cur) then 'MAPPING_VERSION_SUPERSEDED' when last.event_id is null then 'SUPERSEDED_BY_LATER_MAPPING_AUDIT' else '' end as stale_reason from au left join last using (event_id)""")
def mapping_audit_history(spark, sf):
    a = M.audit_staleness(make(spark, sf, "events", AUDITS), current(spark, sf))
    return a.select("event_id", F.coalesce("stale_reason", F.lit("")).alias("stale_reason"))


REPORTS = ("event_id", "'b' || (event_id % 40) as original_path", "sha2('b' || case when event_id % 31 = 0 then 99 else event_id % 40 end, 256) as packet_sha256",
           "case event_type when 'click' then 'MAPPED' when 'view' then 'UNMAPPED' when 'error' then 'SPLIT' else 'AMBIGUOUS' end as decision", "case when event_id % 2 = 0 then 't' || (event_id % 3) end as canonical_path",
           "case when event_id % 37 = 0 then 'OPEN' when event_id % 5 = 0 then 'REJECTED' else 'validated' end as review_status", "case when event_id % 41 = 0 then ' producer ' when event_id % 43 = 0 then '' else 'u' || user_id end as auditor_id",
           "case when event_id % 7 = 0 then '2025-02-03' else '2025-02-03T10:00:00Z' end as audited_at", "'j' as justification", "'e' as evidence", "case when event_id % 47 = 0 then ' ' else 'p. 3' end as locator", "event_id % 53 = 0 as loose")


def _mrule(name, where):
    return rows(name, "MAPPING_AUDIT", "event_id", f"r where {where}")


@query("mapping_audit_rules", f"""with r as (select *, event_id % 31 <> 0 as known from {sql('events', [e.replace("sha2(", "sha256(").replace(", 256) as", ") as") for e in REPORTS])}), v as ({' union all '.join([
    _mrule('packet_unknown', 'not known'), _mrule('auditor_missing', "trim(auditor_id) = ''"), _mrule('auditor_is_producer', "known and trim(auditor_id) = 'producer'"), _mrule('decision_unknown', "decision = 'SPLIT'"),
    _mrule('review_status_unknown', "review_status = 'OPEN'"), _mrule('target_and_decision_disagree', "(decision = 'MAPPED') <> (canonical_path is not null)"), _mrule('target_outside_contract', "decision = 'MAPPED' and canonical_path = 't2'"),
    _mrule('validated_differs', "known and review_status = 'validated' and not (decision = 'MAPPED' and canonical_path is not distinct from 't0')"), _mrule('statement_missing', "trim(locator) = ''"),
    _mrule('time_invalid', "event_id % 7 = 0"), _mrule('sources_not_pinned', 'loose')])})
select rule, count(*) as n, min(key::bigint) as first_event from v group by rule""")
def mapping_audit_rules(spark, sf):
    r = make(spark, sf, "events", REPORTS).withColumn("sources", F.array(F.struct(F.lit("a.pdf").alias("name"), F.lit("v1").alias("edition"), F.when(F.col("loose"), F.lit("zz")).otherwise(F.sha2(F.lit("x"), 256)).alias("sha256"))))
    packets = table(spark, sf, "orders").selectExpr("'b' || (o_orderkey % 40) as original_path").distinct().selectExpr("original_path", "sha2(original_path, 256) as packet_sha256", "'producer' as producer_id", "'MAPPED' as proposed_decision", "'t0' as proposed_path")
    known = table(spark, sf, "region").filter("r_regionkey < 2").selectExpr("'t' || r_regionkey as field_path")
    return M.mapping_audit_rules(r, packets, known).groupBy("rule").agg(F.count("*").alias("n"), F.min(F.col("key").cast("bigint")).alias("first_event"))


@query("audit_report_rules", """with r as (select c_custkey as id from customer)
select 'report_kind' as rule, count(*) as n from r where id % 17 = 0 union all select 'doi_differs', count(*) from r where id % 13 = 0 union all select 'source_hash', count(*) from r where id % 11 = 0
union all select 'corroboration_not_pinned', count(*) from orders where o_orderkey % 3 = 0 and o_orderkey % 7 = 0 union all select 'claim_repeated', count(*) from orders where o_orderkey % 29 = 0
union all select 'claim_of_other_paper', count_if(o_orderkey % 23 = 0) + count_if(o_orderkey % 23 = 0 and o_orderkey % 29 = 0) from orders""")
def audit_report_rules(spark, sf):
    """Each customer's orders are the claims of one report."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    reports = c.selectExpr("c_custkey as report_id", "if(c_custkey % 17 = 0, 'DRAFT', 'INDEPENDENT_SCIENTIFIC_AUDIT') as report_kind", "c_custkey as paper_id", "if(c_custkey % 13 = 0, '10.1/other', concat('10.1/P', c_custkey)) as doi")
    sources = c.selectExpr("c_custkey as report_id", "'main' as name", "'PRIMARY_PAPER' as source_kind", "'aa' as sha256", "if(c_custkey % 11 = 0, 'bb', 'aa') as actual_sha256")
    items = o.selectExpr("o_custkey as report_id", "o_orderkey as claim_id", "if(o_orderkey % 3 = 0, 'PRIMARY_PAPER', '') as corroborating_kind", "if(o_orderkey % 7 = 0, 'zz', 'aa') as corroborating_sha256")
    items = items.unionByName(items.filter("claim_id % 29 = 0").withColumns({"corroborating_kind": F.lit("")}))
    claims = o.selectExpr("o_orderkey as claim_id", "if(o_orderkey % 23 = 0, -1, o_custkey) as paper_id")
    return T.audit_report_rules(reports, sources, items, c.selectExpr("c_custkey as paper_id", "concat('10.1/p', c_custkey) as doi"), claims).groupBy("rule").agg(F.count("*").alias("n"))
