"""Queries over audit ledgers. Claims come from documents, verdicts from events."""

from pyspark.sql import functions as F

from attestry.functions import vocabulary as V
from attestry.functions.text import json_text
from attestry.operators import ledger as L
from attestry.operators.keyed import newest, page
from attestry.operators.listing import listed
from attestry.plans.registry import as_int, query, table


def claims(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in V.CLAIM_KINDS])
    return d.select(
        F.concat(F.lit("c"), i.cast("string")).alias("claim_id"), F.col("source").alias("slug"),
        F.concat(F.lit("results["), i.cast("string"), F.lit("]")).alias("path"),
        F.get(kinds, (i % 8).cast("int")).alias("kind"), json_text(F.col("lang")).alias("value_json"),
        F.when(i % 11 != 0, F.col("text")).alias("quote"), (i % 30).alias("page_pdf"),
        F.concat(F.lit("v"), (i % 2).cast("string")).alias("fingerprint"),
    )


_CLAIMS = """claims as (select 'c' || doc_id as claim_id, doc_id, source as slug, 'results[' || doc_id || ']' as path,
  ['RESULT','TRAINING','TRAINING_EXTRA','CONFLICT','LIMITATION','METHOD','DATASET','EXCLUSION'][(doc_id % 8)::int + 1] as kind, doc_id % 8 as prio,
  to_json(lang)::varchar as value_json, case when doc_id % 11 <> 0 then text end as quote, doc_id % 30 as page_pdf,
  'v' || (doc_id % 2) as fingerprint from documents)"""


def requests(spark, sf):
    """One verdict request per event; the auditor is the user, the decision its type."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("ts").alias("decided_at"), F.concat(F.lit("c"), (F.col("event_id") % 700).cast("string")).alias("claim_id"),
        F.expr("case event_type when 'click' then 'ACCEPTED' when 'signup' then 'ACCEPTED' when 'view' then 'NEEDS_FIX' when 'purchase' then 'REJECTED' else 'MAYBE' end").alias("decision"),
        F.expr("case when value > 20 then ' wrong unit ' when value > 10 then '  ' end").alias("note"),
        F.expr("case when event_id % 41 = 0 then ' ' else concat('user', user_id) end").alias("auditor"),
        F.concat(F.lit("v"), (F.col("event_id") % 3 % 2).cast("string")).alias("audited"),
    )


_REQUESTS = """requests as (select event_id, ts as decided_at, 'c' || (event_id % 700) as claim_id,
  case event_type when 'click' then 'ACCEPTED' when 'signup' then 'ACCEPTED' when 'view' then 'NEEDS_FIX' when 'purchase' then 'REJECTED' else 'MAYBE' end as decision,
  case when value > 20 then ' wrong unit ' when value > 10 then '  ' end as note,
  case when event_id % 41 = 0 then ' ' else 'user' || user_id end as auditor, 'v' || (event_id % 3 % 2) as audited from events),
coded as (select *, case when decision = 'MAYBE' then 'INVALID_DECISION' when decision <> 'ACCEPTED' and coalesce(trim(note), '') = '' then 'REASON_REQUIRED'
  when trim(auditor) = '' then 'AUDITOR_REQUIRED' end as code from requests),
valid as (select * from coded where code is null),
latest as (select * from valid qualify row_number() over (partition by claim_id order by decided_at desc, event_id desc) = 1),
decorated as (select c.*, case when l.decision is null then 'UNAUDITED' when l.audited <> c.fingerprint then 'STALE' else l.decision end as audit_state
  from claims c left join latest l using (claim_id))"""


def decorated(spark, sf):
    r = requests(spark, sf)
    bad = L.verdict_problems(r).select("event_id")
    valid = r.join(bad, "event_id", "left_anti").withColumnRenamed("audited", "fingerprint")
    return L.attach_verdicts(claims(spark, sf), L.current_verdicts(valid))


@query("latest_decision", """
select user_id, event_id, event_type, round(value, 4) as value from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_decision(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return newest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query("supersession_chain", """
select event_id, user_id, event_type, coalesce(lag(event_type) over w, '') as supersedes_decision, coalesce(lag(event_id) over w, -1) as supersedes_event
from events window w as (partition by user_id order by ts, event_id)""")
def supersession_chain(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type"), F.col("event_type").alias("decision"),
                                          F.col("event_id").alias("auditor"), F.col("ts").alias("decided_at"))
    out = L.with_superseded(e, "user_id", ["decided_at", "event_id"], F.date_trunc("day", "decided_at"))
    return out.select("event_id", "user_id", "event_type", F.coalesce("supersedes_decision", F.lit("")).alias("supersedes_decision"),
                      F.coalesce("supersedes_auditor", F.lit(-1)).alias("supersedes_event"))


@query("verdict_problems", f"with {_CLAIMS}, {_REQUESTS} select event_id, claim_id, code from coded where code is not null")
def verdict_problems(spark, sf):
    return L.verdict_problems(requests(spark, sf)).select("event_id", "claim_id", "code")


@query("verdict_record", f"""with {_CLAIMS}, {_REQUESTS}
select v.event_id, c.claim_id, c.slug, c.path, v.decision, coalesce(nullif(trim(v.note), ''), '') as note, trim(v.auditor) as auditor,
  c.fingerprint, c.value_json as audited_value, coalesce(c.quote, '') as audited_quote,
  coalesce(lag(v.decision) over w, '') as supersedes_decision, coalesce(lag(trim(v.auditor)) over w, '') as supersedes_auditor
from valid v join claims c using (claim_id) window w as (partition by c.claim_id order by v.decided_at, v.event_id)""")
def verdict_record(spark, sf):
    r = L.record_verdicts(requests(spark, sf), claims(spark, sf), ["event_id"])
    out = L.with_superseded(r, "claim_id", ["decided_at", "event_id"], F.date_trunc("day", "decided_at"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("event_id", "claim_id", "slug", "path", "decision", blank("note"), "auditor", "fingerprint", "audited_value",
                      blank("audited_quote"), blank("supersedes_decision"), blank("supersedes_auditor"))


@query("stale_verdicts", """
with v1 as (select o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey) as fp, case when o_orderkey % 3 = 0 then 'ACCEPTED' else 'REJECTED' end as decision
  from orders where o_orderkey % 4 <> 0),
v2 as (select o_orderkey, sha256(case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end || '|' || o_orderpriority || '|' || o_custkey) as fp from orders)
select v2.o_orderkey as claim_id, case when v1.fp is null then 'UNAUDITED' when v1.fp <> v2.fp then 'STALE' else decision end as audit_state
from v2 left join v1 using (o_orderkey)""")
def stale_verdicts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("c"))
    print_of = lambda status: F.sha2(F.concat_ws("|", status, "o_orderpriority", "c"), 256).alias("fingerprint")
    was = o.filter("claim_id % 4 <> 0").select("claim_id", print_of("o_orderstatus"), F.expr("if(claim_id % 3 = 0, 'ACCEPTED', 'REJECTED')").alias("decision"))
    now = o.select("claim_id", print_of(F.expr("if(claim_id % 7 = 0, 'X', o_orderstatus)")))
    return L.attach_verdicts(now, was).select("claim_id", "audit_state")


@query("review_queue", f"""with {_CLAIMS}, {_REQUESTS}, p as (select * from decorated where audit_state in ('UNAUDITED', 'STALE'))
select claim_id, slug, kind, audit_state, (select count(*) from p) as total from p
order by coalesce(length(quote) > 0, false), prio, slug, path, claim_id limit 200""")
def review_queue(spark, sf):
    return L.review_queue(decorated(spark, sf), limit=200).select("claim_id", "slug", "kind", "audit_state", "total")


_COUNT = "count(*) as claims, count_if(audit_state in ('ACCEPTED','NEEDS_FIX','REJECTED')) as audited, count_if(audit_state = 'ACCEPTED') as accepted"


@query("audit_progress", f"""with {_CLAIMS}, {_REQUESTS} select {_COUNT}, count_if(audit_state = 'NEEDS_FIX') as needs_fix,
count_if(audit_state = 'REJECTED') as rejected, count_if(audit_state = 'STALE') as stale, count_if(audit_state = 'UNAUDITED') as unaudited from decorated""")
def audit_progress(spark, sf):
    return L.audit_progress(decorated(spark, sf))


@query("audit_auditors", f"with {_CLAIMS}, {_REQUESTS} select auditor, count(*) as claims from latest group by auditor")
def audit_auditors(spark, sf):
    r = requests(spark, sf)
    return L.auditors(L.current_verdicts(r.join(L.verdict_problems(r).select("event_id"), "event_id", "left_anti")))


@query("audit_progress_by_paper", f"with {_CLAIMS}, {_REQUESTS} select slug, {_COUNT} from decorated group by slug")
def audit_progress_by_paper(spark, sf):
    return L.audit_progress_by(decorated(spark, sf))


# re-checks: labels are the verdicts, handed out on an older snapshot whose paths have since moved by one
def recheck_reports(spark, sf):
    """Reports cover labelled documents; every 13th path is unknown, every 9th verdict is no verdict."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return d.select(
        F.col("source").alias("slug"), F.expr("concat('results[', if(doc_id % 13 = 0, doc_id + 1000000000, doc_id), ']')").alias("path"),
        F.expr("case when doc_id % 9 = 0 then 'SURE' when quality = 1 and toxic = 0 then 'CONFIRMED' when quality = 0 then 'SUSPECT' else 'UNREADABLE' end").alias("verdict"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("correct_reading"),
        F.lit("2025-01-01").alias("checked_at"), F.lit("model").alias("checker"))


_REPORTS = """reports as (select d.source as slug, 'results[' || case when doc_id % 13 = 0 then doc_id + 1000000000 else doc_id end || ']' as path, doc_id,
  case when doc_id % 9 = 0 then 'SURE' when quality = 1 and toxic = 0 then 'CONFIRMED' when quality = 0 then 'SUSPECT' else 'UNREADABLE' end as verdict
  from labels join documents d using (doc_id))"""


def doc_claims(spark, sf):
    """Claims whose id is slug::path, as the re-check reports know them."""
    return claims(spark, sf).withColumn("claim_id", F.concat_ws("::", "slug", "path"))


@query("recheck_completeness", f"""with {_CLAIMS}, {_REPORTS},
o as (select slug, path from claims where slug in (select slug from reports)), t as (select distinct slug, path from reports),
b as (select coalesce(o.slug, t.slug) as slug, o.path as op, t.path as tp from o full join t on o.slug = t.slug and o.path = t.path)
select slug, count_if(tp is null) as missing, count_if(op is null) as unknown, coalesce(min(case when tp is null then op end), '') as first_missing,
  coalesce(min(case when op is null then tp end), '') as first_unknown from b group by slug""")
def recheck_completeness(spark, sf):
    r = L.report_completeness(claims(spark, sf), recheck_reports(spark, sf))
    return r.select("slug", "missing", "unknown", *[F.coalesce(c, F.lit("")).alias(c) for c in ("first_missing", "first_unknown")])


def snapshot(spark, sf):
    """What the checkers were handed: some quotes differ from today's, some paths held another claim's content."""
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.col("source"), F.lit("::results["), F.expr("if(doc_id % 2 = 0, doc_id, doc_id + 500000)"), F.lit("]")).alias("claim_id"),
        F.col("source").alias("slug"), json_text(F.col("lang")).alias("value_json"),
        F.expr("case when doc_id % 5 = 0 then 'gone' when doc_id % 11 <> 0 then text end").alias("quote"))


_SNAPSHOT = """snap as (select source || '::results[' || case when doc_id % 2 = 0 then doc_id else doc_id + 500000 end || ']' as claim_id, source as slug,
  to_json(lang)::varchar as value_json, case when doc_id % 5 = 0 then 'gone' when doc_id % 11 <> 0 then text end as quote from documents),
cl as (select slug || '::' || path as id, slug, value_json, quote, fingerprint, path from claims),
byc as (select slug, value_json, quote, count(*) as n, min(id) as only_id from cl group by all),
placed as (select s.claim_id, coalesce(b.n, 0) as candidates,
  case when t.id is not null and t.value_json = s.value_json and t.quote is not distinct from s.quote then s.claim_id when b.n = 1 then b.only_id end as now_id
  from snap s left join cl t on t.id = s.claim_id
  left join byc b on b.slug = s.slug and b.value_json = s.value_json and b.quote is not distinct from s.quote)"""


@query("recheck_reattach", f"with {_CLAIMS}, {_SNAPSHOT} select claim_id, candidates, coalesce(now_id, '') as now_id from placed")
def recheck_reattach(spark, sf):
    r = L.reattach(snapshot(spark, sf), doc_claims(spark, sf))
    return r.select("claim_id", "candidates", F.coalesce("now_id", F.lit("")).alias("now_id"))


def stored_entries(spark, sf):
    """The ledger so far: every 4th claim, and every 17th of a claim that is gone."""
    d = table(spark, sf, "documents").filter("doc_id % 4 = 0")
    return d.select(
        F.expr("concat(source, '::results[', if(doc_id % 17 = 0, -doc_id - 1, doc_id), ']')").alias("claim_id"), F.col("source").alias("slug"),
        F.concat(F.lit("results["), F.col("doc_id"), F.lit("]")).alias("path"), F.lit("CONFIRMED").alias("verdict"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("correct_reading"), F.lit("2024-01-01").alias("checked_at"),
        F.lit("old").alias("checker"), F.lit("v0").alias("fingerprint"))


_INGEST = f"""with {_CLAIMS}, {_REPORTS}, {_SNAPSHOT},
stored as (select source || '::results[' || case when doc_id % 17 = 0 then -doc_id - 1 else doc_id end || ']' as claim_id, 'CONFIRMED' as verdict, 'old' as checker, 'v0' as fingerprint
  from documents where doc_id % 4 = 0),
pl as (select r.slug || '::' || r.path as old_id, r.verdict, r.path, case when p.claim_id is null then r.slug || '::' || r.path else p.now_id end as now_id
  from reports r left join placed p on p.claim_id = r.slug || '::' || r.path),
fresh as (select cl.id as claim_id, pl.verdict, 'model' as checker, cl.fingerprint from pl join cl on cl.id = pl.now_id where verdict in ('CONFIRMED','SUSPECT','UNREADABLE')
  qualify row_number() over (partition by cl.id order by pl.path desc) = 1),
entries as (select * from fresh union all select s.* from stored s where s.claim_id in (select id from cl) and s.claim_id not in (select claim_id from fresh))
"""


def ingest(spark, sf):
    snap = snapshot(spark, sf).withColumn("path", F.substring_index("claim_id", "::", -1)).drop("claim_id")
    return L.ingest_rechecks(recheck_reports(spark, sf), snap, doc_claims(spark, sf), stored_entries(spark, sf))


@query("recheck_ingest", _INGEST + "select claim_id, verdict, checker, fingerprint from entries")
def recheck_ingest(spark, sf):
    return ingest(spark, sf)[0].select("claim_id", "verdict", "checker", "fingerprint")


@query("recheck_ingest_problems", _INGEST + """
, o as (select slug, path from claims where slug in (select slug from reports)), t as (select distinct slug, path from reports)
select 'checked claim is gone or ambiguous' as problem, count(*) as n from pl where now_id is null
union all select 'unknown verdict', count(*) from pl join cl on cl.id = pl.now_id where verdict = 'SURE'
union all select 'claim no longer exists', count(*) from stored where claim_id not in (select id from cl)
union all select 'claims not re-checked', count(distinct slug) from (select * from o except select * from t)
union all select 'unknown paths', count(distinct slug) from (select * from t except select * from o)""")
def recheck_ingest_problems(spark, sf):
    return ingest(spark, sf)[1].groupBy("problem").agg(F.count("*").alias("n"))


@query("recheck_progress", _INGEST + """
, d as (select case when e.verdict is null then 'NOT_RECHECKED' when e.fingerprint <> cl.fingerprint then 'STALE'
   when e.verdict = 'SUSPECT' and c.doc_id % 6 = 0 then 'SUSPECT_APPLIED' when e.verdict = 'SUSPECT' and c.doc_id % 6 = 1 then 'SUSPECT_KEPT' else e.verdict end as s
  from cl join claims c on c.slug || '::' || c.path = cl.id left join entries e on e.claim_id = cl.id)
select count(*) as claims, count_if(s not in ('NOT_RECHECKED','STALE')) as rechecked, count_if(s = 'CONFIRMED') as confirmed, count_if(s like 'SUSPECT%') as flagged,
  count_if(s = 'SUSPECT_APPLIED') as corrected, count_if(s = 'SUSPECT_KEPT') as flag_dismissed, count_if(s = 'SUSPECT') as outstanding,
  count_if(s = 'UNREADABLE') as unreadable, count_if(s = 'STALE') as stale, count_if(s = 'NOT_RECHECKED') as not_rechecked from d""")
def recheck_progress(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id % 6 < 2")
    triage = d.select(F.concat(F.col("source"), F.lit("::results["), "doc_id", F.lit("]")).alias("claim_id"),
                      F.expr("if(doc_id % 6 = 0, 'APPLIED', 'KEPT')").alias("decision"))
    return L.recheck_progress(L.attach_rechecks(doc_claims(spark, sf), ingest(spark, sf)[0], triage))


@query("event_replay_idempotent", """
select event_id, user_id, event_type from events where event_id % 3 <> 0""")
def event_replay_idempotent(spark, sf):
    """A third of the events is stored already; the batch repeats itself twice."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return L.append_once(e.unionByName(e), e.filter("event_id % 3 = 0"))


@query("content_event_ids", """
with e as (select sha256('+' || user_id || chr(1) || '+' || event_type || chr(1) || coalesce('+' || case when value > 10 then event_type end, '-')) as id from events)
select id as content_id, count(*) as n from e group by 1""")
def content_event_ids(spark, sf):
    e = table(spark, sf, "events").withColumn("maybe", F.expr("case when value > 10 then event_type end"))
    return e.groupBy(L.content_event_id(e, ["user_id", "event_type", "maybe"]).alias("content_id")).agg(F.count("*").alias("n"))


@query("event_listing", """
select event_id, user_id, event_type, (select count(*) from events where event_type = 'purchase') as total from events where event_type = 'purchase' order by ts, event_id limit 100 offset 50""")
def event_listing(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'purchase'")
    return page(e, [F.col("ts"), F.col("event_id")], limit=100, offset=50).select("event_id", "user_id", "event_type", "total")


@query("event_pages", "select event_id, (row_number() over (order by ts desc, event_id) - 1) // 50 as page from events")
def event_pages(spark, sf):
    """The page of every event of the whole log, newest first."""
    e = listed(table(spark, sf, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")])
    return e.positions().select("event_id", F.floor(F.col("position") / 50).cast("long").alias("page"))


@query("event_deep_pages", """with e as (select event_id, user_id, row_number() over (order by ts desc, event_id) - 1 as position, count(*) over () as total from events)
select * from e where position >= 2 * total // 3 and position < 2 * total // 3 + 100 or position >= total - 30""")
def event_deep_pages(spark, sf):
    """One hundred events from two thirds down, and what is left of a page at the end."""
    e = listed(table(spark, sf, "events").select("event_id", "user_id", "ts"), [F.desc("ts"), F.col("event_id")])
    return e.page(100, 2 * e.total // 3).unionByName(e.page(100, e.total - 30)).drop("ts")


@query("event_history", f"""with {_CLAIMS}, {_REQUESTS}
select v.event_id, v.claim_id, (row_number() over (partition by v.claim_id order by decided_at desc, event_id desc) = 1)::int as is_latest,
  coalesce(v.audited = c.fingerprint, false)::int as current from valid v left join claims c using (claim_id)""")
def event_history(spark, sf):
    r = requests(spark, sf)
    valid = r.join(L.verdict_problems(r).select("event_id"), "event_id", "left_anti").withColumnRenamed("audited", "target_fingerprint")
    out = L.event_history(valid, claims(spark, sf), "claim_id", ["decided_at", "event_id"])
    return out.select("event_id", "claim_id", *as_int("is_latest", "current"))
