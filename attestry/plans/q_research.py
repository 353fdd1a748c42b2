"""Queries over canonical field states: projection, entities, landing and the extraction benchmark."""

from pyspark.sql import functions as F

from attestry.functions import evidence as E
from attestry.functions import vocabulary as V
from attestry.operators import landing as D
from attestry.operators import research as R
from attestry.operators import scoring as B
from attestry.operators.keyed import page
from attestry.plans.q_staging import make, rows, sql
from attestry.plans.registry import as_int, query, spread_table, table

# Field states per order, as (path, position, value_json, status, provenance, evidence given, page).
_FIELDS = (
    ("scientific_framing.domain", 0, "'[\"' || o_orderpriority || '\"]'", "'NOT_VERIFIED'", "'AUTHOR_REPORTED_FACT'", "true"),
    ("data.datasets", 1, "case when o_orderkey % 3 = 0 then '[\"D' || (o_custkey % 9) || '\",\"D0\"]' else '[\"D' || (o_custkey % 9) || '\"]' end", "'VERIFIED'", "'AUTHOR_REPORTED_FACT'", "o_orderkey % 4 <> 0"),
    ("architecture.family", 2, "case when o_orderkey % 5 = 0 then null else '[\" U  Net ' || (o_custkey % 4) || '\"]' end", "case when o_orderkey % 5 = 0 then 'NOT_REPORTED' else 'NOT_VERIFIED' end", "case when o_orderkey % 7 = 0 then 'AI_INTERPRETATION' else 'AUTHOR_REPORTED_FACT' end", "o_orderkey % 5 <> 0"),
    ("training.optimizer", 3, "case when o_orderkey % 6 = 0 then null else '\"opt' || (o_orderkey % 3) || '\"' end", "case when o_orderkey % 6 = 0 then 'CONFLICT' else 'PARTIALLY_VERIFIED' end", "'AUTHOR_REPORTED_FACT'", "true"),
    ("training.learning_rate", 4, "'\"' || (o_orderkey % 10) || '\"'", "'NOT_VERIFIED'", "'AUTHOR_REPORTED_FACT'", "o_orderkey % 8 <> 1"),
    ("training.batch_size", 5, "case when o_orderkey % 9 = 0 then '3.5' else cast(o_orderkey % 64 as varchar(10)) end", "case when o_orderkey % 11 = 0 then 'EXTRACTION_ERROR' else 'NOT_VERIFIED' end", "'AUTHOR_REPORTED_FACT'", "true"),
    ("results.headline", 6, "'[\"r1\",\"r2\"]'", "'NOT_VERIFIED'", "'AUTHOR_REPORTED_FACT'", "o_orderkey % 2 = 0"),
    ("limitations.data", 7, "case when o_orderkey % 4 = 1 then '[\"few data\"]' end", "case when o_orderkey % 4 = 1 then 'NOT_VERIFIED' else 'NOT_REPORTED' end", "'AUTHOR_REPORTED_LIMITATION'", "o_orderkey % 4 = 1"),
    ("limitations.future_work", 8, "'[\"more\"]'", "'NOT_VERIFIED'", "case when o_orderkey % 13 = 0 then 'TEAM_NOTE' else 'AUTHOR_REPORTED_LIMITATION' end", "true"),
)
_CONFLICT = "o_orderkey % 6 = 0"
_O = "o as (select *, row_number() over () as rn from orders)"
_ST = "s as (" + " union all ".join(
    f"select o_orderkey as paper_id, o_orderkey % 2 as edition_id, '{p}' as field_path, {i} as pos, {v} as value_json, {st} as status, {pr} as provenance_type, {ev} as ev, o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders" for p, i, v, st, pr, ev in _FIELDS) + ")"


def states(spark, sf):
    """Nine fields per order; optimizers of every sixth disagree between two sources."""
    cells = ", ".join(f"struct({i} as pos, '{p}' as field_path, {v} as value_json, {st} as status, {pr} as provenance_type, {ev} as ev)" for p, i, v, st, pr, ev in _FIELDS)
    o = spread_table(spark, sf, "orders").selectExpr("*", f"explode(array({cells})) as c").selectExpr("*", "c.*")
    conflict = F.expr(f"field_path = 'training.optimizer' and {_CONFLICT}")
    source = lambda claimed, page: F.struct(F.lit("Methods").alias("section"), F.lit(page).alias("page"), F.lit(None).cast("string").alias("locator"), F.lit("seen").alias("evidence"),
                                            F.lit("PRIMARY_PAPER").alias("origin"), F.expr("if(pos = 1 and o_orderkey % 10 = 0, 'late', cast(null as string))").alias("edition_key"), claimed.cast("string").alias("claimed_json"))
    plain = F.array(source(F.lit(None), 2))
    two = F.array(source(F.lit('"adam"'), 2), source(F.lit('"sgd"'), 3))
    return o.select(
        F.col("o_orderkey").alias("paper_id"), (F.col("o_orderkey") % 2).alias("edition_id"), "pos", "field_path", "value_json",
        F.when(conflict, F.array(F.lit('"adam"'), F.lit('"sgd"'))).otherwise(F.array().cast("array<string>")).alias("conflict_values"), "status", "provenance_type",
        F.lit(0.8).alias("confidence"), F.when(conflict, two).when(F.col("ev"), plain).otherwise(F.array().cast(f"array<{E.SOURCE}>")).alias("sources"))


def papers(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.year("o_orderdate").alias("year"),
        F.expr("case o_orderstatus when 'F' then 'EXTRACTED' when 'O' then 'INGESTED' else 'PARTIAL' end").alias("workflow_status"))


_MEN = f"""{_ST}, raw as (select *, '"adam"' as claimed, 0 as alt from s where status = 'CONFLICT' union all select *, '"sgd"', 1 from s where status = 'CONFLICT' union all select *, value_json, null from s where status <> 'CONFLICT' and value_json is not null),
m as (select paper_id, edition_id, field_path, status, alt, claimed, ev, unnest(case when claimed like '[%' then json_extract_string(claimed, '$[*]') else [json_extract_string(claimed, '$')] end) as item from raw
 where field_path in ('scientific_framing.domain', 'data.datasets', 'architecture.family', 'training.optimizer') and status <> 'EXTRACTION_ERROR' and provenance_type like 'AUTHOR%'),
men as (select *, trim(item) as wording, regexp_replace(trim(item), '\\s+', ' ', 'g') as normalized_key, case field_path when 'scientific_framing.domain' then 'DOMAIN' when 'data.datasets' then 'DATASET' when 'architecture.family' then 'ARCHITECTURE' else 'OPTIMIZER' end as entity_type,
  case when status = 'CONFLICT' or ev then 1 else 0 end as n_evidence from m)"""


def mentions(spark, sf):
    return R.mentions(states(spark, sf))


@query("entity_mentions", f"with {_MEN} select paper_id, field_path, entity_type, normalized_key, wording, coalesce(alt, -1) as alternative_index, claimed, n_evidence from men")
def entity_mentions(spark, sf):
    return mentions(spark, sf).select("paper_id", "field_path", "entity_type", "normalized_key", "wording", F.coalesce("alternative_index", F.lit(-1)).alias("alternative_index"), "claimed", F.size("evidence").alias("n_evidence"))


@query("entity_upsert", f"with {_MEN} select entity_type, normalized_key, arg_min(wording, (paper_id, field_path, wording)) as canonical_name, sha256('+' || entity_type || chr(1) || '+' || normalized_key) as entity_id from men group by 1, 2")
def entity_upsert(spark, sf):
    fresh = R.entities(mentions(spark, sf))
    return R.merge_entities(fresh.filter("entity_type = 'DATASET'"), fresh)


@query("entity_list", f"""with {_MEN}, e as (select entity_type, normalized_key, arg_min(wording, (paper_id, field_path, wording)) as canonical_name, count(distinct paper_id) as paper_count, count(*) as mention_count from men group by 1, 2)
select *, (select count(*) from e where contains(lower(canonical_name), 'u') or contains(lower(normalized_key), 'u')) as total from e where contains(lower(canonical_name), 'u') or contains(lower(normalized_key), 'u') order by lower(canonical_name), entity_type, normalized_key limit 20""")
def entity_list(spark, sf):
    m = mentions(spark, sf)
    return page(R.entity_list(R.entities(m), m, text="U"), [F.lower("canonical_name"), F.col("entity_type"), F.col("normalized_key")], 20).drop("entity_id")


@query("entity_evidence", f"""with {_MEN} select entity_type, normalized_key, paper_id, coalesce(alt, -1) as alternative_index, case when n_evidence = 0 then -1 when alt = 1 then 3 else 2 end as page from men""")
def entity_evidence(spark, sf):
    m = mentions(spark, sf)
    rows = R.entity_mentions(R.entities(m), m)
    return rows.select("entity_type", "normalized_key", "paper_id", F.coalesce("alternative_index", F.lit(-1)).alias("alternative_index"), F.coalesce("page", F.lit(-1)).alias("page"))


@query("evidence_editions", f"""with {_ST}, e as (select paper_id, edition_id, field_path, pos, o_orderkey, 0 as evidence_order from s where status = 'CONFLICT' or ev union all select paper_id, edition_id, field_path, pos, o_orderkey, 1 from s where status = 'CONFLICT'),
n as (select *, pos = 1 and o_orderkey % 10 = 0 as named from e)
select paper_id, field_path, evidence_order, case when not named then edition_id::varchar when o_orderkey % 20 = 0 then 'E' || o_orderkey else '' end as source_edition_id, (not named or o_orderkey % 20 = 0)::int as bound from n""")
def evidence_editions(spark, sf):
    editions = table(spark, sf, "orders").filter("o_orderkey % 20 = 0").selectExpr("o_orderkey as paper_id", "'late' as edition_key", "concat('E', o_orderkey) as id")
    out = R.evidence_rows(states(spark, sf).withColumn("edition_id", F.col("edition_id").cast("string")), editions)
    return out.select("paper_id", "field_path", "evidence_order", F.coalesce("source_edition_id", F.lit("")).alias("source_edition_id"), *as_int("bound"))


@query("research_view", f"""with {_MEN}, p as (
 select paper_id, 'mentions' as part, count(*) as n from men group by 1 union all select paper_id, 'field_states', count(*) from s group by 1 union all select paper_id, 'hyperparameters', count(*) from s where field_path like 'training.%' group by 1
 union all select paper_id, 'results', 2 from s where pos = 6 union all select paper_id, 'statements', count(*) from s where field_path like 'limitations.%' group by 1 union all select l_orderkey, 'relationships', count(*) from lineitem group by 1
 union all select o_orderkey, 'editions', 1 from orders) select * from p""")
def research_view(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"))
    return R.research_view(states(spark, sf), mentions(spark, sf), o, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id")))


_ROWS = f"""{_MEN}, rows as (select paper_id, 'mentions' as part, field_path || '/' || entity_type as item, '' as status from men union all select paper_id, 'field_states', field_path, status from s
 union all select paper_id, 'hyperparameters', split_part(field_path, '.', -1), status from s where field_path like 'training.%' union all select paper_id, 'results', field_path || '#' || i, status from s, (select unnest([0, 1]) as i) where pos = 6
 union all select paper_id, 'statements', field_path || '#0', status from s where field_path like 'limitations.%' union all select l_orderkey, 'relationships', l_orderkey || '-' || l_linenumber, l_linestatus from lineitem
 union all select o_orderkey, 'editions', 'E' || o_orderkey, '' from orders)"""


def known_rows(spark, sf):
    editions = table(spark, sf, "orders").selectExpr("o_orderkey as paper_id", "'E' || o_orderkey as edition_id")
    relations = table(spark, sf, "lineitem").selectExpr("l_orderkey as paper_id", "l_orderkey || '-' || l_linenumber as edge_id", "l_linestatus as status")
    return R.research_rows(states(spark, sf), mentions(spark, sf), editions, relations)


@query("research_rows", f"with {_ROWS} select paper_id, part, item, status from rows")
def research_rows(spark, sf):
    return known_rows(spark, sf).select("paper_id", "part", "item", F.coalesce("status", F.lit("")).alias("status"))


@query("entity_gather", f"""with {_ROWS}, pp as (select distinct entity_type, normalized_key, paper_id from men)
select entity_type, normalized_key, part, count(*) as n, count(distinct paper_id) as papers, min(item) as first_item from pp join rows using (paper_id) group by all""")
def entity_gather(spark, sf):
    # counted per paper first, so an entity meets one row for each part of a paper
    per_paper = known_rows(spark, sf).groupBy("paper_id", "part").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))
    rows = R.evidence_gather(mentions(spark, sf), per_paper)
    return rows.groupBy("entity_type", "normalized_key", "part").agg(F.sum("n").alias("n"), F.count("*").alias("papers"), F.min("first_item").alias("first_item"))


_SILENT = ", ".join(f"'{p}'" for p in V.FIELD_TYPES if p not in [f[0] for f in _FIELDS])


@query("evidence_walk_long", f"""with {_ST} select field_path, status, count(*) as n, count(value_json) as n_values, count(distinct value_json) as distinct_values from s group by 1, 2
union all select unnest([{_SILENT}]), 'NOT_REPORTED', (select count(*) from orders), 0, 0""")
def evidence_walk_long(spark, sf):
    """Rebuilds nested records from columns and walks them back to long form."""
    v = {f"c{i}": f"named_struct('value', {val}, 'status', {st}, 'provenance_type', {pr})" for _, i, val, st, pr, _e in _FIELDS}
    doc = f"""to_json(named_struct('scientific_framing', named_struct('domain', {v['c0']}), 'data', named_struct('datasets', {v['c1']}), 'architecture', named_struct('family', {v['c2']}),
      'training', named_struct('optimizer', {v['c3']}, 'learning_rate', {v['c4']}, 'batch_size', {v['c5']}), 'results', named_struct('headline', {v['c6']}), 'limitations', named_struct('data', {v['c7']}, 'future_work', {v['c8']})))"""
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit(0).alias("edition_id"), F.parse_json(F.expr(doc)).alias("v"))
    return R.field_states(r).groupBy("field_path", "status").agg(F.count("*").alias("n"), F.count("value_json").alias("n_values"), F.countDistinct("value_json").alias("distinct_values"))


def _frule(name, where):
    return rows(name, "FIELD", "paper_id || '/' || field_path", f"s where {where}")


@query("field_rules", f"""with {_ST}, v as ({' union all '.join([
    _frule('value_type', "pos = 5 and o_orderkey % 9 = 0"), _frule('verified_evidence', "status = 'VERIFIED' and not ev"), _frule('limitation_provenance', "provenance_type = 'TEAM_NOTE'")])})
select rule, count(*) as n, min(key) as first_key from v group by 1""")
def field_rules(spark, sf):
    return R.field_rules(states(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query("projection_refresh", """select o_orderkey as paper_id, o_orderkey % 2 as edition_id, case when o_custkey % 10 = 0 and o_orderkey % 2 = 0 then 'new' else 'old' end as value from orders where not (o_custkey % 10 = 0 and o_orderkey % 2 = 0 and o_orderkey % 3 = 0)""")
def projection_refresh(spark, sf):
    o = table(spark, sf, "orders")
    stored = o.selectExpr("o_orderkey as paper_id", "o_orderkey % 2 as edition_id", "'old' as value")
    scope = o.filter("o_custkey % 10 = 0 and o_orderkey % 2 = 0").selectExpr("o_orderkey as paper_id", "o_orderkey % 2 as edition_id")
    fresh = scope.filter("paper_id % 3 <> 0").selectExpr("*", "'new' as value")
    return R.refresh_projection(stored, fresh, scope)


EDGES = ("l_orderkey * 10 + l_linenumber as edge_id", "l_orderkey as paper_id", "'p' || l_partkey as subject_id", "'s' || (l_suppkey + case when l_linenumber = 6 then 1000000 else 0 end) as object_id",
         "case when l_linenumber = 5 then 'k' || (l_orderkey % 4) end as edition_key", "'uses' as predicate", "l_returnflag as source_wording", "'NOT_VERIFIED' as status")
_EDGE = f"""e as {sql('lineitem', EDGES)}, x as (select *, case when object_id not in (select 's' || s_suppkey from supplier) then 'ENTITY_UNKNOWN' when edition_key is not null and not (edition_key = 'k1' and paper_id in (select o_orderkey from orders)) then 'EDITION_UNKNOWN' end as code from e)"""


def edges(spark, sf):
    part, sup = table(spark, sf, "part"), table(spark, sf, "supplier")
    ids = part.selectExpr("'p' || p_partkey as entity_id").unionByName(sup.selectExpr("'s' || s_suppkey as entity_id"))
    editions = table(spark, sf, "orders").selectExpr("o_orderkey as paper_id", "'k1' as edition_key")
    return R.add_relationships(make(spark, sf, "lineitem", EDGES), ids, editions, ids.selectExpr("entity_id as relationship_id").filter("false"))


@query("relationships_added", f"with {_EDGE} select distinct paper_id, subject_id, object_id, source_wording, coalesce(edition_key, '') as edition_key from x where code is null")
def relationships_added(spark, sf):
    return edges(spark, sf)[0].select("paper_id", "subject_id", "object_id", "source_wording", F.coalesce("edition_key", F.lit("")).alias("edition_key"))


@query("relationships_refused", f"with {_EDGE} select code, count(*) as n from x where code is not null group by 1")
def relationships_refused(spark, sf):
    return edges(spark, sf)[1].groupBy("code").agg(F.count("*").alias("n"))


@query("relationship_rules", """with e as (select l_orderkey * 10 + l_linenumber as id, l_returnflag as f, l_linenumber as n, l_tax, l_discount from lineitem)
select 'not_a_claim' as rule, count(*) as n from e where f = 'N' union all select 'evidence_not_located', count(*) from e where l_tax < 0.01 union all select 'evidence_binds_alternative', count(*) from e where n = 4
union all select 'verified_without_primary', count(*) from e where f = 'A' and l_discount > 0.05 union all select 'verified_provenance', count(*) from e where f = 'A' and n = 7""")
def relationship_rules(spark, sf):
    e = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as edge_id", "case l_returnflag when 'N' then 'NOT_REPORTED' when 'A' then 'VERIFIED' else 'NOT_VERIFIED' end as status",
        "if(l_linenumber = 7, 'TEAM_NOTE', 'AUTHOR_REPORTED_FACT') as provenance_type",
        "array(named_struct('section', if(l_tax < 0.01, cast(null as string), 'Methods'), 'page', cast(null as int), 'locator', cast(null as string), 'evidence', 'text', 'origin', if(l_discount > 0.05, 'OTHER', 'PRIMARY_PAPER'), 'edition_key', cast(null as string), 'claimed_json', if(l_linenumber = 4, '1', cast(null as string)))) as evidence")
    return R.relationship_rules(e).groupBy("rule").agg(F.count("*").alias("n"))


@query("compare_pair", f"""with {_ST}, c as (select * from s where field_path not like 'scientific%'), p as (select o_orderkey as l, o_orderkey + 1 as r from orders), a as (select p.l, p.r, c.* from p join c on c.paper_id = p.l), b as (select p.l, p.r, c.* from p join c on c.paper_id = p.r)
select coalesce(a.l, b.l) as left_id, coalesce(a.r, b.r) as right_id, coalesce(a.field_path, b.field_path) as field_path, coalesce(a.value_json, '') as left_value, coalesce(b.value_json, '') as right_value, coalesce(a.status, '') as left_status, coalesce(b.status, '') as right_status
from a full join b on a.l = b.l and a.r = b.r and a.field_path = b.field_path""")
def compare_pair(spark, sf):
    pairs = table(spark, sf, "orders").selectExpr("o_orderkey as left_id", "o_orderkey + 1 as right_id")
    c = R.compare_pairs(states(spark, sf), pairs)
    text = lambda a, b: F.coalesce(f"{a}_cell.{b}", F.lit("")).alias(f"{a}_{'value' if b == 'value_json' else b}")
    return c.select("left_id", "right_id", "field_path", text("left", "value_json"), text("right", "value_json"), text("left", "status"), text("right", "status"))


# --- intake -----------------------------------------------------------------------------

@query("edition_registration", """with s as (select c_custkey as p, 'k' || c_custkey % 3 as k, 'h' || c_custkey as h, 'i' || c_custkey % 5 as i from customer), n as (select c_custkey as p, 'k' || c_custkey % 4 as k, case when c_custkey % 4 <> 3 then 'h' || c_custkey when c_custkey % 8 = 3 then 'h' || (c_custkey + 1) end as h, 'i' || c_custkey % 7 as i from customer)
select n.p as paper_id, case when s.i = n.i then 'IDENTICAL' when s.i is not null then 'KEY_TAKEN' when exists (select 1 from s o where o.h = n.h and o.p <> n.p) then 'HASH_TAKEN' else 'REGISTERED' end as outcome from n left join s on s.p = n.p and s.k = n.k""")
def edition_registration(spark, sf):
    c = table(spark, sf, "customer")
    stored = c.selectExpr("c_custkey as paper_id", "'k' || c_custkey % 3 as edition_key", "'h' || c_custkey as content_hash", "'i' || c_custkey % 5 as identity")
    incoming = c.selectExpr("c_custkey as paper_id", "'k' || c_custkey % 4 as edition_key", "case when c_custkey % 4 <> 3 then 'h' || c_custkey when c_custkey % 8 = 3 then 'h' || (c_custkey + 1) end as content_hash", "'i' || c_custkey % 7 as identity")
    return R.register_editions(incoming, stored).select("paper_id", "outcome")


@query("paper_create_or_get", """with s as (select c_custkey as p, 'doi:10.1/' || c_custkey as k, 'f' || c_custkey % 3 as f from customer), i as (select 'a' || c_custkey as v, c_custkey as p from customer),
r as (select o_orderkey as id, 'doi:10.1/' || case when o_orderkey % 5 = 0 then o_custkey + 10000000 else o_custkey end as k, 'f' || o_orderkey % 3 as f, case when o_orderkey % 7 = 0 then 'a' || o_custkey end as v1, case when o_orderkey % 14 = 0 then 'a' || (o_custkey + 1) end as v2 from orders),
n as (select id, min(i.p) as lo, max(i.p) as hi from (select id, unnest([v1, v2]) as v from r) x join i using (v) group by 1)
select r.id as request_id, case when lo <> hi then -1 else coalesce(lo, s.p, -1) end as paper_id, case when lo <> hi then 'IDENTIFIERS_DISAGREE' when coalesce(lo, s.p) is null then 'CREATED' when q.f = r.f then 'UNCHANGED' else 'DIFFERENT_CONTENT' end as outcome
from r left join n using (id) left join s on s.k = r.k left join s q on q.p = coalesce(lo, s.p)""")
def paper_create_or_get(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    stored = c.selectExpr("c_custkey as paper_id", "'doi:10.1/' || c_custkey as identity_key", "'f' || c_custkey % 3 as fingerprint")
    incoming = o.selectExpr("o_orderkey as request_id", "'doi:10.1/' || case when o_orderkey % 5 = 0 then o_custkey + 10000000 else o_custkey end as identity_key", "'f' || o_orderkey % 3 as fingerprint",
                            "array_compact(array(case when o_orderkey % 7 = 0 then 'a' || o_custkey end, case when o_orderkey % 14 = 0 then 'a' || (o_custkey + 1) end)) as identifiers")
    out = R.resolve_intake(incoming, c.selectExpr("'a' || c_custkey as value", "c_custkey as paper_id"), stored)
    return out.select("request_id", F.coalesce("paper_id", F.lit(-1)).alias("paper_id"), "outcome")


_WF = "['INGESTED','PARSED','EXTRACTED','SCIENTIFIC_AUDIT','PARTIAL','VERIFIED','REJECTED']"


@query("workflow_merge", f"with w as (select o_orderkey, (o_orderkey % 7)::int as a, (o_custkey % 7)::int as b from orders) select o_orderkey, case when least(b, 5) > least(a, 5) then {_WF}[b + 1] else {_WF}[a + 1] end as status from w")
def workflow_merge(spark, sf):
    names = F.array(*[F.lit(n) for n in V.WORKFLOW_RANK])
    at = lambda c: F.get(names, (F.col(c) % 7).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", R.merge_workflow(at("o_orderkey"), at("o_custkey")).alias("status"))


@query("workflow_warnings", """with w as (select o_orderkey, case when o_orderkey % 5 = 0 then [] else ['w' || (o_orderkey % 3), 'w' || (o_custkey % 3), 'w' || (o_orderkey % 3)] end as old, case when o_orderkey % 4 = 0 then [] else ['w2', 'w' || (o_custkey % 4)] end as new from orders),
i as (select o_orderkey, unnest(list_concat(old, new)) as w, unnest(range(len(old) + len(new))) as pos from w), d as (select o_orderkey, w, min(pos) as pos from i group by all)
select w.o_orderkey, coalesce(string_agg(d.w, ',' order by pos), '') as warnings from w left join d using (o_orderkey) group by 1""")
def workflow_warnings(spark, sf):
    """Stored and incoming warnings of every paper, each once, in the order of their first appearance."""
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 5 <> 0, array('w' || (o_orderkey % 3), 'w' || (o_custkey % 3), 'w' || (o_orderkey % 3)), null) as old", "if(o_orderkey % 4 <> 0, array('w2', 'w' || (o_custkey % 4)), array()) as new")
    return o.select("o_orderkey", F.array_join(R.merge_warnings(F.col("old"), F.col("new").cast("array<string>")), ",").alias("warnings"))


_UP = f"""{_ST}, n as (select *, case when paper_id % 3 = 0 then null when paper_id % 3 = 1 then value_json else '"changed"' end as nv, case when paper_id % 3 = 0 then 'NOT_REPORTED' else status end as ns from s)"""


@query("upgrade_fields", "with " + _UP + """ select paper_id, field_path, case when ns = 'NOT_REPORTED' then 'STORED' when status = 'NOT_REPORTED' or paper_id % 3 = 1 then 'INCOMING' else 'CONFLICT' end as keep from n""")
def upgrade_fields(spark, sf):
    old = states(spark, sf)
    new = old.withColumns({"value_json": F.expr("case when paper_id % 3 = 0 then null when paper_id % 3 = 1 then value_json else '\"changed\"' end"), "status": F.expr("if(paper_id % 3 = 0, 'NOT_REPORTED', status)")})
    return R.upgrade_fields(old, new).select("paper_id", "field_path", "keep")


@query("upgrade_allowed", """select o_orderkey as paper_id from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0 and o_orderstatus <> 'P'""")
def upgrade_allowed(spark, sf):
    s = states(spark, sf)
    old = s.withColumns({"status": F.expr("if(paper_id % 2 = 0, 'NOT_REPORTED', 'NOT_VERIFIED')")})
    new = s.withColumn("sources", F.when(F.col("paper_id") % 3 == 0, F.array(F.struct(*[F.lit(x).alias(n) for n, x in (("section", "s"),)], F.lit(1).alias("page"), *[F.lit(x).alias(n) for n, x in (("locator", "l"), ("evidence", "e"), ("origin", "PRIMARY_PAPER"), ("edition_key", "k"))], F.lit(None).cast("string").alias("claimed_json")))).otherwise(F.array().cast(f"array<{E.SOURCE}>")))
    flow = table(spark, sf, "orders").selectExpr("o_orderkey as paper_id", "if(o_orderstatus = 'P', 'PARSED', 'INGESTED') as old_status", "'EXTRACTED' as new_status")
    return R.may_upgrade(old, new, flow)


@query("merge_precedence", """with f as (select c_custkey as paper_id, 'paper.title' as field_path, case when c_custkey % 3 = 0 then null else '"' || c_name || '"' end as v, case when c_custkey % 3 = 0 then 'NOT_REPORTED' else 'NOT_VERIFIED' end as st from customer),
m as (select c_custkey as paper_id, case when c_custkey % 4 = 0 then '"other"' when c_custkey % 4 = 1 then null else '"' || c_name || '"' end as m from customer),
j as (select *, case when m is null then 'KEPT' when st = 'NOT_REPORTED' then 'FILLED' when m = v then 'KEPT' else 'DIFFERS' end as outcome from f join m using (paper_id))
select paper_id, coalesce(case when outcome = 'FILLED' then m else v end, '') as value_json, case when outcome = 'FILLED' then 'NOT_VERIFIED' else st end as status, outcome from j""")
def merge_precedence(spark, sf):
    c = table(spark, sf, "customer")
    name = "concat('\"', c_name, '\"')"
    f = c.selectExpr("c_custkey as paper_id", "'paper.title' as field_path", f"if(c_custkey % 3 = 0, null, {name}) as value_json", "if(c_custkey % 3 = 0, 'NOT_REPORTED', 'NOT_VERIFIED') as status")
    m = c.selectExpr("c_custkey as paper_id", "'paper.title' as field_path", f"case when c_custkey % 4 = 0 then '\"other\"' when c_custkey % 4 = 1 then null else {name} end as value_json")
    return R.fill_bibliography(f, m).select("paper_id", F.coalesce("value_json", F.lit("")).alias("value_json"), "status", "outcome")


@query("identifier_backfill", r"""with p as (select c_custkey as id, case when c_custkey % 2 = 0 then 'https://doi.org/10.1234/N' || c_nationkey end as doi, case when c_custkey % 3 = 0 then 'arXiv:2401.' || lpad(c_custkey::varchar, 5, '0') || 'v2' end as arxiv, case when c_custkey % 5 = 0 then 'doi:10.99999/' || c_custkey else 'content:x' end as ik from customer),
r as (select id, 'DOI' as kind, case when doi is not null then regexp_replace(lower(doi), '^https://doi.org/', '') when ik like 'doi:%' then substring(ik, 5) end as value from p union all select id, 'ARXIV', regexp_replace(regexp_replace(lower(arxiv), '^arxiv:', ''), 'v\d+$', '') from p)
select id as paper_id, kind, value, count(*) over (partition by kind, value) as owners from r where value is not null""")
def identifier_backfill(spark, sf):
    p = table(spark, sf, "customer").selectExpr("c_custkey as paper_id", "case when c_custkey % 2 = 0 then 'https://doi.org/10.1234/N' || c_nationkey end as doi", "case when c_custkey % 3 = 0 then 'arXiv:2401.' || lpad(cast(c_custkey as string), 5, '0') || 'v2' end as arxiv",
        "case when c_custkey % 5 = 0 then 'doi:10.99999/' || c_custkey else 'content:x' end as identity_key")
    return R.backfill_identifiers(p)


@query("domain_write_back", """with p as (select p_partkey as id, case p_partkey % 4 when 0 then ['sst'] when 1 then ['Sea ice', 'eddy'] when 2 then ['waves', 'zzz'] else ['Sea ice'] end as d, case when p_partkey % 4 = 3 then ['swot data'] else [] end as r from part),
k as (select *, case id % 4 when 0 then 'sst' when 1 then 'sea-ice|eddies-fronts' when 2 then 'waves' else 'ssh-altimetry' end as kept from p)
select id as paper_id, kept as domains, array_to_string(case when kept = array_to_string(d, '|') then r when len(r) > 0 then r else d end, '|') as domains_raw, (kept <> array_to_string(d, '|'))::int as changed from k""")
def domain_write_back(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey as paper_id", "case p_partkey % 4 when 0 then array('sst') when 1 then array('Sea ice', 'eddy') when 2 then array('waves', 'zzz') else array('Sea ice') end as domains", "if(p_partkey % 4 = 3, array('swot data'), cast(array() as array<string>)) as domains_raw")
    return R.normalised_write_back(p).select("paper_id", F.array_join("domains", "|").alias("domains"), F.array_join("domains_raw", "|").alias("domains_raw"), *as_int("changed"))


@query("intake_rules", """select 'doi_blank' as rule, count(*) as n from pages where page_id % 5 = 0 union all select 'source_missing', count(*) from pages where page_id % 5 = 1 and page_id % 3 = 0 union all select 'record_and_file', count(*) from pages where page_id % 3 = 1 and page_id % 2 = 0
union all select 'origin_not_metadata', count(*) from pages where page_id % 7 = 0 union all select 'identity_missing', count(*) from pages where page_id % 5 = 1 and page_id % 11 = 0 union all select 'identity_blank', count(*) from pages where page_id % 5 = 0""")
def intake_rules(spark, sf):
    p = table(spark, sf, "pages").selectExpr("page_id as request_id", "page_id as manifest_id", "case page_id % 5 when 0 then ' ' when 1 then null else '10.1/x' end as doi", "cast(null as string) as metadata", "if(page_id % 3 = 1, '{}', null) as parsed_paper",
        "if(page_id % 2 = 0, if(page_id % 3 = 0, null, 'a.pdf'), null) as pdf_path", "if(page_id % 3 = 2, url, null) as pdf_url", "if(page_id % 11 = 0, null, url) as title", "if(page_id % 7 = 0, 'BLOG', 'CROSSREF_METADATA') as origin", "cast(null as string) as arxiv")
    return R.request_rules(p).unionByName(R.manifest_rules(p)).groupBy("rule").agg(F.count("*").alias("n"))


# --- landing ----------------------------------------------------------------------------

_W = "case o_orderstatus when 'F' then 'EXTRACTED' when 'O' then 'INGESTED' else 'PARTIAL' end"
_FLD = f"""{_ST}, f as (select *, split_part(field_path, '.', 1) as section, o_orderstatus <> 'O' as processed, value_json is not null as valued, value_json is not null or status = 'CONFLICT' as claimed,
 value_json is not null and status in ('NOT_VERIFIED', 'PARTIALLY_VERIFIED', 'VERIFIED') and ev as base, year(o_orderdate) as year from s),
fl as (select *, base and provenance_type like 'AUTHOR%' as exact, base and provenance_type = 'AUTHOR_REPORTED_FACT' as fact, base and provenance_type = 'AUTHOR_REPORTED_LIMITATION' as lim from f)"""


def fields(spark, sf):
    return D.landing_fields(states(spark, sf), papers(spark, sf))


@query("landing_totals", f"""with {_FLD} select 'extracted_scientific_fields' as metric, count_if(claimed) as n from fl union all select 'scientific_record_fields', count_if(processed) from fl union all select 'values_with_exact_evidence', count_if(exact) from fl
union all select 'audited_fields', count_if(processed and status in ('VERIFIED', 'PARTIALLY_VERIFIED')) from fl union all select 'readable_papers', count(*) from orders union all select 'processed_papers', count(*) from orders where o_orderstatus <> 'O'
union all select 'future_dated_papers', count(*) from orders where year(o_orderdate) > 1998 union all select 'papers', count(*) + 2 from orders union all select 'indexed_not_processed', count(*) from orders where o_orderstatus = 'O' union all select 'papers_with_extracted_fields', count(distinct paper_id) from fl where claimed""")
def landing_totals(spark, sf):
    return D.totals(fields(spark, sf), papers(spark, sf), as_of_year=1998, invalid=2)


@query("landing_tallies", f"""with {_FLD}, t as (select 'status' as dimension, status as key, count(*) as n from fl where processed group by 2 union all select 'section', section, count(*) from fl where processed and claimed group by 2 union all select 'workflow', {_W}, count(*) from orders group by 2
 union all select 'limitation', split_part(field_path, '.', 2), count(*) from fl where processed and lim group by 2)
select *, '/api/landing/drilldown?dimension=' || dimension || '&key=' || key as drill from t""")
def landing_tallies(spark, sf):
    f = fields(spark, sf)
    return D.status_tally(f).unionByName(D.section_tally(f)).unionByName(D.workflow_tally(papers(spark, sf))).unionByName(D.limitation_tally(f))


@query("landing_samples", f"with {_FLD} select status, paper_id, field_path, row_number() over (partition by status order by paper_id, pos) as rank from fl where processed qualify rank <= 3")
def landing_samples(spark, sf):
    rows = fields(spark, sf).filter("processed").select("status", "paper_id", "field_path", "seq", "pos")
    return D.samples(rows, "status").select("status", "paper_id", "field_path", "rank")


@query("year_histogram", f"""with {_FLD}, a as (select paper_id, bool_or(claimed and paper_id % 8 <> 0) as c from fl group by 1) select year(o_orderdate) as year, count_if(c) as papers_with_extracted_fields, count_if(not coalesce(c, false)) as bibliography_only from orders left join a on paper_id = o_orderkey where year(o_orderdate) <= 1998 group by 1""")
def year_histogram(spark, sf):
    f = fields(spark, sf).withColumn("claimed", F.col("claimed") & (F.col("paper_id") % 8 != 0))
    return D.year_histogram(f, papers(spark, sf), 1998)


@query("named_tallies", f"""with {_FLD}, n as (select 'dataset' as dimension, json_extract_string(value_json, '$[0]') as key from fl where pos = 1 and processed and fact and o_orderkey % 3 <> 0 union all select 'architecture', trim(json_extract_string(value_json, '$[0]')) from fl where pos = 2 and processed and fact)
select dimension, key, count(*) as n, '/api/landing/drilldown?dimension=' || dimension || '&key=' || url_encode(key) as drill from n group by 1, 2""")
def named_tallies(spark, sf):
    f = fields(spark, sf)
    return D.named_tally(f, "data.datasets", "dataset").unionByName(D.named_tally(f, "architecture.family", "architecture"))


@query("extraction_showcase", f"""with {_FLD}, c as (select paper_id, count(*) as n from fl where pos in (3, 4, 5) and processed and fact group by 1 having count(*) >= 3), b as (select paper_id from c order by n desc, paper_id limit 1)
select fl.paper_id, field_path, value_json from fl join b using (paper_id) where pos in (3, 4, 5) and fact""")
def extraction_showcase(spark, sf):
    return D.best_showcase(fields(spark, sf)).select("paper_id", "field_path", "value_json")


@query("first_conflict", "select min(o_orderkey) as paper_id, 'training.optimizer' as field_path from orders where o_orderkey % 6 = 0 and o_orderstatus <> 'O'")
def first_conflict(spark, sf):
    return D.first_conflict(fields(spark, sf)).select("paper_id", "field_path")


@query("landing_drilldown", f"""with {_FLD}, d as (select 'status' as dimension, paper_id, field_path, pos from fl where processed and status = 'VERIFIED' union all select 'section', paper_id, field_path, pos from fl where processed and claimed and section = 'training'
 union all select 'limitation', paper_id, field_path, pos from fl where processed and lim and pos = 7 union all select 'dataset', paper_id, field_path, pos from fl where pos = 1 and processed and fact and o_orderkey % 3 <> 0 and value_json = '["D3"]'
 union all select 'architecture', paper_id, field_path, pos from fl where pos = 2 and processed and fact and o_custkey % 4 = 1 union all select 'workflow', o_orderkey, '', 0 from orders where o_orderstatus = 'P'
 union all select 'year_extracted', o_orderkey, '', 0 from orders where year(o_orderdate) = 1997)
select dimension, paper_id, field_path, count(*) over (partition by dimension) as total from d qualify row_number() over (partition by dimension order by paper_id, pos) between 6 and 25""")
def landing_drilldown(spark, sf):
    f, p = fields(spark, sf), papers(spark, sf)
    wanted = (("status", "VERIFIED"), ("section", "training"), ("limitation", "data"), ("dataset", "D3"), ("architecture", "U  Net 1"), ("workflow", "PARTIAL"), ("year_extracted", "1997"))
    return D.drilldowns(f, p, wanted, 20, 5).select("dimension", "paper_id", "field_path", "total")


# --- benchmark --------------------------------------------------------------------------

_SRC = "array(named_struct('section', {s}, 'page', {p}, 'locator', cast(null as string), 'evidence', 'text', 'origin', 'PRIMARY_PAPER', 'edition_key', cast(null as string), 'claimed_json', cast(null as string)))"


def gold(spark, sf):
    """Labels joined to their documents are the golden fields: two per document."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    cell = f"struct('data.lang' as path, 'data' as family, case when quality = 1 then 'VERIFIED' else 'NOT_REPORTED' end as status, case when quality = 1 then concat('\"', lang, '\"') end as value_json, cast(array() as array<string>) as conflict_values, {_SRC.format(s='source', p='cast(n_chars % 9 + 1 as int)')} as sources)"
    conf = f"struct('results.toxic' as path, 'results' as family, case when toxic = 1 then 'CONFLICT' else 'VERIFIED' end as status, case when toxic = 0 then '0' end as value_json, case when toxic = 1 then array('0', '1') else cast(array() as array<string>) end as conflict_values, {_SRC.format(s='source', p='cast(1 as int)')} as sources)"
    return d.selectExpr("doc_id as paper_id", f"explode(array({cell}, {conf})) as c").select("paper_id", "c.*")


def predictions(spark, sf):
    """Rules over documents: language by letters, some silent, some wrong, some at another place."""
    d = table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents"), "doc_id")
    guess = "case when text rlike '[éèçê]' then 'fr' when text rlike '[äöüß]' then 'de' when text rlike '[ñóáí]' then 'es' else 'en' end"
    cell = f"struct('data.lang' as path, case when doc_id % 11 = 0 then 'NOT_REPORTED' else 'NOT_VERIFIED' end as status, case when doc_id % 11 <> 0 then concat('\"', {guess}, '\"') end as value_json, cast(array() as array<string>) as conflict_values, {_SRC.format(s='source', p='cast(if(doc_id % 4 = 0, 99, n_chars % 9 + 1) as int)')} as sources)"
    conf = f"struct('results.toxic' as path, case when doc_id % 5 = 0 then 'CONFLICT' else 'NOT_VERIFIED' end as status, case when doc_id % 5 <> 0 then '0' end as value_json, case when doc_id % 5 = 0 then array('1', '0', '1') else cast(array() as array<string>) end as conflict_values, {_SRC.format(s='source', p='cast(1 as int)')} as sources)"
    return d.filter("doc_id % 13 <> 0").selectExpr("doc_id as paper_id", f"explode(array({cell}, {conf})) as c").select("paper_id", "c.*")


_BENCH = """d as (select doc_id, quality, toxic, lang, case when regexp_matches(text, '[éèçê]') then 'fr' when regexp_matches(text, '[äöüß]') then 'de' when regexp_matches(text, '[ñóáí]') then 'es' else 'en' end as guess from labels join documents using (doc_id)),
r as (select 'data' as family, quality = 1 as gc, doc_id % 13 <> 0 and doc_id % 11 <> 0 as pc, doc_id % 13 <> 0 and doc_id % 11 <> 0 and quality = 1 and lang = guess as m, quality <> 1 and doc_id % 13 <> 0 and doc_id % 11 = 0 as sil, doc_id % 4 <> 0 as loc from d
 union all select 'results', true, doc_id % 13 <> 0, doc_id % 13 <> 0 and ((toxic = 1 and doc_id % 5 = 0) or (toxic = 0 and doc_id % 5 <> 0)), false, true from d),
c as (select coalesce(family, '*') as family, count_if(m) as ex, count_if(pc) as pr, count_if(gc) as gd, count(*) as fi, count_if(m or sil) as ef, count_if(pc and not m) as un, count_if(not gc) as ab, count_if(sil) as si, count_if(m and loc) as lo from r group by grouping sets ((), (family))),
u as (select family, unnest(['precision', 'recall', 'exact_match', 'unsupported_claim_rate', 'not_reported_accuracy', 'evidence_location_accuracy']) as metric, unnest([ex, ex, ef, un, si, lo]) as numerator, unnest([pr, gd, fi, pr, ab, gd]) as denominator from c)"""


@query("extraction_benchmark", f"with {_BENCH} select family, metric, numerator, denominator, coalesce(case when denominator <> 0 then round_even(numerator / denominator, 6) end, -1) as value from u")
def extraction_benchmark(spark, sf):
    out = B.score(B.compare(gold(spark, sf), predictions(spark, sf)))
    return out.select("family", "metric", "numerator", "denominator", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("unknown_predictions", """select 'paper_unknown' as rule, count(*) as n from documents where doc_id not in (select doc_id from labels) union all select 'path_unknown', count(*) from labels where doc_id % 2 = 0""")
def unknown_predictions(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id as paper_id", "explode(if(doc_id % 2 = 0, array('data.lang', 'data.other'), array('data.lang'))) as path")
    return B.unknown_predictions(gold(spark, sf), d).groupBy("rule").agg(F.count("*").alias("n"))


@query("prediction_rules", """select 'conflict_alternatives' as rule, count(*) as n from labels where doc_id % 5 = 0 and doc_id % 13 <> 0 and doc_id % 10 = 0 union all select 'silent_with_evidence', count(*) from labels where doc_id % 11 = 0 and doc_id % 13 <> 0
union all select 'path_repeated', count(*) from labels where doc_id % 13 <> 0 and doc_id % 6 = 0""")
def prediction_rules(spark, sf):
    p = predictions(spark, sf).withColumn("conflict_values", F.when((F.col("paper_id") % 10 == 0) & (F.size("conflict_values") > 0), F.array(F.lit("1"), F.lit("1"))).otherwise(F.col("conflict_values")))
    again = p.filter("paper_id % 6 = 0 and path = 'data.lang' and paper_id % 11 <> 0").unionByName(p.filter("paper_id % 66 = 0 and path = 'results.toxic' and paper_id % 10 <> 0"))
    # where both fields break a rule already, the second row of the path is a sound one
    sound = p.filter("paper_id % 330 = 0 and path = 'results.toxic'").withColumns({"status": F.lit("NOT_VERIFIED"), "value_json": F.lit("0"), "conflict_values": F.array().cast("array<string>")})
    return B.prediction_rules(p.unionByName(again).unionByName(sound)).groupBy("rule").agg(F.count("*").alias("n"))


@query("golden_rules", """with g as (select doc_id, quality, toxic from labels join documents using (doc_id))
select 'absent_with_evidence' as rule, count(*) as n from g where quality = 0 union all select 'absent_without_scope', count(*) from g where quality = 0 and doc_id % 2 = 0 union all select 'scope_on_claim', count_if(quality = 1 and doc_id % 2 = 1) + count_if(doc_id % 2 = 1) from g
union all select 'conflict_evidence', count(*) from g where toxic = 1 union all select 'conflict_unbound', count(*) from g where toxic = 1 union all select 'url_unpinned', 2 * count(*) from g where doc_id % 3 = 0 union all select 'auditor_missing', 2 * count(*) from g where doc_id % 7 = 0
union all select 'audit_time', 2 * count(*) from g where doc_id % 9 = 0 union all select 'required_paths_missing', count(*) from g union all select 'no_absence_label', count(*) from g where quality = 1""")
def golden_rules(spark, sf):
    g = gold(spark, sf).withColumns({
        "confidence": F.expr("if(status = 'NOT_REPORTED', 0.95D, 1.0D)"), "provenance_type": F.lit("AUTHOR_REPORTED_FACT"), "source_url": F.expr("if(paper_id % 3 = 0, 'https://arxiv.org/abs/2401.00001', 'https://arxiv.org/abs/2401.00001v1')"),
        "absence_search_scope": F.expr("if(paper_id % 2 = 1, array('all pages'), cast(array() as array<string>))"), "verified_by": F.expr("if(paper_id % 7 = 0, ' ', 'ann')"), "verified_at": F.expr("if(paper_id % 9 = 0, '2025-01-01', '2025-01-01T00:00:00Z')")})
    return B.golden_rules(g).groupBy("rule").agg(F.count("*").alias("n"))
