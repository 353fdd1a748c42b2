"""Corpus analytics queries. Orders are papers, their lines are experiments with one result each."""

from pyspark.sql import functions as F

from attestry.operators import analytics as A
from attestry.plans.q_ledger import _CLAIMS, _REQUESTS, decorated
from attestry.plans.registry import query, spread_table, table

_REPORTED = ("if(l_discount > 0.02, 'learning_rate', null)", "if(l_tax > 0.03, 'batch_size', null)", "if(l_quantity > 25, 'epochs', null)",
             "if(l_linenumber % 2 = 0, 'loss', null)", "if(l_linenumber = 3, 'hardware', null)")


def papers(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("slug"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.year("o_orderdate").alias("year"),
                    F.array("o_orderpriority", F.expr("if(o_custkey % 2 = 0, 'even', 'odd')")).alias("domains"), F.expr("if(o_orderstatus = 'P', 'review', null)").alias("excluded"))


def experiments(spark, sf):
    li = spread_table(spark, sf, "lineitem").join(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return li.select(
        F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("ord"), F.col("p_type").alias("task"), F.col("p_brand").alias("family"),
        F.col("p_name").alias("method"), F.expr("if(l_suppkey % 3 = 0, array(concat('S', l_suppkey % 40), concat('ERA5 ', l_suppkey % 7)), array(concat('S', l_suppkey % 40)))").alias("datasets"),
        F.col("l_returnflag").alias("variable"), F.array_compact(F.array(*[F.expr(e) for e in _REPORTED])).alias("reported"),
        F.expr("if(l_linenumber = 7, array(), array(l_linestatus))").alias("metrics"),
        F.col("l_extendedprice").alias("value"), F.col("l_suppkey"), F.col("p_size"))


_E = """e as (select l_orderkey as slug, l_linenumber as ord, p_type as task, p_brand as family, p_name as method,
  case when l_suppkey % 3 = 0 then ['S' || l_suppkey % 40, 'ERA5 ' || l_suppkey % 7] else ['S' || l_suppkey % 40] end as datasets, l_returnflag as variable,
  l_discount > 0.02 as r_lr, l_tax > 0.03 as r_bs, l_quantity > 25 as r_ep, l_linenumber % 2 = 0 as r_loss, l_linenumber = 3 as r_hw,
  case when l_linenumber = 7 then null else l_linestatus end as metric, l_extendedprice as value, l_suppkey, p_size
  from lineitem join part on l_partkey = p_partkey)"""
_G = "case when contains(lower(d), 'era5') then 'ERA5' else d end"
_EE = f"""{_E}, ee as (select 'family' as kind, family as name, * from e union all select 'task', task, * from e union all select 'variable', variable, * from e
  union all select 'method', method, * from e union all select 'dataset', unnest(datasets), * from e
  union all select 'dataset_group', unnest(list_distinct(list_transform(datasets, lambda d: {_G}))), * from e)"""


@query("corpus_counters", """with k as (select o_orderkey from orders where o_orderstatus <> 'P')
select 'papers' as counter, count(*) as n from k union all select 'excluded', count(*) from orders where o_orderstatus = 'P'
union all select 'experiments', count(*) from lineitem where l_orderkey in (select * from k) union all select 'results', count(*) from lineitem where l_linenumber < 7 and l_orderkey in (select * from k)
union all select 'conflicts', count(*) from lineitem where l_linenumber = 1 and l_orderkey in (select * from k) union all select 'quotes', count(*) from documents""")
def corpus_counters(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slug"), "l_linenumber")
    return A.corpus_counters(papers(spark, sf), e, e.filter("l_linenumber < 7"), e.filter("l_linenumber = 1"), table(spark, sf, "documents"))


@query("category_counts", f"""with {_E} select 'task' as category, task as value, count(*) as n from e group by 2 union all select 'family', family, count(*) from e group by 2
union all select 'method', method, count(*) from e group by 2 union all select 'variable', variable, count(*) from e group by 2""")
def category_counts(spark, sf):
    return A.category_counts(experiments(spark, sf), ["task", "family", "method", "variable"])


@query("reporting_rate", f"""with {_E}, c as (select count_if(r_loss) as loss, 0 as optimizer, count_if(r_lr) as learning_rate, count_if(r_bs) as batch_size, count_if(r_ep) as epochs, count_if(r_hw) as hardware, count(*) as total from e)
select field, reported, total as "of" from c unpivot (reported for field in (loss, optimizer, learning_rate, batch_size, epochs, hardware))""")
def reporting_rate(spark, sf):
    return A.reporting_rate(experiments(spark, sf))


@query("numeric_summary", """
with v as (select l_returnflag || '/' || l_linestatus as g, case when l_linenumber <> 7 then l_extendedprice end as number from lineitem
 union all select 'text ' || (l_linenumber % 3), null from lineitem)
select g, count(*) as n_values, count(number) as n_numbers, round(coalesce(min(number), -1), 4) as min_value, round(coalesce(median(number), -1), 4) as median_value,
  round(coalesce(max(number), -1), 4) as max_value, case when count(number) = 0 then (select string_agg(t, ', ' order by t) from
   (select distinct left('shipped with quantity ' || l_quantity::int, 22) as t from lineitem where 'text ' || (l_linenumber % 3) = g order by t limit 4)) else '' end as texts from v group by g""")
def numeric_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    numbers = li.select(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("g"), F.expr("if(l_linenumber <> 7, l_extendedprice, null)").alias("number"), F.lit(None).cast("string").alias("text"))
    texts = li.select(F.concat(F.lit("text "), F.col("l_linenumber") % 3).alias("g"), F.lit(None).cast("double").alias("number"),
                      F.concat(F.lit("shipped with quantity "), F.col("l_quantity").cast("int").cast("string")).alias("text"))
    out = A.numeric_summary(numbers.unionByName(texts), ["g"])
    return out.select("g", "n_values", "n_numbers", *[F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c) for c in ("min_value", "median_value", "max_value")], F.coalesce("texts", F.lit("")).alias("texts"))


@query("median_per_part", """select l_partkey, count(*) as n, median(l_quantity) as median_value, min(l_quantity) as min_value, max(l_quantity) as max_value from lineitem group by 1""")
def median_per_part(spark, sf):
    from attestry.operators.keyed import exact_median
    return exact_median(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity")


_CELLS = f"with {_E}, f as (select family, p_size, count(distinct l_suppkey) as papers from e group by 1, 2), g as (select a.family, b.p_size from (select distinct family from f) a, (select distinct p_size from f) b)"


@query("coverage_matrix", _CELLS + " select g.family, g.p_size, coalesce(papers, 0) as papers from g left join f using (family, p_size)")
def coverage_matrix(spark, sf):
    return A.coverage(experiments(spark, sf), "family", "p_size", "l_suppkey")


@query("empty_cells", _CELLS + " select g.family, g.p_size from g anti join f using (family, p_size)")
def empty_cells(spark, sf):
    return A.empty_cells(experiments(spark, sf), "family", "p_size", "l_suppkey")


@query("comparable_cells", f"with {_E} select family, variable, p_size, count(distinct l_suppkey) as papers, count(*) as results from e group by 1, 2, 3 having count(distinct l_suppkey) >= 2")
def comparable_cells(spark, sf):
    return A.comparable_cells(experiments(spark, sf), ["family", "variable", "p_size"], "l_suppkey")


@query("comparable_share", f"with {_E}, c as (select datasets[1] as d, metric, family, count(distinct slug) as n from e where metric is not null group by 1, 2, 3) select count(*) as cells, count_if(n > 1) as shared_cells from c")
def comparable_share(spark, sf):
    r = experiments(spark, sf).select("slug", F.get("datasets", F.lit(0)).alias("d"), "family", F.explode("metrics").alias("metric"))
    c = A.comparison_cells(r, ["d", "metric", "family"])
    return c.agg(F.count("*").alias("cells"), F.count_if(F.col("papers") > 1).alias("shared_cells"))


@query("absence_top", """with n as (select 'customer.' || c_mktsegment || '.' || 'nation_' || c_nationkey as field from customer c anti join (select * from orders where o_orderstatus = 'F') o on o_custkey = c_custkey)
select split_part(field, '.', 3) as field, count(*) as n from n group by 1 order by n desc, field limit 10""")
def absence_top(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return A.missing_fields(c.select(F.concat(F.lit("customer."), "c_mktsegment", F.lit(".nation_"), "c_nationkey").alias("field")), 10)


@query("entity_rollup", f"with {_EE} select kind, name, count(distinct slug) as papers, count(*) as experiments, count(metric) as results from ee group by 1, 2")
def entity_rollup(spark, sf):
    return A.entity_rollup(experiments(spark, sf))


@query("entity_reporting", f"""with {_EE}, c as (select kind, name, count_if(r_loss) as loss, 0 as optimizer, count_if(r_lr) as learning_rate, count_if(r_bs) as batch_size, count_if(r_ep) as epochs, count_if(r_hw) as hardware, count(*) as "of" from ee group by 1, 2)
select kind, name, "of", field, reported from c unpivot (reported for field in (loss, optimizer, learning_rate, batch_size, epochs, hardware))""")
def entity_reporting(spark, sf):
    return A.entity_reporting(experiments(spark, sf))


@query("entity_facets", f"""with {_EE}, f as (select kind, name, slug, ord, 'tasks' as facet, task as value from ee union all select kind, name, slug, ord, 'families', family from ee
 union all select kind, name, slug, ord, 'variables', variable from ee union all select kind, name, slug, ord, 'methods', method from ee
 union all select kind, name, slug, ord, 'datasets', unnest(datasets) from ee union all select kind, name, slug, ord, 'metrics', metric from ee where metric is not null),
c as (select kind, name, facet, value, count(*) as n, min(slug * 100 + ord) as first from f group by 1, 2, 3, 4)
select kind, name, facet, value, n, row_number() over (partition by kind, name, facet order by n desc, first, value) as rank from c
qualify rank <= 8 or facet in ('tasks', 'families')""")
def entity_facets(spark, sf):
    return A.entity_facets(experiments(spark, sf))


@query("recurring_problems", "select p_type as theme, count(*) as items, count(distinct l_orderkey) as papers from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1")
def recurring_problems(spark, sf):
    e = experiments(spark, sf).filter("variable = 'R'")
    return A.problems(e.select("slug", F.col("task").alias("theme")))


@query("entity_detail", f"with {_E} select slug, 'Order ' || slug as title, year(o_orderdate) as year, count(*) as experiments from e join orders on o_orderkey = slug where family = 'Brand#3' group by 1, 2, 3")
def entity_detail(spark, sf):
    return A.entity_papers(experiments(spark, sf), papers(spark, sf), "family", "Brand#3")


@query("entity_experiment_list", f"with {_E} select slug, ord, task, method, array_to_string(datasets, '|') as datasets, variable, case when metric is null then 0 else 1 end as results from e where list_contains(datasets, 'ERA5 3')")
def entity_experiment_list(spark, sf):
    out = A.entity_experiment_list(experiments(spark, sf), "dataset", "ERA5 3")
    return out.select("slug", "ord", "task", "method", F.array_join("datasets", "|").alias("datasets"), "variable", F.size("metrics").alias("results"))


@query("entity_problems", f"with {_E} select variable as theme, count(*) as n from e where slug in (select slug from e where method = 'red ring') group by 1")
def entity_problems(spark, sf):
    e = experiments(spark, sf)
    return A.entity_problems(e, e.select("slug", F.col("variable").alias("theme")), "method", "red ring").groupBy("theme").agg(F.count("*").alias("n"))


@query("figures_only", "select o_orderkey as slug, year(o_orderdate) as year from orders where o_orderstatus <> 'P' and o_orderkey not in (select l_orderkey from lineitem where l_linenumber < 7)")
def figures_only(spark, sf):
    r = table(spark, sf, "lineitem").filter("l_linenumber < 7").select(F.col("l_orderkey").alias("slug"))
    return A.figures_only(papers(spark, sf), r).select("slug", "year")


@query("domain_count", "select count(distinct d) as domains from (select o_orderpriority as d from orders union all select case when o_custkey % 2 = 0 then 'even' else 'odd' end from orders)")
def domain_count(spark, sf):
    return A.domain_count(papers(spark, sf))


def summaries(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("family"), "l_linenumber")
    return A.paper_summaries(papers(spark, sf).filter("excluded is null").drop("domains", "excluded"), li, li.filter("l_linenumber < 7"), li.filter("l_linenumber > 2"))


_SUM = """s as (select o_orderkey as slug, 'Order ' || o_orderkey as title, year(o_orderdate) as year, count(l_orderkey) as experiment_count, count_if(l_linenumber < 7) as result_count, count_if(l_linenumber > 2) as claim_count,
  coalesce(list_sort(list_distinct(list(l_returnflag) filter (l_returnflag is not null))), []) as tasks, coalesce(list_sort(list_distinct(list(l_linestatus) filter (l_linestatus is not null))), []) as families
  from orders left join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'P' group by 1, 2, 3)"""


@query("facet_search", f"""with {_SUM} select slug, year, array_to_string(tasks, '|') as tasks, array_to_string(families, '|') as families, experiment_count, result_count, claim_count from s
where contains('order ' || slug, 'r 1') and list_contains(tasks, 'R') and list_contains(families, 'F')""")
def facet_search(spark, sf):
    hits = A.search(summaries(spark, sf), text="R 1", task="R", family="F")
    return hits.select("slug", "year", F.array_join("tasks", "|").alias("tasks"), F.array_join("families", "|").alias("families"), "experiment_count", "result_count", "claim_count")


@query("facet_lists", f"with {_SUM} select 'task' as facet, unnest(tasks) as value from s where list_contains(tasks, 'N') union select 'family', unnest(families) from s where list_contains(tasks, 'N')")
def facet_lists(spark, sf):
    return A.facets(A.search(summaries(spark, sf), task="N"))


@query("paper_catalogue", f"""with {_SUM}, h as (select *, count(*) over () as total from s where list_contains(tasks, 'A') order by slug limit 100 offset 20),
a as (select l_orderkey as slug, count(*) as claims, count_if(l_linestatus = 'F') as audited from lineitem group by 1)
select h.slug, h.total, h.claim_count, a.claims, a.audited from h left join a using (slug)""")
def paper_catalogue(spark, sf):
    progress = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("slug")).agg(F.count("*").alias("claims"), F.count_if(F.col("l_linestatus") == "F").alias("audited"))
    return A.catalogue(summaries(spark, sf), progress, 100, 20, task="A").select("slug", "total", "claim_count", "claims", "audited")


@query("corpus_summary", f"""with {_CLAIMS}, {_REQUESTS}, {_E}
select 'papers' as metric, case when o_orderstatus = 'P' then 'excluded' else 'kept' end as key, count(*) as value from orders group by 2
union all select 'tasks', task, count(*) from e group by 2 union all select 'metrics', metric, count(*) from e where metric is not null group by 2
union all select 'audit_state', audit_state, count(*) from decorated group by 2""")
def corpus_summary(spark, sf):
    n = lambda df, metric, key: df.groupBy(F.lit(metric).alias("metric"), key.alias("key")).agg(F.count("*").alias("value"))
    e = experiments(spark, sf)
    return A.union([
        n(papers(spark, sf), "papers", F.when(F.col("excluded").isNull(), "kept").otherwise("excluded")), n(e, "tasks", F.col("task")),
        n(e.select(F.explode("metrics").alias("m")), "metrics", F.col("m")), n(decorated(spark, sf), "audit_state", F.col("audit_state"))])


@query("topk_per_group", """select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 3""")
def topk_per_group(spark, sf):
    from attestry.operators.keyed import first_n
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return first_n(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@query("silver_experiments", """with o as (select *, 'o' || o_orderkey as slug from orders where o_orderstatus <> 'P')
select slug, 'T' || (o_orderkey % 5) as task, o_orderpriority as family, 'M' || (o_custkey % 50) as method, 'D' || (o_orderkey % 40) as datasets, 'v' || (o_custkey % 7) as variable,
  'batch_size|learning_rate|optimizer' as reported, 1 as n_metrics from o""")
def silver_experiments(spark, sf):
    from attestry.operators import walk
    from attestry.plans.q_records import records
    r = records(spark, sf)
    e = A.experiment_rows(*[walk.silver(r, t) for t in ("experiments", "methods", "datasets")], walk.training(r), walk.silver(r, "results"), walk.papers(r))
    return e.select("slug", "task", "family", "method", F.array_join("datasets", "|").alias("datasets"), "variable",
                    F.array_join(F.array_sort("reported"), "|").alias("reported"), F.size("metrics").alias("n_metrics"))
