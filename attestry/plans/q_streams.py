"""Streaming and storage queries: each runs the stream over the table and reads what it wrote."""


from pyspark.sql import functions as F

from attestry.operators import staging as G
from attestry.plans.q_gate import cited_quotes
from attestry.plans import sqltext as S
from attestry.plans.registry import as_int, query, table
from attestry.session import shared_dir
from attestry.sources import sheets, sinks
from attestry.streaming import events as T
from attestry.streaming import parts as P


def _work(spark):
    """A fresh folder below the shared one."""
    import uuid

    return f"{shared_dir(spark)}/attestry-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    # as a pattern the path may be one file or a folder of parts
    return T.read_stream(spark, f"{sf}/{name}[.]parquet", table(spark, sf, name).schema)


def _event_stream(spark, sf, out, results=None, keys=None):
    """The events in four files that each hold all days, one event in seven a second time in another file: read one by one in
    two runs of the stream, with a compaction after each."""
    e = table(spark, sf, "events").selectExpr("*", "explode(if(event_id % 7 = 0, array(0, 1), array(0))) as copy")
    for half in (0, 1):
        rows = e.filter(F.pmod(F.col("event_id") + F.col("copy"), F.lit(2)) == half).repartition(2).drop("copy")
        rows.write.mode("append").parquet(f"{out}/in")
        stream = T.read_stream(spark, f"{out}/in", rows.schema, files_per_trigger=1)
        P.write_new_events(stream, f"{out}/t", f"{out}/c", results={n: part for n, (part, _) in (results or {}).items()})
        P.compact(spark, f"{out}/t", [P.DAY, "event_id"])
        for name, (_, merge) in (results or {}).items():
            P.compact(spark, f"{out}/t/{name}", keys, merge)
    return f"{out}/t"


@query("stream_intake", "select event_id, user_id, event_type from events")
def stream_intake(spark, sf):
    return P.read_new_events(spark, _event_stream(spark, sf, _work(spark))).select("event_id", "user_id", "event_type")


@query("stream_latest", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def stream_latest(spark, sf):
    steps = P.newest_of("user_id", "ts", "event_id", "event_type")
    out = _event_stream(spark, sf, _work(spark), {"latest": steps}, ["user_id"])
    return P.read_parts(spark, f"{out}/latest", steps[1]).select("user_id", "event_id", "event_type")


@query("stream_progress", "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1, 2")
def stream_progress(spark, sf):
    here = F.current_timezone()  # the table's times carry no zone; days are cut in UTC
    part, merge = P.counts_of("event_type", "ts")
    local = lambda rows: part(rows.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), here)))
    out = _event_stream(spark, sf, _work(spark), {"days": (local, merge)}, ["day", "event_type"])
    rows = P.read_parts(spark, f"{out}/days", merge)
    return rows.select("event_type", F.date_format(F.to_utc_timestamp("day", here), "yyyy-MM-dd").alias("day"), "n")


@query("stream_staleness", "select o_orderkey as claim_id from orders where o_orderkey % 3 = 0 and o_orderkey % 7 = 0")
def stream_staleness(spark, sf):
    """Claims arrive with new fingerprints; verdicts exist for every third."""
    verdicts = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").selectExpr("o_orderkey as claim_id", "'ACCEPTED' as decision", "'f' as fingerprint")
    changed = _stream(spark, sf, "orders").selectExpr("o_orderkey as claim_id", "if(o_orderkey % 7 = 0, 'g', 'f') as fingerprint")
    out = _work(spark)
    T.write_batches(changed, f"{out}/t", f"{out}/c", "append", lambda b: T.stale_verdicts(b, verdicts))
    return spark.read.parquet(f"{out}/t").select("claim_id")


@query("stream_page_gate", f"""with q as (select doc_id, source, case when doc_id % 3 = 0 then doc_id + 1 else doc_id end as page, {S.norm('substring(text, 31, 90)')} as needle from documents)
select q.doc_id, contains({S.norm('d.text')}, needle)::int as located from q join documents d on d.source = q.source and d.doc_id = q.page""")
def stream_page_gate(spark, sf):
    pending = cited_quotes(spark, sf).select("doc_id", "source_file", "page_pdf", "quote")
    pages = _stream(spark, sf, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page"), "text")
    out = _work(spark)
    T.write_batches(pages, f"{out}/t", f"{out}/c", "append", lambda b: T.gate_pages(b, pending))
    return spark.read.parquet(f"{out}/t").select("doc_id", *as_int("located"))


@query("snapshot_publish", "select c_custkey as key, case when c_custkey % 5 = 0 then 'v2' else 'v1' end as value from customer")
def snapshot_publish(spark, sf):
    """Two runs are published; a third writes its table but dies before the manifest."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("v1").alias("value"))
    root = _work(spark)
    sinks.publish_snapshot(spark, {"papers": c}, root, "run1", "2025-01-01")
    later = sinks.read_snapshot(spark, root, "papers").withColumn("value", F.expr("if(key % 5 = 0, 'v2', value)"))
    sinks.publish_snapshot(spark, {"papers": later}, root, "run2", "2025-01-02")
    later.withColumn("value", F.lit("lost")).write.parquet(f"{root}/run3/papers")
    return sinks.read_snapshot(spark, root, "papers")


@query("partition_refresh", "select o_orderkey, case when o_orderpriority = '1-URGENT' then 'new' else 'old' end as value from orders")
def partition_refresh(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lit("old").alias("value"))
    path = _work(spark)
    sinks.overwrite_partitions(o, path, ["o_orderpriority"])
    sinks.overwrite_partitions(o.filter("o_orderpriority = '1-URGENT'").withColumn("value", F.lit("new")), path, ["o_orderpriority"])
    return spark.read.parquet(path).select("o_orderkey", "value")


@query("import_run", """select 'rejected' as outcome, count(*) as n from customer union all select 'stale', count(*) from customer union all select 'imported', count(*) from customer""")
def import_run(spark, sf):
    """A faulty package, one that goes back to replaced content, and a good one, in that order."""
    c = table(spark, sf, "customer")
    root = _work(spark)
    row = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit("f"), "c_nationkey").alias("fingerprint"))
    stored = row.withColumn("protected", F.lit(False))
    changed = row.withColumn("fingerprint", F.lit("old"))
    none = G.plan_upsert(row, stored, row.filter("false"))
    bad = G.paper_identity_rules(c.selectExpr("'same' as paper_id", "c_name as title", "1990 as year", "cast(null as string) as doi", "cast(null as string) as scientific_audit_status"))
    stale = G.plan_upsert(changed, stored, changed)
    outcomes = [sinks.import_package(spark, root, f"r{i}", f"2025-01-0{i + 1}", v, {"papers": p}, {"papers": row})
                for i, (v, p) in enumerate(((bad, none), (bad.filter("false"), stale), (bad.filter("false"), none)))]
    n = sinks.read_snapshot(spark, root, "papers").agg(F.count("*").alias("n"))
    return n.select(F.explode(F.array(*[F.lit(o) for o in outcomes])).alias("outcome"), "n")


@query("sheet_scan", "select c_custkey::varchar as paper_id, case when c_custkey % 4 = 0 then '' else c_name end as title from customer where c_custkey % 9 <> 0")
def sheet_scan(spark, sf):
    """A sheet export with padding, blank cells, blank rows, and an unnamed column, read back."""
    path = _work(spark)
    c = table(spark, sf, "customer").selectExpr("case when c_custkey % 9 = 0 then ' ' else ' ' || c_custkey end as paper_id", "if(c_custkey % 9 = 0 or c_custkey % 4 = 0, '  ', c_name || ' ') as title", "cast(null as string) as ` `")
    c.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return sheets.read_sheet(spark, path).select("paper_id", F.coalesce("title", F.lit("")).alias("title"))


_NAMES = ("START_HERE", "PAPER_INDEX", "SCIENTIFIC_CLAIMS", "RESEARCH_GAPS", "PAPER_RECORDS", "FIELD_CONTRACT", "README", "AUDIT_PROTOCOL", "METHODS_GUIDE", "COVERAGE", "EXTRA", "EXTRA2")


def _sheet_case():
    return "case event_id % 12 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end"


@query("package_kinds", f"""with s as (select user_id as package, {_sheet_case()} as sheet from events where user_id % 3 = 0 or event_id % 12 not in (4, 5)), h as (select package, list(distinct sheet) as has from s group by 1),
k as (select *, list_filter(['START_HERE','PAPER_INDEX','SCIENTIFIC_CLAIMS','RESEARCH_GAPS','PAPER_RECORDS','FIELD_CONTRACT','README','AUDIT_PROTOCOL','METHODS_GUIDE'], lambda x: not list_contains(has, x)) as mb, list_filter(['START_HERE','PAPER_INDEX','SCIENTIFIC_CLAIMS','RESEARCH_GAPS','COVERAGE'], lambda x: not list_contains(has, x)) as ms from h)
select package, case when len(mb) > 0 and not list_contains(has, 'PAPER_RECORDS') and not list_contains(has, 'FIELD_CONTRACT') then 'supplement' else 'base' end as kind,
 array_to_string(list_sort(case when len(mb) > 0 and not list_contains(has, 'PAPER_RECORDS') and not list_contains(has, 'FIELD_CONTRACT') then ms else mb end), '|') as missing from k""")
def package_kinds(spark, sf):
    s = table(spark, sf, "events").filter("user_id % 3 = 0 or event_id % 12 not in (4, 5)").selectExpr("user_id as package", f"{_sheet_case()} as sheet")
    k = sheets.package_kinds(s)
    return k.select("package", "kind", F.array_join("missing", "|").alias("missing"))


@query("embedded_records", """select 'json_invalid' as rule, count(*) as n from events where event_id % 6 = 0 union all select 'json_not_object', count(*) from events where event_id % 6 = 1 union all select 'id_differs', count(*) from events where event_id % 6 = 2 union all select 'kept', count(*) from events where event_id % 6 > 1""")
def embedded_records(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id as paper_id", "case event_id % 6 when 0 then '{' when 1 then '[1]' when 2 then '{\"paper_id\": \"x\"}' else concat('{\"paper_id\": \"', event_id, '\", \"p\": ', props, '}') end as record_json")
    rows, issues = sheets.embedded_records(e)
    return issues.groupBy("rule").agg(F.count("*").alias("n")).unionByName(rows.agg(F.lit("kept").alias("rule"), F.count("*").alias("n")))


@query("record_slots", "select o_custkey as paper_id, 'data.p' || substring(o_orderpriority, 1, 1) as field_path, 'C' || o_orderkey as claim_id from orders union all select o_custkey, 'data.empty', '' from orders union all select o_custkey, 'training.x', 'A' || o_orderkey from orders union all select o_custkey, 'training.x', 'B' || o_orderkey from orders")
def record_slots(spark, sf):
    doc = """concat('{"field_claim_ids": {"data": {"p', substring(o_orderpriority, 1, 1), '": ["C', o_orderkey, '"], "empty": []}, "training": {"x": ["A', o_orderkey, '", "B', o_orderkey, '"]}}}')"""
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("paper_id"), F.parse_json(F.expr(doc)).alias("v"))
    return sheets.slots(r).select("paper_id", "field_path", F.coalesce("claim_id", F.lit("")).alias("claim_id"))


@query("document_store", """select 'pkg:CHANGE_LOG' as name, count(*) as n_rows from supplier union all select 'README', count(*) from nation""")
def document_store(spark, sf):
    rows = sheets.document_rows(table(spark, sf, "supplier"), "CHANGE_LOG", "pkg").unionByName(sheets.document_rows(table(spark, sf, "nation"), "README"))
    return sheets.document_fingerprints(rows).select("name", "n_rows")


@query("start_here", "select n_name as label, case when n_nationkey % 2 = 0 then '' else n_regionkey::varchar end as text from nation where n_nationkey % 5 <> 0")
def start_here(spark, sf):
    n = table(spark, sf, "nation").selectExpr("if(n_nationkey % 5 = 0, '', n_name) as a", "if(n_nationkey % 2 = 0, ' ', cast(n_regionkey as string)) as b")
    return sheets.label_text(sheets.clean(n))


@query("run_log", "select 'r1' as run_id, '[{\"entity\":\"papers\",\"action\":\"created\",\"n\":' || (select count(*) from customer) || '}]' as counts_json")
def run_log(spark, sf):
    c = table(spark, sf, "customer")
    row = c.select(F.col("c_custkey").alias("key"), F.lit("f").alias("fingerprint"))
    counts = G.import_counts({"papers": G.plan_upsert(row, row.withColumn("protected", F.lit(False)).filter("false"), row.filter("false"))})
    warnings = spark.createDataFrame([], "rule string, severity string")
    return sinks.run_log(spark, counts, "r1", "pkg", "sha", "2025-01-01", warnings).select("run_id", "counts_json")


@query("json_export", "select n_nationkey, n_name, n_regionkey from nation")
def json_export(spark, sf):
    path = _work(spark)
    sinks.export_json(table(spark, sf, "nation"), path, ["n_nationkey"])
    return spark.read.schema("n_name string, n_nationkey int, n_regionkey int").json(path).select("n_nationkey", "n_name", "n_regionkey")


