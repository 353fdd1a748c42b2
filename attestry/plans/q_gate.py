"""Queries over page text: normalisation, numbers, sentences, identifiers and the gate."""

from pyspark.sql import functions as F

from attestry.functions import identity as I
from attestry.functions import numbers as N
from attestry.functions import rules as R
from attestry.functions import text as X
from attestry.functions import vocabulary as V
from attestry.operators import gate
from attestry.plans import sqltext as S
from attestry.plans.registry import as_int, query, spread_table, table


@query("quote_locate", f"""
with q as (select item_id, {S.norm('text')} as n from benchmark), p as (select doc_id, {S.norm('text')} as t from documents)
select q.item_id, count(p.doc_id) as n_pages, coalesce(min(p.doc_id), -1) as first_page
from q left join p on contains(p.t, q.n) group by q.item_id""")
def quote_locate(spark, sf):
    return gate.quote_report(table(spark, sf, "benchmark"), spread_table(spark, sf, "documents", "doc_id", "text"), "item_id", "doc_id")


def cited_quotes(spark, sf):
    """Every document cites a passage of itself; a third name the wrong page of their source."""
    d = spread_table(spark, sf, "documents", "doc_id", "source", "lang", "text")
    return d.select(
        "doc_id", F.col("source").alias("slug"), F.col("source").alias("source_file"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("page_pdf"),
        (F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("page_printed"), F.lit(0).alias("page_offset"),
        F.substring("text", 31, 90).alias("quote"),
        F.parse_json(X.json_text(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 35, 20)).otherwise(F.concat_ws(" ", "lang", "source")))).alias("value"),
    )


def cited_pages(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "source", "text").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page"), "text")


_GATE = f"""
with q as (
  select doc_id, source, case when doc_id % 3 = 0 then doc_id + 1 else doc_id end as page_pdf,
    doc_id + case when doc_id % 5 = 0 then 1 else 0 end as page_printed, {S.norm('substring(text, 31, 90)')} as needle,
    {S.norm("case when doc_id % 2 = 0 then substring(text, 35, 20) else lang || ' ' || source end")} as value
  from documents),
p as (select source, doc_id as page, {S.norm('text')} as t from documents),
l as (select q.*, coalesce(contains(p.t, q.needle), false) as located
  from q left join p on p.source = q.source and p.page = q.page_pdf),
f as (select l.doc_id, count(*) as found_on, min(p.page) as first_found
  from l join p on p.source = l.source and contains(p.t, l.needle) where not l.located group by l.doc_id),
w as (select *, list_filter(string_split(value, ' '), lambda x: length(x) > 3) as words from l),
r as (select w.doc_id, w.source, located, coalesce(found_on, 0) as found_on, coalesce(first_found, -1) as first_found,
  located and not (needle <> '' and (contains(needle, value) or (len(words) > 0 and
    len(list_filter(words, lambda x: contains(needle, x))) * 2 >= len(words)))) as support_warning,
  located and page_printed <> page_pdf as pagination_warning
  from w left join f using (doc_id))
"""


@query("quote_cited_page_gate", _GATE + """
select doc_id, located::int as located, found_on, first_found, support_warning::int as support_warning,
  pagination_warning::int as pagination_warning from r""")
def quote_cited_page_gate(spark, sf):
    r = gate.gate_report(cited_quotes(spark, sf), cited_pages(spark, sf))
    return r.select("doc_id", "found_on", F.coalesce("first_found", F.lit(-1)).alias("first_found"),
                    *as_int("located", "support_warning", "pagination_warning"))


@query("gate_summary", _GATE + """
select source as slug, count(*) as checked, count_if(located) as located, count_if(support_warning) as support_warnings,
  count_if(pagination_warning) as pagination_warnings, bool_and(located)::int as ok from r group by source""")
def gate_summary(spark, sf):
    s = gate.gate_summary(gate.gate_report(cited_quotes(spark, sf), cited_pages(spark, sf)))
    return s.select("slug", "checked", "located", "support_warnings", "pagination_warnings", *as_int("ok"))


@query("numeric_tokens", f"""
select doc_id, len({S.numbers('text')}) as n_numbers, array_to_string(list_sort({S.numbers('text')}), '|') as numbers
from documents""")
def numeric_tokens(spark, sf):
    d = spread_table(spark, sf, "documents", "doc_id", "text").withColumn("found", N.numeric_tokens(F.col("text")))
    return d.select("doc_id", F.size("found").alias("n_numbers"), F.array_join(F.array_sort("found"), "|").alias("numbers"))


@query("numeric_support", f"""
with q as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
  'ordered ' || l_quantity::int || ' at ' || l_extendedprice::decimal(18,2) || ', discount ' || l_discount::decimal(4,2) as quote from lineitem)
select (l_orderkey % 100) as bucket, count(*) as n,
  count_if(list_contains({S.numbers('quote')}, {S.six('l_quantity')})) as quantity_supported,
  count_if(list_contains({S.numbers('quote')}, {S.six('l_extendedprice')})) as price_supported,
  count_if(list_contains({S.numbers('quote')}, {S.six('l_linenumber')})) as line_supported
from q group by 1""")
def numeric_support(spark, sf):
    li = spread_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount").withColumn("quote", F.concat(
        F.lit("ordered "), F.col("l_quantity").cast("int").cast("string"), F.lit(" at "),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(", discount "),
        F.col("l_discount").cast("decimal(4,2)").cast("string")))
    n = lambda c: F.count_if(N.supports_number(F.col(c), F.col("quote")))
    return li.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(
        F.count("*").alias("n"), n("l_quantity").alias("quantity_supported"),
        n("l_extendedprice").alias("price_supported"), n("l_linenumber").alias("line_supported"))


@query("text_support", f"""
with q as (select conv_id, turn, {S.norm("coalesce(text, '')")} as hay,
    {S.norm("array_to_string(list_slice(string_split(text, ' '), 2, 6), ' ') || case when turn % 2 = 0 then ' completely unrelated wording' else '' end")} as needle from conversations),
w as (select *, list_filter(string_split(needle, ' '), lambda x: length(x) > 3) as words from q)
select conv_id, turn, (hay <> '' and (contains(hay, needle) or (len(words) > 0 and
  len(list_filter(words, lambda x: contains(hay, x))) * 2 >= len(words))))::int as supported from w""")
def text_support(spark, sf):
    c = spread_table(spark, sf, "conversations")
    value = F.concat(F.array_join(F.slice(F.split("text", " "), 2, 5), " "),
                     F.when(F.col("turn") % 2 == 0, F.lit(" completely unrelated wording")).otherwise(F.lit("")))
    return c.select("conv_id", "turn", N.supports(F.parse_json(X.json_text(value)), F.col("text")).cast("int").alias("supported"))


@query("content_duplicates", """
select sha256(text) as digest, count(*) as copies, min(doc_id) as first_doc, max(doc_id) as last_doc
from documents group by 1 having count(*) > 1""")
def content_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("copies > 1")


@query("content_already_held", """
with held as (select sha256(text) as digest, min(doc_id) as held_as from documents where doc_id % 2 = 0 group by 1)
select d.doc_id, coalesce(h.held_as, -1) as held_as from documents d left join held h on h.digest = sha256(d.text) where d.doc_id % 2 = 1""")
def content_already_held(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    held = d.filter("doc_id % 2 = 0").groupBy("digest").agg(F.min("doc_id").alias("held_as"))
    return d.filter("doc_id % 2 = 1").join(held, "digest", "left").select("doc_id", F.coalesce("held_as", F.lit(-1)).alias("held_as"))


_LIST = "'[' || coalesce(to_json(lang)::varchar, 'null') || ', ' || coalesce(to_json(source)::varchar, 'null') || ']'"


@query("claim_fingerprint", f"""
select doc_id, {S.fingerprint(_LIST, "text")} as fingerprint from documents""")
def claim_fingerprint(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", I.claim_fingerprint(F.to_json(F.array("lang", "source")), F.col("text")).alias("fingerprint"))


_SENTENCES = f"""
with f as (select doc_id, text, {S.flat('text')} as t from documents),
s as (select doc_id, text, list_filter(list_transform(string_split(
    regexp_replace(t, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 12) as parts from f)
"""


@query("sentence_explode", _SENTENCES + """
select doc_id, i - 1 as pos, parts[i] as sentence from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from s)""")
def sentence_explode(spark, sf):
    d = spread_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query("section_lookup", _SENTENCES + r"""
, l as (select doc_id, text, i - 1 as pos, parts[i] as sentence from (select doc_id, text, parts, unnest(range(1, len(parts) + 1)) as i from s)),
b as (select doc_id, pos, case when strpos(text, sentence) > 1 then
  substring(text, greatest(1, strpos(text, sentence) - 400), strpos(text, sentence) - greatest(1, strpos(text, sentence) - 400)) else '' end as before from l),
m as (select doc_id, pos, regexp_extract_all(before, '(?m)^(?:\d+(?:\.\d+)*\s+)?(.{3,100})$', 1) as found from b)
select doc_id, pos, coalesce(trim(found[len(found)]), '') as section from m""")
def section_lookup(spark, sf):
    d = spread_table(spark, sf, "documents", "doc_id", "text")
    d = d.select("doc_id", "text", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    return d.select("doc_id", "pos", F.coalesce(X.section_before(F.col("text"), F.col("sentence")), F.lit("")).alias("section"))


@query("title_keys", r"""
with t as (select doc_id, nullif(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')), '') as key from documents)
select key as title_key, count(*) as n, min(doc_id) as first_doc from t where key is not null group by key""")
def title_keys(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.title_key(F.col("text")).alias("title_key"))
    return d.filter("title_key is not null").groupBy("title_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("question_fold", f"select conv_id, turn, {S.fold('text')} as folded from conversations")
def question_fold(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.fold_question(F.col("text")).alias("folded"))


@query("url_identity", r"""
with u as (select page_id, url,
  case page_id % 4 when 0 then ' https://doi.org/10.' || (1000 + page_id % 500) || '/A-' || page_id when 1 then 'DOI: 10.5555/x' || page_id
    when 2 then 'not a doi ' || page_id else '' end as doi,
  case page_id % 3 when 0 then 'arXiv:2401.' || lpad(page_id::varchar, 5, '0') || 'v2' when 1 then 'https://arxiv.org/abs/ocean-ph/' || lpad(page_id::varchar, 7, '0') else url end as arxiv,
  case page_id % 3 when 0 then 'https://arxiv.org/abs/2401.' || lpad(page_id::varchar, 5, '0') when 1 then 'https://arxiv.org/abs/2401.00001v' || page_id || '/' else url end as link from pages),
k as (select *, nullif(regexp_replace(lower(trim(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '') as doi_key,
  trim(regexp_replace(lower(trim(arxiv)), '^(?:https?://arxiv\.org/abs/|arxiv:)', '')) as a from u)
select page_id, coalesce(doi_key, '') as doi_key,
  case when regexp_matches(trim(doi_key), '^10\.\d{4,9}/\S+$') then trim(doi_key) else '' end as valid_doi,
  case when regexp_matches(a, '^(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]+/\d{7})(?:v\d+)?$') then regexp_replace(a, 'v\d+$', '') else '' end as valid_arxiv,
  (link like 'https://arxiv.org/%' and not regexp_matches(link, 'v\d+/?$'))::int as unpinned,
  coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '^-+|-+$', '', 'g'), ''), 'paper') as slug
from k""")
def url_identity(spark, sf):
    p, i = table(spark, sf, "pages"), F.col("page_id")
    text = i.cast("string")
    doi = (F.when(i % 4 == 0, F.concat(F.lit(" https://doi.org/10."), (1000 + i % 500).cast("string"), F.lit("/A-"), text))
           .when(i % 4 == 1, F.concat(F.lit("DOI: 10.5555/x"), text)).when(i % 4 == 2, F.concat(F.lit("not a doi "), text)).otherwise(F.lit("")))
    arxiv = (F.when(i % 3 == 0, F.concat(F.lit("arXiv:2401."), F.lpad(text, 5, "0"), F.lit("v2")))
             .when(i % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/ocean-ph/"), F.lpad(text, 7, "0"))).otherwise(F.col("url")))
    link = (F.when(i % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(text, 5, "0")))
            .when(i % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/2401.00001v"), text, F.lit("/"))).otherwise(F.col("url")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return p.select("page_id", blank(I.doi_key(doi)).alias("doi_key"), blank(I.valid_doi(doi)).alias("valid_doi"),
                    blank(I.valid_arxiv(arxiv)).alias("valid_arxiv"), I.unpinned_arxiv(link).cast("int").alias("unpinned"),
                    X.slugify(F.col("url")).alias("slug"))


@query("preferred_hosts", """
with u as (select page_id, [url, 'https://zenodo.org/r/' || page_id, url, case when page_id % 2 = 0 then 'https://arxiv.org/pdf/' || page_id else 'https://hal.science/' || page_id end] as urls from pages),
r as (select page_id, u, i, regexp_matches(u, 'arxiv\\.org|biorxiv|essoar|hal\\.|archimer|zenodo|osti\\.gov') as known
  from (select page_id, unnest(urls) as u, unnest(range(1, 5)) as i from u)),
d as (select page_id, u, min(i) as i, bool_or(known) as known from r group by page_id, u)
select page_id, string_agg(u, ' ' order by not known, i) as ranked from d group by page_id""")
def preferred_hosts(spark, sf):
    i = F.col("page_id").cast("string")
    urls = F.array("url", F.concat(F.lit("https://zenodo.org/r/"), i), "url",
                   F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/pdf/"), i)).otherwise(F.concat(F.lit("https://hal.science/"), i)))
    return table(spark, sf, "pages").select("page_id", F.array_join(I.rank_hosts(urls), " ").alias("ranked"))


_EDITION_TEXT = """case page_id % 9 when 0 then 'arXiv:2505.08900v6 ' when 1 then 'Preprint submitted to X ' when 2 then 'Author accepted manuscript '
 when 3 then 'https://doi.org/10.1029/2024 ' when 4 then 'Received 3 May, Accepted 4 June ' when 5 then '© 2024 The Author ' when 6 then 'Vol. 21: 23 ISSN '
 when 7 then 'Ocean Sci., 21, 23-45, 2025 ' else '' end || url"""


@query("edition_classify", f"""
with t as (select page_id, lower(trim(regexp_replace({_EDITION_TEXT}, '\\s+', ' ', 'g'))) as t, lower(regexp_replace({_EDITION_TEXT} || ' ' || html, '\\s+', ' ', 'g')) as page from pages)
select page_id, coalesce({S.regex_ladder('t', V.EDITION_SIGNALS)}, '') as edition,
  concat_ws('|', {', '.join(f"case when regexp_matches(page, '{p}') then '{n}' end" for n, p in V.PUBLICATION_MARKERS)}) as markers from t""")
def edition_classify(spark, sf):
    p = spread_table(spark, sf, "pages").withColumn("t", F.expr(_EDITION_TEXT))
    marks = R.publication_markers(F.concat_ws(" ", "t", "html"))
    return p.select("page_id", F.coalesce(R.edition_of(F.col("t")), F.lit("")).alias("edition"), F.array_join(marks, "|").alias("markers"))


_LABEL = """p_name || case p_partkey % 8 when 0 then ' Sea_Ice' when 1 then ' wave forecast' when 2 then ' eddy' when 3 then ' Argo currents'
 when 4 then '' when 5 then ' ocean colour survey' when 6 then ' digital twin' else ' LLM agent' end"""


@query("domain_rules", f"""
with l as (select p_partkey, unnest([{_LABEL}, p_brand, case when p_partkey % 3 = 0 then 'sst' else p_type end]) as label, unnest([1,2,3]) as i from part),
m as (select p_partkey, i, trim(label) as token, case when trim(label) in ({', '.join(repr(d) for d in V.DOMAINS)}) then trim(label)
   else {S.contains_ladder("replace(lower(trim(label)), '_', ' ')", V.DOMAIN_RULES)} end as domain from l),
k as (select p_partkey, domain, min(i) as i from m where domain is not null group by 1, 2)
select p.p_partkey, coalesce((select string_agg(domain, '|' order by i) from k where k.p_partkey = p.p_partkey), '') as kept,
  coalesce((select string_agg(token, '|' order by i) from m where m.p_partkey = p.p_partkey and domain is null), '') as unmatched from part p""")
def domain_rules(spark, sf):
    p = table(spark, sf, "part").withColumn("labels", F.array(F.expr(_LABEL), F.col("p_brand"), F.expr("case when p_partkey % 3 = 0 then 'sst' else p_type end")))
    kept, unmatched = R.normalise_domains(F.col("labels"))
    return p.select("p_partkey", F.array_join(kept, "|").alias("kept"), F.array_join(unmatched, "|").alias("unmatched"))


_NAME = """p_name || case p_partkey % 7 when 0 then ' ERA5 (forcing)' when 1 then ' GLORYS12' when 2 then ' NATL60 run' when 3 then ' tide gauge'
 when 4 then ' Sentinel 2' when 5 then ' idealized' else '' end"""


@query("dataset_groups", f"""
with n as (select p_partkey, {_NAME} as name from part)
select coalesce({S.contains_ladder('lower(name)', [(w, g) for g, ws in V.DATASET_GROUPS.items() for w in ws])}, name) as dataset_group, count(*) as n, count(distinct name) as names
from n group by 1""")
def dataset_groups(spark, sf):
    p = table(spark, sf, "part").select(F.expr(_NAME).alias("name"))
    return p.groupBy(R.dataset_group(F.col("name")).alias("dataset_group")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


_THEME_PATH = """case p_partkey % 6 when 0 then 'training.' when 1 then 'loss.' when 2 then 'metrics.' when 3 then 'rl.' when 4 then 'future_work.' else 'misc.' end || replace(p_name, ' ', '_')"""


@query("field_labels", f"""
with t as (select {_THEME_PATH} as path from part)
select path, upper(left(split_part(path, '.', 2), 1)) || lower(replace(substring(split_part(path, '.', 2), 2), '_', ' ')) as label,
  case split_part(path, '.', 1) when 'training' then 'Training' when 'loss' then 'Loss and physics' when 'metrics' then 'Evaluation and results'
    when 'rl' then 'Reinforcement learning' when 'future_work' then 'Limitations and future work' else 'Other' end as theme,
  '/api/landing/drilldown?dimension=section&key=' || url_encode(replace(path, '_', ' ')) as drill, count(*) as n
from t group by 1, 2, 3, 4""")
def field_labels(spark, sf):
    p = table(spark, sf, "part").select(F.expr(_THEME_PATH).alias("path"))
    c = F.col("path")
    return p.groupBy("path", X.field_label(c).alias("label"), R.display_theme(c).alias("theme"),
                     X.drill_path("section", F.replace(c, F.lit("_"), F.lit(" "))).alias("drill")).agg(F.count("*").alias("n"))


@query("cell_values", r"""
with t as (select conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda p: trim(p)), lambda p: p <> '') as keys, role, text from conversations)
select conv_id, turn, len(keys) as n_keys, coalesce(keys[1], '') as first_key,
  regexp_replace(upper(trim(role || '-x  y')), '[\s\-]+', '_', 'g') as token,
  case when conv_id % 3 = 0 then '["' || role || '","b c"]' when conv_id % 3 = 1 then to_json('[' || role || ', 1]')::varchar else to_json(role)::varchar end as value_json,
  trim(regexp_replace(text, '\s+', ' ', 'g')) as entity_key, (text ilike '%en_%')::int as literal_like from
  (select *, contains(lower(text), 'en_') as hit from t)""".replace("(text ilike '%en_%')", "hit"))
def cell_values(spark, sf):
    c = table(spark, sf, "conversations").withColumn("keys", X.split_keys(F.col("text"), ","))
    cell = F.expr("case when conv_id % 3 = 0 then concat('[', chr(39), role, chr(39), ', \"b c\"]') when conv_id % 3 = 1 then concat('[', role, ', 1]') else role end")
    return c.select("conv_id", "turn", F.size("keys").alias("n_keys"), F.coalesce(F.get("keys", F.lit(0)), F.lit("")).alias("first_key"),
                    X.status_token(F.concat("role", F.lit("-x  y"))).alias("token"), X.claim_value(cell).alias("value_json"),
                    X.entity_key(F.col("text")).alias("entity_key"), X.contains_ignore_case(F.col("text"), "en_").cast("int").alias("literal_like"))


@query("edition_evidence_check", f"""
with t as (select page_id, {_EDITION_TEXT} as q, {_EDITION_TEXT} || ' ' || html as page,
   case when page_id % 9 < 2 then 'PREPRINT' when page_id % 9 = 2 then 'ACCEPTED_MANUSCRIPT' else 'VERSION_OF_RECORD' end as edition from pages),
c as (select page_id, edition, coalesce({S.regex_ladder('lower(q)', V.EDITION_SIGNALS)}, '') as proven,
  {' + '.join(f"regexp_matches(lower(page), '{p}')::int" for n, p in V.PUBLICATION_MARKERS)} as markers from t)
select page_id::varchar as slug, edition, proven, markers, (proven = edition and (edition <> 'VERSION_OF_RECORD' or markers > 0))::int as ok from c""")
def edition_evidence_check(spark, sf):
    """A page is a file of its own: many pages can have one url."""
    p = spread_table(spark, sf, "pages").withColumn("q", F.expr(_EDITION_TEXT))
    papers = p.select(F.col("page_id").cast("string").alias("slug"), F.col("page_id").cast("string").alias("source_file"), F.lit(1).alias("page_pdf"), F.col("q").alias("quote"),
                      F.expr("case when page_id % 9 < 2 then 'PREPRINT' when page_id % 9 = 2 then 'ACCEPTED_MANUSCRIPT' else 'VERSION_OF_RECORD' end").alias("edition"))
    texts = p.select(F.col("page_id").cast("string").alias("source_file"), F.lit(1).alias("page"), F.concat_ws(" ", "q", "html").alias("text"))
    return gate.edition_check(papers, texts).select("slug", "edition", F.coalesce("proven", F.lit("")).alias("proven"), "markers", *as_int("ok"))
