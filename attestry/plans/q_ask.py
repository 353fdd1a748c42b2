"""Queries over questions and rule extraction. Conversation turns ask, documents are the papers."""

from pyspark.sql import functions as F

from attestry.functions.text import fold_question
from attestry.operators import ask as K
from attestry.operators import extract as X
from attestry.plans import sqltext as S
from attestry.plans.registry import as_int, query, spread_table, table
from attestry.session import kept


def experiments(spark, sf):
    """A document is an experiment: its first words name task, family, method and variable."""
    d = spread_table(spark, sf, "documents", "doc_id", "source", "lang", "text").withColumn("t", F.split(fold_question(F.col("text")), " "))
    word = lambda i: F.nullif(F.get("t", F.lit(i)), F.lit(""))
    return d.select(
        F.col("source").alias("slug"), F.col("doc_id").alias("ord"), word(0).alias("task"), word(1).alias("family"), F.nullif(F.array_join(F.slice("t", 3, 2), " "), F.lit("")).alias("method"),
        F.array(F.concat_ws(" ", "lang", F.lit("set"))).alias("datasets"), word(5).alias("variable"),
        F.expr("array_compact(array(if(doc_id % 2 = 0, 'learning_rate', null), if(doc_id % 3 = 0, 'loss', null), if(doc_id % 5 = 0, 'hardware', null)))").alias("reported"),
        F.expr("if(doc_id % 4 = 0, array('M'), cast(array() as array<string>))").alias("metrics"))


_EXTRA = "case conv_id % 9 when 0 then ' learning rate loss' when 1 then ' best limitation data' when 2 then ' résultats rmse' when 3 then ' gpu' when 4 then ' uncertainty' when 5 then ' ranking' else '' end"


def questions(spark, sf):
    c = spread_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat(F.coalesce("text", F.lit("")), F.expr(_EXTRA)).alias("text"))


_E = f"""d as (select doc_id, source, lang, string_split({S.fold('text')}, ' ') as t from documents),
e as (select source as slug, doc_id as ord, nullif(t[1], '') as task, nullif(t[2], '') as family, nullif(array_to_string(t[3:4], ' '), '') as method, lang || ' set' as ds, nullif(t[6], '') as variable, doc_id % 2 = 0 as r_lr, doc_id % 3 = 0 as r_loss, doc_id % 5 = 0 as r_hw, (doc_id % 4 = 0)::int as nres from d),
voc as (select distinct kind, {S.fold('name')} as key, name from (select 'task' as kind, task as name from e union all select 'family', family from e union all select 'method', method from e union all select 'dataset_group', ds from e union all select 'variable', variable from e) where name is not null),
q as (select conv_id * 1000 + turn as question_id, ' ' || {S.fold(f"coalesce(text, '') || {_EXTRA}")} || ' ' as f from conversations),
h as (select distinct question_id, kind, name from q join voc on length(key) >= 3 and contains(f, ' ' || key || ' '))"""
_HAS = lambda ws: "(" + " or ".join(f"contains(trim(f), '{w}')" for w in ws) + ")"


@query("question_vocabulary", f"with {_E} select kind, key, name from voc")
def question_vocabulary(spark, sf):
    return K.vocabulary(experiments(spark, sf), synonyms=False)


def parsed(spark, sf):
    return K.parse(questions(spark, sf), K.vocabulary(experiments(spark, sf)))


def held(spark, sf):
    """Parsed questions and the experiments, both stored: texts are folded once and do not move again."""
    e = kept(experiments(spark, sf), "experiments")
    return kept(K.parse(questions(spark, sf), kept(K.vocabulary(e), "vocabulary")), "parsed"), e


def _parsed_sql():
    from attestry.functions import vocabulary as V

    fixed = ", ".join([f"('task', '{w}', '{n}')" for n, w in V.TASK_WORDS.items()] + [f"('family', '{w}', '{n}')" for w, n in V.FAMILY_WORDS.items()])
    names = lambda table_: ", ".join(f"case when {_HAS(ws)} then '{n}' end" for n, ws in table_.items())
    kinds = ", ".join(f"coalesce(list_sort(list(name) filter (kind = '{k}')), []) as {k}" for k in K.KINDS)
    return f"""{_E.replace("from voc)", "from voc)").replace("h as (select distinct question_id, kind, name from q join voc on", f"voc2 as (select * from voc union select * from (values {fixed})), h as (select distinct question_id, kind, name from q join voc2 on")},
hk as (select question_id, {kinds} from h group by 1),
p0 as (select q.question_id, list_filter([{names(V.FIELD_WORDS)}], lambda x: x is not null) as fields, list_filter([{names(V.THEME_WORDS)}], lambda x: x is not null) as themes,
  {', '.join(f'coalesce({k}, []) as {k}' for k in K.KINDS)}, {_HAS(V.LIMITATION_WORDS)} as lim, {_HAS(V.RESULT_WORDS)} as res, {_HAS(V.RANKING_WORDS)} as rank from q left join hk using (question_id)),
p as (select * replace (lim or len(themes) > 0 as lim), len(task) + len(family) + len(method) + len(dataset_group) + len(variable) as nf,
  len(fields) + len(themes) + len(task) + len(family) + len(method) + len(dataset_group) + len(variable) > 0 or lim or res as understood from p0)"""


_P = _parsed_sql()


@query("question_parse", f"with {_P} select question_id, {', '.join(f'''array_to_string({k}, '|') as {k}''' for k in ('fields', 'themes', *K.KINDS))}, lim::int as asks_for_limitations, res::int as asks_for_results, rank::int as asks_for_ranking, understood::int as understood from p")
def question_parse(spark, sf):
    p = parsed(spark, sf)
    return p.select("question_id", *[F.array_join(k, "|").alias(k) for k in ("fields", "themes", *K.KINDS)], *as_int("asks_for_limitations", "asks_for_results", "asks_for_ranking", "understood"))


_A = f"""{_P}, x as (select p.question_id, e.* from p join e on understood and (len(p.task) = 0 or list_contains(p.task, e.task)) and ((len(p.family) = 0 and len(p.method) = 0) or coalesce(list_contains(p.family, e.family), false) or coalesce(list_contains(p.method, e.method), false))
  and (len(p.dataset_group) = 0 or list_contains(p.dataset_group, e.ds)) and (len(p.variable) = 0 or coalesce(list_contains(p.variable, e.variable), false))),
s as (select p.question_id, any_value(p.fields) as fields, any_value(lim) as lim, any_value(res) as res, count(x.ord) as n, count(distinct x.slug) as papers, count_if(r_lr) as learning_rate, count_if(r_loss) as loss, count_if(r_hw) as hardware, coalesce(sum(nres), 0) as results from p left join x using (question_id) where understood group by 1),
li as (select source as slug, case lang when 'en' then 'DATA' when 'fr' then 'UNCERTAINTY' else 'PHYSICS' end as theme from documents),
lb as (select p.question_id, count(li.slug) as n from p left join li on (len(p.themes) = 0 or list_contains(p.themes, li.theme)) and (p.nf = 0 or li.slug in (select x.slug from x where x.question_id = p.question_id)) where understood and lim group by 1),
b as (select question_id, 'matched' as block, 'experiments' as item, n, papers as "of" from s union all select question_id, 'training', f, case f when 'learning_rate' then learning_rate when 'loss' then loss when 'hardware' then hardware else 0 end, n from (select *, unnest(fields) as f from s)
 union all select question_id, 'results', 'measured', results, n from s where res union all select question_id, 'experiments', 'listed', n, papers from s where len(fields) = 0 and not res and not lim union all select question_id, 'limitations', 'items', n, 0 from lb)"""


def limitations(spark, sf):
    return table(spark, sf, "documents").selectExpr("source as slug", "case lang when 'en' then 'DATA' when 'fr' then 'UNCERTAINTY' else 'PHYSICS' end as theme")


@query("question_answer", f'with {_A} select question_id, block, item, n::bigint as n, "of"::bigint as "of" from b')
def question_answer(spark, sf):
    p, e = held(spark, sf)
    return K.answers(p, e, limitations(spark, sf))


@query("question_caveats", f"""with {_A}, z as (select count(*) as shared from (select o_custkey from orders group by 1 having count(*) > 1000000000)),
c as (select question_id, 'RANKING_NOT_COMPUTABLE' as caveat from p where understood and rank union all select question_id, 'RESULTS_DO_NOT_COMPARE' from p where understood and res union all select question_id, 'ONLY_STATED_LIMITATIONS' from p where understood and lim
 union all select question_id, 'NOTHING_UNDERSTOOD' from p where not understood union all select distinct question_id, 'SETTING_NOT_REPORTED_BY_ALL' from b where block = 'training' and n < "of") select * from c""")
def question_caveats(spark, sf):
    p, e = held(spark, sf)
    shared = table(spark, sf, "orders").groupBy("o_custkey").count().filter("count > 1000000000").agg(F.count("*").alias("shared"))
    return K.caveats(p, K.answers(p, e, limitations(spark, sf)), shared)


_X = f"""{_P}, x as (select p.question_id, e.slug, e.ord from p join e on understood and nf > 0 and (len(p.task) = 0 or list_contains(p.task, e.task)) and ((len(p.family) = 0 and len(p.method) = 0) or coalesce(list_contains(p.family, e.family), false) or coalesce(list_contains(p.method, e.method), false))
  and (len(p.dataset_group) = 0 or list_contains(p.dataset_group, e.ds)) and (len(p.variable) = 0 or coalesce(list_contains(p.variable, e.variable), false)))"""


@query("question_values", f"""with {_X},
s as (select source as slug, doc_id as ord, case doc_id % 3 when 0 then 'loss' when 1 then 'learning_rate' else 'hardware' end as field, n_chars::varchar as value_json from documents)
select * from (select p.question_id, s.slug, s.ord, s.field, s.value_json, row_number() over (partition by p.question_id, s.field order by s.slug, s.ord) as rank from p join x using (question_id) join s on s.slug = x.slug and s.ord = x.ord and list_contains(p.fields, s.field)) where rank <= 40
union all select p.question_id, a.slug, a.ord, a.field, a.value_json, a.place as rank from p join (select *, row_number() over (partition by field order by slug, ord) as place from s join (select slug, ord from e) using (slug, ord)) a on a.place <= 40 and list_contains(p.fields, a.field) where understood and nf = 0""")
def question_values(spark, sf):
    settings = table(spark, sf, "documents").selectExpr("source as slug", "doc_id as ord", "case doc_id % 3 when 0 then 'loss' when 1 then 'learning_rate' else 'hardware' end as field", "cast(n_chars as string) as value_json")
    return K.training_values(*held(spark, sf), settings).select("question_id", "slug", "ord", "field", "value_json", "rank")


@query("question_results", f"""with {_X},
r as (select source as slug, doc_id as ord, i as pos, case i when 0 then 'M' else 'N' end as metric, n_chars + i as value from (select *, unnest(range(n_chars % 3 + 1)) as i from documents)),
c as (select p.question_id, r.* from p join x using (question_id) join r on r.slug = x.slug and r.ord = x.ord where p.res
  union all select p.question_id, a.* from p join (select * from r order by slug, ord, pos limit 40) a on true where understood and p.res and nf = 0)
select *, row_number() over (partition by question_id order by slug, ord, pos) as rank from c qualify rank <= 40""")
def question_results(spark, sf):
    """Every document has one to three results."""
    r = table(spark, sf, "documents").selectExpr("source as slug", "doc_id as ord", "n_chars", "explode(sequence(0, cast(n_chars % 3 as int))) as pos")
    r = r.selectExpr("slug", "ord", "pos", "if(pos = 0, 'M', 'N') as metric", "n_chars + pos as value")
    return K.result_values(*held(spark, sf), r).select("question_id", "slug", "ord", "pos", "metric", "value", "rank")


@query("question_experiments", f"""with {_X}
select p.question_id, e.slug, e.ord, e.task, e.family, coalesce(e.method, '') as method, coalesce(e.variable, '') as variable,
  concat_ws('|', case when r_lr then 'learning_rate' end, case when r_loss then 'loss' end, case when r_hw then 'hardware' end) as reported, row_number() over (partition by p.question_id order by e.slug, e.ord) as place
from p join x using (question_id) join e on e.slug = x.slug and e.ord = x.ord where len(p.fields) = 0 and not p.res and not p.lim qualify place <= 40""")
def question_experiments(spark, sf):
    out = K.experiment_values(*held(spark, sf))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("question_id", "slug", "ord", "task", "family", text("method"), text("variable"), F.array_join("reported", "|").alias("reported"), F.col("rank").alias("place"))


@query("question_limitations", f"""with {_X},
li as (select source as slug, doc_id as pos, case lang when 'en' then 'DATA' when 'fr' then 'UNCERTAINTY' else 'PHYSICS' end as theme, n_chars % 30 as page from documents),
c as (select p.question_id, li.* from p join li on (len(p.themes) = 0 or list_contains(p.themes, li.theme)) and (p.nf = 0 or li.slug in (select x.slug from x where x.question_id = p.question_id)) where understood and lim)
select *, row_number() over (partition by question_id order by slug, pos) as rank from c qualify rank <= 40""")
def question_limitations(spark, sf):
    li = table(spark, sf, "documents").selectExpr("source as slug", "doc_id as pos", "case lang when 'en' then 'DATA' when 'fr' then 'UNCERTAINTY' else 'PHYSICS' end as theme", "n_chars % 30 as page")
    return K.limitation_values(*held(spark, sf), li).select("question_id", "slug", "pos", "theme", "page", "rank")


# --- extraction -------------------------------------------------------------------------

_TEXT = """text || case doc_id % 6 when 0 then '. The learning rate of 0.0' || (doc_id % 4) || ' was fixed. A batch size of ' || (doc_id % 64) || ' is used.' when 1 then '. Here we used Set A, Set B and Set C for training runs. The learning rate was 0.001 there. The learning rate was 0.002 later.'
 when 2 then '. Our model uses a transformer or a U-Net. ReLU and gelu units are activation function choices. A key limitation is the data.' when 3 then '. Trained on years 1990 to 2000; it ran for 50 epochs.' else '' end"""


def pages(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "source", "text").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page"), F.expr(_TEXT).alias("text"))


def _rule_sql():
    from attestry.functions import vocabulary as V

    trim = lambda x: rf"regexp_replace({x}, '^[ ;:,.\x{{a0}}]+|[ ;:,.\x{{a0}}]+$', '', 'g')"
    out = []
    for n, (p, path, is_list) in enumerate(V.EXTRACTION_RULES):
        raw = f"regexp_extract(sentence, '(?i){p}', 1)"
        text = trim(raw)
        value = (f"to_json(list_filter(list_transform(string_split_regex({text}, ',|;| and '), lambda i: trim(i)), lambda i: i <> ''))::varchar" if is_list
                 else f"try_cast({text} as bigint)::varchar" if path == "training.batch_size" else f"to_json({text})::varchar")
        out.append(f"select source, doc_id as page, pos, {n} as rule, '{path}' as field_path, {value} as value_json from s where {raw} <> ''")
    found = lambda p: f"list_distinct(regexp_extract_all(sentence, '(?i){p}'))"
    # distinct in order of appearance
    found = lambda p: f"list_filter(regexp_extract_all(sentence, '(?i){p}'), lambda x, i: list_position(regexp_extract_all(sentence, '(?i){p}'), x) = i)"
    k = len(V.EXTRACTION_RULES)
    out.append(f"select source, doc_id, pos, {k}, 'architecture.activations', to_json({found(V.ACTIVATION_NAMES)})::varchar from s where regexp_matches(lower(sentence), 'relu|gelu|activation function') and len({found(V.ACTIVATION_NAMES)}) > 0")
    out.append(f"select source, doc_id, pos, {k + 1}, 'architecture.family', to_json({found(V.FAMILY_NAMES)})::varchar from s where len({found(V.FAMILY_NAMES)}) > 0")
    out.append(f"select source, doc_id, pos, {k + 2}, 'limitations.author_reported', to_json(sentence)::varchar from s where regexp_matches(lower(sentence), 'limitation|future work|remains a challenge')")
    return f"""f as (select doc_id, source, {S.flat(_TEXT)} as t from documents), sp as (select doc_id, source, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 12) as parts from f),
s as (select doc_id, source, i - 1 as pos, parts[i] as sentence from (select *, unnest(range(1, len(parts) + 1)) as i from sp)), v as ({' union all '.join(out)})"""


_V = _rule_sql()


@query("rule_extraction", f"with {_V} select source as source_file, page, pos, rule, field_path, value_json from v where value_json is not null")
def rule_extraction(spark, sf):
    return X.extract(X.page_sentences(pages(spark, sf), sections=False)).select("source_file", "page", "pos", "rule", "field_path", "value_json")


_F = f"""{_V}, r as (select source, field_path, value_json, arg_min(struct_pack(page, pos, rule), (page, pos, rule)) as f, count(*) as times from v where value_json is not null group by 1, 2, 3),
w as (select *, count(*) over (partition by source, field_path) as alternatives, row_number() over (partition by source, field_path order by f.page, f.pos, f.rule) = 1 as is_first from r)"""


@query("rule_extract_conflict", f"with {_F} select source as source_file, field_path, value_json, f.page as page, f.pos as pos, f.rule as rule, times, alternatives, case when alternatives > 1 then 'CONFLICT' else 'NOT_VERIFIED' end as status, is_first::int as is_first from w")
def rule_extract_conflict(spark, sf):
    out = X.fold_conflicts(X.extract(X.page_sentences(pages(spark, sf), sections=False)))
    return out.select("source_file", "field_path", "value_json", "page", "pos", "rule", "times", "alternatives", "status", *as_int("is_first"))


@query("extraction_report", f"""with {_F}, p as (select source, count(*) as pages from documents group by 1), n as (select source, count(distinct field_path) as fields, count_if(alternatives > 1) as conflicting_values from w group by 1)
select source as source_file, pages, 1 as readable, coalesce(fields, 0) as fields, coalesce(conflicting_values, 0) as conflicting_values, case when fields is null then 'NO_SUPPORTED_CLAIM' else '' end as warning from p left join n using (source)""")
def extraction_report(spark, sf):
    p = pages(spark, sf)
    out = X.extraction_report(p, X.fold_conflicts(X.extract(X.page_sentences(p, sections=False))))
    return out.select("source_file", "pages", "fields", "conflicting_values", F.coalesce("warning", F.lit("")).alias("warning"), *as_int("readable"))


@query("access_classification", """with w as (select page_id, 'd' || page_id as doi, page_id % 11 <> 0 as resolved, page_id % 7 as n_urls, page_id % 13 = 0 as present from pages), a as (select page_id, o, (page_id + o) % 3 = 0 as ok, length(html) * (o + 1) as n_bytes, sha256(html || o) as h from pages, (select unnest([0, 1, 2, 3, 4]) as o)),
held as (select distinct sha256(html || '0') as h from pages where page_id % 2 = 0), f as (select page_id, arg_min(h, o) as h from a where o < 4 and ok and n_bytes >= 3000 group by 1)
select w.doi, case when not resolved then 'UNRESOLVED' when n_urls = 0 then 'NO_OA_PDF' when present then 'ALREADY_PRESENT' when f.h in (select h from held) then 'DUPLICATE' when f.h is not null then 'DOWNLOADED' else 'BLOCKED' end as status from w left join f using (page_id)""")
def access_classification(spark, sf):
    return _access(spark, sf)


def _access(spark, sf):
    p = table(spark, sf, "pages")
    works = p.selectExpr("'d' || page_id as doi", "page_id % 11 <> 0 as resolved", "page_id % 7 as n_urls", "page_id % 13 = 0 as present")
    attempts = p.selectExpr("page_id", "html", "explode(array(0, 1, 2, 3, 4)) as ord").selectExpr("'d' || page_id as doi", "ord", "(page_id + ord) % 3 = 0 as magic_ok", "length(html) * (ord + 1) as n_bytes", "sha2(html || ord, 256) as sha256")
    return X.classify_access(works, attempts, p.filter("page_id % 2 = 0").selectExpr("sha2(html || '0', 256) as sha256"), least_bytes=3000)


@query("access_report", """with w as (select page_id, page_id % 11 <> 0 as resolved, page_id % 7 as n_urls, page_id % 13 = 0 as present from pages), a as (select page_id, o, (page_id + o) % 3 = 0 as ok, length(html) * (o + 1) as n_bytes, sha256(html || o) as h from pages, (select unnest([0, 1, 2, 3, 4]) as o)),
held as (select distinct sha256(html || '0') as h from pages where page_id % 2 = 0), f as (select page_id, arg_min(h, o) as h from a where o < 4 and ok and n_bytes >= 3000 group by 1),
s as (select case when not resolved then 'UNRESOLVED' when n_urls = 0 then 'NO_OA_PDF' when present then 'ALREADY_PRESENT' when f.h in (select h from held) then 'DUPLICATE' when f.h is not null then 'DOWNLOADED' else 'BLOCKED' end as status from w left join f using (page_id))
select count(*) as indexed, count_if(status in ('DOWNLOADED', 'ALREADY_PRESENT', 'DUPLICATE')) as reachable, count_if(status = 'BLOCKED') as blocked, count_if(status = 'NO_OA_PDF') as no_oa, count_if(status = 'UNRESOLVED') as unresolved, count_if(status in ('BLOCKED', 'NO_OA_PDF', 'UNRESOLVED')) as unreachable from s""")
def access_report(spark, sf):
    from attestry.operators.analytics import access_report as report

    return report(_access(spark, sf))


@query("metadata_flattening", """select page_id as key, 'T ' || page_id as title, 'Ann ' || page_id || '|Bo' as authors, case when page_id % 3 = 0 then -1 else 2000 + page_id % 20 end as year, case when page_id % 2 = 0 then 'J' else '' end as venue, url as publisher_url, case when page_id % 5 = 0 then '' else url || '.pdf' end as pdf_url from pages""")
def metadata_flattening(spark, sf):
    doc = """to_json(named_struct('title', array('T ' || page_id, 'second'), 'author', array(named_struct('given', ' Ann ', 'family', cast(page_id as string)), named_struct('given', cast(null as string), 'family', 'Bo'), named_struct('given', ' ', 'family', '')),
      'published', named_struct('date-parts', if(page_id % 3 = 0, array(), array(array(2000 + page_id % 20, 5)))), 'container-title', if(page_id % 2 = 0, array('J'), cast(array() as array<string>)), 'URL', url, 'DOI', 5,
      'link', array(named_struct('content-type', 'text/html', 'URL', 'x'), named_struct('content-type', if(page_id % 5 = 0, 'text/xml', 'application/pdf'), 'URL', url || '.pdf'))))"""
    m = table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.parse_json(F.expr(doc)).alias("v"))
    out = X.flatten_metadata(m).filter("doi is null")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("key", "title", F.array_join("authors", "|").alias("authors"), F.coalesce("year", F.lit(-1)).alias("year"), blank("venue"), "publisher_url", blank("pdf_url"))


@query("fetch_worklist", "select 'd' || page_id as doi, case when page_id % 3 = 0 then '' else left(url, 200) end as title from pages where page_id % 4 <> 0")
def fetch_worklist(spark, sf):
    p = table(spark, sf, "pages").selectExpr("case page_id % 8 when 0 then null when 4 then '' else 'd' || page_id end as doi",
        "if(page_id % 3 = 0, '{broken', to_json(named_struct('paper', named_struct('title', named_struct('value', url))))) as record_json")
    return X.fetch_worklist(p)
