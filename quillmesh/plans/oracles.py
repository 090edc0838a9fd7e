"""The same answers in the SQL of another engine."""

from __future__ import annotations

from html.entities import html5

from ..functions.characters import _REFERENCE, _odd_numbers
from ..operators import profiles as R

_P = r"""
papers as (
  select doc_id as pos, lpad(cast(doc_id as varchar), 8, '0') as internal_id, source as source_db, title,
    case when doc_id % 4 = 0 or text = title then null when text[length(title) + 1] = chr(10) then substr(text, length(title) + 2) else substr(text, length(title) + 1) end as abstract,
    cast(1994 + length(title) % 33 as int) as year,
    case when doc_id % 5 = 0 then null else (case doc_id % 3 when 0 then '' when 1 then 'https://doi.org/' else 'doi:' end)
      || '10.' || cast(1000 + length(title) % 97 as varchar) || '/' || left(md5(lower(title)), 12) end as doi,
    lang as language, doc_id % 3 <> 0 as has_author, doc_id % 6 <> 0 as has_keyword,
    case when doc_id % 7 <> 0 then source end as venue,
    case when doc_id % 8 <> 0 then doc_id || '-' || (doc_id + 9) end as pages,
    case when doc_id % 2 = 0 then 'article' when doc_id % 3 = 0 then 'Conference Paper' else 'chapter' end as doc_type, text
  from (select *, left(split_part(text, chr(10), 1), 200) as title from documents))"""
_WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_NT = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'), {_WS})"
_ND = lambda c: f"case when {c} like 'https://doi.org/%' then substr({c}, 17) when {c} like 'doi:%' then substr({c}, 5) else {c} end"
_D = (
    _P
    + f""",
rich as (select pos, internal_id, source_db, nullif({_ND('doi')}, '') as norm_doi,
  cast((case when coalesce(doi, '') <> '' then 10 else 0 end) + (case when length(abstract) > 50 then 5 else 0 end) + (case when has_author then 3 else 0 end)
  + (case when has_keyword then 2 else 0 end) + (case when coalesce(venue, '') <> '' then 2 else 0 end) + 1 + (case when coalesce(pages, '') <> '' then 1 else 0 end) as int) as richness from papers),
seen as (select *, max(richness) over b as best, arg_max(internal_id, richness * 10000000000 - pos) over b as holder from rich window b as (partition by norm_doi order by pos rows between unbounded preceding and 1 preceding)),
lead as (select *, (best is null or richness > best) as leads from seen),
flags as (select pos, internal_id, source_db, norm_doi, richness,
  case when norm_doi is null then null when leads then first_value(case when leads then internal_id end ignore nulls) over (partition by norm_doi order by pos rows between 1 following and unbounded following) else holder end as duplicate_of,
  case when norm_doi is null then internal_id else arg_max(internal_id, richness * 10000000000 - pos) over (partition by norm_doi) end as canonical_id from lead)"""
)
_PROVIDER = "provider as (select pos, case when pos % 8 = 0 then 'alpha' else 'beta' end as provider, doi, title, year, text as abstract from papers)"
_CONTROLS = "(select item_id, title, '10.' || cast(1000 + length(title) % 97 as varchar) || '/' || left(md5(lower(title)), 12) as d from (select item_id, left(split_part(text, chr(10), 1), 200) as title from benchmark))"
_R = """
raters as (select doc_id, source, case when doc_id % 2 = 0 then 'TA' else 'FT' end as stage,
  case when toxic = 1 then 'exclude' when quality = 1 then 'include' else 'maybe' end as "primary",
  case when n_chars > 2000 then 'include' when n_chars > 500 then 'maybe' else 'exclude' end as verifier
  from labels join documents using (doc_id))"""
_DEC = """
decisions as (select event_id, user_id as id, ts, case event_type when 'click' then 'include' when 'purchase' then 'exclude' when 'view' then 'maybe' when 'signup' then 'pending' else 'ERROR' end as decision from events),
latest as (select * from (select *, row_number() over (partition by id order by ts desc, event_id desc) as rn from decisions) where rn = 1)"""
_C = """
criteria as (select user_id as id, cast(ts as date) as day,
  coalesce(string_agg(distinct case event_type when 'click' then 'IC1' when 'view' then 'IC2' when 'signup' then 'IC3' end, '|' order by case event_type when 'click' then 'IC1' when 'view' then 'IC2' when 'signup' then 'IC3' end), '') as matched_ic,
  coalesce(string_agg(distinct case event_type when 'purchase' then 'EC1' when 'error' then 'EC2' end, '|' order by case event_type when 'purchase' then 'EC1' when 'error' then 'EC2' end), '') as matched_ec
  from events group by all)"""
_Q = (
    _P
    + f""",
queue as (select *, case pos % 3 when 0 then 'include' when 1 then 'maybe' else 'exclude' end as decision,
  case when pos % 10 = 0 then 'IC1|IC2|IC3|IC4' when pos % 4 = 1 then 'IC1|IC3' when pos % 5 = 2 then 'IC2' else '' end as matched_ic,
  case when pos % 9 = 0 then 'https://x.org/' || pos end as oa_url, case when pos % 2 = 0 then 'https://y.org' end as url,
  case when pos % 11 = 0 then 'downloaded' when pos % 13 = 0 then 'oa_found' else 'manual' end as pdf_status from papers),
scored0 as (select *, case when pos % 10 = 0 then 4 when pos % 4 = 1 then 2 when pos % 5 = 2 then 1 else 0 end as n_ic, trim(coalesce(abstract, ''), {_WS}) <> '' as readable from queue where decision <> 'exclude'),
scored1 as (select *, (case decision when 'include' then 100 else 50 end) + 5 * n_ic + (case when readable then 8 else 0 end)
  + (case when oa_url is not null then 5 when doi is not null then 3 when url is not null then 1 else 0 end)
  + (case when year >= 2020 then 5 when year >= 2018 then 3 when year >= 2015 then 1 else 0 end) + (case when doc_type = 'article' then 3 else 0 end) as score from scored0),
scored2 as (select *, case when decision = 'include' and score >= 120 then 'A' when decision = 'include' then 'B' when readable then 'C' when n_ic > 0 then 'D' else 'E' end as band from scored1),
scored as (select *, case when oa_url is not null or pdf_status <> 'manual' then 1 when doi is not null then 2 when band = 'D' then 3 when band = 'E' then 4 else 5 end as grp from scored2)"""
)
_QA = """
qa as (select doc_id, case when doc_id % 11 <> 0 then
  (n_chars > 80)::int + contains(lower(text), 'the')::int + (n_chars > 1000)::int + contains(lower(text), 'ing')::int + (doc_id % 3 = 0)::int + (n_chars > 3000)::int + contains(lower(text), 'ou')::int + (doc_id % 7 = 0)::int end as qa_total
  from documents)"""
_K = lambda rows, by: f"""
cells as (select {by}, a, b, count(*) as n from ({rows}) group by all),
t as (select {by}, sum(n) as n, sum(case when a = b then n else 0 end) as o from cells group by all),
e as (select {by}, sum(r * c) as e from (select {by}, a as l, sum(n) as r from cells group by all) join (select {by}, b as l, sum(n) as c from cells group by all) using ({by}, l) group by all),
k as (select {by}, cast(t.n as bigint) as n, o / t.n as po, coalesce(e.e, 0) / (t.n * t.n) as pe from t left join e using ({by})),
kk as (select *, (po - pe) / nullif(1 - pe, 0) as kappa from k),
done as (select *, case when kappa < 0 then 'poor (worse than chance)' when kappa < 0.2 then 'slight' when kappa < 0.41 then 'fair' when kappa < 0.61 then 'moderate' when kappa < 0.81 then 'substantial' when kappa is not null then 'almost perfect' end as label from kk)"""  # noqa: E731
_FLAGS = "(select c_custkey, c_custkey % 2 = 0 as s2, c_custkey % 3 = 0 as s3, c_custkey % 5 = 0 as s5, c_custkey % 7 = 0 as s7 from customer)"
_RESP = """
resp as (select conv_id, turn, length(text) as n, case length(text) % 4 when 0 then 'include' when 1 then 'EXCLUDE' when 2 then 'maybe' else 'other' end as d from conversations where role = 'assistant')"""

_CAT = r"""
words as (select doc_id, source, coalesce(regexp_extract(text, '[A-Za-z]+'), '') as w, coalesce(lang, 'en') as l from documents),
catalogue as (
  select source as "database", 'q' || doc_id as id, w as label, case when doc_id % 5 = 0 then l end as notes,
    case doc_id % 4
      when 0 then 'TITLE("' || w || '")' || chr(10) || '  AND (LIMIT-TO(DOCTYPE, "ar") OR LIMIT-TO ( DOCTYPE, "cp"))' || chr(10) || '  AND (LIMIT-TO(LANGUAGE, "' || upper(l) || '"))'
      when 1 then '"All Metadata":"' || w || '" AND "All Metadata" : "' || l || '"'
      when 2 then '"' || w || '" "' || l || '"'
      else w || ' limit-to(x) ' || l end as query
  from words)"""
# by the form that a query was written in
_FORMS = r"""select 'q' || doc_id as id,
  case doc_id % 4 when 0 then 'TITLE("' || w || '") AND (LANGUAGE(' || lower(l) || '))' when 3 then case when lower(w) = 'and' then l else ltrim(w || ' ' || l) end else (select query from catalogue c where c.id = 'q' || doc_id) end as limits_out,
  case when doc_id % 4 = 0 then 'ar,cp' end as kinds,
  case when doc_id % 4 = 1 then '"' || w || '" AND "' || l || '"' else (select trim(query) from catalogue c where c.id = 'q' || doc_id) end as plain,
  coalesce((select string_agg('keyword:"' || t || '"', ' AND ' order by i) from (select unnest(x) as t, generate_subscripts(x, 1) as i from (select regexp_extract_all((select query from catalogue c where c.id = 'q' || doc_id), '"([^"]+)"', 1) as x))), ltrim(w || ' limit-to(x) ' || l)) as keywords
from words"""


def _hit(terms):
    return f"regexp_matches(t, '{terms}')"


def _first(rules, otherwise):
    return "case " + " ".join(f"when {_hit(p)} then '{label}'" for label, p in rules) + f" else '{otherwise}' end"


def _all(rules):
    return "list_filter([" + ", ".join(f"case when {_hit(p)} then '{label}' end" for label, p in rules) + "], lambda x: x is not null)"


def _joined(rules, otherwise, sep=", ", sentence=False):
    text = f"array_to_string({_all(rules)}, '{sep}')"
    return f"case when len({_all(rules)}) = 0 then '{otherwise}' else " + (f"upper(left({text}, 1)) || lower(substr({text}, 2)) || '.'" if sentence else text) + " end"


def _map(of):
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return f"map([{', '.join(map(text, of))}], [{', '.join(map(text, of.values()))}])"


def _unescaped(table, key, c):
    """``references``: key and h of each row, a column's text with all character references read as HTML does, with or without a semicolon."""
    short = _map({k: v for k, v in html5.items() if not k.endswith(";")})
    digits = "rtrim(substr(x, 3), ';')"
    number = f"case when lower(left(x, 3)) = '&#x' then nullif('0x' || ltrim(substr({digits}, 2), '0'), '0x') else nullif(ltrim({digits}, '0'), '') end"
    return rf"""
given as materialized (select {key}, {c}, row_number() over () as k from {table}),
names as materialized (select {_map(html5)} as named, {short} as short, {_map(_odd_numbers())} as odd),
found as (select distinct unnest(regexp_extract_all({c}, '&[^\t\n\f <&;]+;?')) as x from given where contains({c}, '&')),
cut as (select distinct (regexp_extract_all(x, '{_REFERENCE}'))[1] as x from found),
plain as (select x, case when left(x, 2) = '&#' then coalesce(try_cast({number} as bigint), case when {number} is null then 0 else 1114112 end) end as n,
  list_filter(list_reverse(range(2, greatest(length(x) - 1, 2))), lambda i: short[substr(x, 2, i)] is not null)[1] as size, named, short, odd from cut, names),
texts as (select x, case when n > 1114111 or n between 55296 and 57343 then chr(65533) when n is not null then coalesce(odd[n::varchar], chr(n::int)) else coalesce(named[substr(x, 2)], short[substr(x, 2, size)] || substr(x, 2 + size), x) end as y from plain),
pieces as (select k, unnest(l) as p, generate_subscripts(l, 1) as i from (select k, regexp_extract_all({c}, '{_REFERENCE}') as l from given where contains({c}, '&'))),
joined as (select k, string_agg(coalesce(y, p), '' order by i) as h from pieces left join texts on p = x group by k),
"references" as (select {key}, coalesce(h, {c}) as h from given left join joined using (k))"""


# what counts as white space in any script
_SPACES = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_STEPS = "markov|petri net|simulation|monte carlo"
_PROFILE = f"""{_P}, texts as (select *, lower(title || ' ' || coalesce(abstract, '')) as t from papers),
profiled as (select pos, title, abstract, t, {_first(R.RELEVANCE, R.RELEVANCE_ELSE)} as relevance, {_joined(R.METHODS, R.METHODS_ELSE, sentence=True)} as method, {_first(R.EVIDENCE, R.EVIDENCE_ELSE)} as evidence,
  {_joined(R.LIMITS, R.LIMITS_ELSE, '; ', True)} as limitations, {_joined(R.CONTEXTS, R.CONTEXTS_ELSE, sentence=True)} as context, {_joined(R.DATA_SOURCES, R.DATA_SOURCES_ELSE, sentence=True)} as data_source, {_first(R.TECHNIQUE, R.TECHNIQUE_ELSE)} as technique,
  case when not {_hit(R.SOFTWARE)} then 'excluir' when {_hit(R.MINING)} or {_hit(R.STOCHASTIC)} then 'incluir' else 'talvez' end as decision, {_joined(R.QUESTIONS, 'RQ1')} as questions, {_joined(R.PHASES, 'Não definido')} as phases, {_all(R.CRITERIA)} as ics,
  case when {_hit(R.MINING)} and {_hit('markov')} and {_hit('simulation|monte carlo')} and {_hit('machine learning|reinforcement learning|ai|nlp')} then 'L3' when {_hit(R.MINING)} and {_hit(_STEPS)} then 'L2' when {_hit(R.MINING)} or {_hit(_STEPS)} then 'L1' else 'L0' end as level,
  'Relevância ' || {_first(R.VERDICT, 'média')} || ' para a revisão. ' || {_first(R.STRENGTH, R.STRENGTH_ELSE)} || '.' as assessment from texts),
judged as (select *, case decision {" ".join(f"when '{k}' then '{v}'" for k, v in R.REASONS.items())} end as reason,
  case when decision = 'excluir' and not {_hit(R.SOFTWARE_STRICT)} then list_append(ics, 'EC1') when decision = 'excluir' and len(ics) = 0 then ['EC3'] when decision = 'talvez' and len(ics) = 0 then ['EC3?'] else ics end as tags,
  case when decision = 'incluir' and (relevance like 'Alta:%' or relevance like 'Média-alta:%') then 'Alta' when decision = 'talvez' or evidence = '{R.EVIDENCE_ELSE}' then 'Média' else 'Baixa' end as priority from profiled)"""
_CLEAN = rf"trim(regexp_replace(replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '-' || chr(10), ''), '\n{{2,}}', chr(10) || chr(10), 'g'), {_WS})"


def _inferred():
    tests = ("n_chars > 80", "contains(lower(text), 'the')", "n_chars > 1000", "contains(lower(text), 'ing')", "doc_id % 3 = 0", "n_chars > 3000", "contains(lower(text), 'ou')", "doc_id % 7 = 0")
    known = "known as (select doc_id, " + ", ".join(f"case when doc_id % 11 <> 0 then ({t})::int end as qa{i}" for i, t in enumerate(tests, 1)) + " from documents)"
    asked = {k: f"regexp_matches(u, '{p}')" for k, p in R.QUALITY.items()}
    asked["qa1"] = f"length(trim(coalesce(abstract, ''), {_WS})) > 80"
    asked["qa3"] += " or not contains(lower(data_source), 'não identificada')"
    asked["qa4"] += " or not contains(lower(technique), 'não identificada')"
    asked["qa5"] = f"evidence in ('{R.EVIDENCE[0][0]}', '{R.EVIDENCE[1][0]}')"
    asked["qa6"] = "not contains(lower(limitations), 'não ficaram explícitas')"
    items = ", ".join(f"coalesce(qa{i}, ({asked[f'qa{i}']})::int) as qa{i}" for i in range(1, 9))
    whole = "lower(concat_ws(' ', title, coalesce(abstract, ''), '', '', evidence, data_source, technique, context))"
    return f"with {_PROFILE}, {known}, j as (select *, {whole} as u from judged join known on pos = doc_id) select pos, {items}, '{R.QA_NOTE}' as qa_notes, case when qa1 is null then 'inferido' else 'manual' end as qa_status from j"


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    rows = found["enrich_by_doi"]
    found["enrich_summary"] = f"with x as ({rows}), o as (select coalesce(abstract_source, 'own') as source, coalesce(abstract_match_type, 'own') as kind from x where n_chars is not null), r as (select source, kind, count(*) as n from o group by rollup (source, kind)) select source, kind, n, n / (select max(n) from r) as share from r"
    return found


def _oracle_sql() -> dict[str, str]:
    return {
        "papers_by_source": f"with {_D} select source_db, count(*) as raw, count(*) filter (duplicate_of is null) as unique_records from flags group by 1",
        "duplicate_rate": f"with {_D} select count(*) as raw, count(duplicate_of) as removed, count(*) - count(duplicate_of) as unique_records, count(duplicate_of) / count(*) as rate from flags",
        "dedup_flags": f"with {_D} select pos, internal_id, norm_doi, richness, duplicate_of, canonical_id, duplicate_of is not null as is_duplicate from flags",
        "norm_titles": f"with {_P} select pos, {_NT('title')} as ascii, left(trim(regexp_replace(lower(title), '\\s+', ' ', 'g'), {_WS}), 120) as ws120, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') as slug, split_part(title, ' ', 1) as \"first\", case when contains(title, ',') then trim(split_part(title, ',', 1), {_WS}) else list_last(regexp_split_to_array(trim(title, {_WS}), '\\s+')) end as \"last\" from papers",
        "norm_dois": f"with {_P} select pos, {_ND('doi')} as doi, ltrim(ltrim(lower(doi), 'https://doi.org/'), 'http://dx.doi.org/') as stripped, replace(lower(doi), 'https://doi.org/', '') as replaced from papers",
        "missing_abstracts": f"with {_P} select pos, doi is not null as has_doi, trim(title, {_WS}) <> '' as has_title from papers where trim(coalesce(abstract, ''), {_WS}) = ''",
        "enrich_by_doi": f"""with {_P}, {_PROVIDER},
asks as (select pos, {_ND('doi')} as d, row_number() over (partition by {_ND('doi')} order by pos) as rn from papers where doi is not null and trim(coalesce(abstract, ''), {_WS}) = ''),
offers as (select {_ND('doi')} as d, abstract, provider, row_number() over (partition by {_ND('doi')} order by case provider when 'beta' then 0 else 1 end, abstract) as rn from provider where doi is not null and trim(coalesce(abstract, ''), {_WS}) <> ''),
got as (select a.pos, trim(o.abstract, {_WS}) as abstract, o.provider from asks a join offers o on a.d = o.d and a.rn = 1 and o.rn = 1)
select p.pos, length(coalesce(nullif(trim(p.abstract, {_WS}), ''), g.abstract)) as n_chars, g.provider as abstract_source, case when g.provider is not null then 'doi' end as abstract_match_type from papers p left join got g using (pos)""",
        "catalogue_listing": f"with {_CAT} select \"database\", count(*) over () as n_queries, id, label, notes, query from catalogue where \"database\" = 'src0'",
        "request_forms": f"with {_CAT} {_FORMS}",
        "escaped_dois": f"with {_P} select pos, replace(doi, '/', '\\/') as escaped from papers",
        "enrich_working_set": f"""with {_P}, {_PROVIDER},
mine as (select pos, doi, coalesce(nullif(trim(abstract, {_WS}), ''), case when pos % 9 = 0 then nullif(trim(title, {_WS}), '') end) as abstract from papers),
asks as (select pos, {_ND('doi')} as d, row_number() over (partition by {_ND('doi')} order by pos desc) as rn from mine where doi is not null and abstract is null),
offers as (select {_ND('doi')} as d, abstract, provider, row_number() over (partition by {_ND('doi')} order by provider, abstract) as rn from provider where doi is not null and trim(coalesce(abstract, ''), {_WS}) <> ''),
got as (select a.pos, trim(o.abstract, {_WS}) as abstract, o.provider from asks a join offers o on a.d = o.d and a.rn = 1 and o.rn = 1)
select m.pos, length(coalesce(m.abstract, g.abstract)) as n_chars, g.provider as abstract_source from mine m left join got g using (pos)""",
        "enrich_first_source": f"""with {_P}, {_PROVIDER},
mine as (select pos, doi, coalesce(nullif(trim(abstract, {_WS}), ''), case when pos % 9 = 0 then nullif(trim(title, {_WS}), '') end) as abstract from papers),
asks as (select pos, {_ND('doi')} as d, row_number() over (partition by {_ND('doi')} order by pos desc) as rn from mine where doi is not null and abstract is null),
offers as (select {_ND('doi')} as d, abstract, provider, row_number() over (partition by {_ND('doi')} order by provider, abstract) as rn from provider where doi is not null and trim(coalesce(abstract, ''), {_WS}) <> '' and provider = 'alpha'),
got as (select a.pos, trim(o.abstract, {_WS}) as abstract, o.provider from asks a join offers o on a.d = o.d and a.rn = 1 and o.rn = 1)
select m.pos, length(coalesce(m.abstract, g.abstract)) as n_chars, g.provider as abstract_source from mine m left join got g using (pos)""",
        "resume_pending": f"with {_DEC} select c_custkey as id from customer where c_custkey not in (select id from latest where decision <> 'ERROR')",
        "aux_corpus": f"with {_P} select pos, source_db from papers where pos not in (select doc_id from labels where quality = 1)",
        "working_set": f"with {_P} select source_db, language, count(*) as n from papers where source_db <> 'src0' and source_db in (select source_db from papers where language = 'en') group by all",
        "two_key_lookup": f"with {_P}, t as (select nullif({_ND('doi')}, '') as d, nullif({_NT('title')}, '') as t, 'v' || pos as label, pos from papers), bd as (select d, arg_min(label, pos) as label from t where d is not null group by 1), bt as (select t, arg_min(label, pos) as label from t where t is not null group by 1) select p.pos, coalesce(bd.label, bt.label) as label from papers p left join bd on nullif({_ND('p.doi')}, '') = bd.d left join bt on nullif({_NT('p.title')}, '') = bt.t",
        "new_candidates": f"with {_P}, f as (select pos, year, {_ND('doi')} as d, {_NT('title')} as t from papers), known as (select d, {_NT('title')} as t from {_CONTROLS}), fresh as (select * from f where length(t) > 5 and (d is null or d not in (select d from known where d is not null)) and t not in (select t from known)), one as (select * from (select *, row_number() over (partition by d order by pos) as rn from fresh) where rn = 1 or d is null), two as (select * from (select *, row_number() over (partition by t order by pos) as rt from one) where rt = 1) select pos, year from two",
        "title_blocks": f"with {_P}, t as (select pos, year, split_part({_NT('title')}, ' ', 1) as word, array_to_string(list_sort(string_split({_NT('title')}, ' ')), ' ') as s from papers where {_NT('title')} <> ''), j as (select a.year, a.word, levenshtein(a.s, b.s) as lev, 8 * (length(a.s) + length(b.s)) as budget, abs(length(a.s) - length(b.s)) as gap from t a join t b on a.year = b.year and a.word = b.word and a.pos < b.pos), v as (select year, word, 100 * gap > budget or 100 * lev > budget as far, 200 * lev <= budget as near from j) select year, word, count(*) as pairs, count(*) filter (not far and near) as accepted, count(*) filter (far) as rejected from v group by all",
        "ft_queue": f"with {_Q} select pos, score, band, row_number() over (order by score desc, title, pos) as rank from scored",
        "priority_groups": f"with {_Q} select grp, band, count(*) as n, min(score) as low, max(score) as high from scored group by all",
        "prisma_snapshot": f"with {_Q} select decision, band, pdf_status, grouping(decision, band, pdf_status) as level, count(*) as n from scored group by grouping sets ((decision), (band), (decision, pdf_status), ())",
        "criteria_counts": f"with {_C}, x as (select id, unnest(string_split(matched_ec, '|')) as c from criteria) select c, count(*) as n, count(distinct id) as ids from x where c <> '' group by 1",
        "dominant_exclusions": f"with {_C} select coalesce(nullif(split_part(matched_ec, '|', 1), ''), '<missing>') as dominant, count(*) as n from criteria group by 1",
        "criteria_combinations": f"with {_C} select contains(matched_ic, 'IC1') as ic1, contains(matched_ic, 'IC2') as ic2, contains(matched_ic, 'IC3') as ic3, contains(matched_ic, 'IC1')::int + contains(matched_ic, 'IC2')::int + contains(matched_ic, 'IC3')::int as matched, count(*) as n from criteria group by all",
        "stratified_sample": f"with {_R}, s as (select doc_id, \"primary\", count(*) over (partition by \"primary\") as n, row_number() over (partition by \"primary\" order by md5(doc_id || '|20260428'), doc_id) as rn from raters) select doc_id, \"primary\" from s where rn <= greatest(1, round_even(n * 0.2, 0))",
        "simple_sample": f"with {_P} select pos, source_db from papers order by md5(pos || '|20260428'), pos limit 200",
        "confusion_matrix": f'with {_R} select "primary", verifier, count(*) as n from raters group by all',
        "kappa": f"with {_R}, {_K('select stage, \"primary\" as a, verifier as b from raters', 'stage')} select stage, n, po, pe, kappa, label from done",
        "kappa_binary": f"with {_R}, {_K('select 1 as g, case when \"primary\" = $$include$$ then 1 else 0 end as a, case when verifier = $$include$$ then 1 else 0 end as b from raters', 'g')} select n, po, pe, kappa, label from done",
        "disagreements": f"with {_R} select doc_id, stage, \"primary\", verifier, (\"primary\" = 'include') <> (verifier = 'include') as binary_disagreement, case when stage = 'FT' then 0 else 1 end as place from raters where \"primary\" <> verifier",
        "qa_scores": f"with {_QA} select doc_id, qa_total, qa_total >= 4 as qa_include from qa",
        "qa_summary": f"with {_QA} select count(*) as n, count(qa_total) as assessed, count(*) filter (qa_total >= 4) as passed, count(*) filter (qa_total < 4) as failed, avg(qa_total) as mean, stddev_samp(qa_total) as sd, quantile_cont(qa_total, 0.25) as q1, quantile_cont(qa_total, 0.5) as median, quantile_cont(qa_total, 0.75) as q3 from qa",
        "qa_tiers": f"with {_QA} select origin, count(qa_total) as assessed, count(*) filter (qa_total >= 4) as passed, count(*) filter (qa_total >= 4) / count(qa_total) as retention from (select *, case when doc_id % 2 = 0 then 'main' else 'auxiliary' end as origin from qa) group by rollup (origin)",
        "qa_merge": f"with {_QA}, o as (select doc_id, qa_total, case when doc_id % 5 = 0 then 'manual' else 'scored' end as status from qa where doc_id % 3 <> 0), n as (select doc_id, qa_total + 1 as qa_total from qa where doc_id % 2 = 0) select doc_id, case when o.status = 'manual' then o.qa_total else coalesce(n.qa_total, o.qa_total) end as qa_total, case when o.status = 'manual' then 'manual' when n.qa_total is not null then 'scored' else o.status end as status from o full join n using (doc_id)",
        "parse_decisions": f"with {_RESP} select conv_id, turn, conv_id % 7 <> 0 as parsed, case when conv_id % 7 = 0 then 'maybe' when d = 'other' then 'maybe' else lower(d) end as decision, case when conv_id % 7 = 0 then '' else n::varchar end as rationale, case when conv_id % 7 = 0 then '' else 'IC' || (n % 4 + 1) end as matched_ic, '' as matched_ec from resp",
        "evidence_policy": f"with {_Q}, m as (select pos, decision, trim(coalesce(abstract, ''), {_WS}) = '' as missing from queue) select pos, case when missing and decision = 'include' then 'maybe' else decision end as decision, case when missing then 'missing_abstract' else 'verified_abstract' end as evidence_status, case when missing then case when pos % 2 = 0 then 'a_tag|b_tag|full_text_required|insufficient_abstract' else 'full_text_required|insufficient_abstract' end when pos % 2 = 0 then 'b_tag|a_tag' else '' end as evidence_tags, case when missing then 'low' else 'high' end as confidence, missing as manual_review_required, case when missing and decision = 'include' then 'why Abstract missing: include lowered, needs review.' else ' why ' end as rationale from m",
        "ledger_latest": f"with {_DEC} select id, decision, event_id from latest",
        "ledger_summary": f"with {_DEC} select count(*) as n, count(*) filter (decision = 'include') as included, count(*) filter (decision = 'maybe') as maybe, count(*) filter (decision = 'exclude') as excluded, count(*) filter (decision = 'ERROR') as errors from latest",
        "daily_progress": f"with {_DEC} select cast(ts as date) as day, decision, count(*) as n from decisions group by all",
        "citation_expand": "with e as (select l_orderkey as citing, l_partkey as cited from lineitem), s as (select p_partkey as seed from part where p_partkey % 20 = 0), f as (select distinct seed, citing as found, 'forward' as way from e join s on cited = seed), b as (select distinct seed, e.cited as found, 'co-cited' as way from (select citing, seed from e join s on cited = seed) w join e using (citing) where e.cited <> seed) select seed, way, count(*) as n from (select * from f union all select * from b) group by all",
        "seed_topk": "select p_partkey, coalesce(n, 0) as n, p_size from part left join (select l_partkey, count(*) as n from lineitem group by 1) on p_partkey = l_partkey order by coalesce(n, 0) desc, p_size desc, p_partkey limit 20",
        "clusters": f"with {_C}, x as (select id, 'ic1_ic2' as cluster from criteria where contains(matched_ic, 'IC1') and contains(matched_ic, 'IC2') union all select id, 'ic1_ic3' from criteria where contains(matched_ic, 'IC1') and contains(matched_ic, 'IC3') and not contains(matched_ic, 'IC2') union all select id, 'ic2_ic3' from criteria where contains(matched_ic, 'IC2') and contains(matched_ic, 'IC3') union all select id, 'all' from criteria) select cluster, count(*) as n, count(distinct id) as ids from x group by 1",
        "clean_markup": f"with {_unescaped('pages', 'page_id', 'html')}, c as (select page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '{_SPACES}', ' ', 'g'), {_WS}) as h from \"references\") select page_id, length(h) as n, md5(h) as digest from c",
        "relevance_filter": f"with {_P}, t as (select pos, year, lower(title || ' ' || coalesce(abstract, '')) as t from papers) select pos, year from t where (contains(t, 'tion') or contains(t, 'ing ') or contains(t, 'que ')) and (contains(t, 'the') or contains(t, 'des') or contains(t, 'der')) and year between 1994 and 2026",
        "ris_lines": f"with {_P}, r as (select internal_id, array_to_string(list_filter(['TY  - ' || case when doc_type = 'Conference Paper' then 'CPAPER' when doc_type = 'chapter' then 'CHAP' else 'JOUR' end, 'TI  - ' || title, case when has_author then 'AU  - ' || split_part(title, ' ', 1) end, 'PY  - ' || year, case when abstract <> '' then 'AB  - ' || abstract end, case when venue is not null then case when doc_type = 'article' then 'JF  - ' else 'T2  - ' end || venue end, 'DO  - ' || doi, 'SP  - ' || split_part(pages, '-', 1), 'EP  - ' || split_part(pages, '-', 2), case when has_keyword then 'KW  - ' || language end, 'N1  - Source: ' || source_db, 'ER  - '], lambda x: x is not null), chr(10)) as ris from papers) select internal_id, md5(ris) as digest, length(ris) - length(replace(ris, chr(10), '')) + 1 as n from r",
        "bibtex_entries": f"with {_P}, a as (select *, case when has_author then split_part(title, ' ', 1) end as au from papers), k as (select *, coalesce(regexp_replace(case when contains(au, ',') then trim(split_part(au, ',', 1), {_WS}) else list_last(regexp_split_to_array(trim(au, {_WS}), '\\s+')) end, '[^A-Za-z0-9]', '', 'g'), 'anon') || year || left(split_part({_NT('title')}, ' ', 1), 8) as citekey from a) select internal_id, citekey, md5('@' || case when doc_type = 'article' then 'article' else 'inproceedings' end || '{{' || citekey || ',' || chr(10) || array_to_string(list_filter([case when title <> '' then '  title     = {{' || title || '}}' end, case when au <> '' then '  author    = {{' || au || '}}' end, '  year      = {{' || year || '}}', case when doc_type = 'article' then '  journal   = {{' else '  booktitle = {{' end || venue || '}}', '  doi       = {{' || doi || '}}', '  pages     = {{' || pages || '}}', case when abstract <> '' then '  abstract  = {{' || left(abstract, 500) || case when length(abstract) > 500 then '...' else '' end || '}}' end], lambda x: x is not null), ',' || chr(10)) || chr(10) || '}}') as digest from k",
        "year_histogram": f"with {_P} select year, count(*) as n, repeat('#', cast(least(count(*) // 2, 40) as int)) as bar from papers group by year",
        "doc_types": f"with {_P} select doc_type, case doc_type when 'Conference Paper' then 'conference paper' when 'chapter' then 'book chapter' else 'article' end as kind, count(*) as n from papers group by all",
        "source_labels": f"with {_P} select source_db, language, count(*) as n, arg_min(title, pos) as first_title from papers group by all",
        "sensitivity": f"with {_R}, a as (select count(*) as n, count(*) filter (\"primary\" = 'include') as inc, count(*) filter (\"primary\" = 'maybe') as may, (select count(*) from documents) as total from raters), b as (select *, inc / n * total as expected, (inc + may) / n * total as upper from a) select *, expected / inc as ratio, case when expected / inc <= 0.05 then 'unlikely' when expected / inc <= 0.2 then 'modest' else 'substantial' end as reading from b",
        "source_hit_rate": f"select source, count(*) filter (hit) as hits, count(*) as n from (select 's2' as source, s2 as hit from {_FLAGS} union all select 's3', s3 from {_FLAGS} union all select 's5', s5 from {_FLAGS} union all select 's7', s7 from {_FLAGS} union all select 'any', s2 or s3 or s5 or s7 from {_FLAGS}) group by 1",
        "first_source": f"select c_custkey, case when s7 then 's7' when s5 then 's5' when s3 then 's3' when s2 then 's2' end as source, s7 or s5 or s3 or s2 as recovered from {_FLAGS}",
        "vocab_warnings": "with k as (select event_id, props->>'$.k' as k from events) select event_id, case when k is null then 'missing small' when cast(k as int) > 80 then 'invalid small: ' || k else '' end as warnings, k is null or cast(k as int) > 80 as needs_review from k",
        "inverted_index_text": "select doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') as text from documents where len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 0",
        "request_batches": f"with {_P}, o as (select *, floor((row_number() over (order by pos) - 1) / 50)::bigint as batch_no from papers) select pos, batch_no, md5('Title: ' || coalesce(nullif(trim(title, {_WS}), ''), '(none)') || chr(10) || 'Text: ' || coalesce(left(abstract, 400), '(missing)')) as digest from o",
        "reading_list": f"with {_Q} select pos, 3 * contains(matched_ic, 'IC1')::int + 3 * contains(matched_ic, 'IC2')::int + 2 * contains(matched_ic, 'IC3')::int + contains(matched_ic, 'IC4')::int + 2 * (pdf_status = 'downloaded')::int + (year >= 2020)::int + (venue is not null)::int as score from queue order by score desc, pos limit 30",
        "stage_status": f"with {_D} select count(*) as n, 'raw' as stage from papers union all select count(*) filter (duplicate_of is null), 'unique' from flags union all select count(*) filter (pos % 3 <> 2), 'queued' from papers union all select count(*) filter (pos % 3 = 0), 'included' from papers",
        "manifest_status": "select case o_orderstatus when 'F' then 'downloaded' when 'O' then 'oa_found' else 'manual' end as status, count(*) as n, count(distinct o_custkey) as ids from orders group by 1",
        "control_hits": f"with c as (select item_id, {_NT('text')} as key from benchmark), d as (select doc_id, source, {_NT('line')} as key from (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents)), h as (select item_id, string_agg(distinct source, '|' order by source) as sources, min(doc_id) as first_doc, count(distinct doc_id) as docs from d join c using (key) group by 1) select item_id, sources, first_doc, coalesce(docs, 0) as docs from c left join h using (item_id)",
        "sentence_profile": rf"with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: length(x) > 20) as s from documents) select doc_id, len(s) as n, coalesce(s[1], '') as first from s",
        "usable_urls": "select page_id, url from pages where coalesce(url, '') <> '' and not contains(url, 'dx.doi.org/') and not contains(url, 'doi.org/10.') and not contains(url, 'example.org')",
        "text_profile": f"with {_PROFILE} select pos, relevance, method, evidence, limitations, context, data_source, technique, decision, reason, questions, case when len(tags) = 0 then 'Requer decisão manual' else array_to_string(tags, ', ') end as criteria, phases, level, priority, assessment from judged",
        "qa_inferred": _inferred(),
        "cleaned_text": f"with c as (select doc_id, {_CLEAN} as c from documents) select doc_id, length(c) as n, md5(c) as digest from c",
        "abstract_proxy": f"with c as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), {_WS}) as c from documents), s as (select doc_id, c, trim(left(c, 500), {_WS}) as s from c) select doc_id, case when length(s) >= 80 and not regexp_matches(lower(c), '^({'|'.join(R.COVER_PAGES).replace('.', '[.]')})') then s else '' end as abstract from s",
        "payload_entries": f"with {_P} select 'https://www.scopus.com/record/display.uri?eid=' || internal_id as url, trim(title, {_WS}) as title, doi, year, case doc_type when 'Conference Paper' then 'conference paper' else doc_type end as doc_type, pages, venue, case when has_keyword then coalesce(language, '') else '' end as keywords, md5(trim(abstract, {_WS})) as abstract from papers",
        "citation_pages": "select l_orderkey as seed, case when l_linenumber % 2 = 0 then 'backward' else 'forward' end as direction, l_partkey::varchar as title, l_orderkey::varchar as doi from lineitem",
        "result_routes": f"with {_RESP} select conv_id, turn, case when conv_id % 7 = 0 then 'error' when n % 4 = 3 then 'review' else 'good' end as route, case when conv_id % 7 <> 0 and n % 4 = 3 then 'IC4 needs review' end as review_reason from resp",
        "review_artefacts": f"with {_Q}, a as (select *, 'pending' as artefact from scored where decision = 'maybe' union all select *, 'prioritised' from scored where decision = 'maybe' union all select *, 'doi_without_file' from scored where decision = 'maybe' and doi is not null and pdf_status = 'manual' union all select *, 'included' from scored where decision = 'include') select artefact, count(*) as n, min(internal_id) as first_id, max(score) as best from a group by artefact",
        "manual_retrieval": f"with {_Q} select internal_id, year, title, doi, pdf_status from queue where pdf_status = 'manual'",
    }
