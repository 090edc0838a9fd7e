"""SQL of the workflow's queries; matching by similarity has none and is held to brute force in the tests."""

from __future__ import annotations

from . import review
from .oracles import _CONTROLS, _D, _ND, _P, _PROVIDER, _Q, _R, _RESP, _WS

_B = lambda c: f"nullif(trim({c}, {_WS}), '')"
_NT = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'), {_WS})"
_SNAP = """
snap as (select doc_id as pos, case when toxic = 1 then 'exclude' when quality = 1 then 'include' else 'pending' end as ft_decision, case when quality = 1 then 'https://old.org/' || doc_id end as ft_oa_url,
  'seen ' || doc_id as ft_rationale, case when quality = 1 then 'high' else 'low' end as ft_confidence, 'kept ' || doc_id as kept from labels)"""
_WORK = f"""{_Q}, {_SNAP},
worked as (select q.*, s.ft_decision, s.ft_oa_url, s.ft_rationale, s.ft_confidence, case when pdf_status = 'downloaded' then 'f' || pos || '.pdf' end as pdf_file,
  case when ft_confidence = 'high' then 'found' end as main_finding, {_B('q.abstract')} as own from queue q left join snap s using (pos))"""
_SCORE = """(case decision when 'include' then 100 else 50 end) + 5 * n_ic + (case when readable then 8 else 0 end) + (case when oa is not null then 5 when doi is not null then 3 when url is not null then 1 else 0 end)
  + (case when year >= 2020 then 5 when year >= 2018 then 3 when year >= 2015 then 1 else 0 end) + (case when doc_type = 'article' then 3 else 0 end)"""
_BAND = "case when decision = 'include' and score >= 120 then 'A' when decision = 'include' then 'B' when readable then 'C' when n_ic > 0 then 'D' else 'E' end"
_N_IC = "case when pos % 10 = 0 then 4 when pos % 4 = 1 then 2 when pos % 5 = 2 then 1 else 0 end"
_REBUILT = f"""{_WORK},
re0 as (select w.*, s.kept, coalesce(own, s.kept) as now, coalesce(w.ft_oa_url, w.oa_url) as oa, {_N_IC} as n_ic, coalesce(own, s.kept) is not null as readable from worked w left join snap s using (pos) where decision <> 'exclude'),
re1 as (select *, {_SCORE} as score from re0), rebuilt as (select *, {_BAND} as band from re1)"""
_UNDECIDED = "coalesce(ft_decision, '') = ''"


def oracle_sql() -> dict[str, str]:
    no = review.NOTE
    return {
        "queue_rebuilt": f"with {_REBUILT} select pos, decision, length(now) as n_chars, coalesce(ft_decision, '') as ft_decision, coalesce(ft_confidence, '') as ft_confidence, oa as oa_url, score from rebuilt",
        "open_urls_filled": f"""with {_Q}, offers as (select {_ND('doi')} as d, min('https://oa.org/' || pos) as u from papers where doi is not null and length(title) % 2 = 0 group by 1),
lasts as (select {_ND('doi')} as d, max(pos) as pos from queue where decision <> 'exclude' and doi is not null and oa_url is null group by 1), got as (select pos, u from lasts join offers using (d)),
a as (select q.*, coalesce(q.oa_url, g.u) as oa, {_N_IC} as n_ic, {_B('q.abstract')} is not null as readable from queue q left join got g using (pos) where decision <> 'exclude'),
b as (select *, {_SCORE} as score from a), c as (select *, {_BAND} as band from b) select pos, oa as oa_url, score, band, row_number() over (order by score desc, title, pos) as rank from c""",
        "first_stage_statistics": f"with {_Q}, m as (select case when {_B('abstract')} is null and decision = 'include' then 'maybe' else decision end as decision, {_B('abstract')} is null as missing from queue), c as (select count(*) as total, count(*) filter (decision = 'include') as include, count(*) filter (decision = 'exclude') as exclude, count(*) filter (decision = 'maybe') as maybe, count(*) filter (missing) as missing_abstract from m) select *, 100 * include / total as include_pct, 100 * exclude / total as exclude_pct, 100 * maybe / total as maybe_pct, total - include - exclude - maybe as undecided, missing_abstract as manual_review from c",
        "second_stage_statistics": f"with {_REBUILT} select band, count(*) as total, count(*) filter (decision = 'include') as first_include, count(*) filter (decision = 'maybe') as first_maybe, count(now) as with_abstract, count(oa) as with_url, count(doi) as with_doi, count(*) filter (ft_decision = 'include') as included, count(*) filter (ft_decision = 'exclude') as excluded, count(*) filter (ft_decision = 'pending') as pending, count(*) filter ({_UNDECIDED}) as undecided, 100 * count(ft_decision) / count(*) as progress_pct from rebuilt group by band",
        "recovery_summary": f"""with {_P}, {_PROVIDER},
asks as (select pos, {_ND('doi')} as d, row_number() over (partition by {_ND('doi')} order by pos) as rn from papers where doi is not null and {_B("coalesce(abstract, '')")} is null),
offers as (select {_ND('doi')} as d, provider, row_number() over (partition by {_ND('doi')} order by case provider when 'beta' then 0 else 1 end, abstract) as rn from provider where doi is not null and {_B("coalesce(abstract, '')")} is not null),
got as (select o.provider as step, count(*) as n from asks a join offers o on a.d = o.d and a.rn = 1 and o.rn = 1 group by 1)
select step, n, 100 * n / (select sum(n) from got) as of_recovered_pct, 100 * n / (select count(*) from papers) as of_queue_pct from got""",
        "coverage_gain": f"with {_REBUILT}, x as (select s.band, s.readable as b, r.now is not null as a from scored s left join rebuilt r using (pos)) select band, count(*) as papers, count(*) filter (b) as before, count(*) filter (a and not b) as gained, count(*) filter (a) as after, 100 * count(*) filter (a) / count(*) as after_pct from x group by band",
        "level_distribution": f"with {_WORK}, x as (select case when decision <> 'exclude' then 'L' || ({_N_IC}) else 'unknown' end as l, coalesce(ft_confidence, 'unknown') as c from worked) select 'level' as kind, l as value, count(*) as n from x group by l union all select 'confidence', c, count(*) from x group by c",
        "disagreement_counts": f"with {_R} select stage, count(*) as n, count(*) filter ((\"primary\" = 'include') <> (verifier = 'include')) as binary from raters where \"primary\" <> verifier group by stage",
        "input_profile": f"with {_WORK} select count(*) as rows, count(pdf_file) as with_file, cast(floor(100 * count(pdf_file) / count(*)) as bigint) as with_file_pct, count(*) - count(pdf_file) as without_file, count(distinct case when pos in (select doc_id from labels where quality = 1) then pos end) as flagged from worked",
        "overview_by_part": f"with {_D}, x as (select 'all' as part, duplicate_of from flags union all select case when source_db = 'src0' then 'control' else 'primary' end, duplicate_of from flags) select part, count(*) as raw, count(*) - count(duplicate_of) as unique_records, count(duplicate_of) as removed, count(duplicate_of) / count(*) as rate from x group by part",
        "search_figures": f"""with {_D}, x as (select source_db, source_db || '-' || (pos % 3) as q, pos % 3 as k, year, doc_type, duplicate_of from flags join papers using (pos, source_db)),
n as (select *, case when source_db = 'src0' then 'known items, not a search' end as note from x)
select 'part' as section, 'all' as key, null as label, count(*) as raw, count(*) - count(duplicate_of) as unique_records from n
union all select 'part', case when source_db = 'src0' then 'control' else 'primary' end as p, null, count(*), count(*) - count(duplicate_of) from n group by p
union all select 'source', source_db, note, count(*), count(*) - count(duplicate_of) from n group by source_db, note
union all select 'query', source_db || '/' || q, case when k < 2 then 'query ' || k || ' of ' || source_db else note end, count(*), count(*) - count(duplicate_of) from n group by source_db, q, k, note
union all select 'year', year::varchar, null, count(*), count(*) - count(duplicate_of) from n group by year
union all select 'type', doc_type, null, count(*), count(*) - count(duplicate_of) from n group by doc_type""",
        "citation_network": """with e as (select distinct 'order ' || l_orderkey as citing, 'part ' || l_partkey as cited from lineitem),
steps as (select citing as parent, cited as id, 0 as rank from e union all select cited, citing, 1 from e),
seeds as (select 'part ' || p_partkey as id from part where p_brand = 'Brand#11'),
one as (select id, 1 as depth, min((parent, rank)) as f, count(distinct parent) as n from steps where parent in (select id from seeds) and id not in (select id from seeds) group by id),
two as (select id, 2 as depth, min((parent, rank)) as f, count(distinct parent) as n from steps where parent in (select id from one) and id not in (select id from one) and id not in (select id from seeds) group by id),
x as (select * from one union all select * from two),
works as (select 'part ' || p_partkey as id, p_name as title, null::int as year from part union all select 'order ' || o_orderkey, o_orderpriority, year(o_orderdate) from orders)
select x.id, depth, f[1] as parent, case f[2] when 0 then 'backward' else 'forward' end as way, n as n_parents, title, year from x left join works w on w.id = x.id""",
        "work_targets": f"with {_WORK} select pos, coalesce(ft_decision = 'include', false) or (decision = 'include' and {_UNDECIDED}) as download, decision = 'maybe' and own is not null and {_UNDECIDED} as rescreen, decision <> 'exclude' and own is not null as rescreen_all, {_UNDECIDED} as blank, pdf_file is not null and main_finding is null as extract_file, pdf_file is null and main_finding is null and (own is not null or {_B('title')} is not null) as extract_text, pdf_file is not null and coalesce(ft_decision, '') in ('', 'pending') as pending from worked",
        "marked_pending": f"with {_WORK}, h as (select *, doi is null and {_UNDECIDED} as hit from worked) select pos, case when hit then 'pending' else ft_decision end as ft_decision, case when hit then '{no}' else ft_rationale end as ft_rationale, case when hit then 'low' else ft_confidence end as ft_confidence, case when hit then 'missing_pdf' end as ft_evidence_status, case when hit then 'true' end as ft_manual_review_required from h",
        "content_routes": f"with {_WORK} select pos, case when pdf_file is not null and {_B('text')} is not null then 'file' when own is not null then 'abstract' else 'title' end as origin, md5(coalesce(case when pdf_file is not null then {_B('text')} end, own, title)) as digest from worked",
        "title_membership": f"with {_P}, c as (select d, {_B('lower(title)')} as t from {_CONTROLS}) select pos, coalesce({_B('lower(doi)')} in (select d from c), false) or coalesce({_B('lower(title)')} in (select t from c where t is not null), false) as known from papers",
        "id_states": f"with {_WORK} select pos, case when pdf_file is not null then 'mapped' when pos in (select doc_id from labels where toxic = 1) then 'missing' else 'unidentified' end as state, pdf_file from worked",
        "extraction_sheet": f"with {_WORK}, m as (select distinct d.doc_id as pos, d.source as authors, d.lang as venue, d.n_chars::varchar as pages, case when d.n_chars > 500 then {_B('d.text')} end as a, true as known from documents d join labels using (doc_id)), t as (select w.pos, w.matched_ic, w.year, coalesce(m.authors, '') as authors, coalesce(m.venue, '') as venue, coalesce(m.pages, '') as pages, length(coalesce(m.a, w.abstract, '')) as n_chars, case when pdf_file is null then 'não' else 'sim' end as pdf_available, coalesce(pdf_file, '') as pdf_file, '' as main_finding from worked w left join m using (pos) where decision = 'include') select * exclude (year), row_number() over (order by pdf_available = 'não', matched_ic, year, pos) as place from t",
        "first_links": f"with {_P}, i as (select {_ND('doi')} as d, arg_min(case length(title) % 3 when 1 then 'https://files.org/' || pos else 'https://p.org/' || pos end, pos) as url from papers where doi is not null group by 1) select pos, url from papers join i on {_ND('doi')} = d",
        "responses_joined": f"with {_RESP} select conv_id as pos, turn, case when conv_id % 7 = 0 or d = 'other' then 'maybe' else lower(d) end as decision, source as source_db from resp left join documents on conv_id = doc_id",
        "lookup_by_kind": f"with {_P}, {_SNAP} select p.pos, case when doc_type = 'article' then 'aux' else 'recovered' end as kind, case when doc_type = 'article' then s.ft_decision else g.url end as note from papers p left join snap s using (pos) left join (select page_id as pos, min(url) as url from pages group by 1) g on g.pos = p.pos",
        "target_union": f"with {_P}, {_SNAP} select pos, ft_oa_url as url, null::int as n_chars, 'recovered' as origin from snap where ft_oa_url is not null union all select pos, null, length(abstract), 'aux' from snap left join papers using (pos) where ft_decision = 'include'",
        "merged_scores": f"with {_P}, o as (select doc_id as pos, 'old ' || doc_id as t, quality as q, case when toxic = 1 then 'manual' else 'avaliado_llm' end as s from labels), n as (select doc_id as pos, case when n_chars > 300 then n_chars % 9 end as q, true as scored from documents) select pos, coalesce(t, title) as title, case when s = 'manual' then o.q else coalesce(n.q, o.q) end as qa_total, case when s = 'manual' or scored is null then s else 'avaliado_llm' end as qa_status from o full join n using (pos) left join papers using (pos)",
        "quality_json": "with x as (select doc_id, n_chars as n, n_chars % 7 = 0 as broken from documents) select doc_id, case when not broken then (n % 3 >= 1)::int end as qa1, case when not broken then (n % 2 = 1)::int end as qa2, case when not broken then case n % 5 when 2 then 1 when 3 then 0 when 4 then 0 end end as qa3, null::int as qa4 from x",
        "tag_lists": rf"with x as (select doc_id, source, list_distinct_in_order from (select doc_id, source, list_filter([trim(regexp_replace(lower(lang), '[^a-z0-9]+', '_', 'g'), '_'), trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_')], lambda v: v in {review.ALLOWED}) as list_distinct_in_order from documents)) select doc_id, array_to_string(list_distinct_in_order, '|') as tags, case when trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') in {review.ALLOWED} then trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') else 'unclear' end as kind from x",
        "file_slugs": rf"with {_P}, s as (select pos, regexp_replace(lower(trim(regexp_replace(regexp_replace(strip_accents(coalesce(nullif(title, ''), 'untitled')), '[^\x00-\x7f]', '', 'g'), '[^\w\s-]', '', 'g'), {_WS})), '[\s_-]+', '_', 'g') as s from papers) select pos, rtrim(left(s, 50), '_') as slug from s",
        "search_links": f"with {_P} select pos, 'https://scholar.google.com/scholar?q=' || url_encode('\"' || title || '\"') as link from papers",
        "clean_cells": r"with c as (select doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as c from documents) select doc_id, length(c) as n, md5(c) as digest from c",
        "percent_by_source": f"with {_P} select source_db, printf('%.2f%%', 100 * (count(doi) / count(*))) as with_doi from papers group by 1",
        "file_decisions": f"with {_WORK} select pos, ft_decision, 'pdf_full_text' as ft_evidence_status, 'false' as ft_manual_review_required from worked where pdf_file is not null",
        "download_outcomes": f"with {_Q}, t as (select pos, 1 as r, 'unpaywall' as s, oa_url as u, length(title) % 5 = 0 as saved from queue where oa_url is not null union all select pos, 2, 'core', url, length(title) % 3 = 0 from queue where url is not null), b as (select *, row_number() over (partition by pos order by case when saved then 0 else 1 end, r) as rn from t) select q.pos, case when s is null then 'manual' when saved then 'downloaded' else 'oa_found' end as pdf_status, s as pdf_source, u as oa_url from queue q left join b on b.pos = q.pos and rn = 1",
        "audit_routes": f"with {_WORK}, x as (select w.*, l.toxic = 1 as wrong, l.quality = 1 as good from worked w left join labels l on l.doc_id = w.pos) select pos, case when wrong then 'wrong_file' when good then 'rescreened' else 'unchanged' end as route, case when wrong then null else pdf_file end as pdf_file, case when wrong then 'exclude' when good then 'include' else ft_decision end as ft_decision, case when wrong then 'EC5' end as matched_ec from x",
        "closed_queue": f"with {_WORK}, x as (select *, coalesce(ft_decision, '') in ('', 'pending') and own is null and pdf_file is null as closes from worked) select pos, case when closes then 'exclude' else ft_decision end as ft_decision, case when closes then 'EC5' end as matched_ec from x",
        "sequential_ids": f"with {_P}, n as (select pos, (row_number() over (order by year, pos) - 1)::varchar as n from papers) select pos, 'snow_' || case when length(n) >= 5 then n else lpad(n, 5, '0') end as internal_id from n",
        "included_order": f"with {_Q} select pos, row_number() over (order by year desc nulls last, title desc, pos desc) as place from queue where decision = 'include'",
        "response_status": f"with {_RESP} select conv_id, turn, case when turn % 3 = 0 then 'failed' when conv_id % 7 = 0 then 'unparsed' else 'parsed' end as state, case when turn % 3 = 0 then null when conv_id % 7 = 0 or d = 'other' then 'maybe' else lower(d) end as decision from resp",
        "title_exact_matches": f"with {_P}, {_PROVIDER}, o as (select provider, {_NT('title')} as t, min({_B('abstract')}) as a from provider where {_B('abstract')} is not null group by 1, 2) select pos, provider, length(a) as n_chars from papers join o on {_NT('papers.title')} = t where t <> ''",
    }
