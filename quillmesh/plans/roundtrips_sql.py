"""SQL of what the round trips through files must give back."""

from __future__ import annotations

from .oracles import _DEC, _ND, _NT, _P, _R, _WS, _unescaped

_ONE = lambda c: rf"nullif(trim(regexp_replace(regexp_replace({c}, '[{{}}]', '', 'g'), '\s+', ' ', 'g'), {_WS}), '')"
_B = lambda c: f"nullif(trim({c}, {_WS}), '')"
_FLAT = f"{_P}, flat as (select * exclude (title, abstract), {_ONE('title')} as title, {_ONE('abstract')} as abstract from papers)"
_WORD = "split_part(title, ' ', 1)"
_READ = "case when has_author then 1 else 0 end as n_authors, case when has_keyword then language else '' end as keywords"
_SNAP = "(select doc_id as pos, case when toxic = 1 then 'exclude' when quality = 1 then 'include' else 'pending' end as ft_decision from labels)"
_WHO = f"case when has_author then {_B(_WORD)} end"


def oracle_sql() -> dict[str, str]:
    return {
        "source_ris": f"with {_FLAT} select title, doi, year, venue, pages, case when pos % 2 = 0 then 'JOUR' when pos % 3 = 0 then 'CPAPER' else 'CHAP' end as doc_type, {_READ}, md5(abstract) as abstract from flat",
        "source_bibtex": f"with {_FLAT}, t as (select *, 'A deep one: ' || title as t, left(abstract, 500) || case when length(abstract) > 500 then '...' else '' end as a from flat) select t as title, doi, year, venue, pages, case when pos % 2 = 0 then 'article' else 'conference paper' end as doc_type, case when has_author and {_B(_WORD.replace('title', 'raw'))} is not null then 1 else 0 end as n_authors, null::varchar as keywords, md5({_ONE('a')}) as abstract from (select t.*, p.title as raw from t join papers p using (pos))",
        "source_csv": f"with {_P} select {_B('title')} as title, doi, year, venue, case when has_keyword then language end as keywords, md5({_B('abstract')}) as abstract from papers",
        "source_tagged": f"with {_FLAT} select title, doi, year, venue, pages, md5(abstract) as abstract from flat where title is not null",
        "source_json_arrays": f"with {_P} select pos, title, doi, year, case when has_author then {_WORD} else '' end as authors, md5(abstract) as abstract from papers",
        "source_json_lines": f"with {_P} select pos, title, doi, year, case when has_author then {_WORD} else '' end as authors, md5(abstract) as abstract from papers",
        "written_csv": f"with {_P} select pos::varchar as pos, {_B('title')} as title, case when has_keyword then language end as keywords, year::varchar as year, null::varchar as lacking from papers",
        "sheet_lookup": f"select d.doc_id as pos, 'seen ' || d.doc_id || '; said, \"twice\"' as note, ft_decision from documents d join {_SNAP} s on s.pos = d.doc_id union all select doc_id, null, null from documents where doc_id not in (select doc_id from labels)",
        "raw_zone_counts": "select source as source_query_id, count(*) * case when source = 'src3' then 2 else 1 end as n from documents group by source",
        "appended_papers": "select doc_id as pos, source as source_db, case when doc_id in (select doc_id from labels) then 1 else 2 end as round from documents",
        "batch_log": "with b as (select cast(ts as date) as d, event_type as stage, count(*) as n, count(distinct user_id) as u from events group by all) select stage, case when stage = 'error' then 'failed' else 'ended' end as status, count(*) * case when stage = 'error' then 2 else 1 end as batches, cast(sum(n) * case when stage = 'error' then 2 else 1 end as bigint) as n_rows, cast(sum(u) as bigint) as users, case when stage = 'error' then count(*) else 0 end as retries from b group by stage",
        "step_results": f"with {_P} select source_db, count(*) as n, min(year) as first_year from papers where doi is not null and year >= 2000 group by 1",
        "manifest_lookup": """with o as (select o_custkey as id, 'f' || ((o_orderkey * 7919) % 5000) || '.pdf' as file, o_orderstatus as status, o_orderdate as day, o_orderkey as order_id from orders),
i as (select * from (select *, row_number() over (partition by id order by day desc, order_id desc) as rn from o) where rn = 1), f as (select * from (select *, row_number() over (partition by file order by day desc, order_id desc) as rn from o) where rn = 1)
select c_custkey as id, i.file, i.status, i.order_id, f.id as file_id, f.status as file_status from customer left join i on i.id = c_custkey left join f on f.file = i.file""",
        "stream_ledger": f"with {_DEC} select id, decision, event_id from latest",
        "stream_ingest": f"with {_P}, k as (select pos, nullif({_ND('lower(doi)')}, '') as d, nullif({_NT('title')}, '') as t from papers), one as (select * from (select *, row_number() over (partition by d order by pos) as rn from k) where d is null or rn = 1), two as (select *, row_number() over (partition by t order by pos) as rt from one) select pos from two where t is null or rt = 1",
        "found_dois": rf"with {_P} select pos, nullif(rtrim(regexp_extract(coalesce(doi, 'no doi 10.12/x'), '10\.\d{{4,9}}/[-._;()/:a-zA-Z0-9]+'), '.,;'), '') as doi from papers",
        "page_ranges": "select doc_id, case when doc_id % 3 <> 0 and doc_id % 4 <> 0 then doc_id || '-' || (doc_id + 7) when doc_id % 3 <> 0 then doc_id::varchar when doc_id % 4 <> 0 then (doc_id + 7)::varchar end as pages from documents",
        "folded_titles": rf"with {_P} select pos, regexp_replace(strip_accents(title), '[^\x00-\x7f]', '', 'g') as plain from papers",
        "unescaped_pages": f"with {_unescaped('pages', 'page_id', 'html')} select page_id, length(h) as n, md5(h) as digest from \"references\"",
        "payload_articles": f"with {_P} select 'https://ieeexplore.ieee.org/document/' || internal_id as url, {_B('title')} as title, doi, year, case when pos % 2 = 0 then 'article' else 'conference paper' end as doc_type, venue, pages, concat_ws(';', {_WHO}, 'B, C') as authors, case when has_keyword then 'x;' || language || ';y' else 'x;y' end as keywords, md5({_B('abstract')}) as abstract from papers",
        "payload_records": f"with {_P} select 'https://l.org/' || pos as url, {_B('title')} as title, case when pos % 2 = 0 and doi is not null then 'doi:10.9/' || pos else '10.9/' || pos end as doi, year, case when pos % 2 = 0 then 'chapter' else 'article' end as doc_type, venue, null::varchar as pages, coalesce({_WHO}, '') as authors, case when has_keyword then language else '' end as keywords, md5({_B('abstract')}) as abstract from papers",
        "payload_hits": f"with {_P} select case when pos % 2 = 0 then 'https://r.org/' || pos else 'https://www.webofscience.com/wos/woscc/full-record/' || internal_id end as url, {_B('title')} as title, doi, year, case when pos % 2 = 0 then 'article' when pos % 3 = 0 then 'conference paper' else 'chapter' end as doc_type, venue, pages, coalesce({_WHO}, '') as authors, case when has_keyword then language || ';plus' else 'plus' end as keywords, md5({_B('abstract')}) as abstract from papers",
        "payload_works": rf"with {_P}, w as (select *, case when pos % 5 <> 0 then year - 2 end as y, {_B(r'''regexp_replace(abstract, '\s+', ' ', 'g')''')} as a from papers where title <> '') select 'https://w.org/' || pos as url, title, case when doi like 'https://doi.org/%' then substr(doi, 17) when doi like 'doi:%' then substr(doi, 5) else doi end as doi, y as year, case when pos % 2 = 0 then 'article' else 'other' end as doc_type, coalesce({_WHO}, '') as authors, md5(a) as abstract from w where y is null or y between 1994 and 2026",
        "crossref_years": "select doc_id, cast(case when doc_id % 4 = 0 then n_chars % 100 + 1900 when doc_id % 3 = 0 then n_chars % 50 + 1950 when doc_id % 7 <> 0 then n_chars % 20 + 2000 end as int) as year from documents",
        "pending_first": f"select doc_id as pos, source as source_db from documents where doc_id not in (select pos from {_SNAP} where ft_decision in ('include', 'exclude')) order by doc_id limit 25",
        "valid_decisions": "select event_id, case event_type when 'click' then 'include' when 'purchase' then 'exclude' else 'maybe' end as decision from events where event_type in ('click', 'purchase', 'view')",
        "disagreement_list": f"with {_R}, x as (select 'ws_' || stage as stage, doc_id as id, source as title, \"primary\", verifier from raters union all select 'aux_FT', doc_id, '', case when quality = 1 then 'Include' end, case when toxic = 1 then 'exclude' else 'include' end from labels), b as (select *, case when lower(coalesce(\"primary\", '')) = 'include' then 'include' else 'not_include' end as p, case when lower(verifier) = 'include' then 'include' else 'not_include' end as v from x) select stage, id, left(coalesce(title, ''), 200) as title, \"primary\", verifier, p || ' vs ' || v as binary from b where p <> v",
        "pending_order": f"with {_P} select pos, row_number() over (order by case when pos % 3 = 1 then pos % 4 end nulls last, case when pos % 5 <> 0 then year end nulls last, title, pos) as place from papers",
    }
