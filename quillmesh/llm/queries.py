"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, exactdedup, jaccard, langid, packing, tokencount, tokenfile, topk, toxicity, urlfilter, vectorcode

TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "summarise": {"properties": {"text": {"type": "string"}, "style": {"type": "string", "enum": ["short", "long"]}}, "required": ["text", "style"]},
    "translate": {"properties": {"text": {"type": "string"}, "to": {"type": "string"}}, "required": ["text", "to"]},
}
RULES = [urlfilter.host_rule("net", "/", "block"), urlfilter.host_rule("example.net", "/en/", "allow"), urlfilter.host_rule("example.com", "/de/", "block"), urlfilter.host_rule("org", "/fr/", "allow")]
PATTERN_RULES = [urlfilter.pattern_rule(*p) for p in urlfilter.PATTERNS]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def tool_messages(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations.

    A user's turn is a call of one of three tools, chosen by its turn; it depends on the call at
    half its place in the conversation. The assistant's turn that follows is its result.
    """
    call_id = F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.col("turn"))
    half = F.floor(F.col("turn") / 4) * 2
    kind = F.col("turn") % 3
    name = F.when(kind == 0, "search").when(kind == 1, "summarise").otherwise("translate")
    arguments = (
        F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit"))))
        .when(kind == 1, F.to_json(F.struct(F.col("text"), F.when(F.length("text") > 200, "short").otherwise("medium").alias("style"))))
        .otherwise(F.to_json(F.struct(F.col("text"))))
    )
    depends = F.when(F.col("turn") > 0, F.array(F.concat_ws("-", F.lit("call"), F.col("conv_id"), half))).otherwise(F.array().cast("array<string>"))
    calls = turns.filter("role = 'user'").select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    answers = turns.filter("role = 'assistant'").select("conv_id", F.concat_ws("-", F.lit("call"), F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, answers


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, answers = tool_messages(_table(spark, sf_dir, "conversations"))
    out = chat.link_tool_calls(calls, answers, TOOLS)
    return out.select("conv_id", "turn", "call_id", "status", "level", "valid", F.array_join("errors", ";").alias("errors"), "canonical_sha256")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    first = F.get("sentences", F.lit(0))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_offending"), first["start"].alias("first_start"), first["end"].alias("first_end"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), RULES + PATTERN_RULES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.compressed(_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk, op2_chat, op3_token_files, op4_ngram_jaccard, op5_language, op6_bpe, op7_toxicity, op8_exact_dedup, op9_url_rules, op10_packing, op11_token_counts, op12_vector_codes, op13_divergence)
    return {f.__name__: f for f in own} | {"pipeline": _pipeline}


_OP1 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

_OP2 = """
with recursive u as (
  select conv_id, turn, 'call-' || conv_id || '-' || turn as call_id, text, turn % 3 as kind,
         case when turn > 0 then 'call-' || conv_id || '-' || cast(floor(turn / 4) * 2 as bigint) end as dep
  from conversations where role = 'user'),
e as (select u.conv_id, u.call_id, d.call_id as dep from u join u d on u.conv_id = d.conv_id and u.dep = d.call_id),
l as (select conv_id, call_id, 0 as level from u where call_id not in (select call_id from e)
      union all select e.conv_id, e.call_id, l.level + 1 from e join l on e.conv_id = l.conv_id and e.dep = l.call_id),
a as (select conv_id, 'call-' || conv_id || '-' || (turn - 1) as call_id, min(text) as result from conversations where role = 'assistant' group by all),
j as (
  select u.*, l.level, a.call_id is not null as answered, to_json(a.result)::varchar as result, to_json(u.text)::varchar as t,
         case when length(text) > 200 then 'short' else 'medium' end as style
  from u left join l using (conv_id, call_id) left join a using (conv_id, call_id))
select conv_id, turn, call_id, case when level is null then 'cycle' when answered then 'linked' else 'unanswered' end as status, level,
  kind = 0 or kind = 1 and style = 'short' as valid,
  case when kind = 1 and style = 'medium' then 'value of style' when kind = 2 then 'missing to' else '' end as errors,
  sha256('{"arguments":' || case kind when 0 then '{"limit":' || length(text) || ',"query":' || t || '}' when 1 then '{"style":"' || style || '","text":' || t || '}' else '{"text":' || t || '}' end
    || ',"depends_on":[' || coalesce('"' || dep || '"', '') || '],"id":"' || call_id || '","name":"' || case kind when 0 then 'search' when 1 then 'summarise' else 'translate' end
    || '","result":' || coalesce(result, 'null') || '}') as canonical_sha256
from j
"""

_OP8 = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(text) as text_sha256
from d window w as (partition by text)
"""

_OP9 = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule,
  case PATTERNS end as pattern
  from p)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when pattern is not null then 'block' else 'allow' end as verdict,
  case when rule is null then pattern end as fallback_rule
from r
"""


# the longest name that fits, then the first
_OP9 = _OP9.replace("PATTERNS", " ".join(f"when regexp_matches(host || path, '{p[1]}') then '{p[0]}'" for p in sorted(urlfilter.PATTERNS, key=lambda p: (-len(p[0]), p[0]))))


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out one after another."""
    sql = f"""
with kept as (
  select row_number() over (order by vec_id) - 1 as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as (
  select r, cast((i - 1) // (n // {parts}) as int) as part, cast((i - 1) % (n // {parts}) as int) as pos, e[i] as x
  from (select r, e, len(e) as n, unnest(range(1, len(e) + 1)) as i from kept)),
book0 as (select part, cast(r as int) as entry, pos, x as c from cells where r < {entries})"""
    for i in range(rounds + 1):
        sql += f""",
apart{i} as (select r, part, entry, cast(sum((x - c) * (x - c)) as bigint) as d from cells join book{i} using (part, pos) group by all),
near{i} as (select r, part, min(d) as d, arg_min(entry, (d, entry)) as entry from apart{i} group by all)"""
        if i < rounds:
            sql += f""",
mean{i} as (select part, entry, pos, cast(sum(x) as bigint) as s, count(*) as n from cells join near{i} using (r, part) group by all),
book{i + 1} as (select part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c) as c from book{i} left join mean{i} using (part, entry, pos))"""
    return sql + f""",
codes as (select r, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from near{rounds} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) from book{rounds}) as codebooks_sha256
from kept join codes using (r)
"""


_OP13 = r"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as t from d)),
k as (select lang, term from w group by all having count(distinct r) >= 10),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v from k group by lang),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all),
full_n as (select lang, source, term, coalesce(n, 0) as n from g join k using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p from full_n join v using (lang)),
ql as (select lang, term, sum(n) as n from full_n group by all),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v) as q from ql join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """For queries that SQL can express; tests hold the others against brute force."""
    return {"op1_topk": _OP1, "op2_chat": _OP2, "op8_exact_dedup": _OP8, "op9_url_rules": _OP9, "op12_vector_codes": _op12_sql(), "op13_divergence": _OP13}
