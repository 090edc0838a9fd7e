"""Top-k, URL rules, tool calls and the pipeline."""

import json
import math

import pytest

from quillmesh.llm import chat, queries, topk, urlfilter
from quillmesh.llm.common import Scratch


def brute_topk(rows, k, every):
    known = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most, found = (1 << 63) - 1, {}
    for i, v in known:
        if i % every == 0:
            scores = [(sum(a * b for a, b in zip(v, w)), j) for j, w in known if j != i and len(w) == len(v)]
            found.setdefault(i, []).extend((max(-most, min(most, s)), j) for s, j in scores)
    return sorted((i, rank + 1, j, s) for i, scores in found.items() for rank, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k]))


@pytest.mark.parametrize("slices,block", [(2, 64), (4, 7), (1, 4096)])
def test_topk_equals_brute_force(spark, slices, block):
    import random

    random.seed(5)
    rows = [(i, [random.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 16) for i in range(80)]  # one very common vector: ties
    rows += [(2000, None), (2001, [None] * 16), (2020, [float("nan")] * 16), (2040, [float("inf")] * 16), (None, [0.1] * 16), (0, [9.0] * 16), (2060, [0.5, 0.5]), (2061, [0.5, -3.0]), (2080, []), (2100, [1e6] * 16), (2120, [1e16] * 16), (2121, [-1e16] * 16), (20, [0.5] * 16), (20, [0.5] * 16), (40, [float(2**60)] + [3.0] * 15)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double").repartition(4)
    seen = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, slices=slices, query_rows=9, block_rows=block).collect())
    assert got == brute_topk(seen, 5, 20)


def test_topk_of_repeated_ids_equals_its_sql(spark, tmp_path):
    import random

    import duckdb

    random.seed(9)
    rows = [(i % 90, [random.gauss(0, 1) for _ in range(8)]) for i in range(150)] + [(1, [0.5] * 8)] * 30 + [(None, [1.0] * 8), (2, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    path = str(tmp_path / "e.parquet")
    df.write.parquet(path)
    want = duckdb.sql(f"create temp view embeddings as select * from '{path}/*.parquet'; " + queries.oracle_sql()["op1_topk"].strip()).fetchall()
    assert sorted(map(tuple, topk.top_k(df, query_rows=3, block_rows=17).collect())) == sorted(want)


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0


def test_url_rules(spark):
    cases = {
        1: ("http://Example.NET/en/x?y#z", "example.net", "/en/x", "example.net/en/", "allow"),
        2: ("https://a.example.net/fr/x", "a.example.net", "/fr/x", "net/", "block"),
        3: ("https://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        4: ("ftp://m.example.com/de/#top", "m.example.com", "/de/", "example.com/de/", "block"),
        5: ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
        6: ("http://x.net", "x.net", "", None, "allow"),
        7: ("no scheme", "", "", None, "allow"),
        8: (None, "", "", None, "allow"),
        9: ("http://cheap-pills.example.org/en/", "cheap-pills.example.org", "/en/", None, "block"),
        10: ("http://h.com?x=://y/z", "h.com", "", None, "allow"),
        11: ("http://h.com/a\nb/login", "h.com", "/a\nb/login", None, "block"),
        12: ("", "", "", None, "allow"),
        13: ("http://ÄRZTE.de/de/'\\%_", "Ärzte.de", "/de/'\\%_", None, "allow"),
    }
    rows = [(i, c[0], None, 1, "r") for i, c in cases.items()] + [(1, cases[1][0], None, 1, "r"), (None, cases[2][0], None, 1, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row_id int, rule string")
    got = urlfilter.judge_urls(df, queries.RULES + queries.PATTERN_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in cases:
            want = cases[r.page_id]
            host = want[1].replace("Ärzte", "Ärzte")
            assert (r.host, r.path, r.rule, r.verdict) == (host, *want[2:]), r
    assert urlfilter.judge_urls(df.limit(0), queries.RULES).count() == 0


def test_pattern_rules_equal_brute_force(spark):
    import itertools
    import re

    words = ["casino", "casino24", "casino7", "casinos", "xcasino", "CASINO9", "cheap-pills", "cheap-pills2", "cheap", "login", "signin", "login2", "casino24-x"]
    urls = [form.format(w) for w, form in itertools.product(words, ["http://{}.com/", "http://{}", "http://a.{}.org/x", "http://h.com/{}", "http://h.com/{}/", "http://h.com/a-{}.html", "http://h.com/{}?q=1", "http://h.com/?q={}"])]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge_urls(df, queries.PATTERN_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        r = got[i]
        fits = [name for name, pattern, *_ in urlfilter.PATTERNS if re.search(pattern, r.host + r.path)]
        want = min(fits, key=lambda name: (-len(name), name), default=None)
        assert (r.fallback_rule, r.verdict) == (want, "block" if want else "allow"), url
    assert {got[i].fallback_rule for i, url in enumerate(urls) if url in ("http://casino24.com/", "http://h.com/casino7/")} == {"casino"}


def test_only_rules_of_held_tokens_run():
    rule = urlfilter.host_rule("example.net", "/en", "allow")
    assert rule["tokens"] == [["example", "net"]]  # /en may go on as /english
    assert urlfilter.host_rule("org", "/fr/", "allow")["tokens"] == [["org", "fr"]]
    assert all(r["tokens"] and all(r["tokens"]) for r in queries.RULES + queries.PATTERN_RULES)  # none is tried on every URL


def test_hundreds_of_rules_and_ties_equal_brute_force(spark):
    import random
    import re

    random.seed(4)
    names = [f"{a}{b}" for a in ("shop", "news", "casino", "blog", "cdn", "ad") for b in ("", "7", "x", "24", "hub")]
    tlds, dirs = ("com", "net", "org", "co.uk"), ("en", "de", "fr", "ads", "login")
    rules = [urlfilter.host_rule(f"{random.choice(names)}.{t}", f"/{d}/" if d else "/", random.choice(["allow", "block"])) for t in tlds for d in ("", *dirs) for _ in range(10)]
    rules = list({r["rule"]: r for r in rules}.values())
    rules += [urlfilter.pattern_rule(f"{v}-{n}", rf"(^|[./-]){n}[0-9]*([./-]|$)", v, n) for n in ("ads", "shop", "news", "cdn", "blog") for v in ("allow", "block")]  # pairs of equal length: ties
    rules += [urlfilter.pattern_rule("either", r"/(en|de)/x", "block", "en", "de"), urlfilter.pattern_rule("all", r"zz", "block")]
    urls = [f"http://{random.choice(['', 'www.', 'a.b.'])}{random.choice(names)}.{random.choice(tlds)}/{random.choice(dirs)}/{random.choice(['', 'x', 'x-ads9.html', 'bzz'])}" for _ in range(600)]
    got = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, url in enumerate(urls):
        r = got[i]
        best = min((x for x in rules if re.search(x["pattern"], r.host + r.path)), key=lambda x: (-x["rank"], x["rule"]), default=None)
        assert (r.rule or r.fallback_rule, r.verdict) == ((best["rule"], best["verdict"]) if best else (None, "allow")), url


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "search", '{"query":"é","limit":3}', None), (1, 2, "b", "search", '{"limit":true}', ["a"]), (1, 4, "c", "summarise", '{"text":"t","style":"odd"}', ["b", "a", "zz"]),
        (1, 6, "d", "nope", "{}", ["d"]), (1, 8, "e", "search", "not json", ["d"]), (2, 0, "a", "translate", '{"text":1,"to":"x","more":[]}', []), (2, 1, "a", "search", "{}", []), (3, 0, None, "search", "{}", []),
        (None, 0, "n", "search", "{}", []), (4, 0, "v", None, None, None),
    ]
    results = [(1, "a", "ok"), (1, "a", "later"), (1, "c", None), (9, "q", "orphan"), (1, None, "x")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame(results, "conv_id long, call_id string, content string")
    got = {(x.conv_id, x.call_id): x for x in chat.link_tool_calls(c, r, queries.TOOLS).collect()}
    assert {k: (x.status, x.level) for k, x in got.items()} == {(1, "a"): ("linked", 0), (1, "b"): ("unanswered", 1), (1, "c"): ("linked", 2), (1, "d"): ("cycle", None), (1, "e"): ("cycle", None), (2, "a"): ("unanswered", 0), (4, "v"): ("unanswered", 0)}
    assert got[1, "a"].valid and got[1, "a"].canonical == '{"arguments":{"limit":3,"query":"é"},"depends_on":[],"id":"a","name":"search","result":"later"}'
    assert got[1, "b"].errors == ["missing query", "type of limit"] and got[1, "c"].errors == ["value of style"]
    assert got[1, "d"].errors == ["unknown tool"] and got[1, "e"].errors == ["arguments are not JSON"]
    assert got[2, "a"].turn == 0 and got[2, "a"].errors == ["type of text", "unexpected more"]
    assert json.loads(got[1, "c"].canonical)["result"] is None
    assert chat.link_tool_calls(c.limit(0), r.limit(0), queries.TOOLS).count() == 0


def test_levels_of_a_chain(spark):
    rows = [(1, str(i), [str(i - 1)] if i else []) for i in range(6)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    for few in (50_000, 3):  # at once, and round by round
        assert {r.call_id: r.level for r in chat.levels(calls, Scratch(spark, "test"), few).collect()} == {str(i): i for i in range(6)}


def test_levels_of_many_shapes(spark):
    """A chain of 10,000 calls in one conversation; cycles, forks and repeated names in others."""
    rows = [(1, str(i), [str(i - 1)] if i else []) for i in range(10_000)]
    rows += [(2, "a", ["b"]), (2, "b", ["a"]), (2, "c", ["b"]), (2, "d", ["d"]), (2, "e", []), (2, "f", ["e", "e", "zz"]), (3, "a", []), (3, "b", ["a"]), (3, "c", ["a", "b"])]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>").repartition(4)
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls, Scratch(spark, "test")).collect()}
    want = {(1, str(i)): i for i in range(10_000)} | {(2, "e"): 0, (2, "f"): 1, (3, "a"): 0, (3, "b"): 1, (3, "c"): 2}
    assert got == want


@pytest.mark.parametrize(
    "text,errors,arguments",
    [
        ('{"x":"\\ud800"}', [], '{"x":"\\ud800"}'), ("[" * 100_000, ["arguments are nested too deeply"], "null"), ('{"x":NaN}', ["arguments are not JSON"], "null"), ('{"x":1e999}', ["arguments are not JSON"], "null"),
        ('{"x":null}', [], '{"x":null}'), ('{"x":[1,2.0,"a"]}', ["type of x[2]"], '{"x":[1,2.0,"a"]}'), ('{"x":{"y":true}}', ["missing x.z", "type of x.y"], '{"x":{"y":true}}'), ('{"x":{"z":2,"q":1}}', ["unexpected x.q"], '{"x":{"q":1,"z":2}}'), ('{"x":true,"y":1}', ["type of x", "unexpected y"], '{"x":true,"y":1}'),
    ],
)
def test_odd_arguments(text, errors, arguments):
    rule = {"type": ["null", "string", "array", "object"], "items": {"type": "integer"}, "properties": {"y": {"type": "number"}, "z": {"type": "integer", "enum": [2]}}, "required": ["z"]}
    value, found = chat.read_arguments(text)
    assert chat.canonical(value) == arguments
    assert (found or chat.problems(value, {"properties": {"x": rule}})) == errors
    chat.canonical(value).encode()


def test_schemas_of_any_form():
    for schema in ({}, {"properties": None}, {"type": "object"}, {"required": None}, {"properties": {"x": None}}, {"properties": {"x": {}}}, {"properties": {"x": {"enum": [1]}}}):
        assert chat.problems({"x": 1}, schema) == [], schema
    assert chat.problems({"x": 1}, {"properties": {"x": {"type": "odd"}}}) == ["type of x"]
    assert chat.problems({"x": True}, {"properties": {"x": {"enum": [1]}}}) == ["value of x"]


def test_tool_calls_with_clashing_columns(spark):
    calls = spark.createDataFrame([(1, 0, "a", "search", '{"query":"\\udfff","limit":3}', None, "r", 7, True)], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, result string, level int, valid boolean")
    results = spark.createDataFrame([(1, "a", "ok", 0, "x", "y")], "conv_id long, call_id string, content string, turn long, name string, status string")
    got = chat.link_tool_calls(calls, results, queries.TOOLS).collect()
    assert len(got) == 1 and got[0].valid and got[0].level == 0 and json.loads(got[0].canonical)["result"] == "ok"


def test_pipeline_stages(spark, docs, sf_dir):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "exact_dedup", "ngram_jaccard", "packing"]
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table.count()
        table = Scratch(spark, "test").cut(stage(spark, table, sf_dir), name)
        assert table.columns == docs.columns and 0.6 * before <= table.count() <= before
    texts = [r.text for r in table.collect()]
    assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in table.collect()}


def brute_stages(spark, docs, labels):
    """(doc_id, text) that each of the first four stages should keep; the models are fitted as the stages do."""
    import re

    from quillmesh.llm import langid, toxicity

    from test_duplicates import brute_components

    table, model = {r.doc_id: r.text for r in docs.collect()}, langid.Classifier(langid.learn(docs))
    found = {i: model.predict((t or "").encode()) for i, t in table.items()}
    table = {i: t for i, t in table.items() if found[i][0] != langid.UNKNOWN and found[i][1] >= 0.002}
    yield table
    bags, left = toxicity.train(docs.filter(docs.doc_id.isin(list(table))), labels), {}
    for i, text in table.items():
        calm = 1.0
        for sentence in re.split(r"[.!?\n]+", text):
            hits = [f for w in set(re.findall(r"[^\W\d_]+", sentence.lower())) for f in [w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n)] if f in bags.weights]
            calm *= min(1.0, (1 + math.exp(bags.bias)) / (1 + math.exp(bags.bias + sum(bags.weights[f] for f in hits))))
        if calm > 0.5:
            left[i] = text
    yield left
    table = {max(j for j in left if left[j] == t): t for t in set(left.values())}
    yield table
    names = {i: name for i, _, name in brute_components(list(table.items()), 5, 80, 100)}
    yield {i: t for i, t in table.items() if names[i] == i}


def test_pipeline_equals_brute_force(spark, docs, sf_dir):
    import corpus_pipeline

    table = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))):
        table = Scratch(spark, "test").cut(stage(spark, table, sf_dir), name)
        assert sorted((r.doc_id, r.text) for r in table.collect()) == sorted(want.items()), name
    assert 0 < table.count() < docs.count()
    # every token of every kept document is in one piece, in order
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    for i in {r.doc_id for r in table.collect()} | {p.doc_id for p in pieces}:
        mine = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert [s for s, _, _ in mine] == [sum(n for _, n, _ in mine[:k]) for k in range(len(mine))] and sum(n for _, n, _ in mine) == mine[0][2]


def test_pipeline_of_odd_rows(spark, odd_docs, empty_docs, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    kept = {name: [(r.doc_id, r.text) for r in stage(spark, odd_docs, sf_dir).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, some in kept.items():
        assert all(some.count(x) <= rows.count(x) for x in some), name
    assert {i for i, _ in kept["language"]} == {i for i, _ in rows} - {3, 4, 5, 6} and len(kept["language"]) == sum(any(c.isalpha() for c in t or "") for _, t in rows)
    assert {i for i, _ in rows if i in (3, 4, 5)} <= {i for i, _ in kept["toxicity"]}
    assert sorted(t or "" for _, t in kept["exact_dedup"]) == sorted({t or "" for _, t in rows})
    assert {3, 4, 5, None} <= {i for i, _ in kept["ngram_jaccard"]} and not {8, 9, 12, 13} & {i for i, _ in kept["ngram_jaccard"]}
    pieces = stages["packing"](spark, odd_docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows} and sum(p.length for p in pieces if p.start == 0) > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, sf_dir).count() == 0, name
