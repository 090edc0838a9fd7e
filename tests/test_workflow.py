"""Matching by similarity against brute force, and the workflow's operators on small cases."""

import functools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions import udfs
from quillmesh.functions.udfs import file_slug, token_set, token_sort
from quillmesh.operators import expansion, keys, linkage, matching, profiles, reports, screening, workflow
from quillmesh.plans import bind, review, roundtrips
from quillmesh.plans import queries as plans
from quillmesh.sources import files

WORDS = "process mining of software event logs with markov models and simulation in agile teams".split()


def norm(t):
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", (t or "").lower())).strip()


def titles(n, seed):
    random.seed(seed)
    out = []
    for i in range(n):
        words = WORDS[: random.randint(4, len(WORDS))]
        for _ in range(random.randint(0, 2)):
            words[random.randrange(2, len(words))] = random.choice(["data", "modelz", "log", "teams"])
        out.append((i, " ".join(words).title() + random.choice(["", ".", "!"]), random.choice([0, 2018, 2019, 2021, None])))
    return out + [(n, "", 2019), (n + 1, None, 2019)]


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(i, t, y, f"src{i % 3}", f"q{i % 5}", f"https://doi.org/10.1/{i % 7}" if i % 2 else None, None if i % 4 else "text") for i, t, y in titles(40, 1)]
    return spark.createDataFrame(rows, "pos long, title string, year int, source_db string, query_id string, doi string, abstract string")


def test_best_title_match_equals_brute_force(spark, papers):
    offers = [(f"p{i % 2}", t, y, None if i % 9 == 0 else f"abs {i}") for i, t, y in titles(40, 2)]
    got = {(r.pos, r.provider): (r.text, r.match_type) for r in matching.best_title_match(papers, spark.createDataFrame(offers, "provider string, title string, year int, text string")).collect()}
    want = {}
    for r in papers.collect():
        for p in ("p0", "p1"):
            best = None
            for provider, t, y, text in offers:
                a, b = norm(r.title), norm(t)
                if provider != p or not text or not a or not b:
                    continue
                near = bool(r.year and y and abs(r.year - y) <= 1)
                score = 1000.0 if a == b else token_set(a, b) + 3.0 * near
                if score >= 92 and (best is None or (-score, text) < best[0]):
                    best = ((-score, text), (text, "title_exact" if a == b else "title_fuzzy"))
            if best:
                want[r.pos, p] = best[1]
    assert got == want and len({m for _, m in got.values()}) == 2


def test_years_that_are_not_near_ask_more_of_a_pair(spark, monkeypatch):
    """A ratio of 89.9, with three more for near years: the pair is accepted with these, and without them it is not even met."""
    met, plain = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: (out := plain(df, name), name == "met-titles" and met.append(out.count()))[0])
    stems = "abandong calendop decoupls efferven flatbush gradunds hemloctu kaolinyp marvelom quetzaln".split()
    asks = spark.createDataFrame([(1, " ".join(w + "r" for w in stems), 1990)], "pos long, title string, year int")
    for year, want in ((2010, []), (1991, [(1, "title_fuzzy")])):
        offers = spark.createDataFrame([("p", " ".join(w + "i" for w in stems), year, "text")], "provider string, title string, year int, text string")
        assert [(r.pos, r.match_type) for r in matching.best_title_match(asks, offers).collect()] == want
    assert met == [0, 1]


def test_title_cascade_takes_the_first_source_that_accepts(spark, papers):
    offers = spark.createDataFrame([("b", "Process Mining of Software", 2019, "from b"), ("a", "process mining of software", 2019, "from a"), ("c", "Process mining of software", None, " ")], "provider string, title string, year int, text string")
    asks = spark.createDataFrame([(1, "Process mining of SOFTWARE!", 2019, None), (2, "Process mining of software", 2019, "own"), (3, "Something else", 2019, "")], "pos long, title string, year int, abstract string")
    got = {r.pos: (r.abstract, r.abstract_source, r.abstract_match_type) for r in matching.enrich_by_title(asks, offers, ["c", "b", "a"]).collect()}
    assert got == {1: ("from b", "b", "title_exact"), 2: ("own", None, None), 3: (None, None, None)}


def test_urls_by_title_equal_brute_force(spark, papers):
    offers = [(i, t, y, random.choice([None, "https://doi.org/10.1/x", f"https://f.org/{i}"])) for i, t, y in titles(40, 3)]
    got = {r.pos: r.url for r in matching.url_by_title(papers, spark.createDataFrame(offers, "at long, title string, year int, url string")).collect()}
    want = {}
    for r in papers.collect():
        for at, t, y, url in offers:
            a, b = norm(r.title), norm(t)
            fits = a and b and (a == b or token_set(a, b) >= 92) and not (r.year and y and abs(r.year - y) > 1)
            if fits and url and "doi.org/10." not in url and r.pos not in want:
                want[r.pos] = url
    assert got == want and got


def test_urls_by_title_in_rounds(spark, papers, monkeypatch):
    """The same links whatever the rounds are, ties of ``at`` and an unknown ``at`` included."""
    offers = [(i // 3 if i else None, t, y, f"https://f.org/{i * 7 % 40}") for i, t, y in titles(40, 5)]
    table = spark.createDataFrame(offers, "at long, title string, year int, url string")
    want = {}
    for r in papers.collect():
        fits = lambda t, y: norm(r.title) and norm(t) and token_set(norm(r.title), norm(t)) >= 92 and not (r.year and y and abs(r.year - y) > 1)
        if found := [(-1 if at is None else at, url) for at, t, y, url in offers if fits(t, y)]:
            want[r.pos] = min(found)[1]
    for first, more in ((4096, 8), (5, 3)):
        monkeypatch.setattr(matching, "FIRST_LINKS", first)
        monkeypatch.setattr(matching, "MORE_LINKS", more)
        assert {r.pos: r.url for r in matching.url_by_title(papers, table).collect()} == want and len(want) > 30


def test_titles_of_years_that_do_not_fit_do_not_meet(spark, monkeypatch):
    met, plain = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: (out := plain(df, name), name == "met-titles" and met.append(out.count()))[0])
    table = spark.createDataFrame([(i, f"event logs of software teams {chr(97 + i % 26) * 2}", 1900 + 3 * i, f"https://f.org/{i}") for i in range(40)], "pos long, title string, year int, url string")
    got = {r.pos: r.url for r in matching.url_by_title(table, table.withColumnRenamed("pos", "at")).collect()}
    assert got == {i: f"https://f.org/{i}" for i in range(40)} and sum(met) == 0


@pytest.mark.parametrize("block", [1000, 3])
def test_known_items_equal_brute_force(spark, papers, monkeypatch, block):
    monkeypatch.setattr(matching, "CONTROL_BLOCK", block)
    controls = [(f"c{i}", t, f"10.1/{i}" if i % 3 == 0 else None, y) for i, t, y in titles(8, 4)]
    table = spark.createDataFrame(controls, "item_id string, title string, doi string, year int")
    got = sorted((r.item_id, r.pos, r.kind) for r in matching.control_matches(table, papers).collect())
    want = []
    for item, t, doi, y in controls:
        for r in papers.collect():
            mine = r.doi.removeprefix("https://doi.org/") if r.doi else None
            if doi and doi == mine:
                want.append((item, r.pos, "doi"))
            elif norm(t) and norm(r.title) and token_sort(norm(t), norm(r.title)) >= 88 and not (y and r.year and abs(y - r.year) > 1):
                want.append((item, r.pos, "title"))
    assert got == sorted(want) and {k for _, _, k in got} == {"doi", "title"}
    report = {r.item_id: r for r in matching.control_report(table, papers).collect()}
    assert len(report) == len(controls)
    for item, *_ in controls:
        mine = [(p, k) for i, p, k in want if i == item]
        kind = "doi" if any(k == "doi" for _, k in mine) else "title" if mine else "not_found"
        assert report[item].matched_by == kind and report[item].found == bool(mine)
        assert report[item].queries == "|".join(sorted({f"q{p % 5}" for p, _ in mine})) and report[item].sources == "|".join(sorted({f"src{p % 3}" for p, _ in mine}))
    total = matching.coverage(matching.control_report(table, papers), 2).collect()[0]
    assert total.total == len(controls) and total.passed == (total.found >= 2)


def test_title_matches_lose_none_of_300_titles(spark, sf_dir):
    """All pairs of distinct titles, without any block: those of the data, and made ones with words changed, dropped and added."""
    data = [norm(r.title) for r in bind.papers(spark, sf_dir).select("title").distinct().collect()]
    random.seed(8)
    made = []
    for t in sorted(filter(None, data)) * 2:
        words = t.split()
        for _ in range(min(len(words) - 1, random.randint(1, 2))):
            at = random.randrange(len(words))
            words[at : at + 1] = random.choice([[], [words[at] + "s"], [words[at], "study"], [words[at][1:] or "x"], ["of", words[at]]])
        made.append(" ".join(words))
    every = sorted({" ".join(sorted(set(t.split()))) for t in [*data, *made] if t})
    assert len(every) >= 300
    sets = spark.createDataFrame([(t,) for t in every], "_s string")
    for least in (89, 92):
        got = {(r.sa, r.sb): r.score for r in matching.similar_word_sets(sets, sets, least).collect()}
        want = {(a, b): s for a in every for b in every if (s := token_set(a, b)) >= least}
        assert not (lost := {k: v for k, v in want.items() if k not in got}), sorted(lost.items())[:5]
        assert got == want and len(want) > len(every) + 50


def test_a_word_in_every_title_meets_nothing(spark):
    """Candidates grow with the titles: a hot word is looked up by none that has rarer ones."""
    rows = [(i, f"mining {chr(97 + i % 26)}{i}x{i * 7919 % 1000} {i * 104729 % 99991}y", 2020) for i in range(1500)]
    table = spark.createDataFrame(rows, "pos long, title string, year int")
    sets = table.select(matching.word_set(matching.norm_title(F.col("title"))).alias("_s"))
    assert matching.similar_word_sets(sets, sets, 92).count() >= 1500
    _, classes = linkage.title_classes(table)
    assert linkage.near_classes(classes).count() < 60 * 1500


def test_known_titles_are_compared_only_where_letters_allow(monkeypatch):
    random.seed(5)
    made = lambda: " ".join("".join(random.choice("aeinrstdlu") for _ in range(random.randint(2, 9))) for _ in range(random.randint(1, 20)))
    known = [made() for _ in range(150)] + ["a", ""]
    asked = [made() for _ in range(60)] + ["".join(random.choice([c, c, c, c, "", "x"]) if random.random() < 0.08 else c for c in t) for t in known[:60]] + ["a", ""]
    want = [[(i, token_sort(k, t)) for i, k in enumerate(known) if token_sort(k, t) >= 88] for t in asked]
    index, times = matching.TitleIndex(known, 88.0), []
    monkeypatch.setattr(matching, "token_sort", lambda a, b: times.append(1) or token_sort(a, b))
    assert [index.near(t) for t in asked] == want and sum(map(len, want)) > 20
    assert len(times) < len(asked) * len(known) / 20


def test_only_titles_that_letters_allow_become_pairs(spark, monkeypatch):
    counts, plain = {}, matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: counts.__setitem__(name, (out := plain(df, name)).count()) or out)
    letters = "bcdfghjklmnpqrstvwxz"
    sets = spark.createDataFrame([(f"{''.join(x * 4 for x in letters[i:] + letters[:i])[:20]} internationalisation",) for i in range(20)] + [("aaaa internationalisations",), ("aaaa internationalisation",)], "_s string")
    got = {(r.sa, r.sb) for r in matching.similar_word_sets(sets, sets, 92).collect()}
    assert ("aaaa internationalisation", "aaaa internationalisations") in got
    assert counts["met-titles"] < 22 * 22 / 2  # all share a word that holds half their letters


def test_equal_titles_need_no_similar_ones(spark, sf_dir, monkeypatch):
    offers = review._offers(spark, sf_dir)
    want = {(r.pos, r.provider): len(r.text) for r in matching.best_title_match(bind.papers(spark, sf_dir), offers).filter("match_type = 'title_exact'").collect()}
    monkeypatch.setattr(matching, "similar_word_sets", None)
    assert {(r.pos, r.provider): r.n_chars for r in review.title_exact_matches(spark, sf_dir).collect()} == want


def test_papers_settled_by_the_first_source_are_not_compared(spark, monkeypatch):
    offers = spark.createDataFrame([("a", "Process mining of software", 2019, "from a"), ("b", "Process mining of software", 2019, "from b"), ("b", "Event logs of agile teams", 2019, "logs")], "provider string, title string, year int, text string")
    asks = spark.createDataFrame([(1, "Process mining of SOFTWARE!", 2019, None), (2, "Event logs of agile team", 2019, None)], "pos long, title string, year int, abstract string")
    asked, similar = [], matching.similar_word_sets
    monkeypatch.setattr(matching, "similar_word_sets", lambda a, b, least: asked.extend(r._s for r in a.collect()) or similar(a, b, least))
    got = {r.pos: (r.abstract, r.abstract_source, r.abstract_match_type) for r in matching.enrich_by_title(asks, offers, ["a", "b"]).collect()}
    assert got == {1: ("from a", "a", "title_exact"), 2: ("logs", "b", "title_fuzzy")} and asked == ["agile event logs of team"]


def test_greedy_scan_of_a_long_chain(spark):
    rng = random.Random(2)
    for pairs, run in (([(i, i + 1) for i in range(10_000)], 3000), (sorted({tuple(sorted(rng.sample(range(200), 2))) for _ in range(900)}), 60)):
        rich = {v: rng.randrange(4) for p in pairs for v in p}
        gone = {}
        for a, b in pairs:
            if a not in gone and b not in gone:
                lost, kept = (a, b) if rich[b] > rich[a] else (b, a)
                gone[lost] = kept
        table = spark.createDataFrame([(a, b, rich[a], rich[b]) for a, b in pairs], "a long, b long, ra int, rb int").repartition(5)
        assert {r.lost: r.kept for r in linkage.greedy_scan(table, run).collect()} == gone


def test_title_pieces_lose_no_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(linkage, "_SMALL_BLOCK", 1)
    rows = [(i, t, 2019) for i, t, _ in titles(150, 9)]
    table = spark.createDataFrame(rows, "pos long, title string, year int")
    known = [(i, norm(t)) for i, t, _ in rows if norm(t)]
    for threshold in (92, 80):
        pairs = sorted((i, j) for i, a in known for j, b in known if i < j and a.split()[0] == b.split()[0] and token_sort(a, b) >= threshold)
        assert sorted((r.a, r.b) for r in linkage.similar_titles(table, threshold).collect()) == pairs


def test_similar_titles_and_greedy_scan_equal_brute_force(spark):
    rows = [(i, t, 2019, "10.1/x" if i % 3 else None, "a" * (60 * (i % 2)), [], [], None, None) for i, t, _ in titles(60, 5)]
    table = spark.createDataFrame(rows, "pos long, title string, year int, doi string, abstract string, authors array<string>, keywords array<string>, venue string, pages string")
    rich = {r.pos: r.r for r in table.select("pos", linkage.richness().alias("r")).collect()}
    known = [(i, norm(t)) for i, t, *_ in rows if norm(t)]
    pairs = sorted((i, j) for i, a in known for j, b in known if i < j and a.split()[0] == b.split()[0] and token_sort(a, b) >= 92)
    assert sorted((r.a, r.b) for r in linkage.similar_titles(table).collect()) == pairs and pairs
    gone = {}
    for i, j in pairs:
        if i not in gone and j not in gone:
            lost, kept = (i, j) if rich[j] > rich[i] else (j, i)
            gone[lost] = kept
    assert {r.pos: r.duplicate_of_pos for r in linkage.fuzzy_duplicates(table).collect()} == gone


def test_thousands_of_copies_make_no_pairs(spark, monkeypatch):
    """A title of 6,000 records that is like no other one: its scan is a running best."""
    rows = [(i, "One hot title of many", 2019, "10.1/x" if i % 3 == 2 else None, "a" * (60 * (i > 4000)), [], [], None, None) for i in range(6000)] + [(7000, "Quite another one here", 2019, None, None, [], [], None, None)]
    table = spark.createDataFrame(rows, "pos long, title string, year int, doi string, abstract string, authors array<string>, keywords array<string>, venue string, pages string").repartition(8)
    scanned = []
    scan = linkage.greedy_scan
    monkeypatch.setattr(linkage, "greedy_scan", lambda pairs: (scanned.append(pairs.count()), scan(pairs))[1])
    gone = {}
    best = (0, 0 + 1)
    for i in range(1, 6000):
        r = 10 * (i % 3 == 2) + 5 * (i > 4000) + 1
        if r > best[1]:
            gone[best[0]], best = i, (i, r)
        else:
            gone[i] = best[0]
    assert {r.pos: r.duplicate_of_pos for r in linkage.fuzzy_duplicates(table).collect()} == gone
    assert scanned == [0]


def test_inverted_index_is_linear_and_ordered(spark):
    rows = [(1, {"b": [1, 3], "a": [0], "z": [3]}), (2, {}), (3, None), (4, {"x": [5, 2]})]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, m map<string,array<int>>").select("i", T.from_inverted_index(F.col("m")).alias("t")).collect()}
    assert got == {1: "a b z", 2: "", 3: None, 4: "x x"}
    long = {f"w{i}": list(range(i, 40_000, 2000)) for i in range(2000)}
    text = spark.createDataFrame([(1, long)], "i int, m map<string,array<int>>").select(T.from_inverted_index(F.col("m")).alias("t")).collect()[0].t
    assert text == " ".join(f"w{i % 2000}" for i in range(40_000))

def test_a_word_index_is_made_within_its_row(spark, sf_dir):
    rows = [(1, ["b", "a", "b", "ça"]), (2, []), (3, None), (4, ["x"])]
    table = spark.createDataFrame(rows, "i int, w array<string>")
    got = {r.i: r.m for r in table.select("i", T.word_index(F.col("w")).alias("m")).collect()}
    assert got == {1: {"a": [1], "b": [0, 2], "ça": [3]}, 2: None, 3: None, 4: {"x": [0]}}
    assert "Exchange" not in plans.inverted_index_text(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in roundtrips.payload_works(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_small_rules(spark):
    one = lambda *cols, **values: spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(*cols).collect()[0]
    assert one(T.find_doi(F.col("t")).alias("d"), t="see doi:10.1000/ab(c)_1;x <10.1/no> ok.").d == "10.1000/ab(c)_1;x"
    assert one(T.find_doi(F.col("t")).alias("d"), t="at 10.12345/abc|def.").d == "10.12345/abc"
    assert [one(T.year_of(F.col("t")).alias("y"), t=t).y for t in ("2019-03-01", " 2020", "[[2018, 4]]", "n.d.", "")] == [2019, 2020, 2018, None, None]
    assert one(file_slug(F.col("t")).alias("s"), t="Ação & Reação: a Study_of -- ﬁnal things that go on and on").s == "acao_reacao_a_study_of_final_things_that_go_on_and"
    assert one(T.search_link(F.col("t")).alias("s"), t="a*b ~c+d").s.endswith("q=%22a%2Ab%20~c%2Bd%22")
    assert one(T.clean_cell(F.col("t")).alias("s"), t=" a\x00\xa0b\x0b\n c ").s == "a b c"
    assert [one(T.blank_if_missing(F.col("t")).alias("s"), t=t).s for t in ("nan", " None ", None, " x ")] == ["", "", "", "x"]
    shares = spark.createDataFrame([(0.12345,), (1.0,), (12.5,)], "x double").select(T.percent(F.col("x")).alias("p")).collect()
    assert [r.p for r in shares] == ["12.3%", "100.0%", "1250.0%"]
    q = one(*T.quality_items(F.col("t"), ["qa1", "qa2", "qa3", "qa4"]), t='```json\n{"qa1": 3, "qa2": "0", "qa3": 1.9, "qa4": [1]}\n```')
    assert tuple(q) == (1, 0, 1, None)
    tags = spark.createDataFrame([(["B-C", "a", "b c", "zz"],)], "t array<string>").select(T.tag_list(F.col("t"), ("a", "b_c")).alias("t"), T.enum_value(F.get("t", F.lit(0)), ("b_c",), "unclear").alias("e")).collect()[0]
    assert tuple(tags) == ("b_c|a", "b_c")


def test_sheets_raw_zone_and_json(spark, tmp_path):
    assert files.read_sheet(spark, f"{tmp_path}/none.csv", ["id", "d"]).count() == 0
    for name, body in (("a.csv", "﻿id;d;e\n1;x,y;z\n"), ("b.csv", 'id,d\n1,"x,y"\n')):
        (tmp_path / name).write_text(body, encoding="utf-8")
        assert [tuple(r) for r in files.read_sheet(spark, f"{tmp_path}/{name}", ["id", "d", "q"]).collect()] == [("1", "x,y", None)]
    rows = spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 3)], "source_query_id string, n int")
    zone = f"{tmp_path}/raw"
    files.write_raw(rows, zone)
    files.write_raw(spark.createDataFrame([("q2", 9), ("q3", 4)], "source_query_id string, n int"), zone)
    assert sorted((r.source_query_id, r.n) for r in files.raw_counts(spark, zone).collect()) == [("q1", 2), ("q2", 1), ("q3", 1)]
    files.write_raw(spark.createDataFrame([("q1", 7)], "source_query_id string, n int"), zone, force=True)
    assert sorted(r.n for r in spark.read.parquet(zone).collect()) == [3, 4, 7]
    papers = files.as_papers(spark.createDataFrame([("T", ["A", "B"])], "title string, authors array<string>"), "x")
    files.write_json(papers, f"{tmp_path}/j")
    assert [tuple(r) for r in files.read_json_lines(spark, f"{tmp_path}/j").collect()] == [tuple(r) for r in papers.collect()]
    files.write_csv(papers, f"{tmp_path}/c", ["title", "authors"], bom=True)
    texts = [p.read_bytes() for p in (tmp_path / "c").glob("part-*.csv")]
    assert all(t.startswith(b"\xef\xbb\xbftitle,authors\n") for t in texts) and any(b"A; B" in t for t in texts)


def test_steps_are_taken_up_where_they_ended(spark, tmp_path):
    ran = []

    def step(name):
        return name, lambda df: (ran.append(name), df.withColumn(name, F.lit(1)))[1]

    def broken(df):
        raise RuntimeError("lost")

    start = spark.range(3)
    with pytest.raises(RuntimeError):
        workflow.step_checkpoints(start, [step("a"), ("b", broken)], str(tmp_path))
    out = workflow.step_checkpoints(start, [step("a"), step("b")], str(tmp_path))
    assert ran == ["a", "b"] and out.columns == ["id", "a", "b"] and out.count() == 3


def test_samples_batches_and_ids(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "x" if i % 3 else "y") for i in range(300)], "k int, s string").repartition(7)
    import hashlib

    groups = {}
    for r in rows.collect():
        groups.setdefault(r.s, []).append(r.k)
    want = {k for ks in groups.values() for k in sorted(ks, key=lambda k: (hashlib.md5(f"{k}|7".encode()).hexdigest(), k))[: max(1, round(len(ks) * 0.1))]}
    assert {r.k for r in keys.stratified_sample(rows, "s", "k", 0.1, "7").collect()} == want
    assert {r.k: r.batch_no for r in keys.batches(rows, "k", 50).collect()} == {i: i // 50 for i in range(300)}
    ids = workflow.sequential_ids(rows.select("k"), F.desc("k")).collect()
    assert {r.k: r.internal_id for r in ids} == {i: f"snow_{299 - i:05d}" for i in range(300)}


def test_report_and_clusters(spark, papers):
    flags = papers.select("pos", (F.col("pos") % 5 == 0).alias("is_duplicate"))
    rows = papers.withColumn("doc_type", F.when(F.col("pos") % 2 == 0, "article"))
    figures = reports.search_figures(rows, flags, "src0", spark.createDataFrame([("q1", "first words")], "query_id string, label string"))
    got = {(r.section, r.key): (r.label, r.raw, r.unique_records) for r in figures.collect()}
    assert got["part", "all"] == (None, 42, 33) and got["part", "primary"][1] + got["part", "control"][1] == 42
    assert got["query", "src1/q1"][0] == "first words" and got["query", "src0/q0"][0] == "known items, not a search" and got["source", "src0"][0] and not got["source", "src1"][0]
    assert sum(v[1] for (s, _), v in got.items() if s == "query") == 42 and ("year", None) not in got and got["type", None][1] == 21
    items = spark.createDataFrame([("c1", True, "src1", "q1", "doi")], "item_id string, found boolean, sources string, queries string, matched_by string")
    text = reports.search_report(figures, items, 2)
    assert "| all |  | 42 | 33 | 78.6% |" in text and "| src1/q1 | first words |" in text and "too few" in text
    rows = spark.createDataFrame([(1, "IC1|IC2"), (2, "IC3")], "id int, matched_ic string")
    got = sorted((r.id, r.cluster) for r in screening.clusters(rows, {"both": (["IC1", "IC2"], [])}, members={"picked": [2, 9]}).collect())
    assert got == [(1, "both"), (2, "picked")]


def test_section_scans(spark):
    long = "This sentence is long enough to be kept in the summary of it all. " * 2
    cases = {
        f"A Title\nAbstract — {long}\nKeywords: a, b\nmore": ("abstract", long.strip()[:60]),
        f"Abstract: {long}\n1. A study\nrest": ("abstract", long.strip()[:60]),
        f"Abstract {long}\nTHE END": ("abstract", long.strip()[:60]),
        f"Abstract {long} and no end": ("abstract", ""),
        f"x\n2.1 Results\n\n{long}\nOther Part\nnot this": ("results", long.strip()[:60]),
        f"x\nRESULTS\n{long}": ("results", long.strip()[:60]),
        f"x\nresults of it\n{long}": ("results", ""),
    }
    for text, (kind, want) in cases.items():
        df = spark.createDataFrame([(text,)], "t string")
        got = df.select((profiles.abstract_section(F.col("t")) if kind == "abstract" else profiles.named_section(F.col("t"), "results")).alias("x")).collect()[0].x
        assert got[:60] == want[:60] and "not this" not in got and "Keywords" not in got, (text, got)
    titles_of = {"A fine study of logs\nin two lines\nAbstract\nno": "A fine study of logs in two lines", "ab\nA fine study\nSolo\nnext line": "A fine study", "me@x.org\nA fine study": "", "Solo!\nmore words": "Solo! more words"}
    for text, want in titles_of.items():
        assert spark.createDataFrame([(text,)], "t string").select(profiles.title_guess(F.col("t")).alias("x")).collect()[0].x == want, text


def test_expansion_keeps_the_first_step(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "a"), ("d", "a"), ("c", "a"), ("b", "e"), (None, "a"), ("a", None), ("f", "e"), ("g", "f")] + [(f"h{i}", "b") for i in range(50)]
    table = spark.createDataFrame(edges, "citing string, cited string")
    works = spark.createDataFrame([("b", "Title b"), ("e", "Title e")], "id string, title string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    got = {r.id: (r.depth, r.parent, r.way, r.title) for r in expansion.expand(seeds, table, works, 3).collect()}
    want = {"b": (1, "a", "backward", "Title b"), "c": (1, "a", "forward", None), "d": (1, "a", "forward", None), "e": (2, "b", "backward", "Title e"), "f": (3, "e", "forward", None)} | {f"h{i}": (2, "b", "forward", None) for i in range(50)}
    assert got == want
    only = expansion.expand(seeds, table, works, 1, ("backward",)).collect()
    assert [(r.id, r.n_parents) for r in only] == [("b", 1)]
    assert expansion.expand(seeds.limit(0), table, works, 2).collect() == []


def test_expansion_writes_edges_once_and_nothing_after_the_last_step(spark, monkeypatch):
    names, plain = [], expansion.written
    monkeypatch.setattr(expansion, "written", lambda df, name: names.append((name, df.columns)) or plain(df, name))
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a")], "citing string, cited string")
    works = spark.createDataFrame([("b", "Title b")], "id string, title string")
    got = sorted((r.id, r.n_parents) for r in expansion.expand(spark.createDataFrame([("a",)], "id string"), edges, works, 1).collect())
    assert got == [("b", 1), ("c", 1)]
    assert [n for n, _ in names] == ["steps", "frontier", "reached"] and names[0][1] == ["citing", "cited"]


def test_new_records_against_an_index_of_all_seen(spark, tmp_path):
    random.seed(12)
    made = [(i, f"10.1/{i // 2}" if i % 3 == 0 else None, t, y or None) for i, t, y in titles(120, 12)]
    batches = [made[:50], made[50:90], made[90:]]
    schema = "pos long, doi string, title string, year int, abstract string, authors array<string>, keywords array<string>, venue string, pages string"
    index, seen, reads = expansion.SeenIndex(spark, str(tmp_path)), [], []
    read = index._table
    index._table = lambda name, kind: (reads.append(name), read(name, kind))[1]
    block = lambda t, y: (y or 0, norm(t).split()[0]) if norm(t) else None
    alike = lambda a, b: norm(a[2]) and norm(b[2]) and block(a[2], a[3]) == block(b[2], b[3]) and token_sort(norm(a[2]), norm(b[2])) >= 92
    for rows in batches:
        table = spark.createDataFrame([(*r, "a" * (60 * (r[0] % 2)), [], [], None, None) for r in rows], schema)
        found = index.new(table)
        got = sorted(r.pos for r in found.collect())
        title = lambda r: (r[2] or "").strip().lower() or None
        fresh = [r for r in rows if not (r[1] and r[1] in {s[1] for s in seen}) and not (title(r) and title(r) in {title(s) for s in seen})]
        one, dois, names = [], set(), set()
        for r in fresh:
            if r[1] not in dois:
                one.append(r)
            dois.add(r[1] or object())
        two = []
        for r in one:
            if title(r) not in names:
                two.append(r)
            names.add(title(r) or object())
        left = [r for r in two if not any(alike(r, s) for s in seen)]
        rich = lambda r: 10 * bool(r[1]) + 5 * (r[0] % 2) + bool(r[3])
        gone = set()
        for i, a in enumerate(left):
            for b in left[i + 1 :]:
                if a[0] not in gone and b[0] not in gone and alike(a, b):
                    gone.add(a[0] if rich(b) > rich(a) else b[0])
        want = [r for r in left if r[0] not in gone]
        assert got == sorted(r[0] for r in want)
        index.add(found)
        seen += want
    assert set(reads) == {"keys", "pieces"} and index._batches() == 3


def test_title_links_say_all_pairs_without_pairs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(linkage, "_TILE", 7)
    rows = [(i, t, 2019) for i, t, _ in titles(60, 5)] + [(1000 + i, "Copies of a hot title all alike", 2019) for i in range(300)] + [(2000, "Copies of a hot title all alikes", 2019)]
    table = spark.createDataFrame(rows, "pos long, title string, year int")
    links = plans.queries()["similar_titles"]  # the registered query has this form
    monkeypatch.setattr(bind, "papers", lambda spark, sf: table)
    found = links(spark, "").collect()
    of = {r.b: r.a for r in found if r.kind == "member"}
    near = {(r.a, r.b) for r in found if r.kind == "similar"}
    known = [(i, norm(t)) for i, t, _ in rows if norm(t)]
    pairs = {(i, j) for i, a in known for j, b in known if i < j and a.split()[0] == b.split()[0] and token_sort(a, b) >= 92}
    assert set(of) == {i for i, _ in known} and (1000, 2000) in near and len(found) < 2 * len(rows)
    assert {(i, j) for i in of for j in of if i < j and (of[i] == of[j] or tuple(sorted((of[i], of[j]))) in near)} == pairs


def test_many_ratios_at_once_equal_one_by_one():
    rng = random.Random(4)
    words = ["the", "a", "of", "process", "mining", "x9", "tion", "in"]
    a = [" ".join(sorted(rng.choices(words, k=rng.randrange(45))))[: rng.choice([200, 63, 64, 65, 128, 129])] for _ in range(300)]
    b = ["".join(rng.choice(" abz9") if rng.random() < 0.03 else c for c in x if rng.random() > i % 6 * 0.08) for i, x in enumerate(a)]
    for least in (80, 92):
        want = [udfs.ratio(x, y) >= least for x, y in zip(a, b)]
        assert udfs.reach(pa.array(a), pa.array(b), least).tolist() == want and 0 < sum(want) < 300
        one = [a[0]] * 300
        assert udfs.reach(pa.array(one), pa.array(a), least, np.zeros(300, int)).tolist() == [udfs.ratio(a[0], y) >= least for y in a]


def test_the_index_has_one_row_for_each_title(spark, tmp_path):
    index = expansion.SeenIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame([(None, "Some long title of mining processes", 2019), (None, "Another title", 2019), (None, "another  TITLE", 2019)], "doi string, title string, year int"))
    assert index._table("pieces", index._PIECES).count() == 2


def test_titles_that_are_all_similar_make_no_pairs(spark, monkeypatch):
    """Three titles similar to each other, of many copies: one running best. A chain of titles is scanned as pairs."""
    hot = ["Hot title of many copies one", "Hot title of many copies ona", "Hot title of many copies on"]
    chain = ["chain aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "chain aaaaaaaaaaaaaaaaaaaaaaaaaaaabb", "chain aaaaaaaaaaaaaaaaaaaaaaaaaabbbb"]
    made = [hot[i % 3] for i in range(300)] + [chain[i % 3] for i in range(30)]
    rows = [(i, t, 2019, "10.1/x" if i % 5 == 4 else None, "a" * (60 * (i % 7 == 6)), [], [], None, None) for i, t in enumerate(made)]
    table = spark.createDataFrame(rows, "pos long, title string, year int, doi string, abstract string, authors array<string>, keywords array<string>, venue string, pages string")
    alike = [[token_sort(norm(a), norm(b)) >= 92 and norm(a).split()[0] == norm(b).split()[0] for b in hot + chain] for a in hot + chain]
    assert all(alike[i][j] for i in range(3) for j in range(3)) and alike[3][4] and alike[4][5] and not alike[3][5]
    kind = [i % 3 + 3 * (i >= 300) for i in range(330)]
    rich, gone, scanned = [10 * (i % 5 == 4) + 5 * (i % 7 == 6) + 1 for i in range(330)], {}, []
    for i in range(330):
        for j in range(i + 1, 330):
            if alike[kind[i]][kind[j]] and i not in gone and j not in gone:
                lost, kept = (i, j) if rich[j] > rich[i] else (j, i)
                gone[lost] = kept
    scan = linkage.greedy_scan
    monkeypatch.setattr(linkage, "greedy_scan", lambda pairs: (scanned.append(pairs.count()), scan(pairs))[1])
    assert {r.pos: r.duplicate_of_pos for r in linkage.fuzzy_duplicates(table).collect()} == gone
    assert 0 < scanned[0] <= 30 * 29 / 2


def test_copies_after_the_richest_make_no_pairs(spark, monkeypatch):
    """A chain of titles, the middle one of many copies: only records up to the richest of a title are scanned."""
    rng = random.Random(8)
    chain = ["chain " + "a" * (30 - 2 * k) + "b" * 2 * k for k in range(4)]
    made = [rng.choice([0, 1, 1, 1, 1, 2, 2, 3]) for _ in range(400)]
    rows = [(i, chain[k], 2019, "10.1/x" if i % 9 == 4 else None, "a" * (60 * (i % 7 == 6)), [], [], None, None) for i, k in enumerate(made)]
    table = spark.createDataFrame(rows, "pos long, title string, year int, doi string, abstract string, authors array<string>, keywords array<string>, venue string, pages string")
    rich, gone, scanned = [10 * (i % 9 == 4) + 5 * (i % 7 == 6) + 1 for i in range(400)], {}, []
    for i in range(400):
        for j in range(i + 1, 400):
            if i not in gone and j not in gone and token_sort(chain[made[i]], chain[made[j]]) >= 92:
                lost, kept = (i, j) if rich[j] > rich[i] else (j, i)
                gone[lost] = kept
    scan = linkage.greedy_scan
    monkeypatch.setattr(linkage, "greedy_scan", lambda pairs: (scanned.append(pairs.count()), scan(pairs))[1])
    assert {r.pos: r.duplicate_of_pos for r in linkage.fuzzy_duplicates(table).collect()} == gone
    assert 0 < scanned[0] < 400 * 399 / 8


@functools.lru_cache(None)
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_titles_of_a_large_block_meet_only_if_they_are_near(spark, monkeypatch):
    monkeypatch.setattr(linkage, "_TILE", 50)
    rng = random.Random(11)
    made = lambda: " ".join(rng.choice(["the", "of", "and", "tion", "ed", "ing", "an"]) + rng.choice(["th", "re", "er", "st", ""]) for _ in range(rng.choice([3, 8, 12, 16])))
    rows = ["w " + made() for _ in range(60)]
    rows += ["".join(rng.choice(["", "x", c + "y"]) if c != " " and i > 1 and rng.random() < 0.09 else c for i, c in enumerate(t)) for t in rows[:45]] + rows[:10] + ["v " + t for t in rows[:3]]
    table = spark.createDataFrame([(i, t, 2020) for i, t in enumerate(rows)], "pos long, title string, year int")
    key = lambda t: (t.split()[0], " ".join(sorted(norm(t).split())))
    for threshold in (92, 80):
        want, near = {}, set()
        for i, a in enumerate(map(key, rows)):
            for b in map(key, rows[:i]):
                if a[0] == b[0]:
                    apart, budget = edits(a[1], b[1]), (100 - threshold) * (len(a[1]) + len(b[1]))
                    near |= {tuple(sorted((a[1], b[1])))} if a[1] != b[1] and 100 * apart <= budget else set()
                    n = want.setdefault(a[0], [0, 0, 0])
                    n[0], n[1], n[2] = n[0] + 1, n[1] + (200 * apart <= budget), n[2] + (100 * apart > budget)
        assert {r.word: [r.pairs, r.accepted, r.rejected] for r in linkage.title_blocks(table, threshold).collect()} == want
        _, classes = linkage.title_classes(table)
        met, of = linkage.near_classes(classes, threshold).collect(), {r.cls: r.t for r in classes.collect()}
        assert {tuple(sorted((of[r.x], of[r.y]))) for r in met} == near and len(met) == len(near) > 10


def test_edit_distances_of_many_pairs():
    rng = random.Random(3)
    a = ["".join(rng.choice("abc 01") for _ in range(n)) for n in (0, 1, 2, 5, 63, 64, 65, 127, 128, 129, 200) * 4]
    b = ["".join(rng.choice(["", c + "x", "q"]) if rng.random() < rng.choice([0.05, 0.5]) else c for c in t) + rng.choice(["", "zz"]) for t in a]
    want = [edits(x, y) for x, y in zip(a, b)]
    assert udfs.edit_distances(pa.array(a), pa.array(b)).tolist() == want
    assert udfs.edit_distances(pa.array(a)[9:30], pa.array(b)[9:30]).tolist() == want[9:30]
    every, twice = pa.array(a + b), 2 * len(a)
    p, q = udfs.near_by_runs(every, every, 92, True)
    found = set(zip(p.tolist(), q.tolist()))
    pairs = [(i, j) for i in range(twice) for j in range(i + 1, twice)]
    apart = udfs.edit_distances(*(every.take(pa.array(ends)) for ends in zip(*pairs)))
    near = {(i, j) for (i, j), d in zip(pairs, apart) if 100 * d <= 8 * (len(every[i].as_py()) + len(every[j].as_py()))}
    assert near <= found and len(found) < len(pairs) / 2
