"""Sections of extracted text and payload readers against values worked out by hand."""

import json

from pyspark.sql import functions as F

from quillmesh.operators import exports, profiles
from quillmesh.sources import payloads

PAPER_TEXT = (
    "A Study of Merge\nQueues in Practice\nJane Doe jane@example.org\nAbstract - "
    "We look at how merge queues change the pace of teams. The results show that queues shorten waits by a third. More of it is said further below.\n"
    "Introduction\nTeams merge often and wait long.\n\n"
    "2 Findings\nQueues find broken builds before they reach anyone else. Waiting times improve in most of the teams seen.\nConclusion\nDone.\n"
)


def rows(spark, *items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "payload string")


def test_sections(spark):
    df = spark.createDataFrame([(PAPER_TEXT,), ("",), (None,)], "text string")
    got = profiles.extracted(df).collect()
    assert got[0].title_guess == "A Study of Merge Queues in Practice"
    assert got[0].abstract_found.startswith("We look at how") and got[0].abstract_found.endswith("More of it is said further below.")
    assert got[0].results_found == "The results show that queues shorten waits by a third."
    for r in got[1:]:
        assert (r.title_guess, r.abstract_found, r.results_found, r.clean_length) == ("", "", "", 0)
    part = df.select(profiles.named_section(F.col("text"), "findings").alias("s")).first().s
    assert part == "Queues find broken builds before they reach anyone else. Waiting times improve in most of the teams seen."


def test_summary_keeps_the_first_sentence_whatever_its_length(spark):
    s = ["a" * 30 + ".", "b" * 30 + ".", "c" * 30 + "."]
    df = spark.createDataFrame([(s,), ([],)], "s array<string>")
    cut = [r[0] for r in df.select(profiles.summarized(F.col("s"), 2, 1000)).collect()]
    assert cut == [" ".join(s[:2]), ""]
    assert df.select(profiles.summarized(F.col("s"), 3, 20)).first()[0] == "a" * 20


def test_profile_of_nothing(spark):
    r = profiles.profile(spark.createDataFrame([(None,)], "title string"), "title").first()
    assert (r.decision, r.level, r.criteria, r.questions, r.priority) == ("excluir", "L0", "EC1", "RQ1", "Média")


def test_articles(spark):
    r = payloads.payload_b(rows(spark, {"authors": {"authors": [{"full_name": " A B "}, {"full_name": ""}]}, "publication_year": "2019", "title": " T ", "article_number": "7", "content_type": "IEEE Journals", "index_terms": {"terms": ["x", "y"]}, "author_terms": {"terms": ["y", " z "]}, "start_page": "3", "end_page": "9"})).first()
    assert (r.title, r.authors, r.year, r.doc_type, r.keywords, r.pages) == ("T", ["A B"], 2019, "article", ["x", "y", "z"], "3-9")
    assert r.url.endswith("/7")


def test_articles_with_blank_fields(spark):
    first, second = payloads.payload_b(rows(spark, {"title": " \n", "abstract": "", "publication_title": " ", "article_number": "1"}, {"article_number": "2"})).collect()
    assert (first.title, first.abstract, first.venue) == (second.title, second.abstract, second.venue) == (None, None, None)


def test_records_of_mixed_types(spark):
    first = {"creators": [{"creator": "A"}, "B"], "onlineDate": "2020-02-01", "identifier": "doi:10.1/x", "url": [{"value": "http://u"}], "subjects": [{"term": "k"}, "l"], "contentType": "Article", "startingPage": "1"}
    second = {"authors": ["C"], "publicationDate": "", "identifier": "10.2/y", "url": "http://v", "genre": "BookSection"}
    a, b = sorted(payloads.payload_c(rows(spark, first, second)).collect(), key=lambda r: r.doi)
    assert (a.doi, a.authors, a.year, a.url, a.keywords, a.doc_type, a.pages) == ("10.1/x", ["A", "B"], 2020, "http://u", ["k", "l"], "article", "1")
    assert (b.doi, b.authors, b.year, b.url, b.keywords, b.doc_type) == ("10.2/y", ["C"], None, "http://v", [], "chapter")


def test_records_with_blank_fields(spark):
    first, second = payloads.payload_c(rows(spark, {"title": " \n", "abstract": "", "journalTitle": " ", "doi": " "}, {"url": "http://v"})).collect()
    assert (first.title, first.abstract, first.venue, first.doi) == (second.title, second.abstract, second.venue, second.doi) == (None,) * 4


def test_hits_and_works(spark):
    h = payloads.payload_d(rows(spark, {"uid": "W:1", "names": {"authors": [{"displayName": "D"}]}, "source": {"publishYear": 2001, "pages": {"range": "1-2"}}, "types": ["Review"], "title": {"value": "T"}, "keywords": {"authorKeywords": ["a"], "keywordsPlus": ["a", "b"]}})).first()
    assert (h.title, h.year, h.doc_type, h.keywords, h.pages) == ("T", 2001, "article", ["a", "b"], "1-2")
    assert h.url.endswith("/W:1")
    found = rows(spark, {"title": "Old", "publication_year": 1990}, {"title": None}, {"title": "Event logs", "doi": "https://doi.org/10.1/Z", "publication_year": 2000, "type": "journal-article", "abstract_inverted_index": {"software": [1], "our": [0]}}, {"title": "Event cooking"})
    r = payloads.works(found, "forward", "10.9/p", ("event",), ("software",)).collect()
    assert [(x.title, x.doi, x.abstract, x.doc_type, x.source_query_id) for x in r] == [("Event logs", "10.1/z", "our software", "article", "snowball_forward")]


def test_hits_with_blank_fields(spark):
    blank = {"title": {"value": " \n"}, "abstract": {"value": ""}, "source": {"sourceTitle": " "}, "identifiers": {"doi": ""}}
    first, second = payloads.payload_d(rows(spark, blank, {"uid": "W:2"})).collect()
    assert (first.title, first.abstract, first.venue, first.doi) == (second.title, second.abstract, second.venue, second.doi) == (None,) * 4


def test_routes_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None), (2, True, ["w"]), (3, False, None), (4, None, ["w"])], "id int, parsed boolean, warnings array<string>")
    assert {r.id: r.route for r in exports.routed(df).collect()} == {1: "good", 2: "review", 3: "error", 4: "error"}
    for _ in range(2):
        exports.append_log(df.select("id"), str(tmp_path / "log"), stage="x")
    assert spark.read.json(str(tmp_path / "log")).filter("stage = 'x'").count() == 8


def test_a_profile_looks_for_each_term_once(spark):
    from quillmesh.operators import profiles

    table = spark.createDataFrame([("a GitHub case study", "process mining")], "t string, a string")
    plan = profiles.profile(table, "t", "a").select("method", "technique", "level", "assessment", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("Contains") <= len(profiles._TERMS)
