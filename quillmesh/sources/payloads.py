"""Landed response pages of search services to papers.

Each reader takes a DataFrame with a string column ``payload``, one JSON item (entry, article,
record, hit, work) a row. Broken JSON gives a row of nulls, which is dropped with the untitled ones
where the service marks errors so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, from_inverted_index, norm_doi, pages, strip
from ..operators.screening import first_match, relevant
from .files import as_papers

# Kinds of documents by what their type says, the first that fits.
KINDS_A = [("conference paper", "conference|proceeding"), ("article", "article|journal"), ("chapter", "chapter|book")]
KINDS_B = [("article", "journal"), ("conference paper", "conference")]
KINDS_C = [("article", "article"), ("chapter", "chapter|book")]
KINDS_D = [("article", "article"), ("conference paper", "conference|proceeding"), ("article", "review"), ("chapter", "chapter|book")]
WORK_KINDS = {"journal-article": "article", "proceedings-article": "conference paper", "conference-paper": "conference paper"}
RECORD_A, RECORD_B = "https://www.scopus.com/record/display.uri?eid=", "https://ieeexplore.ieee.org/document/"
RECORD_D = "https://www.webofscience.com/wos/woscc/full-record/"
YEARS = (1994, 2026)
_NONE = "array<string>"


def _items(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(F.from_json("payload", schema).alias("p")).select("p.*")


def _kind(c: Column, rules) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(first_match(low, rules), F.nullif(low, F.lit("")), F.lit("unknown"))


def _list(c: Column) -> Column:
    """Stripped values of a list, without blank ones; null is the empty list."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast(_NONE)), strip), lambda x: x.isNotNull() & (x != ""))


def _year(*columns) -> Column:
    return F.coalesce(*(F.left(F.col(c), F.lit(4)).try_cast("int") for c in columns))


def _plain(**columns) -> list[Column]:
    return [strip(c if isinstance(c, Column) else F.col(c)).alias(name) for name, c in columns.items()]


def _filled(**columns) -> list[Column]:
    """As ``_plain``; what is blank is null, as what is missing."""
    return [F.nullif(c, F.lit("")).alias(name) for name, c in zip(columns, _plain(**columns))]


def payload_a(raw: DataFrame, query_id: str = "", label: str = "") -> DataFrame:
    """Flat entries; creators split at ";", keywords at "|"; entries with an error are dropped."""
    names = ("error", "dc:creator", "authkeywords", "prism:coverDate", "prism:doi", "eid", "dc:title", "dc:description", "prism:publicationName", "subtypeDescription", "prism:volume", "prism:issueIdentifier", "prism:pageRange", "dc:publisher")
    e = _items(raw, ", ".join(f"`{n}` string" for n in names)).filter(blank_to_null(F.col("error")).isNull())
    out = e.select(
        *_plain(doi="`prism:doi`", title="`dc:title`", abstract="`dc:description`", venue="`prism:publicationName`", volume="`prism:volume`", issue="`prism:issueIdentifier`", pages="`prism:pageRange`", publisher="`dc:publisher`"),
        _list(F.split("`dc:creator`", ";")).alias("authors"), _list(F.split("authkeywords", r"\|")).alias("keywords"), _year("`prism:coverDate`").alias("year"), _kind(F.col("subtypeDescription"), KINDS_A).alias("doc_type"), F.concat(F.lit(RECORD_A), F.nullif("eid", F.lit(""))).alias("url"),
    )
    return as_papers(out, "scopus", query_id, label)


def payload_b(raw: DataFrame, query_id: str = "", label: str = "") -> DataFrame:
    """Nested authors; three keyword lists merged, each keyword once, in order."""
    terms = "struct<terms: array<string>>"
    a = _items(raw, f"authors struct<authors: array<struct<full_name: string>>>, publication_year string, doi string, article_number string, index_terms {terms}, author_terms {terms}, controlled_terms {terms}, content_type string, title string, abstract string, publication_title string, volume string, issue string, start_page string, end_page string, publisher string")
    keywords = F.array_distinct(F.concat(*(_list(F.col(f"{k}.terms")) for k in ("index_terms", "author_terms", "controlled_terms"))))
    out = a.select(
        *_filled(doi="doi", title="title", abstract="abstract", venue="publication_title", volume="volume", issue="issue", publisher="publisher"),
        _list(F.col("authors.authors.full_name")).alias("authors"), keywords.alias("keywords"), F.col("publication_year").try_cast("int").alias("year"), _kind(F.col("content_type"), KINDS_B).alias("doc_type"), F.concat(F.lit(RECORD_B), F.nullif("article_number", F.lit(""))).alias("url"), pages(F.col("start_page"), F.col("end_page")).alias("pages"),
    )
    return as_papers(out, "ieee", query_id, label)


def _either(c: Column, *keys: str) -> Column:
    """A value that is text itself or an object with the text under one of some keys."""
    found = [F.nullif(F.get_json_object(c, f"$.{k}"), F.lit("")) for k in keys]
    return F.when(F.startswith(c, F.lit("{")), F.coalesce(*found)).otherwise(c)


def payload_c(raw: DataFrame, query_id: str = "", label: str = "") -> DataFrame:
    """Creators, addresses and subjects are text or objects; four dates stand in for one another."""
    names = ("creators", "authors", "publicationDate", "onlineDate", "coverDate", "printDate", "doi", "identifier", "url", "subjects", "keywords", "contentType", "genre", "type", "title", "abstract", "journalTitle", "publicationName", "volume", "number", "startingPage", "endingPage", "publisher")
    r = _items(raw, ", ".join(f"{n} string" for n in names))
    many = lambda first, second: F.coalesce(*(F.from_json(F.when(F.col(c) != "[]", F.col(c)), _NONE) for c in (first, second)))
    some = lambda *cols: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols))
    name = strip(F.col("identifier"))
    by_name = F.when((F.coalesce(strip(F.col("doi")), F.lit("")) == "") & F.startswith(name, F.lit("doi:")), strip(F.substring(name, 5, 1 << 30))).when(F.contains(name, F.lit("/")), name)
    first_url = F.when(F.startswith("url", F.lit("[")), F.get(F.from_json("url", _NONE), F.lit(0))).otherwise(F.col("url"))
    out = r.select(
        *_filled(doi=F.coalesce(by_name, F.col("doi")), title="title", abstract="abstract", venue=some("journalTitle", "publicationName"), volume="volume", issue="number", publisher="publisher"),
        _list(F.transform(many("creators", "authors"), lambda x: _either(x, "creator", "name", "author"))).alias("authors"), _list(F.transform(many("subjects", "keywords"), lambda x: _either(x, "term", "value"))).alias("keywords"),
        _year("publicationDate", "onlineDate", "coverDate", "printDate").alias("year"), _either(first_url, "value", "url").alias("url"), _kind(some("contentType", "genre", "type"), KINDS_C).alias("doc_type"), pages(F.col("startingPage"), F.col("endingPage")).alias("pages"),
    )
    return as_papers(out, "springer", query_id, label)


def payload_d(raw: DataFrame, query_id: str = "", label: str = "") -> DataFrame:
    """Nested names, source and identifiers; the record's link or one made from its id; no publisher."""
    h = _items(raw, "uid string, names struct<authors: array<struct<displayName: string>>>, source struct<publishYear: string, sourceTitle: string, volume: string, issue: string, pages: struct<range: string>>, identifiers struct<doi: string>, links struct<record: string>, keywords struct<authorKeywords: array<string>, keywordsPlus: array<string>>, types array<string>, abstract struct<value: string>, title struct<value: string>")
    keywords = F.array_distinct(F.concat(_list(F.col("keywords.authorKeywords")), _list(F.col("keywords.keywordsPlus"))))
    url = F.coalesce(blank_to_null(F.col("links.record")), F.concat(F.lit(RECORD_D), F.nullif("uid", F.lit(""))))
    out = h.select(
        *_filled(doi="identifiers.doi", title="title.value", abstract="abstract.value", venue="source.sourceTitle", volume="source.volume", issue="source.issue", pages="source.pages.range"),
        _list(F.col("names.authors.displayName")).alias("authors"), keywords.alias("keywords"), F.col("source.publishYear").try_cast("int").alias("year"), _kind(F.get("types", F.lit(0)), KINDS_D).alias("doc_type"), url.alias("url"),
    )
    return as_papers(out, "wos", query_id, label)


def works(raw: DataFrame, direction: str, parent_doi: str, *term_lists) -> DataFrame:
    """Nested works found through citations; dropped without title, when irrelevant or outside the years.

    ``term_lists``: of each list a term must occur in title or abstract. A work without a year stays.
    """
    w = _items(raw, "id string, title string, doi string, publication_year int, type string, abstract_inverted_index map<string, array<int>>, authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string>>, keywords array<struct<display_name: string>>")
    w = w.withColumn("abstract", F.when(F.size("abstract_inverted_index") > 0, from_inverted_index(F.col("abstract_inverted_index"))))
    w = w.filter((F.col("title") != "") & (F.col("publication_year").isNull() | F.col("publication_year").between(*YEARS)))
    if term_lists:
        w = w.filter(relevant(F.concat_ws(" ", "title", "abstract"), *term_lists))
    kinds = F.create_map(*(F.lit(x) for kv in WORK_KINDS.items() for x in kv))
    out = w.select(norm_doi(F.col("doi")).alias("doi"), "title", "abstract", F.col("publication_year").alias("year"), _list(F.col("authorships.author.display_name")).alias("authors"), F.col("primary_location.source.display_name").alias("venue"), _list(F.col("keywords.display_name")).alias("keywords"), F.coalesce(kinds[F.col("type")], F.col("type")).alias("doc_type"), F.col("id").alias("url"))
    return as_papers(out, "snowball", f"snowball_{direction}", f"snowball:{direction} from {parent_doi}")


def citation_rows(pages_: DataFrame) -> DataFrame:
    """Rows seed, direction, title, year, doi, abstract, venue of pages (seed, direction, payload): forward pages hold citing works, backward ones cited works."""
    paper = "struct<title: string, year: string, abstract: string, venue: string, externalIds: struct<DOI: string>>"
    data = F.from_json("payload", f"data array<struct<citingPaper: {paper}, citedPaper: {paper}>>")["data"]
    hit = pages_.select("seed", "direction", F.explode(data).alias("h")).select("seed", "direction", F.when(F.col("direction") == "forward", F.col("h.citingPaper")).otherwise(F.col("h.citedPaper")).alias("p"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return hit.select("seed", "direction", text("p.title").alias("title"), text("p.year").alias("year"), text("p.externalIds.DOI").alias("doi"), text("p.abstract").alias("abstract"), text("p.venue").alias("venue"))
