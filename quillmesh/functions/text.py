"""Normalisers and text rules as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .characters import html_unescape

# Fixed values.
DOI_IN_TEXT = r"(?i)\b10\.\d{4,9}/[-._;()/:a-z0-9]+\b"
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
SPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    """Without white space at either end, as Python's strip sees it."""
    return F.btrim(c, F.lit(SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def norm_doi(c: Column) -> Column:
    """Lower case, stripped, without the first of the five known prefixes; blank is null. The input is named once."""
    prefix = "^(?:" + "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES) + ")"
    return blank_to_null(F.regexp_replace(strip(F.lower(c)), prefix, ""))


def norm_doi_strip(c: Column) -> Column:
    """Strips any of the prefixes' letters on the left, twice: kept for compatibility."""
    low = strip(F.lower(c))
    return F.ltrim(F.ltrim(low, F.lit("https://doi.org/")), F.lit("http://dx.doi.org/"))


def norm_doi_replace(c: Column) -> Column:
    """Drops the resolver's address wherever it stands."""
    return strip(F.lower(F.replace(c, F.lit("https://doi.org/"), F.lit(""))))


def norm_title(c: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces."""
    bare = F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", "")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def norm_title_ws(c: Column, n: int = 120) -> Column:
    return F.left(strip(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(n))


def norm_title_html(c: Column) -> Column:
    return norm_title(html_unescape(c))


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def last_name(c: Column) -> Column:
    """Of "Last, First" or "First Last"."""
    words = F.split(strip(c), r"\s+")
    return F.when(F.contains(c, F.lit(",")), strip(F.split_part(c, F.lit(","), F.lit(1)))).otherwise(F.element_at(words, -1))


def first_word(c: Column) -> Column:
    return F.split_part(c, F.lit(" "), F.lit(1))


def clean_markup(c: Column) -> Column:
    """Entities to text, tags to spaces, runs of white space to one space."""
    return strip(F.regexp_replace(F.regexp_replace(html_unescape(c), "<[^>]+>", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def clean_extracted(c: Column) -> Column:
    """Text taken from files: control characters as spaces, hyphenated line ends joined, at most one blank line."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"-\n", ""), r"\n{2,}", "\n\n"))


def sentences(c: Column, more_than: int = 20) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > more_than)


def find_doi(c: Column) -> Column:
    """The first DOI in a text: a registrant of 4 to 9 digits and a suffix of letters, digits and ``-._;()/:``."""
    return blank_to_null(F.rtrim(F.regexp_extract(c, DOI_IN_TEXT, 0), F.lit(".,;")))


def year_of(c: Column) -> Column:
    """Of a year or a date as text, or of nested date-parts as JSON ([[2019, 3]]): the first four digits' number."""
    plain = F.ltrim(strip(c.cast("string")), F.lit("[ "))
    return F.left(plain, F.lit(4)).try_cast("int")


# Where an item says when it came out, the first that does wins.
DATE_KEYS = ("published-print", "published-online", "published", "issued")


def year_by_keys(item: Column, keys: tuple[str, ...] = DATE_KEYS) -> Column:
    """Of an item as JSON the year under the first of some keys that has date-parts; null if that is no whole number."""
    parts = [F.get_json_object(item, f"$['{k}']['date-parts'][0]") for k in keys]
    return F.trim(F.split_part(F.btrim(F.coalesce(*(F.nullif(p, F.lit("[]")) for p in parts)), F.lit('[]" ')), F.lit(","), F.lit(1)), F.lit('" ')).try_cast("int")


def pages(first: Column, last: Column) -> Column:
    return blank_to_null(F.concat_ws("-", blank_to_null(first), blank_to_null(last)))


def doc_type(c: Column) -> Column:
    """A publication type in one of five words."""
    low = F.lower(F.coalesce(c, F.lit("")))
    ladder = (("conference", "conference paper"), ("proceeding", "conference paper"), ("review", "review"), ("chapter", "book chapter"), ("book", "book"), ("article", "article"), ("journal", "article"))
    return reduce(lambda rest, x: F.when(F.contains(low, F.lit(x[0])), x[1]).otherwise(rest), reversed(ladder), blank_to_null(low))


def from_inverted_index(c: Column) -> Column:
    """Text of a map from word to positions: in order of position, the later word wins a slot, gaps dropped."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    # bound once as the only element of an array: a lambda's outer expressions are computed for each element
    beside = lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.when(y["p"].isNull() | (y["p"] != x["p"]), x["w"]))
    return F.array_join(F.get(F.transform(F.array(F.array_sort(pairs)), beside), F.lit(0)), " ")


def word_index(words: Column) -> Column:
    """A list of words as a map from word to its positions (from 0), in a row by itself: sorted, then cut where a word begins; null without words."""
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def entries(s):
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        entry = lambda i, j: F.struct(F.get(s, i)["w"].alias("key"), F.transform(F.slice(s, i + 1, F.coalesce(j, F.size(s)) - i), lambda x: x["p"]).alias("value"))
        return bound(begins, lambda b: F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), entry))

    return F.when(F.size(words) > 0, F.map_from_entries(bound(placed, entries)))


def strip_fences(c: Column) -> Column:
    """What stands between the outermost braces, code fences dropped."""
    return F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), r"(?s)\{.*\}", 0)


def count_criteria(c: Column, prefix: str = "IC") -> Column:
    return F.coalesce(F.size(F.filter(F.split(c, r"\|"), lambda x: F.startswith(strip(x), F.lit(prefix)))), F.lit(0))


def contains_any(c: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms])


def quality_items(response: Column, items: list[str]) -> list[Column]:
    """1, 0 or null for each item of a quality response: whole numbers from 1 on (or true) count as 1, the rest as 0.

    A number with a fraction is cut to a whole one; other values, missing ones and broken JSON are null.
    """
    data = F.from_json(F.coalesce(F.nullif(strip_fences(response), F.lit("")), response), "map<string,string>")

    def item(name):
        v = strip(data[name])
        n = F.when(v.rlike(r"^[+-]?\d+(\.\d+)?$"), v.try_cast("double")).when(v == "true", 1.0).when(v == "false", 0.0)
        return F.when(n >= 1, 1).when(n.isNotNull(), 0).alias(name)

    return [item(i) for i in items]


def tag_list(values: Column, allowed) -> Column:
    """Slugs of an array's values that a vocabulary allows, each once, in order, with bars between them."""
    slugs = F.transform(F.coalesce(values, F.array().cast("array<string>")), slugify)
    return F.array_join(F.array_distinct(F.filter(slugs, lambda x: x.isin(*allowed))), "|")


def enum_value(value: Column, allowed, default: str) -> Column:
    """A value's slug where a vocabulary allows it, else ``default``."""
    return F.when(slugify(value).isin(*allowed), slugify(value)).otherwise(default)


def search_link(title: Column, base: str = "https://scholar.google.com/scholar?q=") -> Column:
    """A search for a title in quotes, percent-encoded."""
    encoded = F.url_encode(F.concat(F.lit('"'), title, F.lit('"')))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), encoded)


def clean_cell(c: Column) -> Column:
    """A cell of a sheet: control characters and runs of white space as one space; null as empty."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return F.btrim(F.regexp_replace(plain, r"(?U)\s+", " "))


def percent(share: Column, digits: int = 1) -> Column:
    """A share as text, rounded half to even, for renderers only."""
    return F.concat(F.replace(F.format_number(100 * share, digits), F.lit(","), F.lit("")), F.lit("%"))


def blank_if_missing(c: Column) -> Column:
    """Text of a value; null, NaN and the words nan and none as empty."""
    text = strip(c.cast("string"))
    return F.when(c.isNull() | F.lower(text).isin("nan", "none"), "").otherwise(text)
