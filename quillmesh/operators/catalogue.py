"""The catalogue of search queries: listing, and the forms that providers take them in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Clauses of the interactive search form, and field names.
LIMIT = r"LIMIT-TO\s*\([^)]+\)"
LIMIT_KIND = r'(?i)LIMIT-TO\s*\(\s*DOCTYPE\s*,\s*"(\w+)"\s*\)'
LIMIT_LANGUAGE = r'(?i)LIMIT-TO\s*\(\s*LANGUAGE\s*,\s*"([^"]+)"\s*\)'
ANY_FIELD = r'"All Metadata"\s*:\s*'
_TOKEN = rf'(?i){LIMIT}|"[^"]*"|[()]|\s+|[^\s()"]+|"'


def listing(queries: DataFrame, database: str | None = None, show_query: bool = False) -> DataFrame:
    """database, n_queries (of that database), id, label, notes, and on demand query; of one database or all."""
    chosen = queries if database is None else queries.filter(F.col("database") == database)
    counts = chosen.groupBy("database").agg(F.count("*").alias("n_queries"))
    return chosen.join(counts, "database").select("database", "n_queries", "id", "label", "notes", *["query"] * show_query)


def clauses(query: Column) -> Column:
    """The clauses of a query: what its operators AND outside all brackets and quotes stand between.

    The query is read token by token: a limit clause, a quoted text, a bracket, white space or a word.
    """
    tokens = F.regexp_extract_all(query, F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def read(state: Column, token: Column) -> Column:
        ends = (state["depth"] == 0) & (F.upper(token) == "AND")
        step = F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        return F.struct(
            F.greatest(F.lit(0), state["depth"] + step).alias("depth"),
            F.when(ends, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(ends, F.lit("")).otherwise(F.concat(state["open"], token)).alias("open"),
        )

    return F.aggregate(tokens, start, read, lambda state: F.array_append(state["done"], state["open"]))


def without_limits(query: Column) -> Column:
    """The query on one line, without limit clauses; limits of language become a clause of their own.

    Of each clause the limits go; one that held nothing but limits, brackets and ORs goes whole. Operators
    are whole words; blank clauses are dropped; a null query is null.
    """
    bare = F.transform(clauses(query), lambda clause: strip(F.regexp_replace(F.regexp_replace(clause, rf"(?i){LIMIT}", ""), r"\s+", " ")))
    kept = F.filter(bare, lambda clause: F.regexp_replace(clause, r"(?i)\bOR\b|[\s()]", "") != "")
    languages = F.transform(F.array_distinct(F.regexp_extract_all(query, F.lit(LIMIT_LANGUAGE), F.lit(1))), lambda x: F.format_string("LANGUAGE(%s)", F.lower(x)))
    turned = F.when(F.size(languages) > 0, F.array(F.concat(F.lit("("), F.array_join(languages, " OR "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(kept, turned), " AND ")


def limited_kinds(query: Column) -> Column:
    """The document types that the limit clauses name, with commas; null without any."""
    kinds = F.regexp_extract_all(query, F.lit(LIMIT_KIND), F.lit(1))
    return F.when(F.size(kinds) > 0, F.array_join(kinds, ","))


def plain_boolean(query: Column) -> Column:
    """Without the any-field prefix of each term."""
    return strip(F.regexp_replace(query, ANY_FIELD, ""))


def keywords(query: Column) -> Column:
    """All quoted terms as keywords joined by AND; a query without quotes as it is."""
    terms = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    named = F.array_join(F.transform(terms, lambda x: F.concat(F.lit('keyword:"'), x, F.lit('"'))), " AND ")
    return F.when(F.size(terms) > 0, named).otherwise(strip(query))


def escape_slashes(identifier: Column) -> Column:
    return F.replace(identifier, F.lit("/"), F.lit("\\/"))
