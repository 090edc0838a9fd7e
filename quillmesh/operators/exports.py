"""Records as RIS and BibTeX text, one row for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_word, last_name, norm_title


def _line(tag: str, value):
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), value))


def ris(papers: DataFrame) -> DataFrame:
    """internal_id, ris. Lines without a value are left out."""
    kind = F.when(F.contains(F.lower(F.coalesce("doc_type", F.lit(""))), F.lit("conference")), "CPAPER").when(F.contains(F.lower(F.coalesce("doc_type", F.lit(""))), F.lit("chapter")), "CHAP").otherwise("JOUR")
    venue = F.when(kind == "JOUR", _line("JF", F.col("venue"))).otherwise(_line("T2", F.col("venue")))
    parts = F.split("pages", "-")
    lines = F.concat(
        F.array(F.concat(F.lit("TY  - "), kind), F.concat(F.lit("TI  - "), F.coalesce("title", F.lit("")))),
        F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("AU  - "), a)),
        F.array(_line("PY", F.col("year").cast("string")), _line("AB", F.col("abstract")), venue, _line("DO", F.col("doi")), _line("SP", F.trim(F.get(parts, F.lit(0)))), _line("EP", F.trim(F.get(parts, F.lit(1))))),
        F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.concat(F.lit("KW  - "), k)),
        F.array(F.concat(F.lit("N1  - Source: "), "source_db"), F.lit("ER  - ")),
    )
    return papers.select("internal_id", F.array_join(F.array_compact(lines), "\n").alias("ris"))


def bibtex(papers: DataFrame) -> DataFrame:
    """internal_id, citekey, bibtex. The key is author, year and the first title word; the abstract is cut at 500."""
    article = F.contains(F.lower(F.coalesce("doc_type", F.lit("article"))), F.lit("article"))
    kind = F.when(article, "article").otherwise("inproceedings")
    who = F.coalesce(F.regexp_replace(last_name(F.get("authors", F.lit(0))), "[^A-Za-z0-9]", ""), F.lit("anon"))
    key = F.concat(who, F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.left(first_word(norm_title(F.col("title"))), F.lit(8)))
    cut = F.concat(F.left("abstract", F.lit(500)), F.when(F.length("abstract") > 500, "...").otherwise(""))

    def field(name, value):
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  {name:<9} = {{"), value, F.lit("}")))

    venue = F.when(article, field("journal", F.col("venue"))).otherwise(field("booktitle", F.col("venue")))
    fields = F.array_compact(F.array(field("title", F.col("title")), field("author", F.array_join("authors", " and ")), field("year", F.col("year").cast("string")), venue, field("doi", F.col("doi")), field("pages", F.col("pages")), field("abstract", cut)))
    return papers.select("internal_id", key.alias("citekey"), F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}")).alias("bibtex"))


def append_log(rows: DataFrame, path: str, **extras: str) -> None:
    """Append raw rows as JSON lines, stamped with the time and any extras."""
    stamped = rows.withColumn("logged_at", F.current_timestamp())
    stamped.withColumns({k: F.lit(v) for k, v in extras.items()}).write.mode("append").json(path)


#: A record of a batch of work: what ran, how it ended, for how many rows, and anything else by name.
BATCH = "batch_id string, stage string, status string, n_rows long, logged_at timestamp, extras map<string,string>"


def log_batches(batches: DataFrame, path: str) -> None:
    """Append batch records of a declared shape; columns that BATCH does not name go into extras as text. ``logged_at`` is now where it is missing."""
    names = [c.strip().split(" ")[0] for c in BATCH.rpartition(", extras")[0].split(",")]
    kinds = dict(c.strip().split(" ") for c in BATCH.rpartition(", extras")[0].split(","))
    more = [x for c in batches.columns if c not in names for x in (F.lit(c), F.col(c).cast("string"))]
    have = {c: F.col(c).cast(kinds[c]) if c in batches.columns else F.lit(None).cast(kinds[c]) for c in names}
    have["logged_at"] = F.coalesce(have["logged_at"], F.current_timestamp())
    extras = F.create_map(*more) if more else F.lit(None).cast("map<string,string>")
    batches.select(*(c.alias(n) for n, c in have.items()), extras.cast("map<string,string>").alias("extras")).write.mode("append").parquet(path)


def review_order() -> list[Column]:
    """The order of the pending sheet: group rank, then priority rank, both last where they are no whole number, then title."""
    number = lambda c: F.when(F.col(c).cast("string").rlike("^[0-9]+$"), F.col(c).try_cast("long"))
    return [F.asc_nulls_last(number("group_rank")), F.asc_nulls_last(number("priority_rank")), F.asc(F.coalesce("title", F.lit("")))]


def routed(results: DataFrame) -> DataFrame:
    """Adds route (good, review or error) and review_reason, from parsed and warnings (an array)."""
    warned = F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0
    route = F.when(~F.coalesce("parsed", F.lit(False)), "error").when(warned, "review").otherwise("good")
    return results.withColumns({"route": route, "review_reason": F.when(route == "review", F.array_join("warnings", "; "))})


def write_routes(results: DataFrame, path: str) -> None:
    """Good rows, rows to review and errors, each in a partition of one table written in one pass."""
    routed(results).write.mode("overwrite").partitionBy("route").json(path)


def review_artefacts(queue: DataFrame) -> dict[str, DataFrame]:
    """The lists a reviewer works from: pending, pending by priority, pending with a DOI but no file, included."""
    pending = queue.filter("decision = 'maybe'")
    no_file = ~F.coalesce(F.lower("pdf_status"), F.lit("")).isin("downloaded", "oa_found")
    return {
        "pending": pending,
        "prioritised": pending.orderBy("grp", F.desc("score"), "internal_id"),
        "doi_without_file": pending.filter(no_file & (F.coalesce("doi", F.lit("")) != "")),
        "included": queue.filter("decision = 'include'"),
    }


def manual_list(queue: DataFrame) -> DataFrame:
    """What has to be fetched by hand, the newest first."""
    wanted = queue.filter(F.lower("pdf_status").isin("manual", "not_found", "failed"))
    return wanted.select("internal_id", "year", "title", "doi", "pdf_status").orderBy(F.desc_nulls_last("year"), "internal_id")
