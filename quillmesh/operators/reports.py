"""Statistics of the stages as small tables, and the search report as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

def _has(c: str) -> Column:
    return blank_to_null(F.col(c)).isNotNull()


def _said(c: str, value: str) -> Column:
    return F.count_if(F.coalesce(F.col(c) == value, F.lit(False)))


def overview(flags: DataFrame, control: str) -> DataFrame:
    """part (all, primary, control), raw, unique_records, removed, rate: with and without the control source.

    ``flags``: source_db, is_duplicate. One pass: each row counts for all and for one of the parts.
    """
    part = F.explode(F.array(F.lit("all"), F.when(F.col("source_db") == control, "control").otherwise("primary")))
    unique = F.count_if(~F.col("is_duplicate"))
    return flags.select(part.alias("part"), "is_duplicate").groupBy("part").agg(F.count("*").alias("raw"), unique.alias("unique_records"), (F.count("*") - unique).alias("removed"), ((F.count("*") - unique) / F.count("*")).alias("rate"))


def first_stage_statistics(rows: DataFrame) -> DataFrame:
    """One row: decisions with their percentages, rows to review, rows without an abstract. Reads decision,
    manual_review_required, evidence_status."""
    n = F.count("*")
    share = lambda value: (100 * _said("decision", value) / n).alias(f"{value}_pct")
    counts = [_said("decision", d).alias(d) for d in ("include", "exclude", "maybe")]
    undecided = F.count_if(~F.coalesce(F.col("decision").isin("include", "exclude", "maybe"), F.lit(False))).alias("undecided")
    review = F.count_if(F.lower(F.coalesce(F.col("manual_review_required").cast("string"), F.lit(""))) == "true").alias("manual_review")
    return rows.agg(n.alias("total"), *counts, *(share(d) for d in ("include", "exclude", "maybe")), undecided, review, _said("evidence_status", "missing_abstract").alias("missing_abstract"))


def second_stage_statistics(rows: DataFrame, *by: str) -> DataFrame:
    """Coverage, decisions and progress of the queue, over all of it or by the columns given.

    Reads decision, abstract, oa_url, doi, ft_decision.
    """
    n = F.count("*")
    decided = _said("ft_decision", "include") + _said("ft_decision", "exclude") + _said("ft_decision", "pending")
    return rows.groupBy(*by).agg(
        n.alias("total"), _said("decision", "include").alias("first_include"), _said("decision", "maybe").alias("first_maybe"), F.count_if(_has("abstract")).alias("with_abstract"), F.count_if(_has("oa_url")).alias("with_url"), F.count_if(_has("doi")).alias("with_doi"),
        _said("ft_decision", "include").alias("included"), _said("ft_decision", "exclude").alias("excluded"), _said("ft_decision", "pending").alias("pending"), F.count_if(~_has("ft_decision")).alias("undecided"), (100 * decided / n).alias("progress_pct"),
    )


def recovery_by_step(enriched: DataFrame, step: str = "step") -> DataFrame:
    """step, n, of_recovered_pct, of_queue_pct: what each step has filled. ``enriched``: every queue row, step null where nothing was filled."""
    counts = enriched.groupBy(step).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("_queue"), F.sum(F.when(F.col(step).isNotNull(), F.col("n"))).alias("_recovered"))
    both = counts.filter(F.col(step).isNotNull()).crossJoin(F.broadcast(totals))  # one row
    return both.select(F.col(step), "n", (100 * F.col("n") / F.col("_recovered")).alias("of_recovered_pct"), (100 * F.col("n") / F.col("_queue")).alias("of_queue_pct"))


def coverage_by_band(before: DataFrame, after: DataFrame) -> DataFrame:
    """band, papers, before, gained, after, after_pct: abstracts in two snapshots (pos, band, abstract), by the first one's band."""
    later = after.select("pos", _has("abstract").alias("_after"))
    both = before.select("pos", "band", _has("abstract").alias("_before")).join(later.hint("merge"), "pos", "left")
    now = F.count_if(F.coalesce("_after", F.lit(False)))
    return both.groupBy("band").agg(F.count("*").alias("papers"), F.count_if("_before").alias("before"), F.count_if(F.coalesce("_after", F.lit(False)) & ~F.col("_before")).alias("gained"), now.alias("after"), (100 * now / F.count("*")).alias("after_pct"))


def level_distribution(rows: DataFrame, level: str = "level", confidence: str = "confidence") -> DataFrame:
    """kind, value, n: rows by level and by confidence; null and blank count as unknown."""
    name = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit("unknown"))
    long = rows.select(F.explode(F.array(F.struct(F.lit("level").alias("kind"), name(level).alias("value")), F.struct(F.lit("confidence").alias("kind"), name(confidence).alias("value")))).alias("x"))
    return long.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def disagreement_counts(pairs: DataFrame) -> DataFrame:
    """stage, n, binary: how many ratings differ, and how many by include or not."""
    differ = pairs.filter("primary <> verifier")
    two = (F.col("primary") == "include") != (F.col("verifier") == "include")
    return differ.groupBy("stage").agg(F.count("*").alias("n"), F.count_if(two).alias("binary"))


def input_profile(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: rows, with_file, with_file_pct (rounded down), without_file, flagged: ids of ``flagged`` (pos) among them."""
    marks = flagged.select("pos").distinct().withColumn("_flag", F.lit(1))
    with_file = F.count_if(_has("pdf_file"))
    return rows.join(marks.hint("merge"), "pos", "left").agg(F.count("*").alias("rows"), with_file.alias("with_file"), F.floor(100 * with_file / F.count("*")).alias("with_file_pct"), (F.count("*") - with_file).alias("without_file"), F.countDistinct(F.when(F.col("_flag") == 1, F.col("pos"))).alias("flagged"))


def search_figures(papers: DataFrame, flags: DataFrame, control: str, labels: DataFrame) -> DataFrame:
    """section, key, label, raw, unique_records: all figures of the search report, by one pass over the records.

    ``papers``: pos, source_db, query_id, year, doc_type; ``flags``: pos, is_duplicate; ``labels``: query_id, label, one row
    of each. Sections: part (all, primary, control), source, query (with its label; the control source's queries
    are marked as such), year (known ones), type. Years and types count unique records only in ``unique_records``.
    """
    joined = papers.select("pos", "source_db", "query_id", "year", "doc_type").join(flags.select("pos", "is_duplicate").hint("merge"), "pos")
    named = lambda section, key: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))
    is_control = F.col("source_db").eqNullSafe(F.lit(control))
    year = F.when(F.col("year") != 0, F.col("year"))
    query = F.concat_ws("/", "source_db", "query_id")
    rows = joined.select(
        "is_duplicate",
        F.when(is_control, "known items, not a search").alias("note"),
        "query_id",
        F.explode(F.array(named("part", F.lit("all")), named("part", F.when(is_control, "control").otherwise("primary")), named("source", F.col("source_db")), named("query", query), named("year", year), named("type", F.col("doc_type")))).alias("x"),
    )
    counted = rows.filter("x.section <> 'year' or x.key is not null").groupBy("x.section", "x.key", F.when(F.col("x.section") == "query", F.col("query_id")).alias("query_id"), F.when(F.col("x.section").isin("query", "source"), F.col("note")).alias("note"))
    counted = counted.agg(F.count("*").alias("raw"), F.count_if(~F.col("is_duplicate")).alias("unique_records"))
    return counted.join(labels.select("query_id", "label").hint("merge"), "query_id", "left").select("section", "key", F.coalesce("label", "note").alias("label"), "raw", "unique_records")


def search_report(figures: DataFrame, items: DataFrame | None = None, threshold: int = 8) -> str:
    """The figures as a Markdown text, a table for each section, and known items with a verdict.

    ``figures``: of ``search_figures``; what comes to the driver is a row for each source, query, year and type.
    ``items``: a control report.
    """
    by: dict[str, list] = {}
    for r in figures.collect():
        by.setdefault(r.section, []).append(r)
    text = ["# Search report"]
    for section in ("part", "source", "query", "year", "type"):
        text += ["", f"## By {section}", "", f"| {section} | label | raw | unique | kept |", "|-|-|-|-|-|"]
        text += [f"| {r.key} | {r.label or ''} | {r.raw} | {r.unique_records} | {r.unique_records / r.raw:.1%} |" for r in sorted(by.get(section, []), key=lambda r: (r.key is None, r.key))]
    if items is not None:
        rows = items.orderBy("item_id").collect()
        found = sum(r.found for r in rows)
        text += ["", "## Known items", "", "| item | match | sources | queries |", "|-|-|-|-|", *(f"| {r.item_id} | {r.matched_by} | {r.sources} | {r.queries} |" for r in rows)]
        text += ["", f"{found} of {len(rows)} known items found, {threshold} asked for: {'enough' if found >= threshold else 'too few'}."]
    return "\n".join([*text, ""])
