"""The review queue over time: what to work on next, what carries over, how outcomes are recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, norm_doi
from . import keys
from .screening import priority_band, priority_score

#: Columns that a rebuilt queue takes over from the one before it.
CARRIED = ("ft_oa_url", "ft_decision", "ft_rationale", "ft_confidence")

# What is recorded where no file could be found, and where a file was read.
NO_FILE = {"ft_decision": "pending", "ft_screened_by": "manual_no_pdf", "ft_confidence": "low", "ft_evidence_status": "missing_pdf", "ft_manual_review_required": "true"}
FILE_READ = {"ft_evidence_status": "pdf_full_text", "ft_manual_review_required": "false"}
YES, NO = "sim", "não"


def blank(c: str) -> Column:
    return blank_to_null(F.col(c)).isNull()


def download_target() -> Column:
    """Included, or included earlier and not decided yet."""
    return F.coalesce(F.col("ft_decision") == "include", F.lit(False)) | (F.coalesce(F.col("decision") == "include", F.lit(False)) & blank("ft_decision"))


def rescreen_target(confirm_includes: bool = False, force: bool = False) -> Column:
    """To be screened again: maybe (and include, on demand) with an abstract, undecided unless forced."""
    wanted = ["maybe", "include"] if confirm_includes else ["maybe"]
    return F.coalesce(F.col("decision").isin(*wanted), F.lit(False)) & ~blank("abstract") & (blank("ft_decision") | F.lit(force))


def blank_target(force: bool = False) -> Column:
    return blank("ft_decision") | F.lit(force)


def extraction_target(with_file: bool = True, force: bool = False) -> Column:
    """To be extracted: with a file, or without one and an abstract or title; no finding yet unless forced."""
    kind = ~blank("pdf_file") if with_file else blank("pdf_file") & (~blank("abstract") | ~blank("title"))
    return kind & (blank("main_finding") | F.lit(force))


def pending_target(force: bool = False) -> Column:
    """With a file, and not decided or put off before, unless forced."""
    said = F.lower(F.coalesce(blank_to_null(F.col("ft_decision")), F.lit("")))
    return ~blank("pdf_file") & (said.isin("", "pending") | F.lit(force))


def rebuilt_queue(screened: DataFrame, before: DataFrame | None, force: bool = False) -> DataFrame:
    """Records to include or maybe, with what the queue before said of them, scored anew.

    ``before``: pos, abstract and CARRIED columns, one row of each pos. Its abstract counts only where
    the record has none. ``force`` starts without it.
    """
    queue = screened.filter(F.col("decision").isin("include", "maybe")).drop(*CARRIED)
    if before is None or force:
        out = queue.withColumns({c: F.lit("") for c in CARRIED})
    else:
        old = before.select("pos", F.col("abstract").alias("_abstract"), *CARRIED)
        out = queue.join(old.hint("merge"), "pos", "left").withColumns({"abstract": F.coalesce(blank_to_null(F.col("abstract")), "_abstract"), **{c: F.coalesce(c, F.lit("")) for c in CARRIED}}).drop("_abstract")
    return out.withColumn("oa_url", F.coalesce(blank_to_null(F.col("ft_oa_url")), "oa_url")).withColumn("score", priority_score())


def fill_open_urls(queue: DataFrame, offers: DataFrame) -> DataFrame:
    """Fills oa_url by DOI (of records with one DOI the last one gets it), then scores, bands and ranks again.

    ``offers``: doi, url. Ranks are in order of descending score, then title, then pos.
    """
    given = offers.select(norm_doi(F.col("doi")).alias("_doi"), blank_to_null(F.col("url")).alias("_url")).filter("_doi is not null and _url is not null").groupBy("_doi").agg(F.min("_url").alias("_url"))
    keyed = queue.select("pos", norm_doi(F.col("doi")).alias("_doi"), blank("oa_url").alias("_open")).filter("_open and _doi is not null")
    last = keyed.groupBy("_doi").agg(F.max("pos").alias("pos"))
    got = last.join(given.hint("merge"), "_doi").select("pos", "_url")
    out = queue.join(got.hint("merge"), "pos", "left").withColumn("oa_url", F.coalesce(blank_to_null(F.col("oa_url")), "_url")).drop("_url")
    scored = out.withColumn("score", priority_score()).withColumn("band", priority_band())
    return keys.global_rank(scored, "rank", F.desc("score"), F.asc(F.coalesce("title", F.lit(""))), F.asc("pos"))


def responses_joined(responses: DataFrame, papers: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Responses with their record's columns; unknown ids keep blanks, or are skipped."""
    return responses.join(papers.hint("merge"), "pos", "left" if keep_unknown else "inner")


def lookup_by_kind(rows: DataFrame, tables: dict[str, DataFrame], kind: str, key: str, *columns: str) -> DataFrame:
    """``columns`` out of the table that a row's ``kind`` names; null where there is none.

    All tables go into one, tagged, so there is one join whatever their number. The first row of a
    key counts in each table, by the order of its values.
    """
    tagged = None
    for name, table in tables.items():
        one = table.groupBy(key).agg(F.min(F.struct(*columns)).alias("_v")).withColumn(kind, F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    out = rows.join(tagged.hint("merge"), [kind, key], "left")
    return out.withColumns({c: F.coalesce(F.col(f"_v.{c}"), F.col(c)) if c in rows.columns else F.col(f"_v.{c}") for c in columns}).drop("_v")


def with_origin(**parts: DataFrame) -> DataFrame:
    """All parts in one table with the name of each in ``origin``; columns that a part lacks are null."""
    out = None
    for name, part in parts.items():
        one = part.withColumn("origin", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def id_partition(rows: DataFrame, files: DataFrame, declared: DataFrame, key: str = "pos") -> DataFrame:
    """key, state (mapped, missing or unidentified), pdf_file: a file wins over a declaration that there is none."""
    mapped = files.groupBy(key).agg(F.min("pdf_file").alias("pdf_file"))
    gone = declared.select(key).distinct().withColumn("_gone", F.lit(True))
    out = rows.select(key).join(mapped.hint("merge"), key, "left").join(gone.hint("merge"), key, "left")
    state = F.when(F.col("pdf_file").isNotNull(), "mapped").when(F.col("_gone"), "missing").otherwise("unidentified")
    return out.select(key, state.alias("state"), "pdf_file")


def mark_without_file(queue: DataFrame, ids: DataFrame, note: str) -> DataFrame:
    """Of the ids given, records without a decision become pending with a note; a decision is never overwritten."""
    chosen = ids.select("pos").distinct().withColumn("_marked", F.lit(True))
    out = queue.join(chosen.hint("merge"), "pos", "left")
    hit = F.coalesce(F.col("_marked"), F.lit(False)) & blank("ft_decision")
    new = {**NO_FILE, "ft_rationale": note}
    return out.withColumn("_hit", hit).withColumns({c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c) if c in queue.columns else F.lit(None).cast("string")) for c, v in new.items()}).drop("_hit", "_marked")


def file_override(decisions: DataFrame) -> DataFrame:
    """Decisions made from the whole file: their evidence is the file, and no review is needed."""
    return decisions.withColumns({c: F.lit(v) for c, v in FILE_READ.items()})


def download_outcomes(attempts: DataFrame, papers: DataFrame, sources: list[str]) -> DataFrame:
    """pos, pdf_status, pdf_source, oa_url: the first source that gave a file, else the first that gave a link.

    ``attempts``: pos, source, url, saved (boolean). Status: downloaded, oa_found or manual.
    """
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    tried = attempts.filter(blank_to_null(F.col("url")).isNotNull() & (rank > 0)).withColumn("_rank", rank)
    best = tried.groupBy("pos").agg(F.min(F.struct(F.when(F.col("saved"), 0).otherwise(1).alias("_later"), "_rank", "source", "url")).alias("_b"))
    out = papers.select("pos").join(best.hint("merge"), "pos", "left")
    status = F.when(F.col("_b").isNull(), "manual").when(F.col("_b._later") == 0, "downloaded").otherwise("oa_found")
    return out.select("pos", status.alias("pdf_status"), F.col("_b.source").alias("pdf_source"), F.col("_b.url").alias("oa_url"))


def audited(queue: DataFrame, audit: DataFrame) -> DataFrame:
    """Corrections of a file audit: wrong files lose their file and are excluded with the new criterion,
    screened-again ones take the new decision. ``audit``: pos, audit_result, new_decision, new_ec."""
    one = audit.groupBy("pos").agg(F.min(F.struct("audit_result", "new_decision", "new_ec")).alias("_a"))
    out = queue.join(one.hint("merge"), "pos", "left")
    result = F.coalesce(F.col("_a.audit_result"), F.lit(""))
    return out.withColumns(
        {
            "route": F.when(result == "wrong_pdf", "wrong_file").when(result == "rescreened", "rescreened").when(F.col("_a.new_ec").isNotNull(), "new_criterion").otherwise("unchanged"),
            "pdf_file": F.when(result == "wrong_pdf", F.lit(None)).otherwise(F.col("pdf_file")),
            "ft_decision": F.when(result == "wrong_pdf", "exclude").otherwise(F.coalesce("_a.new_decision", "ft_decision")),
            "matched_ec": F.coalesce("_a.new_ec", "matched_ec"),
        }
    ).drop("_a")


def conservative_closure(queue: DataFrame) -> DataFrame:
    """Records still pending with neither abstract nor file are excluded for lack of access (EC5)."""
    said = F.lower(F.coalesce(blank_to_null(F.col("ft_decision")), F.lit("")))
    closes = said.isin("", "pending") & blank("abstract") & blank("pdf_file")
    return queue.withColumn("_closes", closes).withColumns({"ft_decision": F.when(F.col("_closes"), "exclude").otherwise(F.col("ft_decision")), "matched_ec": F.when(F.col("_closes"), "EC5").otherwise(F.col("matched_ec"))}).drop("_closes")


def sequential_ids(rows: DataFrame, *order: Column, prefix: str = "snow_", digits: int = 5) -> DataFrame:
    """Adds internal_id: a prefix and the row's number in the order given, from 0, with leading zeros."""
    ranked = keys.global_rank(rows.drop("internal_id"), "_rank", *order)
    n = (F.col("_rank") - 1).cast("string")
    return ranked.withColumn("internal_id", F.concat(F.lit(prefix), F.lpad(n, digits, "0") if digits == 0 else F.when(F.length(n) >= digits, n).otherwise(F.lpad(n, digits, "0")))).drop("_rank")


def content_route() -> tuple[Column, Column]:
    """(content, origin): the file's text, else the abstract, else the title only."""
    text, abstract = blank_to_null(F.col("file_text")), blank_to_null(F.col("abstract"))
    return F.coalesce(text, abstract, F.col("title")), F.when(text.isNotNull(), "file").when(abstract.isNotNull(), "abstract").otherwise("title")


def extraction_template(included: DataFrame, files: DataFrame, metadata: DataFrame, blanks: tuple[str, ...] = ("main_finding", "notes")) -> DataFrame:
    """The sheet that extraction starts from: the record, its file, a provider's metadata, and blank columns.

    The provider's abstract wins over the record's. Order with ``template_order``.
    """
    mapped = files.groupBy("pos").agg(F.min("pdf_file").alias("pdf_file"))
    known = metadata.groupBy("pos").agg(F.min(F.struct("authors", "venue", "pages", "abstract")).alias("_m"))
    out = included.join(mapped.hint("merge"), "pos", "left").join(known.hint("merge"), "pos", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        "pos", text("title").alias("title"), text("doi").alias("doi"), "year", "source_db", text("matched_ic").alias("matched_ic"), text("_m.authors").alias("authors"), text("_m.venue").alias("venue"), text("_m.pages").alias("pages"),
        F.coalesce(blank_to_null(F.col("_m.abstract")), "abstract", F.lit("")).alias("abstract"), F.when(F.col("pdf_file").isNull(), NO).otherwise(YES).alias("pdf_available"), text("pdf_file").alias("pdf_file"), *(F.lit("").alias(c) for c in blanks),
    )


def template_order() -> list[Column]:
    """Records without a file last, then by criteria and year."""
    return [F.asc(F.col("pdf_available") == NO), F.asc("matched_ic"), F.asc("year"), F.asc("pos")]


def included_order() -> list[Column]:
    return [F.desc_nulls_last("year"), F.desc("title"), F.desc("pos")]


def scores_with_third_table(old: DataFrame, new: DataFrame, facts: DataFrame, manual: tuple[str, ...] = ("manual", "avaliado_manual")) -> DataFrame:
    """pos, title, qa_total, qa_status: scores over old ones unless a person set them; ids new to the
    table take their title from ``facts``."""
    both = old.select("pos", F.col("title").alias("_title"), F.col("qa_total").alias("_old"), "qa_status").join(new.select("pos", F.col("qa_total").alias("_new"), F.lit(True).alias("_scored")).hint("merge"), "pos", "full_outer")
    out = both.join(facts.select("pos", F.col("title").alias("_fact")).hint("merge"), "pos", "left")
    held = F.coalesce(F.col("qa_status").isin(*manual), F.lit(False))
    return out.select("pos", F.coalesce("_title", "_fact").alias("title"), F.when(held, F.col("_old")).otherwise(F.coalesce("_new", "_old")).alias("qa_total"), F.when(held | F.col("_scored").isNull(), F.col("qa_status")).otherwise("avaliado_llm").alias("qa_status"))


def step_checkpoints(papers: DataFrame, steps: list[tuple], folder: str) -> DataFrame:
    """Runs steps one after another, each written to its own folder and read back, and reused where it is complete.

    ``steps``: (name, function of a DataFrame). A step that has its _SUCCESS mark is not run again, so a
    run that was cut short goes on where it ended.
    """
    spark, out = papers.sparkSession, papers
    for i, (name, step) in enumerate(steps):
        path = f"{folder.rstrip('/')}/{i:02d}-{name}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            step(out).write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
    return out


def latest_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """A manifest looked up by an id or a file name: of each key that is not blank the last row by the columns of ``order``.

    An aggregate and no window, so a hot key is combined before it is shuffled.
    """
    known = rows.filter(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "")
    rest = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return known.groupBy(key).agg(last).select(key, "_last.*").select(*rows.columns)
