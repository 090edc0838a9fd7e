"""Queries of the review's workflow: targets, carry-over, matching by title, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import file_slug
from ..operators import enrich, expansion, keys, linkage, matching, reports, screening, workflow
from ..storage import shared_folder
from . import bind

NOTE = "No file found by hand; the whole text cannot be read."
ALLOWED = ("en", "fr", "src0", "src1")
ITEMS = ["qa1", "qa2", "qa3", "qa4"]


def _rebuilt(spark, sf):
    return workflow.rebuilt_queue(bind.queue(spark, sf), bind.snapshot(spark, sf))


def _worked(spark, sf):
    """The queue with what a snapshot says of it, a file and a finding."""
    old = bind.snapshot(spark, sf).drop("abstract")
    rows = bind.queue(spark, sf).join(old.hint("merge"), "pos", "left")
    return rows.withColumns({"pdf_file": bind.pdf_file(), "main_finding": F.when(F.col("ft_confidence") == "high", "found"), "matched_ec": F.lit(None).cast("string")})


def queue_rebuilt(spark, sf):
    return _rebuilt(spark, sf).select("pos", "decision", F.length("abstract").alias("n_chars"), "ft_decision", "ft_confidence", "oa_url", "score")


def open_urls_filled(spark, sf):
    q = bind.queue(spark, sf).filter("decision in ('include', 'maybe')")
    offers = bind.papers(spark, sf).select("doi", F.when(F.length("title") % 2 == 0, F.concat(F.lit("https://oa.org/"), F.col("pos"))).alias("url"))
    return workflow.fill_open_urls(q, offers).select("pos", "oa_url", "score", "band", "rank")


def first_stage_statistics(spark, sf):
    rows = bind.queue(spark, sf).withColumns({"evidence_tags": F.lit(""), "confidence": F.lit("high"), "rationale": F.lit("")})
    return reports.first_stage_statistics(screening.evidence_policy(rows))


def second_stage_statistics(spark, sf):
    return reports.second_stage_statistics(_rebuilt(spark, sf).withColumn("band", screening.priority_band()), "band")


def recovery_summary(spark, sf):
    out = enrich.enrich_by_doi(bind.papers(spark, sf), bind.provider(spark, sf), ["beta", "alpha"])
    return reports.recovery_by_step(out.select(F.col("abstract_source").alias("step")))


def coverage_gain(spark, sf):
    before = bind.queue(spark, sf).filter("decision in ('include', 'maybe')").withColumn("score", screening.priority_score()).withColumn("band", screening.priority_band())
    return reports.coverage_by_band(before.select("pos", "band", "abstract"), _rebuilt(spark, sf).select("pos", "abstract"))


def level_distribution(spark, sf):
    level = F.when(F.col("decision") != "exclude", F.concat(F.lit("L"), T.count_criteria(F.col("matched_ic"))))
    return reports.level_distribution(_worked(spark, sf).select(level.alias("level"), F.col("ft_confidence").alias("confidence")))


def disagreement_counts(spark, sf):
    return reports.disagreement_counts(bind.rater_pairs(spark, sf))


def input_profile(spark, sf):
    flagged = bind.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("pos"))
    return reports.input_profile(_worked(spark, sf), flagged)


def overview_by_part(spark, sf):
    flags = linkage.exact_duplicates(bind.papers(spark, sf)).select("pos", "is_duplicate")
    return reports.overview(bind.papers(spark, sf).select("pos", "source_db").join(flags.hint("merge"), "pos"), "src0")


def search_figures(spark, sf):
    flags = linkage.exact_duplicates(bind.papers(spark, sf)).select("pos", "is_duplicate")
    return reports.search_figures(bind.papers(spark, sf), flags, "src0", bind.query_labels(spark, sf))


def work_targets(spark, sf):
    flags = {
        "download": workflow.download_target(), "rescreen": workflow.rescreen_target(), "rescreen_all": workflow.rescreen_target(True, True), "blank": workflow.blank_target(),
        "extract_file": workflow.extraction_target(), "extract_text": workflow.extraction_target(False), "pending": workflow.pending_target(),
    }
    return _worked(spark, sf).select("pos", *(c.alias(n) for n, c in flags.items()))


def marked_pending(spark, sf):
    ids = bind.papers(spark, sf).filter("doi is null").select("pos")
    return workflow.mark_without_file(_worked(spark, sf), ids, NOTE).select("pos", "ft_decision", "ft_rationale", "ft_confidence", "ft_evidence_status", "ft_manual_review_required")


def content_routes(spark, sf):
    texts = bind.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("file_text"))
    rows = _worked(spark, sf).join(texts.hint("merge"), "pos").withColumn("file_text", F.when(F.col("pdf_file").isNotNull(), F.col("file_text")))
    content, origin = workflow.content_route()
    return rows.select("pos", origin.alias("origin"), F.md5(content).alias("digest"))


def title_membership(spark, sf):
    return matching.membership(bind.papers(spark, sf), bind.controls(spark, sf), "known").select("pos", "known")


def id_states(spark, sf):
    declared = bind.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("pos"))
    files = _worked(spark, sf).filter("pdf_file is not null").select("pos", "pdf_file")
    return workflow.id_partition(bind.papers(spark, sf), files, declared)


def extraction_sheet(spark, sf):
    worked = _worked(spark, sf)
    docs = bind.table(spark, sf, "documents")
    facts = docs.select(F.col("doc_id").alias("pos"), F.col("source").alias("authors"), F.col("lang").alias("venue"), F.col("n_chars").cast("string").alias("pages"), F.when(F.col("n_chars") > 500, F.col("text")).alias("abstract"))
    facts = facts.join(bind.table(spark, sf, "labels").select(F.col("doc_id").alias("pos")).distinct(), "pos", "left_semi")
    sheet = workflow.extraction_template(bind.queue(spark, sf).filter("decision = 'include'"), worked.filter("pdf_file is not null").select("pos", "pdf_file"), facts)
    placed = keys.global_rank(sheet.withColumn("n_chars", F.length("abstract")).drop("abstract", "title"), "place", *workflow.template_order())
    return placed.select("pos", "matched_ic", "authors", "venue", "pages", "n_chars", "pdf_available", "pdf_file", "main_finding", "place")


def first_links(spark, sf):
    n, pos = F.length("title"), F.col("pos")
    direct = F.when(n % 3 == 0, "https://doi.org/10.1/x").when(n % 3 == 1, F.concat(F.lit("https://files.org/"), pos))
    link = lambda kind, base: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(base), pos).alias("url"))
    items = bind.papers(spark, sf).select(pos.alias("at"), "doi", direct.alias("direct"), F.array(link("Reader", "https://r.org/"), link("PDF", "https://p.org/")).alias("links"))
    return matching.first_links(bind.papers(spark, sf), items)


def responses_joined(spark, sf):
    said = screening.parse_decisions(bind.responses(spark, sf)).select(F.col("conv_id").alias("pos"), "turn", "decision")
    return workflow.responses_joined(said, bind.papers(spark, sf).select("pos", "source_db"))


def lookup_by_kind(spark, sf):
    rows = bind.papers(spark, sf).select("pos", F.when(F.col("doc_type") == "article", "aux").otherwise("recovered").alias("kind"))
    tables = {"aux": bind.snapshot(spark, sf).select("pos", F.col("ft_decision").alias("note")), "recovered": bind.table(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("note"))}
    return workflow.lookup_by_kind(rows, tables, "kind", "pos", "note").select("pos", "kind", "note")


def target_union(spark, sf):
    recovered = bind.snapshot(spark, sf).filter("ft_oa_url is not null").select("pos", F.col("ft_oa_url").alias("url"))
    aux = bind.snapshot(spark, sf).filter("ft_decision = 'include'").select("pos").join(bind.papers(spark, sf).select("pos", F.length("abstract").alias("n_chars")).hint("merge"), "pos", "left")
    return workflow.with_origin(recovered=recovered, aux=aux).select("pos", "url", "n_chars", "origin")


def merged_scores(spark, sf):
    docs, labels = bind.table(spark, sf, "documents"), bind.table(spark, sf, "labels")
    old = labels.select(F.col("doc_id").alias("pos"), F.concat(F.lit("old "), "doc_id").alias("title"), F.col("quality").cast("int").alias("qa_total"), F.when(F.col("toxic") == 1, "manual").otherwise("avaliado_llm").alias("qa_status"))
    new = docs.select(F.col("doc_id").alias("pos"), F.when(F.col("n_chars") > 300, (F.col("n_chars") % 9).cast("int")).alias("qa_total"))
    return workflow.scores_with_third_table(old, new, bind.papers(spark, sf))


def quality_json(spark, sf):
    n = F.col("n_chars")
    body = F.concat(F.lit('{"qa1": '), (n % 3).cast("string"), F.lit(', "qa2": "'), (n % 2).cast("string"), F.lit('", "qa3": '), F.when(n % 5 == 0, "null").when(n % 5 == 1, '"x"').when(n % 5 == 2, "true").otherwise("0.5"), F.lit("}"))
    response = F.when(n % 7 == 0, F.left(body, F.lit(9))).when(n % 7 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return bind.table(spark, sf, "documents").select("doc_id", *T.quality_items(response, ITEMS))


def tag_lists(spark, sf):
    d = bind.table(spark, sf, "documents")
    values = F.array("lang", F.concat(F.lit(" "), F.upper("source")), F.lit("Bad One!"), F.upper("lang"))
    return d.select("doc_id", T.tag_list(values, ALLOWED).alias("tags"), T.enum_value(F.col("source"), ALLOWED, "unclear").alias("kind"))


def file_slugs(spark, sf):
    return bind.papers(spark, sf).select("pos", file_slug(F.col("title")).alias("slug"))


def search_links(spark, sf):
    return bind.papers(spark, sf).select("pos", T.search_link(F.col("title")).alias("link"))


def clean_cells(spark, sf):
    cell = T.clean_cell(F.col("text"))
    return bind.table(spark, sf, "documents").select("doc_id", F.length(cell).alias("n"), F.md5(cell).alias("digest"))


def percent_by_source(spark, sf):
    flags = bind.papers(spark, sf).groupBy("source_db").agg(F.count_if(F.col("doi").isNotNull()).alias("k"), F.count("*").alias("n"))
    return flags.select("source_db", T.percent(F.col("k") / F.col("n"), 2).alias("with_doi"))


def file_decisions(spark, sf):
    rows = _worked(spark, sf).filter("pdf_file is not null").select("pos", "ft_decision")
    return workflow.file_override(rows)


def download_outcomes(spark, sf):
    q = bind.queue(spark, sf)
    tries = F.array(F.struct(F.lit("core").alias("source"), F.col("url").alias("url"), (F.length("title") % 3 == 0).alias("saved")), F.struct(F.lit("unpaywall").alias("source"), F.col("oa_url").alias("url"), (F.length("title") % 5 == 0).alias("saved")))
    attempts = q.select("pos", F.explode(tries).alias("x")).select("pos", "x.*")
    return workflow.download_outcomes(attempts, q, ["unpaywall", "core"])


def audit_routes(spark, sf):
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    audit = bind.table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.when(toxic, "wrong_pdf").when(good, "rescreened").otherwise("ok").alias("audit_result"), F.when(good, "include").alias("new_decision"), F.when(toxic, "EC5").alias("new_ec"))
    return workflow.audited(_worked(spark, sf), audit).select("pos", "route", "pdf_file", "ft_decision", "matched_ec")


def closed_queue(spark, sf):
    return workflow.conservative_closure(_worked(spark, sf)).select("pos", "ft_decision", "matched_ec")


def sequential_ids(spark, sf):
    return workflow.sequential_ids(bind.papers(spark, sf).select("pos", "year", "internal_id"), F.asc("year"), F.asc("pos")).select("pos", "internal_id")


def included_order(spark, sf):
    rows = bind.queue(spark, sf).filter("decision = 'include'").select("pos", "year", "title")
    return keys.global_rank(rows, "place", *workflow.included_order()).select("pos", "place")


def response_status(spark, sf):
    r = bind.responses(spark, sf).withColumn("status", F.when(F.col("turn") % 3 == 0, "errored").otherwise("succeeded"))
    return screening.parse_pages(r).select("conv_id", "turn", "state", "decision")


def control_validation(spark, sf):
    return matching.control_report(bind.controls(spark, sf), bind.papers(spark, sf))


def control_coverage(spark, sf):
    return matching.coverage(control_validation(spark, sf))


def _offers(spark, sf):
    return bind.provider(spark, sf).select("provider", "title", "year", F.col("abstract").alias("text"))


def enrich_cascade(spark, sf):
    """By DOI first, then by title for what is left."""
    by_doi = enrich.enrich_by_doi(bind.papers(spark, sf), bind.provider(spark, sf), ["beta", "alpha"])
    left = by_doi.filter("abstract is null").select("pos", "title", "year", "abstract")
    return matching.enrich_by_title(left, _offers(spark, sf), ["beta", "alpha"]).select("pos", F.length("abstract").alias("n_chars"), "abstract_source", "abstract_match_type")


def title_exact_matches(spark, sf):
    """The part of the title matches that wins at once: equal normalised titles."""
    return matching.exact_title_match(bind.papers(spark, sf), _offers(spark, sf)).select("pos", "provider", F.length("text").alias("n_chars"))


def urls_by_title(spark, sf):
    offers = bind.papers(spark, sf).select(F.col("pos").alias("at"), "title", (F.col("year") + F.col("pos").cast("int") % 3).alias("year"), F.concat(F.lit("https://f.org/"), F.col("pos")).alias("url"))
    return matching.url_by_title(bind.papers(spark, sf), offers)


def citation_network(spark, sf):
    """Two steps from the parts of one brand: orders that cite them, and what these cite."""
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    parts, orders = bind.table(spark, sf, "part"), bind.table(spark, sf, "orders")
    edges = bind.edges(spark, sf).select(named("order ", "citing").alias("citing"), named("part ", "cited").alias("cited"))
    works = parts.select(named("part ", "p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("int").alias("year")).unionByName(orders.select(named("order ", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year")))
    seeds = parts.filter("p_brand = 'Brand#11'").select(named("part ", "p_partkey").alias("id"))
    return expansion.expand(seeds, edges, works, 2)


def new_against_seen(spark, sf):
    """All papers against an index of the known items and of the labelled papers."""
    index = expansion.SeenIndex(spark, f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}")
    index.add(bind.controls(spark, sf).select("doi", "title", "year"))
    labelled = bind.table(spark, sf, "labels").select(F.col("doc_id").alias("pos")).distinct()
    index.add(bind.papers(spark, sf).join(labelled.hint("merge"), "pos", "left_semi").select("doi", "title", "year"))
    return index.new(bind.papers(spark, sf)).select("pos", "source_db")


def queries():
    own = [v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"]
    return {f.__name__: f for f in own}
