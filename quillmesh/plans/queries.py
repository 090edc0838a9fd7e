"""One query for each operator (or small family of operators) on the bound tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, catalogue, enrich, exports, keys, linkage, profiles, screening
from ..sources import payloads
from . import bind

RELEVANCE = (("tion", "ing ", "que "), ("the", "des", "der"))
VOCAB = {"small": [str(i) for i in range(0, 81)]}
CLUSTERS = {"ic1_ic2": (["IC1", "IC2"], []), "ic1_ic3": (["IC1", "IC3"], ["IC2"]), "ic2_ic3": (["IC2", "IC3"], []), "all": ([], [])}
SEED = "20260428"


def papers_by_source(spark, sf):
    flags = linkage.exact_duplicates(bind.papers(spark, sf)).select("pos", "is_duplicate")
    return bind.papers(spark, sf).select("pos", "source_db").join(flags, "pos").groupBy("source_db").agg(F.count("*").alias("raw"), F.count_if(~F.col("is_duplicate")).alias("unique_records"))


def duplicate_rate(spark, sf):
    flags = linkage.exact_duplicates(bind.papers(spark, sf))
    return flags.agg(F.count("*").alias("raw"), F.count_if("is_duplicate").alias("removed"), F.count_if(~F.col("is_duplicate")).alias("unique_records"), (F.count_if("is_duplicate") / F.count("*")).alias("rate"))


def dedup_flags(spark, sf):
    return linkage.exact_duplicates(bind.papers(spark, sf))


def norm_titles(spark, sf):
    t = F.col("title")
    return bind.papers(spark, sf).select("pos", T.norm_title(t).alias("ascii"), T.norm_title_ws(t).alias("ws120"), T.slugify(t).alias("slug"), T.first_word(t).alias("first"), T.last_name(t).alias("last"))


def norm_dois(spark, sf):
    d = F.col("doi")
    return bind.papers(spark, sf).select("pos", T.norm_doi(d).alias("doi"), T.norm_doi_strip(d).alias("stripped"), T.norm_doi_replace(d).alias("replaced"))


def missing_abstracts(spark, sf):
    p = bind.papers(spark, sf).filter(T.blank_to_null(F.col("abstract")).isNull())
    return p.select("pos", T.norm_doi(F.col("doi")).isNotNull().alias("has_doi"), T.blank_to_null(F.col("title")).isNotNull().alias("has_title"))


def enrich_by_doi(spark, sf):
    out = enrich.enrich_by_doi(bind.papers(spark, sf), bind.provider(spark, sf), ["beta", "alpha"])
    return out.select("pos", F.length("abstract").alias("n_chars"), "abstract_source", "abstract_match_type")


def enrich_summary(spark, sf):
    out = enrich_by_doi(spark, sf).filter("n_chars is not null").withColumns({"source": F.coalesce("abstract_source", F.lit("own")), "kind": F.coalesce("abstract_match_type", F.lit("own"))})
    rolled = out.rollup("source", "kind").agg(F.count("*").alias("n"))
    share = F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1)))  # a row for each pair of labels
    return rolled.withColumn("share", share).select("source", "kind", "n", "share")


def resume_pending(spark, sf):
    d = keys.latest(bind.decisions(spark, sf), "id", F.desc("ts"), F.desc("event_id"))
    todo = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return keys.pending(todo, d, "id", "decision")


def aux_corpus(spark, sf):
    p = bind.papers(spark, sf)
    chosen = bind.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("pos"))
    return p.join(chosen, "pos", "left_anti").select("pos", "source_db")


def working_set(spark, sf):
    p = bind.papers(spark, sf)
    wanted = p.filter("language = 'en'").select("source_db").distinct()
    return p.filter("source_db <> 'src0'").join(wanted, "source_db", "left_semi").groupBy("source_db", "language").agg(F.count("*").alias("n"))


def two_key_lookup(spark, sf):
    p = bind.papers(spark, sf)
    return enrich.two_key_lookup(p.select("pos", "doi", "title"), p.withColumn("label", F.concat(F.lit("v"), F.col("pos"))), "label").select("pos", "label")


def new_candidates(spark, sf):
    """Papers that are new against the benchmark's items seen as a corpus."""
    known = bind.controls(spark, sf)
    return enrich.new_candidates(bind.papers(spark, sf), known).select("pos", "year")


def title_blocks(spark, sf):
    return linkage.title_blocks(bind.papers(spark, sf))


def similar_titles(spark, sf):
    return linkage.title_links(bind.papers(spark, sf))


def fuzzy_duplicates(spark, sf):
    return linkage.fuzzy_duplicates(bind.papers(spark, sf))


def _scored(spark, sf):
    q = bind.queue(spark, sf).filter("decision in ('include', 'maybe')").withColumn("score", screening.priority_score())
    return q.withColumn("band", screening.priority_band())


def ft_queue(spark, sf):
    ranked = keys.global_rank(_scored(spark, sf).select("pos", "title", "score", "band"), "rank", F.desc("score"), F.asc("title"), F.asc("pos"))
    return ranked.select("pos", "score", "band", "rank")


def priority_groups(spark, sf):
    return _scored(spark, sf).withColumn("grp", screening.priority_group()).groupBy("grp", "band").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def prisma_snapshot(spark, sf):
    s = _scored(spark, sf).withColumn("grp", screening.priority_group())
    sets = s.select("decision", "band", "pdf_status").groupingSets([["decision"], ["band"], ["decision", "pdf_status"], []], "decision", "band", "pdf_status")
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select("decision", "band", "pdf_status", "level", "n")


def criteria_counts(spark, sf):
    c = bind.criteria(spark, sf).withColumn("c", F.explode(F.split("matched_ec", r"\|"))).filter("c <> ''")
    return c.groupBy("c").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def dominant_exclusions(spark, sf):
    first = F.coalesce(F.get(F.filter(F.split("matched_ec", r"\|"), lambda x: x != ""), F.lit(0)), F.lit("<missing>"))
    return bind.criteria(spark, sf).groupBy(first.alias("dominant")).agg(F.count("*").alias("n"))


def criteria_combinations(spark, sf):
    c = bind.criteria(spark, sf)
    has = [F.contains("matched_ic", F.lit(f"IC{i}")).alias(f"ic{i}") for i in (1, 2, 3)]
    flags = c.select(*has, T.count_criteria(F.col("matched_ic")).alias("matched"))
    return flags.groupBy("ic1", "ic2", "ic3", "matched").agg(F.count("*").alias("n"))


def stratified_sample(spark, sf):
    return keys.stratified_sample(bind.rater_pairs(spark, sf), "primary", "doc_id", 0.2, SEED).select("doc_id", "primary")


def simple_sample(spark, sf):
    return keys.simple_sample(bind.papers(spark, sf).select("pos", "source_db"), "pos", 200, SEED)


def confusion_matrix(spark, sf):
    return agreement.confusion(bind.rater_pairs(spark, sf))


def kappa(spark, sf):
    return agreement.cohen_kappa(bind.rater_pairs(spark, sf), "primary", "verifier", "stage")


def kappa_binary(spark, sf):
    two = lambda c: F.when(F.col(c) == "include", "include").otherwise("rest").alias(c)
    return agreement.cohen_kappa(bind.rater_pairs(spark, sf).select(two("primary"), two("verifier")))


def disagreements(spark, sf):
    r = bind.rater_pairs(spark, sf).filter("primary <> verifier")
    place = F.when(F.col("stage") == "FT", 0).otherwise(1)
    two = (F.col("primary") == "include") != (F.col("verifier") == "include")
    return r.select("doc_id", "stage", "primary", "verifier", two.alias("binary_disagreement"), place.alias("place"))


def qa_scores(spark, sf):
    q = bind.quality(spark, sf).withColumn("qa_total", agreement.quality_total([f"qa{i}" for i in range(1, 9)]))
    return q.select("doc_id", "qa_total", F.when(F.col("qa_total").isNotNull(), F.col("qa_total") >= 4).alias("qa_include"))


def qa_summary(spark, sf):
    return agreement.quality_summary(bind.quality(spark, sf).withColumn("qa_total", agreement.quality_total([f"qa{i}" for i in range(1, 9)])))


def qa_tiers(spark, sf):
    q = qa_scores(spark, sf).withColumn("origin", F.when(F.col("doc_id") % 2 == 0, "main").otherwise("auxiliary"))
    return q.rollup("origin").agg(F.count("qa_total").alias("assessed"), F.count_if("qa_include").alias("passed"), (F.count_if("qa_include") / F.count("qa_total")).alias("retention"))


def qa_merge(spark, sf):
    q = qa_scores(spark, sf)
    old = q.filter("doc_id % 3 <> 0").select("doc_id", "qa_total", F.when(F.col("doc_id") % 5 == 0, "manual").otherwise("scored").alias("status"))
    new = q.filter("doc_id % 2 = 0").select("doc_id", (F.col("qa_total") + 1).alias("qa_total"))
    return agreement.merge_scores(old, new, "doc_id", "qa_total")


def parse_decisions(spark, sf):
    out = screening.parse_decisions(bind.responses(spark, sf))
    return out.select("conv_id", "turn", "parsed", "decision", "rationale", "matched_ic", "matched_ec")


def evidence_policy(spark, sf):
    rows = bind.queue(spark, sf).withColumns({"evidence_tags": F.when(F.col("pos") % 2 == 0, "b_tag|a_tag").otherwise(""), "confidence": F.lit("high"), "rationale": F.lit(" why ")})
    return screening.evidence_policy(rows).select("pos", "decision", "evidence_status", "evidence_tags", "confidence", "manual_review_required", "rationale")


def ledger_latest(spark, sf):
    return keys.latest(bind.decisions(spark, sf), "id", F.desc("ts"), F.desc("event_id")).select("id", "decision", "event_id")


def ledger_summary(spark, sf):
    d = ledger_latest(spark, sf)
    said = lambda x: F.count_if(F.col("decision") == x)
    return d.agg(F.count("*").alias("n"), said("include").alias("included"), said("maybe").alias("maybe"), said("exclude").alias("excluded"), said("ERROR").alias("errors"))


def daily_progress(spark, sf):
    from ..streaming.ledger import daily_progress as progress

    return progress(bind.decisions(spark, sf), "ts", "decision")


def citation_expand(spark, sf):
    parts = bind.table(spark, sf, "part")
    seeds = parts.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("seed"))
    e = bind.edges(spark, sf)
    forward = e.join(seeds, e["cited"] == seeds["seed"]).select("seed", F.col("citing").alias("found"), F.lit("forward").alias("way"))
    works = e.join(seeds, e["cited"] == seeds["seed"]).select("citing", "seed")
    backward = works.join(e.select("citing", "cited"), "citing").filter("cited <> seed").select("seed", F.col("cited").alias("found"), F.lit("co-cited").alias("way"))
    return forward.unionByName(backward).distinct().groupBy("seed", "way").agg(F.count("*").alias("n"))


def seed_topk(spark, sf):
    parts = bind.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    cites = bind.edges(spark, sf).groupBy("cited").agg(F.count("*").alias("n"))
    return parts.join(cites, F.col("p_partkey") == F.col("cited"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), "p_size").orderBy(F.desc("n"), F.desc("p_size"), "p_partkey").limit(20)


def clusters(spark, sf):
    return screening.clusters(bind.criteria(spark, sf), CLUSTERS).groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def clean_markup(spark, sf):
    h = T.clean_markup(F.col("html"))
    return bind.table(spark, sf, "pages").select("page_id", F.length(h).alias("n"), F.md5(h).alias("digest"))


def sentence_profile(spark, sf):
    s = T.sentences(F.col("text"))
    return bind.table(spark, sf, "documents").select("doc_id", F.size(s).alias("n"), F.coalesce(F.get(s, F.lit(0)), F.lit("")).alias("first"))


def relevance_filter(spark, sf):
    p = bind.papers(spark, sf)
    words = F.concat_ws(" ", "title", F.coalesce("abstract", F.lit("")))
    return p.filter(screening.relevant(words, *RELEVANCE) & F.coalesce(F.col("year").between(1994, 2026), F.lit(True))).select("pos", "year")


def ris_lines(spark, sf):
    return exports.ris(bind.papers(spark, sf)).select("internal_id", F.md5("ris").alias("digest"), F.size(F.split("ris", "\n")).alias("n"))


def bibtex_entries(spark, sf):
    return exports.bibtex(bind.papers(spark, sf)).select("internal_id", "citekey", F.md5("bibtex").alias("digest"))


def year_histogram(spark, sf):
    return bind.papers(spark, sf).groupBy("year").agg(F.count("*").alias("n")).withColumn("bar", F.expr("repeat('#', cast(least(n div 2, 40) as int))"))


def doc_types(spark, sf):
    return bind.papers(spark, sf).groupBy("doc_type", T.doc_type(F.col("doc_type")).alias("kind")).agg(F.count("*").alias("n"))


def source_labels(spark, sf):
    return bind.papers(spark, sf).groupBy("source_db", "language").agg(F.count("*").alias("n"), F.min_by("title", "pos").alias("first_title"))


def sensitivity(spark, sf):
    r = bind.rater_pairs(spark, sf)
    a = r.agg(F.count("*").alias("n"), F.count_if(F.expr("primary = 'include'")).alias("inc"), F.count_if(F.expr("primary = 'maybe'")).alias("may"))
    total = bind.papers(spark, sf).agg(F.count("*").alias("total"))
    x = a.crossJoin(total).withColumns({"expected": F.col("inc") / F.col("n") * F.col("total"), "upper": (F.col("inc") + F.col("may")) / F.col("n") * F.col("total")})  # one row each
    ratio = F.col("expected") / F.col("inc")
    return x.select("n", "inc", "may", "total", "expected", "upper", ratio.alias("ratio"), F.when(ratio <= 0.05, "unlikely").when(ratio <= 0.2, "modest").otherwise("substantial").alias("reading"))


def source_hit_rate(spark, sf):
    k = F.col("c_custkey")
    flags = bind.table(spark, sf, "customer").select(k, *((k % m == 0).alias(s) for s, m in (("s2", 2), ("s3", 3), ("s5", 5), ("s7", 7))))
    long = flags.unpivot("c_custkey", ["s2", "s3", "s5", "s7"], "source", "hit")
    any_hit = flags.select("c_custkey", F.lit("any").alias("source"), F.greatest("s2", "s3", "s5", "s7").alias("hit"))
    return long.unionByName(any_hit).groupBy("source").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def first_source(spark, sf):
    k = F.col("c_custkey")
    urls = [F.when(k % m == 0, F.lit(s)) for s, m in (("s7", 7), ("s5", 5), ("s3", 3), ("s2", 2))]
    c = bind.table(spark, sf, "customer").select(k, F.coalesce(*urls).alias("source"))
    return c.withColumn("recovered", F.col("source").isNotNull())


def vocab_warnings(spark, sf):
    e = bind.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("small"))
    w = screening.vocabulary_warnings(VOCAB)
    return e.select("event_id", F.array_join(w, ";").alias("warnings"), (F.size(w) > 0).alias("needs_review"))


def inverted_index_text(spark, sf):
    d = bind.table(spark, sf, "documents")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    maps = d.select("doc_id", T.word_index(words).alias("index")).filter("index is not null")
    return maps.select("doc_id", T.from_inverted_index(F.col("index")).alias("text"))


def request_batches(spark, sf):
    p = keys.batches(bind.papers(spark, sf), "pos", 50)
    prompt = F.concat(F.lit("Title: "), F.coalesce(T.blank_to_null(F.col("title")), F.lit("(none)")), F.lit("\nText: "), F.coalesce(F.left("abstract", F.lit(400)), F.lit("(missing)")))
    return p.select("pos", "batch_no", F.md5(prompt).alias("digest"))


def reading_list(spark, sf):
    weight = F.when(F.contains("matched_ic", F.lit("IC1")), 3).otherwise(0) + F.when(F.contains("matched_ic", F.lit("IC2")), 3).otherwise(0) + F.when(F.contains("matched_ic", F.lit("IC3")), 2).otherwise(0) + F.when(F.contains("matched_ic", F.lit("IC4")), 1).otherwise(0)
    score = weight + F.when(F.col("pdf_status") == "downloaded", 2).otherwise(0) + F.when(F.col("year") >= 2020, 1).otherwise(0) + F.when(F.col("venue").isNotNull(), 1).otherwise(0)
    return bind.queue(spark, sf).withColumn("score", score).orderBy(F.desc("score"), "pos").limit(30).select("pos", "score")


def stage_status(spark, sf):
    p, q = bind.papers(spark, sf), bind.queue(spark, sf)
    d = linkage.exact_duplicates(p)
    stages = (("raw", p.agg(F.count("*").alias("n"))), ("unique", d.filter("not is_duplicate").agg(F.count("*").alias("n"))), ("queued", q.filter("decision <> 'exclude'").agg(F.count("*").alias("n"))), ("included", q.filter("decision = 'include'").agg(F.count("*").alias("n"))))
    out = None
    for name, df in stages:
        row = df.withColumn("stage", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def manifest_status(spark, sf):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "downloaded").when(s == "O", "oa_found").otherwise("manual")
    return bind.table(spark, sf, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("ids"))


def control_hits(spark, sf):
    """Known items by document: a control counts as found where a whole line of a document has its words."""
    controls = bind.table(spark, sf, "benchmark").select("item_id", T.norm_title(F.col("text")).alias("key"))
    docs = bind.table(spark, sf, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "source", T.norm_title(F.col("line")).alias("key"))
    hits = docs.join(controls.hint("shuffle_hash"), "key").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("docs"))
    return controls.select("item_id").join(hits, "item_id", "left").select("item_id", "sources", "first_doc", F.coalesce("docs", F.lit(0)).alias("docs"))


def usable_urls(spark, sf):
    bad = ("dx.doi.org/", "doi.org/10.", "example.org")
    return bind.table(spark, sf, "pages").filter(F.coalesce(F.col("url"), F.lit("")) != "").filter(~T.contains_any(F.col("url"), bad)).select("page_id", "url")


_PROFILE = ("relevance", "method", "evidence", "limitations", "context", "data_source", "technique", "decision", "reason", "questions", "criteria", "phases", "level", "priority", "assessment")


def text_profile(spark, sf):
    return profiles.profile(bind.papers(spark, sf), "title", "abstract").select("pos", *_PROFILE)


def qa_inferred(spark, sf):
    known = bind.quality(spark, sf).withColumnRenamed("doc_id", "pos").drop("source")
    read = profiles.profile(bind.papers(spark, sf), "title", "abstract").select("pos", "title", "abstract", "evidence", "data_source", "technique", "limitations", "context")
    empty = {"rationale": F.lit(None).cast("string"), "results": F.lit(None).cast("string"), "qa_notes": F.lit(None).cast("string"), "qa_status": F.when(F.col("qa1").isNull(), "pendente").otherwise("manual")}
    filled = profiles.infer_quality(read.join(known.hint("merge"), "pos").withColumns(empty))
    return filled.select("pos", *(f"qa{i}" for i in range(1, 9)), "qa_notes", "qa_status")


def cleaned_text(spark, sf):
    clean = T.clean_extracted(F.coalesce("text", F.lit("")))
    return bind.table(spark, sf, "documents").select("doc_id", F.length(clean).alias("n"), F.md5(clean).alias("digest"))


def abstract_proxy(spark, sf):
    return bind.table(spark, sf, "documents").select("doc_id", profiles.abstract_proxy(F.coalesce("text", F.lit(""))).alias("abstract"))


def extracted_sections(spark, sf):
    return profiles.extracted(bind.table(spark, sf, "documents")).select("doc_id", "title_guess", "abstract_found", "results_found", "clean_length")


def payload_entries(spark, sf):
    p = bind.papers(spark, sf)
    fields = {"dc:title": "title", "dc:description": "abstract", "prism:doi": "doi", "subtypeDescription": "doc_type", "prism:pageRange": "pages", "prism:publicationName": "venue", "eid": "internal_id"}
    entry = F.struct(*(F.col(v).alias(k) for k, v in fields.items()), F.concat("year", F.lit("-01-01")).alias("prism:coverDate"), F.array_join("keywords", " | ").alias("authkeywords"))
    read = payloads.payload_a(p.select(F.to_json(entry).alias("payload")))
    return read.select("url", "title", "doi", "year", "doc_type", "pages", "venue", F.array_join("keywords", ";").alias("keywords"), F.md5("abstract").alias("abstract"))


def citation_pages(spark, sf):
    e = bind.edges(spark, sf)
    paper = F.struct(F.col("cited").cast("string").alias("title"), F.struct(F.col("citing").cast("string").alias("DOI")).alias("externalIds"))
    hit = F.when(F.col("direction") == "forward", F.struct(paper.alias("citingPaper"), F.lit(None).cast(_CITED).alias("citedPaper"))).otherwise(F.struct(F.lit(None).cast(_CITED).alias("citingPaper"), paper.alias("citedPaper")))
    # a seed's hits come in pages, so a hub has many
    page = F.pmod(F.xxhash64("cited"), F.lit(16)).alias("page")
    pages = e.groupBy(F.col("citing").alias("seed"), "direction", page).agg(F.to_json(F.struct(F.collect_list(hit).alias("data"))).alias("payload"))
    return payloads.citation_rows(pages).select("seed", "direction", "title", "doi")


_CITED = "struct<title:string,externalIds:struct<DOI:string>>"


def result_routes(spark, sf):
    r = screening.parse_decisions(bind.responses(spark, sf))
    r = r.withColumn("warnings", F.when(F.col("matched_ic") == "IC4", F.array(F.lit("IC4 needs review"))))
    return exports.routed(r).select("conv_id", "turn", "route", "review_reason")


def review_artefacts(spark, sf):
    found = exports.review_artefacts(_scored(spark, sf).withColumn("grp", screening.priority_group()))
    counted = [f.agg(F.count("*").alias("n"), F.min("internal_id").alias("first_id"), F.max("score").alias("best")).withColumn("artefact", F.lit(name)) for name, f in found.items()]
    return reduce(lambda a, b: a.unionByName(b), counted)


def manual_retrieval(spark, sf):
    return exports.manual_list(bind.queue(spark, sf))


def catalogue_listing(spark, sf):
    return catalogue.listing(bind.catalogue(spark, sf), "src0", show_query=True)


def request_forms(spark, sf):
    q = F.col("query")
    return bind.catalogue(spark, sf).select("id", catalogue.without_limits(q).alias("limits_out"), catalogue.limited_kinds(q).alias("kinds"), catalogue.plain_boolean(q).alias("plain"), catalogue.keywords(q).alias("keywords"))


def escaped_dois(spark, sf):
    return bind.papers(spark, sf).select("pos", catalogue.escape_slashes(F.col("doi")).alias("escaped"))


def _working_set(spark, sf, first_only):
    saved = bind.papers(spark, sf).filter("pos % 9 = 0").select("internal_id", F.col("title").alias("abstract"))
    out = enrich.enrich_working_set(bind.papers(spark, sf), bind.provider(spark, sf), "alpha", "beta", first_only, saved)
    return out.select("pos", F.length("abstract").alias("n_chars"), "abstract_source")


def enrich_working_set(spark, sf):
    return _working_set(spark, sf, False)


def enrich_first_source(spark, sf):
    return _working_set(spark, sf, True)


def queries():
    own = [v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"]
    return {f.__name__: f for f in own}
