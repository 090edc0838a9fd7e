"""Sources and sinks on the driver's tables: written to the shared folder, read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.characters import html_unescape, nfkd_ascii
from ..operators import agreement, exports, keys, screening, workflow
from ..sources import files, payloads
from ..storage import shared_folder, written
from ..streaming import ingest, ledger
from . import bind


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(spark, sf):
    """Papers with title and abstract on one line, without braces."""
    flat = lambda c: T.blank_to_null(F.regexp_replace(F.regexp_replace(c, "[{}]", ""), r"\s+", " "))
    return bind.papers(spark, sf).withColumns({"title": flat("title"), "abstract": flat("abstract")})


def _read(df):
    return df.select("title", "doi", "year", "venue", "pages", "doc_type", F.greatest(F.size(F.coalesce("authors", F.array().cast("array<string>"))), F.lit(0)).alias("n_authors"), F.array_join("keywords", ";").alias("keywords"), F.md5("abstract").alias("abstract"))


def source_ris(spark, sf):
    place = _place(spark, "ris")
    exports.ris(_plain(spark, sf)).select("ris").write.text(place)
    return _read(files.read_records(spark, place, "ris", "db"))


def source_bibtex(spark, sf):
    place = _place(spark, "bibtex")
    deep = _plain(spark, sf).withColumn("title", F.concat(F.lit("{A {{deep} one}}: "), "title"))
    exports.bibtex(deep).select("bibtex").write.text(place)
    return _read(files.read_records(spark, place, "bibtex", "db"))


def source_csv(spark, sf):
    place, p = _place(spark, "csv"), bind.papers(spark, sf)
    table = p.select(F.col("title").alias("Document Title"), F.col("doi").alias("Item DOI"), F.col("year").alias("Publication Year"), F.array_join("authors", "; ").alias("Authors"), F.array_join("keywords", ", ").alias("Author Keywords"), F.col("venue").alias("Source Title"), F.col("abstract").alias("Abstract"))
    table.write.csv(place, header=True, quoteAll=True, escape='"')
    return files.read_records(spark, place, "csv", "db").select("title", "doi", "year", "venue", F.array_join("keywords", ";").alias("keywords"), F.md5("abstract").alias("abstract"))


def source_tagged(spark, sf):
    place, p = _place(spark, "tagged"), _plain(spark, sf).filter("title is not null")
    line = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{tag} "), F.regexp_replace(F.col(c).cast("string"), "^(\\S+) ", "$1\n   "))).otherwise(None)
    pages = F.split("pages", "-")
    p = p.withColumns({"first": F.get(pages, F.lit(0)), "last": F.get(pages, F.lit(1))})
    rows = F.array_join(F.array_compact(F.array(F.lit("PT J"), line("TI", "title"), line("DI", "doi"), line("PY", "year"), line("SO", "venue"), line("AB", "abstract"), line("BP", "first"), line("EP", "last"), F.lit("ER"))), "\n")
    p.select(rows.alias("value")).write.text(place)
    read = files.read_records(spark, place, "tagged")
    return read.select("title", "doi", "year", "venue", "pages", F.md5("abstract").alias("abstract"))


def _corpus(spark, sf):
    return files.as_papers(bind.papers(spark, sf).drop("internal_id"), "db", "q1", "label")


def source_json_arrays(spark, sf):
    place = _place(spark, "arrays")
    files.write_json_arrays(_corpus(spark, sf).withColumn("unknown", F.lit(1)), place, F.floor(F.col("pos") / 500))
    return files.read_records(spark, place, "json").select("pos", "title", "doi", "year", F.array_join("authors", ";").alias("authors"), F.md5("abstract").alias("abstract"))


def source_json_lines(spark, sf):
    place = _place(spark, "lines")
    files.write_json(_corpus(spark, sf), place)
    return files.read_json_lines(spark, place).select("pos", "title", "doi", "year", F.array_join("authors", ";").alias("authors"), F.md5("abstract").alias("abstract"))


def written_csv(spark, sf):
    """The CSV with a byte-order mark, read as a sheet; a column that it lacks is null."""
    place = _place(spark, "flat")
    files.write_csv(_corpus(spark, sf), place, ["pos", "title", "keywords", "year"], bom=True)
    return files.read_sheet(spark, place, ["pos", "title", "keywords", "year", "lacking"])


def sheet_lookup(spark, sf):
    """Decisions of a sheet with semicolons looked up for all papers; a sheet that isn't there is empty."""
    place = _place(spark, "sheet")
    bind.snapshot(spark, sf).select("pos", F.concat("ft_rationale", F.lit("; said, \"twice\"")).alias("note"), "ft_decision").write.csv(place, header=True, sep=";", quoteAll=False, escape='"')
    held = files.read_sheet(spark, place, ["pos", "note", "ft_decision"])
    none = files.read_sheet(spark, place + "-missing", ["pos", "note", "ft_decision"])
    both = held.unionByName(none).select(F.col("pos").cast("long").alias("pos"), "note", "ft_decision")
    return bind.papers(spark, sf).select("pos").join(both.hint("merge"), "pos", "left")


def raw_zone_counts(spark, sf):
    """A query that is in the raw zone is kept when it comes again; a forced one is replaced."""
    place, p = _place(spark, "raw"), bind.papers(spark, sf).select("pos", F.col("source_db").alias("source_query_id"))
    files.write_raw(p.filter("source_query_id <> 'src1'"), place)
    files.write_raw(p.unionByName(p.filter("source_query_id = 'src2'")), place)
    files.write_raw(p.filter("source_query_id = 'src3'").unionByName(p.filter("source_query_id = 'src3'")), place, force=True)
    return files.raw_counts(spark, place).select("source_query_id", "n")


def appended_papers(spark, sf):
    """Labelled papers first, then all: what is there already stays as it is."""
    place, p = _place(spark, "combined"), bind.papers(spark, sf).select("pos", "source_db")
    labelled = bind.table(spark, sf, "labels").select(F.col("doc_id").alias("pos")).distinct()
    files.append_absent(p.join(labelled.hint("merge"), "pos", "left_semi").withColumn("round", F.lit(1)), place, "pos")
    files.append_absent(p.withColumn("round", F.lit(2)), place, "pos")
    return spark.read.parquet(place)


def batch_log(spark, sf):
    """Batches of events by day and kind, logged twice and summed up from the log."""
    place = _place(spark, "batches")
    events = bind.table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("batch_id"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("users"))
    batches = events.withColumn("status", F.when(F.col("stage") == "error", "failed").otherwise("ended"))
    exports.log_batches(batches, place)
    exports.log_batches(batches.filter("status = 'failed'").drop("users").withColumn("retry", F.lit(True)), place)
    log = spark.read.parquet(place)
    return log.groupBy("stage", "status").agg(F.count("*").alias("batches"), F.sum("n_rows").alias("n_rows"), F.sum(F.col("extras")["users"].cast("long")).alias("users"), F.count_if(F.col("extras")["retry"] == "true").alias("retries"))


def step_results(spark, sf):
    """Three steps, each written and read back."""
    steps = [("known", lambda df: df.filter("doi is not null")), ("dated", lambda df: df.filter("year >= 2000")), ("counted", lambda df: df.groupBy("source_db").agg(F.count("*").alias("n"), F.min("year").alias("first_year")))]
    return workflow.step_checkpoints(bind.papers(spark, sf).select("source_db", "doi", "year"), steps, _place(spark, "steps"))


def manifest_lookup(spark, sf):
    """Orders as a manifest of downloads: customers with their last one by id, and by the name of its file."""
    o = bind.table(spark, sf, "orders")
    rows = o.select(F.col("o_custkey").alias("id"), F.concat(F.lit("f"), F.col("o_orderkey") * 7919 % 5000, F.lit(".pdf")).alias("file"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("order_id"))
    rows = written(rows, "manifest")
    by_id, by_file = workflow.latest_of(rows, "id", "day", "order_id"), workflow.latest_of(rows, "file", "day", "order_id")
    names = by_file.select("file", F.col("id").alias("file_id"), F.col("status").alias("file_status"))
    customers = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return customers.join(by_id.hint("merge"), "id", "left").join(names.hint("merge"), "file", "left").select("id", "file", "status", "order_id", "file_id", "file_status")


def _entry(spark, sf):
    return bind.papers(spark, sf).withColumns({"y": F.col("year").cast("string"), "who": F.get("authors", F.lit(0)), "word": F.get("keywords", F.lit(0))})


def _payload(df):
    return df.select("url", "title", "doi", "year", "doc_type", "venue", "pages", F.array_join("authors", ";").alias("authors"), F.array_join("keywords", ";").alias("keywords"), F.md5("abstract").alias("abstract"))


def payload_articles(spark, sf):
    terms = lambda *cols: F.struct(F.array(*cols).alias("terms"))
    item = F.struct(
        F.struct(F.array(F.struct(F.col("who").alias("full_name")), F.struct(F.lit(" B, C ").alias("full_name")))
        .alias("authors")).alias("authors"), F.col("y").alias("publication_year"), "doi", F.col("internal_id").alias("article_number"), terms(F.lit("x"), "word").alias("index_terms"), terms("word", F.lit("x"), F.lit("y")).alias("author_terms"),
        F.when(F.col("pos") % 2 == 0, "Journals").otherwise("Conferences").alias("content_type"), "title", "abstract", F.col("venue").alias("publication_title"), F.split_part("pages", F.lit("-"), F.lit(1)).alias("start_page"), F.split_part("pages", F.lit("-"), F.lit(2)).alias("end_page"),
    )
    return _payload(payloads.payload_b(_entry(spark, sf).select(F.to_json(item).alias("payload"))))


def payload_records(spark, sf):
    """Creators and subjects as objects, three forms of an identifier, two dates."""
    k = F.col("pos")
    item = F.struct(
        F.array(F.struct(F.col("who").alias("creator"))).alias("creators"), F.when(k % 3 == 0, F.col("y")).alias("publicationDate"), F.concat("y", F.lit("-05-01")).alias("coverDate"), F.when(k % 2 == 0, F.col("doi")).alias("doi"), F.concat(F.lit("doi:"), F.lit("10.9/"), k).alias("identifier"),
        F.array(F.struct(F.col("word").alias("term"))).alias("subjects"), F.when(k % 2 == 0, "Book Chapter").otherwise("Article").alias("contentType"), "title", "abstract", F.col("venue").alias("publicationName"), F.concat(F.lit("https://l.org/"), k).alias("url"),
    )
    return _payload(payloads.payload_c(_entry(spark, sf).select(F.to_json(item).alias("payload"))))


def payload_hits(spark, sf):
    item = F.struct(
        F.col("internal_id").alias("uid"), F.struct(F.array(F.struct(F.col("who").alias("displayName"))).alias("authors")).alias("names"), F.struct(F.col("y").alias("publishYear"), F.col("venue").alias("sourceTitle"), F.struct(F.col("pages").alias("range")).alias("pages")).alias("source"), F.struct("doi").alias("identifiers"),
        F.struct(F.when(F.col("pos") % 2 == 0, F.concat(F.lit("https://r.org/"), "pos")).alias("record")).alias("links"), F.struct(F.array("word").alias("authorKeywords"), F.array("word", F.lit("plus")).alias("keywordsPlus")).alias("keywords"), F.array("doc_type").alias("types"), F.struct(F.col("abstract").alias("value")).alias("abstract"), F.struct(F.col("title").alias("value")).alias("title"),
    )
    return _payload(payloads.payload_d(_entry(spark, sf).select(F.to_json(item).alias("payload"))))


def payload_works(spark, sf):
    """Works with their abstract as a word index, of the years asked for."""
    papers = _entry(spark, sf)
    indexed = papers.withColumn("index", T.word_index(F.filter(F.split("abstract", r"\s+"), lambda w: w != "")))
    item = F.struct(F.concat(F.lit("https://w.org/"), "pos").alias("id"), "title", "doi", F.when(F.col("pos") % 5 != 0, F.col("year") - 2).alias("publication_year"), F.when(F.col("pos") % 2 == 0, "journal-article").otherwise("other").alias("type"), F.col("index").alias("abstract_inverted_index"), F.array(F.struct(F.struct(F.col("who").alias("display_name")).alias("author"))).alias("authorships"))
    found = payloads.works(indexed.select(F.to_json(item).alias("payload")), "forward", "10.1/seed")
    return found.select("url", "title", "doi", "year", "doc_type", F.array_join("authors", ";").alias("authors"), F.md5("abstract").alias("abstract"))


def crossref_years(spark, sf):
    """Years of items that say in four ways when they came out."""
    n, k = F.col("n_chars"), F.col("doc_id")
    date = lambda year: F.struct(F.array(F.array(year.cast("int"), F.lit(3))).alias("date-parts"))
    item = F.to_json(F.struct(F.when(k % 4 == 0, date(n % 100 + 1900)).alias("published-print"), F.when(k % 4 == 1, F.struct(F.array().cast("array<array<int>>").alias("date-parts"))).alias("published-online"), F.when(k % 3 == 0, date(n % 50 + 1950)).alias("published"), F.when(k % 7 != 0, date(n % 20 + 2000)).alias("issued")))
    return bind.table(spark, sf, "documents").select("doc_id", T.year_by_keys(item).alias("year"))


def pending_first(spark, sf):
    """The first of the papers that are still to be decided."""
    decided = screening.valid_decisions(bind.snapshot(spark, sf).withColumn("decision", F.upper("ft_decision")), "decision", ("include", "exclude"))
    return bind.papers(spark, sf).select("pos", "source_db").join(decided.select("pos").hint("merge"), "pos", "left_anti").orderBy("pos").limit(25)


def valid_decisions(spark, sf):
    rows = bind.decisions(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("decision")).otherwise(F.concat(F.lit(" "), "decision")).alias("decision"))
    return screening.valid_decisions(rows)


def disagreement_list(spark, sf):
    """Three tables of double ratings in one list, with their stage."""
    pairs = bind.rater_pairs(spark, sf).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "stage", "primary", "verifier")
    third = bind.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.when(F.col("quality") == 1, "Include").alias("primary"), F.when(F.col("toxic") == 1, "exclude").otherwise("include").alias("verifier"))
    return agreement.disagreement_list(("ws_TA", pairs.filter("stage = 'TA'")), ("ws_FT", pairs.filter("stage = 'FT'")), ("aux_FT", third))


def pending_order(spark, sf):
    """The pending sheet in its order."""
    k = F.col("pos")
    rows = bind.papers(spark, sf).select("pos", "title", F.when(k % 3 == 0, "x").when(k % 3 == 1, (k % 4).cast("string")).alias("group_rank"), F.when(k % 5 != 0, F.col("year").cast("string")).alias("priority_rank"))
    return keys.global_rank(rows, "place", *exports.review_order(), F.asc("pos")).select("pos", "place")


def _landed(spark, name, df, column):
    """A table as files that arrive one after another, in order of a column: the schema's text and the folder."""
    place = _place(spark, name)
    ranked = written(keys.global_rank(df, "_rank", F.asc(column)), "landing")
    part = F.floor((F.col("_rank") - 1) * 3 / ranked.count()).cast("int")
    for i in range(3):  # files are taken up by age
        ranked.filter(part == i).drop("_rank").repartition(1, column).write.mode("append").parquet(place)
    return place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def stream_ledger(spark, sf):
    """Decisions arriving in files, taken up by the ledger; its current state."""
    place, schema = _landed(spark, "decisions", bind.decisions(spark, sf), "event_id")
    out = _place(spark, "ledger")
    ledger.follow_decisions(spark, place, schema, "id", ["ts", "event_id"], out, _place(spark, "ledger-check"), 16).awaitTermination()
    return ledger.Ledger(spark, out, "id", ["ts", "event_id"], 16).read(schema).select("id", "decision", "event_id")


def stream_ingest(spark, sf):
    """Papers arriving in files; those that are new by DOI and by title."""
    place, schema = _landed(spark, "arrivals", bind.papers(spark, sf).select("pos", "doi", "title"), "pos")
    name, out = "spark.sql.streaming.stateStore.providerClass", _place(spark, "ingested")
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)
        kept = ingest.distinct_arrivals(arriving, "pos").select("pos")
        kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", _place(spark, "ingest-check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema("pos long").parquet(out)


def found_dois(spark, sf):
    """DOIs found in running text."""
    p = bind.papers(spark, sf)
    said = F.concat_ws(" ", F.lit("as in"), F.coalesce("doi", F.lit("no doi 10.12/x")), F.lit(", and others"))
    return p.select("pos", T.find_doi(said).alias("doi"))


def page_ranges(spark, sf):
    k = F.col("doc_id")
    first, last = F.when(k % 3 != 0, F.concat(F.lit(" "), k)), F.when(k % 4 != 0, (k + 7).cast("string"))
    return bind.table(spark, sf, "documents").select("doc_id", T.pages(first, last).alias("pages"))


def folded_titles(spark, sf):
    return bind.papers(spark, sf).select("pos", nfkd_ascii(F.col("title")).alias("plain"))


def unescaped_pages(spark, sf):
    text = html_unescape(F.col("html"))
    return bind.table(spark, sf, "pages").select("page_id", F.length(text).alias("n"), F.md5(text).alias("digest"))


def queries():
    own = [v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"]
    return {f.__name__: f for f in own}
