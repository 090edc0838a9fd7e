"""The driver's tables seen as bibliographic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: the title is the first line up to 200 characters, the abstract all that follows it."""
    return _with_text(spark, sf_dir).drop("text")


def _with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.left(F.substring_index("text", "\n", 1), F.lit(200)).alias("title"))
    after = F.substring("text", F.length("title") + 1, F.length("text"))
    rest = F.when(F.startswith(after, F.lit("\n")), F.substring(after, F.lit(2), F.length("text"))).otherwise(after)
    k, n = F.col("doc_id"), F.length("title")
    prefix = F.when(k % 3 == 0, "").when(k % 3 == 1, "https://doi.org/").otherwise("doi:")
    doi = F.concat(prefix, F.lit("10."), (1000 + n % 97).cast("string"), F.lit("/"), F.left(F.md5(F.lower("title")), F.lit(12)))
    empty = F.array().cast("array<string>")
    return docs.select(
        k.alias("pos"),
        F.lpad(k.cast("string"), 8, "0").alias("internal_id"),
        F.col("source").alias("source_db"),
        F.concat_ws("-", "source", (k % 3).cast("string")).alias("query_id"),
        "title",
        F.when(~((k % 4 == 0) | (after == "")), rest).alias("abstract"),
        (1994 + n % 33).cast("int").alias("year"),
        F.when(k % 5 != 0, doi).alias("doi"),
        F.col("lang").alias("language"),
        F.when(k % 3 != 0, F.array(F.split_part("title", F.lit(" "), F.lit(1)))).otherwise(empty).alias("authors"),
        F.when(k % 6 != 0, F.array(F.col("lang"))).otherwise(empty).alias("keywords"),
        F.when(k % 7 != 0, F.col("source")).alias("venue"),
        F.when(k % 8 != 0, F.concat(k.cast("string"), F.lit("-"), (k + 9).cast("string"))).alias("pages"),
        F.when(k % 2 == 0, "article").when(k % 3 == 0, "Conference Paper").otherwise("chapter").alias("doc_type"),
        "text",
    )


def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of abstracts for all papers, from two sources by turns."""
    return _with_text(spark, sf_dir).select("pos", F.when(F.col("pos") % 8 == 0, "alpha").otherwise("beta").alias("provider"), "doi", "title", "year", F.col("text").alias("abstract"))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as known items: the title is the first line up to 200 characters, the DOI made as for papers."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(200)).alias("title"))
    doi = F.concat(F.lit("10."), (1000 + F.length("title") % 97).cast("string"), F.lit("/"), F.left(F.md5(F.lower("title")), F.lit(12)))
    return items.select("item_id", "title", doi.alias("doi"), F.lit(None).cast("int").alias("year"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as what an earlier queue said of its records."""
    good = F.col("quality") == 1
    said = F.when(F.col("toxic") == 1, "exclude").when(good, "include").otherwise("pending")
    named = lambda word: F.concat(F.lit(word), F.col("doc_id"))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos"), said.alias("ft_decision"), F.when(good, named("https://old.org/")).alias("ft_oa_url"), named("seen ").alias("ft_rationale"), F.when(good, "high").otherwise("low").alias("ft_confidence"), named("kept ").alias("abstract")
    )


def query_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the queries that have one."""
    docs = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3).alias("k")).distinct().filter("k < 2")
    return docs.select(F.concat_ws("-", "source", F.col("k").cast("string")).alias("query_id"), F.concat(F.lit("query "), "k", F.lit(" of "), "source").alias("label"))


def pdf_file():
    """The file of a queued record that has been downloaded."""
    return F.when(F.col("pdf_status") == "downloaded", F.concat(F.lit("f"), F.col("pos"), F.lit(".pdf")))


def rater_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ratings of each labelled document."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    primary = F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 1, "include").otherwise("maybe")
    verifier = F.when(F.col("n_chars") > 2000, "include").when(F.col("n_chars") > 500, "maybe").otherwise("exclude")
    return rows.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, "TA").otherwise("FT").alias("stage"), primary.alias("primary"), verifier.alias("verifier"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions on users."""
    kind = F.col("event_type")
    decision = F.when(kind == "click", "include").when(kind == "purchase", "exclude").when(kind == "view", "maybe").when(kind == "signup", "pending").otherwise("ERROR")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), decision.alias("decision"), "ts")


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, day, matched_ic, matched_ec): kinds of events of a user on a day, as criteria."""
    events = table(spark, sf_dir, "events")
    pick = lambda pairs: F.array_join(F.array_sort(F.collect_set(F.when(F.col("event_type").isin(*pairs), F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[F.col("event_type")]))), "|")
    return events.groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day")).agg(pick({"click": "IC1", "view": "IC2", "signup": "IC3"}).alias("matched_ic"), pick({"purchase": "EC1", "error": "EC2"}).alias("matched_ec"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as decision responses: fenced for odd conversations, broken for every seventh."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    n = F.length("text")
    decision = F.when(n % 4 == 0, "include").when(n % 4 == 1, "EXCLUDE").when(n % 4 == 2, "maybe").otherwise("other")
    body = F.concat(F.lit('{"decision":"'), decision, F.lit('","rationale":"'), n.cast("string"), F.lit('","matched_ic":["IC'), (n % 4 + 1).cast("string"), F.lit('"]}'))
    fenced = F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return turns.select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, F.left(body, F.lit(20))).otherwise(fenced).alias("response"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with a decision and criteria for the review queue."""
    k = F.col("pos")
    return papers(spark, sf_dir).withColumns(
        {
            "decision": F.when(k % 3 == 0, "include").when(k % 3 == 1, "maybe").otherwise("exclude"),
            "matched_ic": F.when(k % 10 == 0, "IC1|IC2|IC3|IC4").when(k % 4 == 1, "IC1|IC3").when(k % 5 == 2, "IC2").otherwise(""),
            "oa_url": F.when(k % 9 == 0, F.concat(F.lit("https://x.org/"), k.cast("string"))),
            "url": F.when(k % 2 == 0, "https://y.org"),
            "pdf_status": F.when(k % 11 == 0, "downloaded").when(k % 13 == 0, "oa_found").otherwise("manual"),
        }
    ).drop("title_norm")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight quality items by document; every eleventh is not assessed."""
    text, k, n = F.lower("text"), F.col("doc_id"), F.col("n_chars")
    tests = [n > 80, F.contains(text, F.lit("the")), n > 1000, F.contains(text, F.lit("ing")), k % 3 == 0, n > 3000, F.contains(text, F.lit("ou")), k % 7 == 0]
    items = [F.when(k % 11 != 0, F.when(t, 1).otherwise(0)).alias(f"qa{i + 1}") for i, t in enumerate(tests)]
    return table(spark, sf_dir, "documents").select("doc_id", "source", *items)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as citations: orders cite parts, in two directions."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.when(F.col("l_linenumber") % 2 == 0, "backward").otherwise("forward").alias("direction"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search queries in three providers' forms, of their first word and language."""
    docs = table(spark, sf_dir, "documents")
    word, lang, at = F.coalesce(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")), F.coalesce("lang", F.lit("en")), F.col("doc_id") % 4
    limited = F.format_string('TITLE("%s")\n  AND (LIMIT-TO(DOCTYPE, "ar") OR LIMIT-TO ( DOCTYPE, "cp"))\n  AND (LIMIT-TO(LANGUAGE, "%s"))', word, F.upper(lang))
    query = F.when(at == 0, limited).when(at == 1, F.format_string('"All Metadata":"%s" AND "All Metadata" : "%s"', word, lang)).when(at == 2, F.format_string('"%s" "%s"', word, lang)).otherwise(F.concat(word, F.lit(" limit-to(x) "), lang))
    return docs.select(F.col("source").alias("database"), F.format_string("q%d", F.col("doc_id")).alias("id"), word.alias("label"), F.when(F.col("doc_id") % 5 == 0, lang).alias("notes"), query.alias("query"))
