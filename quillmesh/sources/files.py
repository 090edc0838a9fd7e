"""Record files to papers, papers to files."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, pages, strip, year_of
from .json_arrays import read_array

PAPER = (
    "internal_id string, source_db string, source_query_id string, source_query_label string, doi string, title string, authors array<string>, year int, abstract string, venue string, "
    "doc_type string, language string, keywords array<string>, url string, volume string, issue string, pages string, publisher string, is_duplicate boolean, duplicate_of string, selected boolean, pos long"
)
_COLUMNS = [c.strip().split(" ")[0] for c in PAPER.split(",")]
# Header names that mean the same field.
ALIASES = {
    "title": ("title", "document title", "article title", "item title"),
    "authors": ("authors", "author", "author names"),
    "year": ("year", "publication year", "publication_year"),
    "doi": ("doi", "item doi"),
    "abstract": ("abstract", "description"),
    "venue": ("venue", "source title", "publication title", "journal", "booktitle"),
    "keywords": ("keywords", "author keywords", "index keywords"),
    "url": ("url", "link", "pdf link"),
    "doc_type": ("doc_type", "document type", "type"),
    "volume": ("volume",),
    "issue": ("issue",),
    "publisher": ("publisher",),
}
RIS_TAGS = {"title": ("TI", "T1"), "doi": ("DO", "M3"), "year": ("PY", "Y1", "DA"), "abstract": ("AB", "N2"), "venue": ("JF", "JO", "T2", "BT"), "url": ("UR", "L2"), "doc_type": ("TY",), "volume": ("VL",), "issue": ("IS",), "publisher": ("PB",)}


def as_papers(df: DataFrame, source_db: str, query_id: str = "", query_label: str = "") -> DataFrame:
    """The declared columns of a paper, in order, with a deterministic id; missing ones are null."""
    have = {**{c: F.col(c) for c in df.columns}, "source_db": F.lit(source_db), "source_query_id": F.lit(query_id), "source_query_label": F.lit(query_label), "is_duplicate": F.lit(False)}
    have.setdefault("pos", F.monotonically_increasing_id())
    have["internal_id"] = F.substring(F.sha2(F.concat_ws("|", F.lit(source_db), F.lit(query_id), *(have.get(c, F.lit("")) .cast("string") for c in ("doi", "title", "pos"))), 256), 1, 16)
    kinds = dict(c.strip().split(" ", 1) for c in PAPER.split(","))
    return df.select(*(have.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS))


def _split_list(c, pattern: str):
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def read_ris(spark: SparkSession, path: str, source_db: str, query_id: str = "", label: str = "") -> DataFrame:
    """Records end with an ER line; tags fall back on one another; authors and keywords repeat."""
    raw = spark.read.option("lineSep", "\nER  -").text(path).filter(F.col("value").rlike("TY  - "))
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")

    def all_of(tag):
        return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{tag}  -"))), lambda x: strip(F.substring(x, 6, 1 << 30)))

    def first_of(tags):
        return F.coalesce(*(blank_to_null(F.get(all_of(t), F.lit(0))) for t in tags))

    fields = {k: first_of(tags) for k, tags in RIS_TAGS.items()}
    authors = F.when(F.size(all_of("AU")) > 0, all_of("AU")).otherwise(all_of("A1"))
    out = raw.select(*(v.alias(k) for k, v in fields.items()), authors.alias("authors"), all_of("KW").alias("keywords"), pages(first_of(("SP",)), first_of(("EP",))).alias("pages"))
    return as_papers(out.withColumn("year", F.expr("try_cast(substring(year, 1, 4) as int)")), source_db, query_id, label)


_NAME = re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*")
_BARE = re.compile(r"[^\s,{}\"#]+")


def bibtex_fields(entry: str) -> dict[str, str]:
    """Fields of one entry: values in braces of any depth, in quotes (braces inside keep their quotes), or bare; ``#`` joins parts.

    Braces are dropped, white space is one space, names are small; the last of repeated names wins. An entry that is cut
    short gives what is whole.
    """
    found, at = {}, entry.find(",")
    while at >= 0 and (name := _NAME.match(entry, at)):
        at, parts = name.end(), []
        while at < len(entry):
            opened = entry[at]
            if opened in '{"':
                depth, end = int(opened == "{"), at + 1
                while end < len(entry) and not (entry[end] == '"' and opened == '"' and not depth):
                    depth += (entry[end] == "{") - (entry[end] == "}")
                    if opened == "{" and not depth:
                        break
                    end += 1
                if end == len(entry):
                    return found
                parts.append(entry[at + 1 : end])
                at = end + 1
            elif bare := _BARE.match(entry, at):
                parts.append(bare[0])
                at = bare.end()
            else:
                break
            joined = re.compile(r"\s*#\s*").match(entry, at)
            if not joined:
                break
            at = joined.end()
        found[name[1].lower()] = " ".join("".join(parts).replace("{", "").replace("}", "").split())
    return found


@F.pandas_udf(T.StringType())
def _bibtex_json(entries: pd.Series) -> pd.Series:
    return entries.map(lambda x: json.dumps(bibtex_fields(x)), na_action="ignore")


def read_bibtex(spark: SparkSession, path: str, source_db: str, query_id: str = "", label: str = "") -> DataFrame:
    """Entries start with @ at the start of a line, so a large file is read by several tasks; values as ``bibtex_fields`` reads them."""
    raw = spark.read.option("lineSep", "\n@").text(path).filter(F.col("value").rlike(r"^@?\w+\s*\{"))
    entry = raw.withColumn("_f", F.from_json(_bibtex_json("value"), "map<string,string>"))
    get = lambda *names: F.coalesce(*(blank_to_null(F.col("_f")[n]) for n in names))
    kind = F.lower(F.regexp_extract("value", r"^@?(\w+)", 1))
    out = entry.select(
        get("title").alias("title"), get("doi").alias("doi"), F.expr("try_cast(substring(_f['year'], 1, 4) as int)").alias("year"), get("abstract").alias("abstract"), get("journal", "booktitle", "series").alias("venue"),
        _split_list(get("author"), r"\s+and\s+").alias("authors"), _split_list(get("keywords"), "[,;]").alias("keywords"), get("url").alias("url"), get("volume").alias("volume"), get("number").alias("issue"), get("pages").alias("pages"), get("publisher").alias("publisher"),
        F.when(kind == "article", "article").when(kind == "inproceedings", "conference paper").when(kind == "incollection", "book chapter").otherwise(kind).alias("doc_type"),
    )
    return as_papers(out, source_db, query_id, label)


def read_csv(spark: SparkSession, path: str, source_db: str, query_id: str = "", label: str = "", sep: str = ",") -> DataFrame:
    """Headers go through an alias table; the first alias with a value wins; a byte-order mark is tolerated."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    by_name = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    found = {field: [F.col(f"`{by_name[a]}`") for a in names if a in by_name] for field, names in ALIASES.items()}
    cols = {f: F.coalesce(*(blank_to_null(c) for c in cs)) for f, cs in found.items() if cs}
    out = raw.select(*(c.alias(f) for f, c in cols.items()))
    if "year" in cols:
        out = out.withColumn("year", year_of(F.col("year")))
    for field, pattern in (("authors", r"[;|]"), ("keywords", r"[;|,]")):
        if field in cols:
            out = out.withColumn(field, _split_list(F.col(field), pattern))
    return as_papers(out, source_db, query_id, label)


def read_tagged(spark: SparkSession, path: str, query_id: str = "", label: str = "") -> DataFrame:
    """Two-letter tags, continuation lines indented by three spaces, records end with ER."""
    raw = spark.read.option("lineSep", "\nER\n").text(path)
    stitched = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n   ", "\u0001"), "\n")

    def value(tag):
        return F.substring(F.get(F.filter(stitched, lambda x: F.startswith(x, F.lit(f"{tag} "))), F.lit(0)), 4, 1 << 30)

    text = lambda tag: blank_to_null(F.replace(value(tag), F.lit("\u0001"), F.lit(" ")))
    out = raw.select(text("TI").alias("title"), text("DI").alias("doi"), F.expr("1").alias("_"), text("PY").alias("year"), text("AB").alias("abstract"), text("SO").alias("venue"), text("DT").alias("doc_type"), F.coalesce(_split_list(value("AU"), "\u0001"), F.array().cast("array<string>")).alias("authors"), F.coalesce(_split_list(text("DE"), ";"), F.array().cast("array<string>")).alias("keywords"), pages(text("BP"), text("EP")).alias("pages"))
    return as_papers(out.drop("_").filter("title is not null").withColumn("year", F.expr("try_cast(substring(year, 1, 4) as int)")), "wos", query_id, label)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A corpus as a JSON array; unknown keys are dropped. Files of more than one block are read by several tasks each."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if any(x.getLen() > most for x in files.globStatus(place) or []) or any(x.getLen() > most for g in files.globStatus(place) or [] if g.isDirectory() for x in files.listStatus(g.getPath())):
        return read_array(spark, path, PAPER)
    return spark.read.schema(PAPER).option("multiLine", True).json(path)


def read_records(spark: SparkSession, path: str, fmt: str, source_db: str = "", query_id: str = "", label: str = "") -> DataFrame:
    """Dispatch by format: an explicit one wins over the suffix."""
    kind = fmt if fmt != "auto" else {"bib": "bibtex", "ris": "ris", "csv": "csv", "json": "json", "txt": "tagged"}[path.rpartition(".")[2].lower()]
    if kind == "json":
        return read_json(spark, path)
    if kind == "tagged":
        return read_tagged(spark, path, query_id, label)
    return {"bibtex": read_bibtex, "ris": read_ris, "csv": read_csv}[kind](spark, path, source_db, query_id, label)


def write_csv(papers: DataFrame, path: str, columns: list[str], bom: bool = False) -> None:
    """A flat CSV, arrays joined by "; ". ``bom``: each file starts with a byte-order mark, for spreadsheets."""
    flat = [F.array_join(c, "; ").alias(c) if papers.schema[c].dataType.typeName() == "array" else F.col(c) for c in columns]
    out = papers.select(*flat)
    if bom:  # the mark goes before the first name, which must stand without quotes then
        out = out.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    out.write.mode("overwrite").csv(path, header=True, quoteAll=not bom, escape='"')


def write_json_arrays(papers: DataFrame, path: str, bucket: Column) -> None:
    """A corpus as JSON arrays, a file for each value of ``bucket``, which must hold few enough papers for one text."""
    one = F.to_json(F.struct(*papers.columns), {"ignoreNullFields": "false"})
    arrays = papers.select(bucket.alias("_b"), one.alias("_j")).groupBy("_b").agg(F.concat(F.lit("["), F.array_join(F.collect_list("_j"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_json(papers: DataFrame, path: str) -> None:
    """A corpus as JSON lines, one object for each paper, nulls included; ``read_json_lines`` takes it back."""
    papers.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAPER).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A sheet of decisions by column names, all as text: with or without a byte-order mark; a missing file is empty.

    Columns that the file lacks are null, others are dropped. The delimiter is what the first line holds more of.
    """
    empty = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    if not exists(spark, path):
        return empty
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return empty
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sniffed(first[0].value))
    held = {c.strip().lstrip("\ufeff"): c for c in raw.columns}
    return raw.select(*((F.col(f"`{held[c]}`") if c in held else F.lit(None).cast("string")).alias(c) for c in columns))


def sniffed(line: str) -> str:
    """The delimiter of a line: a semicolon where there are more of them than commas."""
    return ";" if line.count(";") > line.count(",") else ","


def write_raw(rows: DataFrame, path: str, query: str = "source_query_id", force: bool = False) -> None:
    """The raw zone: a folder for each query. Queries that are there already are kept unless forced, then replaced."""
    spark = rows.sparkSession
    if not force and exists(spark, path):
        held = spark.read.parquet(path).select(query).distinct()
        rows = rows.join(held, query, "left_anti")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(query).parquet(path)


def raw_counts(spark: SparkSession, path: str, query: str = "source_query_id") -> DataFrame:
    """query, files, n of the raw zone."""
    rows = spark.read.parquet(path).select(query, F.col("_metadata.file_path").alias("_file"))
    return rows.groupBy(query).agg(F.countDistinct("_file").alias("files"), F.count("*").alias("n"))


def append_absent(new: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table does not hold yet."""
    spark = new.sparkSession
    try:
        held = spark.read.parquet(path).select(key)
    except Exception as missing:  # no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        held = new.select(key).limit(0)
    new.join(held, key, "left_anti").dropDuplicates([key]).write.mode("append").parquet(path)


def union_common(frames: dict[str, DataFrame]) -> DataFrame:
    """Union on the columns that all frames have, with the origin of each row."""
    common = [c for c in next(iter(frames.values())).columns if all(c in f.columns for f in frames.values())]
    return reduce(DataFrame.unionByName, [f.select(*common, F.lit(name).alias("origin")) for name, f in frames.items()])
