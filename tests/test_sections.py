"""Sections of extracted text against line scans in plain Python, over all documents and made ones."""

import random
import re

from pyspark.sql import functions as F

from quillmesh.operators import profiles as P

SPACE = " \t\n\r\f\x0b"


def clean(text):
    plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", text or "")
    return re.sub(r"\n{2,}", "\n\n", plain.replace("-\n", "")).strip(SPACE)


def split(text):
    flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(SPACE)
    return [s for s in (x.strip(SPACE) for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", flat)) if len(s) > 20]


def summary(sentences, most, chars):
    out, size = [], 0
    for s in sentences:
        if len(out) >= most or out and size + len(s) > chars:
            break
        out.append(s)
        size += len(s) + 1
    return " ".join(out)[:chars].strip(SPACE)


def title(text):
    lines = [x for x in (x.strip(SPACE) for x in re.split(r"\r\n|\n|\r", text)[:20]) if x]
    for i, x in enumerate(lines):
        if "@" in x or any(x.lower().startswith(t) for t in P.TITLE_ENDS):
            lines = lines[:i]
            break
    begun = next((i for i, x in enumerate(lines) if len(x) >= 5), 0)
    body = []
    for i, x in enumerate(lines[begun:]):
        if i and not re.search(r"[ \t\n\x0b\f\r]", x):
            break
        body.append(x)
    joined = ""
    for x in body:
        if len(x) >= 5 and len(joined) <= 180:
            joined = f"{joined} {x}" if joined else x
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", joined).strip(" ,-")[:300]


def abstract(text):
    parts = re.split(r"\babstract\b", text, maxsplit=1, flags=re.I | re.A)
    if len(parts) < 2:
        return ""
    rest = parts[1].lstrip(SPACE + "—:-")
    lines = [x.lstrip(SPACE).rstrip("\r") for x in rest.split("\n")]

    def opens(line):
        low = line.lower()
        words = any(low.startswith(t) and not re.match(r"\w", low[len(t) : len(t) + 1], re.A) for t in P.ABSTRACT_ENDS)
        return words or any(low.startswith(n) for n in P.FIRST_NUMBERS) and re.match(r"\S+\s+[a-z]\b", low, re.A)

    at = next((i for i, x in enumerate(lines) if i and opens(x)), None)
    found = ["\n".join(lines[:at])] if at is not None else []
    full = [x for x in lines if x.strip(SPACE)]
    if len(full) > 1 and re.fullmatch("[A-Za-z][A-Za-z -]{3,}", full[-1].strip(SPACE)):
        found.append("\n".join(full[:-1]))
    return next((s for s in (summary(split(x), 5, 1800) for x in found) if len(s) > 80), "")


def section(text, heading):
    lines = [x for x in (x.strip(SPACE) for x in text.split("\n")) if x]
    bare = lambda x: re.sub(P.SECTION_NUMBER, "", x).strip(SPACE)
    at = next((i for i, x in enumerate(lines[:-1]) if bare(x).lower() == heading), None)
    if at is None:
        return ""
    under = lines[at + 1 :]
    end = next((i for i, x in enumerate(under[:-1]) if i and re.fullmatch("[A-Za-z][A-Za-z -]{2,}", bare(x))), len(under))
    return summary(split("\n".join(under[:end])), 4, 1400)


def results(text):
    hits = lambda x, most, chars: summary([s for s in split(x) if re.search(P.RESULT_TERMS, s.lower())], most, chars)
    if found := hits(abstract(text), 3, 900):
        return found
    for h in P.RESULT_HEADINGS:
        if h in text.lower() and len(found := section(text, h)) > 80:
            return found
    return hits(text, 4, 1000)


def made(docs):
    """Documents with headings, mail addresses and short lines put in between their lines."""
    rng, out = random.Random(4), []
    extra = ["Abstract", "ABSTRACT: we", "Keywords: a, b", "1. Introduction", "I. A study", "2.1 Results", "RESULTS", "Discussion", "Conclusion", "me@x.org", "Solo", "We found that it improves the results of all and shows a significant gain.", "References", "", "ab", "A Heading Here"]
    for text in docs:
        lines = (text or "").split("\n")[:12]
        for _ in range(rng.randrange(6)):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(extra))
        out.append("\n".join(lines))
    return out


def test_sections_equal_line_scans(spark, sf_dir):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = docs + made(docs) + made(docs)[::-1] + [None, "", "abstract", "Abstract\n", "\n\n", "results\nx"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    got = {r.i: (r.title_guess, r.abstract_found, r.results_found, r.clean_length) for r in P.extracted(table).select("i", "title_guess", "abstract_found", "results_found", "clean_length").collect()}
    for i, text in enumerate(texts):
        c = clean(text)
        assert got[i] == (title(c), abstract(c), results(c), len(c)), (text or "")[:400]
    assert sum(bool(g[1]) for g in got.values()) > 10 and sum(bool(g[2]) for g in got.values()) > 20


def test_named_sections_equal_line_scans(spark, sf_dir):
    texts = made([r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    table = spark.createDataFrame([(i, clean(t)) for i, t in enumerate(texts)], "i int, text string")
    for heading in ("results", "discussion", "conclusion"):
        got = {r.i: r.x for r in table.select("i", P.named_section(F.col("text"), heading).alias("x")).collect()}
        assert all(got[i] == section(clean(t), heading) for i, t in enumerate(texts))
