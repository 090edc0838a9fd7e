"""Folding and entities against Python's own, for every code point and every name."""

import html
import random
import unicodedata
from html.entities import html5

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmesh.functions import characters


def fold(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def test_folding_of_every_code_point(spark):
    every = [chr(n) for n in range(1, 0x110000) if not 0xD800 <= n < 0xE000]
    rows = ["".join(every[i : i + 64]) for i in range(0, len(every), 64)] + ["", "plain ascii\n", "Ação & Reação ﬁnal ½ ㎏ 𝐀𝐁", "日本"]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").repartition(8)
    got = {r.i: r.y for r in table.select("i", characters.nfkd_ascii(F.col("x")).alias("y")).collect()}
    wrong = [i for i, x in enumerate(rows) if got[i] != fold(x)]
    assert not wrong, [(rows[i], got[i], fold(rows[i])) for i in wrong[:3]]
    assert spark.range(1).select(characters.nfkd_ascii(F.lit(None).cast("string")).alias("y")).first().y is None


def test_every_entity(spark):
    rng = random.Random(2)
    texts = [f"a&{n}b &{n.rstrip(';')}x;" for n in html5] + [f"&#{n};&#x{n:x}z&#X{n:X};" for n in [*range(0x200), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**12]]
    pieces = ["&", "&&", "&amp", "&amp;lt;", "&#", "&#;", "&#x;", "&#00065;", "&notit;", "&notin;", "&nosuch;", "&copy2", " ", "x", "<b>", "&" + "a" * 40, "é", "&é;", "&lt\n", "&#9999999999999999999999;"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(1500)]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(8)
    got = {r.i: r.y for r in table.select("i", characters.html_unescape(F.col("x")).alias("y")).collect()}
    wrong = [i for i, x in enumerate(texts) if got[i] != html.unescape(x)]
    assert not wrong, [(texts[i], got[i], html.unescape(texts[i])) for i in wrong[:5]]
    plan = table.select(characters.html_unescape(F.col("x")), characters.nfkd_ascii(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


@pytest.mark.parametrize("name", ["unescaped_pages", "clean_markup"])
def test_references_equal_the_sql(spark, tmp_path, name):
    odd = ["a &amp", "&am", "x &ampx; <b>&lt;b&gt;</b> &notit; &notin; &#65 &#x41;&#X1f600; &#0; &#128; &#55296; &#99999999999;", "&nbsp;| &#11;v&#x2003;w\x85 &amp;lt; &bogus; && &#; &#x; &#xg", "", None, "&copy2 &acE; &#x110000; &#1;'&quot;\n&\n"]
    rows = [*enumerate(odd), (0, "a &amp again")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.digest or "") for r in entry.queries()[name](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == sorted((k, digest or "") for k, _, digest in db.execute(entry.oracle_sql()[name]).fetchall())
