"""Hand-computed values, small randomised checks, and readers and writers."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import characters
from quillmesh.functions import text as T
from quillmesh.functions import udfs
from quillmesh.operators import agreement, catalogue, enrich, exports, keys, linkage, screening
from quillmesh.sources import files
from quillmesh.streaming import ingest, ledger

LABELS = ("include", "exclude", "maybe")


def pairs(spark, matrix):
    rows = [(LABELS[i], LABELS[j]) for i, row in enumerate(matrix) for j, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "primary string, verifier string")


@pytest.mark.parametrize("matrix,kappa,label", [([[233, 0, 58], [3, 12, 7], [7, 0, 100]], 0.641, "substantial"), ([[109, 9, 25], [2, 26, 6], [0, 0, 0]], 0.479, "moderate"), ([[0, 0, 0], [1, 38, 0], [0, 0, 0]], 0.0, "slight"), ([[0, 0, 0], [0, 7, 0], [0, 0, 0]], None, None)])
def test_kappa(spark, matrix, kappa, label):
    r = agreement.cohen_kappa(pairs(spark, matrix)).collect()[0]
    assert r.n == sum(map(sum, matrix)) and r.label == label
    assert r.kappa is None if kappa is None else round(r.kappa, 3) == kappa


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_similarity_and_its_filters(spark):
    random.seed(2)
    rows = []
    for i in range(200):
        a = "".join(random.choice("abcd ") for _ in range(random.randint(0, 40)))
        b = "".join(random.choice([c, c, c, c, "", "x"]) for c in a)
        assert udfs.common_length(a, b) == lcs(a, b)
        rows += [(2 * i, 2000 + i, f"k {a}"), (2 * i + 1, 2000 + i, f"k {b}")]
    assert udfs.token_sort("b a", "a b") == 100 and udfs.token_set("a b", "a b c") == 100 and udfs.token_set("", "") == 0
    df = spark.createDataFrame(rows, "pos long, year int, title string")
    got = {(r.a, r.b) for r in linkage.similar_titles(df).collect()}
    norm = {r.pos: r.t for r in df.select("pos", T.norm_title(F.col("title")).alias("t")).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(200) if udfs.token_sort(norm[2 * i], norm[2 * i + 1]) >= 92}


def test_exact_pass_is_the_sequential_rule(spark):
    random.seed(4)
    rows = [(i, str(i), random.choice(["10.1/a", "doi:10.1/A", "10.1/b", None, ""]), "t", "x" * random.choice([0, 60]), random.choice([["a"], []]), [], None, 2000, None) for i in range(120)]
    df = spark.createDataFrame(rows, "pos long, internal_id string, doi string, title string, abstract string, authors array<string>, keywords array<string>, venue string, year int, pages string")
    got = {r.pos: r for r in linkage.exact_duplicates(df).collect()}
    best, flags = {}, {}
    for i in range(120):
        r = got[i]
        if r.norm_doi is None:
            continue
        if r.norm_doi not in best:
            best[r.norm_doi] = i
        elif r.richness > got[best[r.norm_doi]].richness:
            flags[best[r.norm_doi]], best[r.norm_doi] = i, i
        else:
            flags[i] = best[r.norm_doi]
    assert {i: str(v) for i, v in flags.items()} == {i: r.duplicate_of for i, r in got.items() if r.duplicate_of}
    assert all(r.canonical_id == str(best.get(r.norm_doi, i)) for i, r in got.items())


def test_a_hot_doi_is_dealt_to_many_tasks(spark):
    """20,000 records of one DOI, richness rising at 0, 7,000 and 15,000: no window over the DOI."""
    hot = spark.range(20_000).selectExpr("id as pos", "cast(id as string) as internal_id", "'10.1/a' as doi", "'t' as title", "if(id >= 15000, repeat('x', 60), null) as abstract", "if(id >= 7000, array('a'), array()) as authors", "array() as keywords", "cast(null as string) as venue", "2000 as year", "cast(null as string) as pages")
    out = linkage.exact_duplicates(hot)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.pos: (r.duplicate_of, r.canonical_id) for r in out.collect()}
    best = lambda i: 15_000 if i > 15_000 else 7_000 if i > 7_000 else 0
    want = {i: (str(best(i)), "15000") for i in range(20_000)} | {0: ("7000", "15000"), 7_000: ("15000", "15000"), 15_000: (None, "15000")}
    assert got == want


def test_text_rules(spark):
    row = spark.range(1).select(
        T.norm_doi(F.lit(" HTTPS://doi.org/10.1/X \t")).alias("a"), T.norm_title(F.lit("A—b: Cé d\n2")).alias("b"), T.clean_markup(F.lit("<p>x &amp;lt; y</p>\n z")).alias("c"),
        T.from_inverted_index(F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(5)), F.lit("a"), F.array(F.lit(0)))).alias("d"), T.find_doi(F.lit("see 10.1234/ab.c).")).alias("e"),
        T.strip_fences(F.lit('```json\n{"a":{"b":1}}\n``` tail')).alias("f"), T.last_name(F.lit("Ann B. Cole")).alias("g"), T.last_name(F.lit("Cole, Ann")).alias("h"), characters.nfkd_ascii(F.lit("Ünïcode")).alias("i"), characters.html_unescape(F.lit("&eacute;")).alias("j"),
    ).collect()[0]
    assert row.a == "10.1/x" and row.b == "ab c d 2" and row.d == "a b b" and row.e == "10.1234/ab.c" and row.f == '{"a":{"b":1}}' and (row.g, row.h, row.i, row.j) == ("Cole", "Cole", "Unicode", "é")


def test_decision_modes(spark):
    df = spark.createDataFrame([(1, '{"decision":"Include"}'), (2, '{"decision":'), (3, "I would exclude it"), (4, None)], "id int, response string")
    for mode, want in (("maybe", ["include", "maybe", "maybe", "maybe"]), ("blank", ["include", "", "", ""]), ("guess", ["include", "maybe", "exclude", "maybe"])):
        assert [r.decision for r in screening.parse_decisions(df, mode).orderBy("id").collect()] == want


def test_global_rank_and_samples(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 7)
    got = keys.global_rank(df, "rank", F.desc("s"), F.asc("id")).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1001)) and [(r.s, r.id) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    sample = keys.stratified_sample(df, "s", "id", 0.1, "x").groupBy("s").count().collect()
    assert all(r["count"] == 14 for r in sample)


def test_readers(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - One\nAU  - A, B\nAU  - C, D\nPY  - 2020/01\nDO  - 10.1/a\nSP  - 1\nEP  - 9\nKW  - k\nER  - \nTY  - CPAPER\nT1  - Two\nY1  - 2021\nER  - \n")
    ris = files.read_records(spark, f"{tmp_path}/a.ris", "auto", "db").orderBy("title").collect()
    assert [(r.title, r.year, r.authors, r.pages, r.doi) for r in ris] == [("One", 2020, ["A, B", "C, D"], "1-9", "10.1/a"), ("Two", 2021, [], None, None)]
    (tmp_path / "a.bib").write_text('@article{x,\n title = {A {B} c},\n author = {P, Q and R S},\n year = 2019,\n journal = "J",\n}\n@inproceedings{y,\n title={Z}, booktitle={W}, pages={1--2}\n}\n')
    bib = files.read_records(spark, f"{tmp_path}/a.bib", "auto", "db").orderBy("title").collect()
    assert [(r.title, r.year, r.authors, r.venue, r.doc_type, r.pages) for r in bib] == [("A B c", 2019, ["P, Q", "R S"], "J", "article", None), ("Z", None, None, "W", "conference paper", "1--2")]
    (tmp_path / "a.csv").write_text('﻿Document Title,Authors,Publication Year,DOI\n"X, ""y""\nz","A; B",2018-05,10.2/b\n,,,\n')
    csv = files.read_records(spark, f"{tmp_path}/a.csv", "csv", "db").collect()
    assert (csv[0].title, csv[0].authors, csv[0].year) == ('X, "y"\nz', ["A", "B"], 2018)
    (tmp_path / "a.txt").write_text("PT J\nAU One, A\n   Two, B\nTI Long\n   title\nPY 2001\nDE a; b\nBP 3\nEP 4\nER\nPT J\nAU X\nER\n")
    tagged = files.read_records(spark, f"{tmp_path}/a.txt", "auto").collect()
    assert [(r.title, r.authors, r.year, r.keywords, r.pages) for r in tagged] == [("Long title", ["One, A", "Two, B"], 2001, ["a", "b"], "3-4")]
    (tmp_path / "a.json").write_text('[{"title":"t","unknown":1,"authors":["a"]}]')
    assert files.read_records(spark, f"{tmp_path}/a.json", "auto").collect()[0].authors == ["a"]


def test_exports_and_append(spark, tmp_path):
    rows = [("1", "T", ["L, F"], [], 2020, "abc", "J", "10.1/x", "1-2", "article", "db")]
    df = spark.createDataFrame(rows, "internal_id string, title string, authors array<string>, keywords array<string>, year int, abstract string, venue string, doi string, pages string, doc_type string, source_db string")
    assert exports.ris(df).collect()[0].ris.split("\n")[-1] == "ER  - " and exports.bibtex(df).collect()[0].citekey == "L2020t"
    for ids in ((1, 2), (2, 3)):
        files.append_absent(spark.createDataFrame([(i,) for i in ids], "id int"), f"{tmp_path}/t", "id")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2, 3]


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_ledger_stream_equals_batch(spark, tmp_path):
    schema, rng = "id long, decision string, at long", random.Random(3)
    batches = [[(i, rng.choice("abc"), i) for i in range(4000)], [(5, "late", 1), (7, "new", 9000), (4001, "new", 9001)], [(5, "now", 9002), (5, "old", 0)]]
    every, book = [], ledger.Ledger(spark, f"{tmp_path}/out", "id", ["at"], 32)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ledger.follow_decisions(spark, f"{tmp_path}/in", schema, "id", ["at"], f"{tmp_path}/out", f"{tmp_path}/check", 32).awaitTermination()
        every += rows
        want = {}
        for k, d, at in sorted(every, key=lambda r: r[2]):
            want[k] = d
        assert {r.id: r.decision for r in book.read(schema).collect()} == want
        if i:  # a small batch writes its buckets only
            touched = {v for v in book.placed(i).values()}
            assert sum(v == i for v in book.placed(i).values()) <= len({r[0] for r in rows}) and touched != {i}
            assert size_of(tmp_path / "out" / "data" / f"v={i}") < 0.25 * size_of(tmp_path / "out" / "data" / "v=0")
    assert len(book.placed(0 if 0 in book.versions() else 1)) == 32 and book.versions() == [1, 2]
    book.upsert(spark.createDataFrame([(5, "again", 9999)], schema), 2)  # taken up before: nothing changes
    assert {r.decision for r in book.read(schema).filter("id = 5").collect()} == {"now"}
    book.upsert(spark.createDataFrame([(i, "x", 10_000) for i in range(4002)], schema), 3)
    book.upsert(spark.createDataFrame([(1, "y", 10_001)], schema), 4)
    assert not (tmp_path / "out" / "data" / "v=0").exists() and not (tmp_path / "out" / "data" / "v=2").exists()


def test_ingest_finds_repeats_by_doi_and_by_title_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [(1, "10.1/a", "A Title"), (2, "https://doi.org/10.1/A", "Other"), (3, None, "A title!"), (4, None, None), (5, None, "")],
        [(6, "10.1/a", "Third"), (7, "10.1/b", "a TITLE"), (8, "10.1/c", "New one"), (9, None, "new one")],
        [(0, "10.1/c", "late"), (10, "10.1/b", "Fourth"), (11, "10.1/d", "Fourth"), (12, None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "pos long, doi string, title string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("pos long, doi string, title string").parquet(f"{tmp_path}/in")
        out = ingest.distinct_arrivals(stream, "pos").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        out.awaitTermination()
    # 7: its title came before, and its DOI is used up, so 10 is a repeat too
    assert sorted(r.pos for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 4, 5, 8, 11, 12]


def test_ingest_for_ever_needs_no_call_for_each_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "_FirstOfKey", None)
    spark.createDataFrame([(i, f"10.1/{i % 7}" if i % 3 else None, f"Title {i % 50}") for i in range(25_000)], "pos long, doi string, title string").coalesce(1).sortWithinPartitions(F.desc("pos")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("pos long, doi string, title string").parquet(f"{tmp_path}/in")
    ingest.distinct_arrivals(stream, "pos").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    dois, names, want = set(), set(), []
    for i in range(25_000):
        doi = f"10.1/{i % 7}" if i % 3 else None
        if doi is None or doi not in dois:
            dois.add(doi)
            if i % 50 not in names:
                names.add(i % 50)
                want.append(i)
    assert sorted(r.pos for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_request_forms(spark):
    q = 'TITLE("a b")\n AND (LIMIT-TO(DOCTYPE, "ar") OR LIMIT-TO(DOCTYPE, "cp"))\n AND (LIMIT-TO(LANGUAGE, "English"))'
    rows = spark.createDataFrame([(q,), ('"All Metadata":"x" AND "All Metadata" : "y"',), (" plain ",), (None,)], "q string")
    c = F.col("q")
    got = rows.select(catalogue.without_limits(c), catalogue.limited_kinds(c), catalogue.plain_boolean(c), catalogue.keywords(c)).collect()
    assert tuple(got[0])[:2] == ('TITLE("a b") AND (LANGUAGE(english))', "ar,cp")
    assert got[1][2] == '"x" AND "y"' and got[2][3] == "plain" and got[3][1:3] == (None, None)
    cases = {
        'a and (b AND c) AND (LIMIT-TO(X, "y"))': "a AND (b AND c)",
        'LIMIT-TO(DOCTYPE, "ar") AND "x AND y" and z': '"x AND y" AND z',
        'band LIMIT-TO ( LANGUAGE , "Old Norse" ) or (limit-to(LANGUAGE,"English"))': "band or () AND (LANGUAGE(old norse) OR LANGUAGE(english))",
        'a AND (LIMIT-TO(LANGUAGE, "en") OR LIMIT-TO(LANGUAGE, "en"))': "a AND (LANGUAGE(en))",
        "": "",
        "x ) AND ( y AND z": "x ) AND ( y AND z",
        'open "quote AND more': 'open "quote AND more',
    }
    made = spark.createDataFrame([(x,) for x in cases], "q string")
    assert {r.q: r.x for r in made.select("q", catalogue.without_limits(c).alias("x")).collect()} == cases
    assert got[3][0] is None
    assert rows.limit(1).select(catalogue.escape_slashes(F.lit("10.1/a/b"))).collect()[0][0] == "10.1\\/a\\/b"


def test_enrich_working_set(spark):
    papers = spark.createDataFrame([(1, "a", "10.1/x", None), (2, "b", "10.1/X", " "), (3, "c", "10.1/y", None), (4, "d", "10.1/z", None)], "pos int, internal_id string, doi string, abstract string")
    provider = spark.createDataFrame([("10.1/x", "s", "one"), ("10.1/y", "o", "two"), ("10.1/x", "o", "three"), ("10.1/z", "s", "four")], "doi string, provider string, abstract string")
    saved = spark.createDataFrame([("d", "kept"), ("a", "")], "internal_id string, abstract string")
    both = {r.pos: (r.abstract, r.abstract_source) for r in enrich.enrich_working_set(papers, provider, "s", "o", saved=saved).collect()}
    assert both == {1: (None, None), 2: ("one", "s"), 3: ("two", "o"), 4: ("kept", None)}
    first = {r.pos: r.abstract for r in enrich.enrich_working_set(papers, provider, "s", "o", True).collect()}
    assert first == {1: None, 2: "one", 3: None, 4: "four"}


def test_hot_null_keys_stay_out_of_the_window(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 7, i % 2 or None) for i in range(200)], "pos int, k int, j int")
    got = sorted(r.pos for r in keys.first_wins(rows, ["k"], "pos").collect())
    seen, want = set(), []
    for i in range(200):
        k = None if i % 3 else i % 7
        if k is None or k not in seen:
            want.append(i)
        seen.add(k)
    assert got == want
    both = keys.first_wins(rows, ["k", "j"], F.desc("pos"))
    assert both.filter("k is not null and j is not null").count() == 7 and both.filter("k is null or j is null").count() == rows.filter("k is null or j is null").count()
    plan = keys.first_wins(rows, ["k"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_shared_folder_of_a_cluster():
    from quillmesh import storage

    assert storage.cluster_folder("hdfs://nn/warehouse/") == "hdfs://nn/warehouse/_checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.cluster_folder("file:/home/x/spark-warehouse")


def test_bibtex_values_of_any_depth():
    entry = """article{key1,
      title = {Of {A {very {deep}}} one, with = and "quotes"}, AUTHOR="A {"}b{"} C and D", year = 2020 , month = jan # "~" # {x},
      note = {}, title = {Last {wins}}, cut = {never ends"""
    assert files.bibtex_fields(entry) == {"title": "Last wins", "author": 'A "b" C and D', "year": "2020", "month": "jan~x", "note": ""}
    assert files.bibtex_fields("comment{no fields}") == {} and files.bibtex_fields("book{k, a = 1 b = 2}") == {"a": "1", "b": "2"}
    assert files.bibtex_fields("") == {}


def test_a_large_bibtex_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.bib").write_text("".join(f"@article{{k{i},\n title = {{T {{{{{i}}}}} {'x' * 200}}},\n year = {1990 + i % 30}\n}}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = files.read_bibtex(spark, f"{tmp_path}/a.bib", "db")
        assert read.rdd.getNumPartitions() > 4
        assert sorted(int(r.title.split()[1]) for r in read.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_json_arrays_are_read_by_several_tasks(spark, tmp_path):
    import json

    rng = random.Random(6)
    odd = ['a "quoted} {text', "back\\\\slash", "{[}]", "ends with \\", "ünï 日本", "", "line\nbreak }, {", "x" * 3000]
    rows = [{"title": " ".join(rng.choice(odd) for _ in range(rng.randrange(5))), "authors": ["{", "}"] if i % 3 else [], "year": i, "unknown": {"deep": {"er": [{}, {"a": "}"}]}}} for i in range(400)]
    rows.insert(7, {"title": "y}{" * 9000, "year": -1})  # longer than blocks
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    (tmp_path / "one" / "b.json").write_text(" [\n" + ",\n".join(json.dumps(r, indent=1, ensure_ascii=False) for r in rows[:50]) + "\n]\n", encoding="utf-8")
    (tmp_path / "one" / "c.json").write_text("[]")
    key = lambda df: sorted((r.year, r.title, r.authors) for r in df.select("year", "title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors")).collect())
    want = key(spark.read.schema(files.PAPER).option("multiLine", True).json(f"{tmp_path}/one"))
    assert len(want) == 451
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "10k", "100k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert key(files.read_records(spark, f"{tmp_path}/one", "json")) == want
            assert spark.read.option("lineSep", "}").text(f"{tmp_path}/one/a.json").rdd.getNumPartitions() > 2
        assert key(files.read_json(spark, f"{tmp_path}/one/c.json")) == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
