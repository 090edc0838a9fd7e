import pytest

#: Clashing names: every operator must ignore them.
EXTRA = "n long, score double, name string, key string, level int, shingle string, component string, start long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    long_text = " ".join(f"word{i % 977} thing{i % 31}," for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood"
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (6, "42 !!! 17"), (7, long_text), (8, long_text + " end"), (9, long_text),
        (10, "Ünïcode’s ŒUVRE ﬁn  double  space nbsp  em  x\x1cy <|endoftext|> tail"), (11, "one two"), (12, "one two"), (13, "ONE two"), (None, base), (None, None),
        (14, base.replace("fox", "cat")), (15, "éclair café naıve İstanbul ΣΑΣ don't we'll 'quoted' 123abc"), (16, "  lead and trail  "), (17, "a   b\n\n c \n d"),
    ]
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src0", None if t is None else len(t), k, k / 2, f"n{k}", None, k, "s", "c", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
