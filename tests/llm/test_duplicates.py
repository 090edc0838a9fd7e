"""Exact and near duplicates against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest

from quillmesh.llm import exactdedup, jaccard
from quillmesh.llm.common import Scratch


def brute_components(rows, words, num, den):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}  # rows that repeat an id are one node

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and den * both >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(n):
    """A chain and a crowd of near copies with passages that others share."""
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for j in range(k % 4):
            words[(k * 7 + j * 41) % 120] = f"x{k}_{j}" if k % 3 else f"y{j}"
        out.append((1000 + k, " ".join(words)))
    for k in range(12):  # a chain: each two edits from the one before
        words = [f"c{i}" for i in range(200)]
        for j in range(2 * k):
            words[j * 8] = f"z{j}"
        out.append((2000 + k, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(40))
    return out + [(3000 + k, f"{passage} " + " ".join(f"q{k}_{i}" for i in range(k))) for k in range(15)]


def crowd_of_outliers(n):
    """A crowd whose members link only through others, and outliers that share much with all and link with none."""
    base = [f"k{i}" for i in range(150)]
    out = []
    for k in range(n):
        words = list(base)
        for j in range(4):  # a window of edits that moves on: only close numbers link
            words[(6 * k + 7 * j) % 150] = f"e{(6 * k + 7 * j) % 150}"
        out.append((5000 + k, " ".join(words)))
        out.append((6000 + k, " ".join(w if i % 9 else f"o{k}_{i}" for i, w in enumerate(base))))
    return out


@pytest.mark.parametrize("words,num,den", [(4, 85, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, docs, odd_docs, words, num, den):
    made = spark.createDataFrame(near_copies(60), "doc_id long, text string")
    table = docs.select("doc_id", "text").union(made).repartition(5)
    rows = [tuple(r) for r in table.collect()]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(table, words, num, den).collect())
    assert got == brute_components(rows, words, num, den)
    assert len({c for i, _, c in got if 1000 <= i < 2000}) < 60


@pytest.mark.parametrize("rounds,short", [(0, 2), (1, 1)])
def test_work_is_split_without_losing_links(spark, monkeypatch, rounds, short):
    """Few linking rounds and short lists leave more to the pairs at the end; the result is the same."""
    monkeypatch.setattr(jaccard, "_SHORT", short)
    rows = near_copies(40) + crowd_of_outliers(30)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(table, 5, 80, 100, rounds=rounds).collect())
    assert got == brute_components(rows, 5, 80, 100)


def test_repeated_ids_with_other_texts_lose_no_link(spark):
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    a, b = words("a", 63), words("b", 63)
    near_b = [*b[:-1], "z"]
    rows = [(5, a), (5, b), (6, near_b), (3, words("c", 63)), (3, b), (8, words("d", 40)), (9, words("c", 63)), (9, words("e", 50)), (11, [*words("e", 49), "y"])]
    rows = [(i, " ".join(t)) for i, t in rows] + [(None, " ".join(b))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute_components(rows, 4, 85, 100)
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 60, None)]
    only = [r for r in rows if r[0] in (5, 6)]
    got = jaccard.near_duplicates(spark.createDataFrame(only, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (6, 5)}


def test_components_of_odd_rows(odd_docs, empty_docs):
    got = jaccard.near_duplicates(odd_docs).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute_components(rows, 4, 85, 100)
    assert [tuple(r) for r in got if r.doc_id is None].count((None, 0, None)) == 1
    assert jaccard.near_duplicates(empty_docs).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    for part in (500_000, 40):  # one task, and stars of several tasks put together
        found = jaccard.components(edges.repartition(9), Scratch(spark, "test"), part).collect()
        assert len(found) == 301 and {r.component for r in found} == {0}


def test_bitmap_filter_never_drops_a_link():
    import random

    import numpy as np
    import pyarrow as pa

    random.seed(3)
    for _ in range(300):
        n = random.randint(1, 400)
        a = np.unique(np.array([random.getrandbits(63) for _ in range(n)], np.uint64))
        edits = random.randint(0, n // 5)
        b = np.unique(np.concatenate([a[edits:], np.array([random.getrandbits(63) for _ in range(random.randint(0, edits))], np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "a_n": [len(a)], "b_n": [len(b)], "a_bitmap": [jaccard._bitmap(a)], "b_bitmap": [jaccard._bitmap(b)]})
            assert next(jaccard._close(80, 100)([batch])).num_rows == 1


@pytest.mark.parametrize("block,bits", [(4096, 64), (16, 64), (16, 2), (7, 3)])
def test_exact_duplicates_equal_brute_force(odd_docs, docs, block, bits):
    table = odd_docs.select("doc_id", "text").filter("doc_id is null or doc_id not in (7, 8, 9)") if block < 64 else odd_docs.select("doc_id", "text").union(docs.select("doc_id", "text"))
    groups = defaultdict(list)
    for r in table.collect():
        groups[r.text or ""].append(r.doc_id)
    want = sorted((i if i is not None else -1, max(x for x in [*ids, -9] if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = exactdedup.exact_duplicates(table, block, bits).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id if r.keep_id is not None else -9, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_names_do_not_depend_on_the_layout(odd_docs, docs):
    """A name is a rank among sorted contents: the same whatever the files and their order."""
    table, names = odd_docs.filter("doc_id is not null").select("doc_id", "text").union(docs.select("doc_id", "text")), []
    for parts in (1, 7):
        found, _ = exactdedup.identities(table.repartition(parts, "text"), 512)
        names.append(sorted(tuple(r) for r in found.select("doc_id", "n_blocks", "name").collect()))
    assert names[0] == names[1]
    blocks = {n for _, k, n in names[0] if k == 1}
    assert min(blocks) == 1 or len(blocks) > 1


def test_names_have_no_python_in_their_plan(docs):
    plan = exactdedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_stage_forms(odd_docs, empty_docs):
    assert exactdedup.exact_duplicates(empty_docs).count() == 0
    kept = exactdedup.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({r.text or "" for r in odd_docs.collect()})
    near = jaccard.keep_one_of_each(odd_docs)
    assert near.columns == odd_docs.columns
