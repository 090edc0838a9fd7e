"""Token counts against the library, vector codes and divergence against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillmesh.llm import divergence, tokencount, vectorcode
from quillmesh.llm.chunks import load

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def counted(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()))


def by_library(*tables):
    library = load(BYTE)
    out = []
    for table in tables:
        for r in table.select("doc_id", "text").collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            out.append((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n, n > 1024))
    return sorted(out)


def test_counts_equal_the_library(docs, odd_docs, empty_docs):
    assert counted(tokencount.token_counts(docs, BYTE)) == by_library(docs)
    assert counted(tokencount.token_counts(odd_docs, BYTE)) == by_library(odd_docs)
    assert counted(tokencount.token_counts(empty_docs, BYTE)) == []


def test_chunks_of_any_size_count_alike(docs, odd_docs):
    want = by_library(odd_docs)
    for words, size, rows, held in ((1, 1, 1, 1), (50, 1 << 20, 3, 7), (1 << 18, 4000, 8192, 1 << 20)):
        assert counted(tokencount.token_counts(odd_docs, BYTE, chunk_words=words, chunk_bytes=size, chunk_docs=rows, held_rows=held)) == want


def test_odd_texts_are_cut_as_the_library_cuts_them():
    rng, counter, library = random.Random(5), tokencount.PieceCounter(BYTE), load(BYTE)
    pieces = ["<|endoftext|>", "<|endof", "'s", "'LL", " ", "  ", "\n", "\t \n", "\x1c", "\x85", "\xa0", " ", "ß", "Ünï", "ﬁ", "é", "日本", "ا", "१२", "²", "½", "😀", "x" * 700, "…", "don't", "1234", "!!", "‍", "\x00", "İ"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        special, found = counter.frequencies(text)
        n = special + sum(counter.pieces(w) * k for w, k in found.items())
        assert n == len(library.encode(text, add_special_tokens=False).ids), text


def test_long_texts_are_cut_in_parts(monkeypatch):
    counter, library = tokencount.PieceCounter(BYTE), load(BYTE)
    for text in ("word  two \n three's é " * 500, "日本 語 and  more\t" * 400, "x" * 5000, " " * 3000 + "a b" * 10):
        monkeypatch.setattr(tokencount, "_PART", 97)
        special, found = counter.frequencies(text)
        assert special + sum(counter.pieces(w) * k for w, k in found.items()) == len(library.encode(text, add_special_tokens=False).ids)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) of usable vectors, plain Python throughout."""
    length = -(-max(len(v) for _, v, _ in rows) // parts)
    full = [(i, [math.floor(4096 * x) for x in v] + [0] * (parts * length - len(v)), label) for i, v, label in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))[:entries]
    books = []
    for p in range(parts):
        cut = lambda v: (v + [0] * (parts * length - len(v)))[p * length : (p + 1) * length]
        books.append([cut([math.floor(4096 * x) for x in v]) for _, v, _ in first])

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in full:
                x = v[p * length : (p + 1) * length]
                held[nearest(books[p], x)[1]].append(x)
            for i, some in held.items():
                books[p][i] = [sum(c) // len(some) for c in zip(*some)]
    out, by_label = [], Counter()
    for i, v, label in full:
        found = [nearest(books[p], v[p * length : (p + 1) * length]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    return sorted(((i is None, i or 0, code, min(e, top), min(by_label[label], top), digest) for i, code, e, label in out))


def codes_of(df):
    return sorted(((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()))


@pytest.mark.parametrize("dims,n,scale", [(64, 90, 0.3), (8, 40, 3.0), (13, 25, 0.01), (16, 5, 1.0), (16, 30, 1e6), (16, 20, 1e30)])
def test_codes_equal_brute_force(spark, dims, n, scale):
    rng = random.Random(dims)
    rows = [(i * 3, [rng.gauss(0, scale) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(7, rows[0][1], 1), (7, rows[0][1], 1), (None, rows[1][1], None), (1, rows[2][1][: dims // 2], 2)]
    bad = [(2, None, 1), (4, [float("nan")] * dims, 1), (5, [None] * dims, 1), (8, [float("inf")] + [0.0] * (dims - 1), 2)]
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    assert codes_of(vectorcode.compressed(df)) == brute_codes(rows)


def test_codes_of_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectorcode.compressed(spark.createDataFrame([], schema)).collect() == []
    assert vectorcode.compressed(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    got = vectorcode.compressed(spark.createDataFrame([(1, [], 1), (2, [], None)], schema)).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in got} == {(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)}
    unlabelled = vectorcode.compressed(spark.createDataFrame([(1, [1.0]), (2, [3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(unlabelled) == 2


def test_the_tree_rules_out_entries_and_keeps_ties():
    rng = np.random.default_rng(3)
    centres = rng.integers(-9000, 9000, (4, 8))
    entries = np.repeat(centres, 4, axis=0) + rng.integers(-60, 60, (16, 8))
    x = entries[rng.integers(0, 16, 5000)] + rng.integers(-40, 40, (5000, 8))
    tree = vectorcode.Gnat(entries)
    index, square = tree.nearest(x)
    every = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()
    assert tree.worked < 0.7 * tree.plain
    grid = rng.integers(-2, 3, (16, 2))  # many ties and equal entries
    points = rng.integers(-4, 5, (2000, 2))
    index, square = vectorcode.Gnat(grid).nearest(points)
    every = ((points[:, None] - grid) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()


def test_codes_stand_for_vectors(spark):
    rows = [(i, [float(i % 4), -1.0] * 8, 0) for i in range(16)]
    kept = vectorcode.usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    books = vectorcode.train_codebooks(kept)
    back = vectorcode.reconstruct(vectorcode.encode_vectors(kept, books), books).collect()
    assert {r.vec_id: r.embedding for r in back} == {i: v for i, v, _ in rows}


def brute_divergence(rows, least=10):
    """rows: (text, lang, source)."""
    groups, times, in_docs = set(), defaultdict(Counter), defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(lower) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        times[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda n, total: 1 + 1_000_000_000 * (n + 2) // (total + 2 * len(kept))
        p = {s: {t: share(times[lang, s][t], sum(times[lang, s][u] for u in kept)) for t in kept} for s in sources}
        every = {t: sum(times[lang, s][t] for s in sources) for t in kept}
        q = {t: share(every[t], sum(every.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if times[lang, s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, part, x.decode(), -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, x) in enumerate(found)]
    return sorted(out)


def diverged(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_brute_force(docs):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert diverged(divergence.source_divergence(docs)) == brute_divergence(rows)
    assert diverged(divergence.source_divergence(docs, held_terms=500, tree_items=200)) == brute_divergence(rows)


def test_divergence_of_odd_rows(spark, odd_docs, empty_docs):
    assert divergence.source_divergence(empty_docs).collect() == []
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert diverged(divergence.source_divergence(odd_docs, least=2)) == brute_divergence(rows, 2)
    assert diverged(divergence.source_divergence(odd_docs, least=99)) == brute_divergence(rows, 99)
    made = [("Ä ä É naïve Naïve  x\x00y 1a2", "fr", f"s{i % 3}") for i in range(12)] + [(None, "fr", "none"), ("", None, None), ("only here", "xx", "one")]
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(made)], "doc_id long, text string, lang string, source string, n int")
    assert diverged(divergence.source_divergence(df)) == brute_divergence(made)


def test_trees_share_beginnings():
    rng = random.Random(1)
    paths = sorted(tuple(sorted({s: rng.randrange(3) for s in rng.sample(range(6), rng.randrange(1, 6))}.items())) for _ in range(300))
    counted_paths = sorted(Counter(paths).items())
    offsets = np.cumsum([0, *(len(p) for p, _ in counted_paths)])
    flat = [x for p, _ in counted_paths for x in p]
    sources, shares = (np.array([x[i] for x in flat], np.int64) for i in (0, 1))
    tree = divergence.PatternTree(offsets, sources, shares * 100 + 7, np.full(len(flat), 5), np.array([n for _, n in counted_paths]))
    nodes = sum(len(rows) for _, rows, _ in tree.levels())
    assert nodes == len({p[: i + 1] for p, _ in counted_paths for i in range(len(p))}) < len(flat)
    got = Counter()
    for a, b, v in tree.corrections(block=64):
        for x in zip(a.tolist(), b.tolist(), v.tolist()):
            got[x[:2]] += x[2]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for p in paths:
        for j, (sb, pb) in enumerate(p):
            for sa, pa in p[:j]:
                x, y = pa * 100 + 7, pb * 100 + 7
                want[sa, sb] += f(x, y) - f(x, 5) - f(5, y)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
