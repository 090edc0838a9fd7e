"""Token files, BPE and packing against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillmesh.llm import bpe, packing, tokenfile
from quillmesh.llm.chunks import RankEncoder, WordEncoder, load
from quillmesh.llm.common import word_hashes

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts(*tables):
    return [(r.doc_id, r.text or "") for t in tables for r in t.select("doc_id", "text").collect()]


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_fast_encoders_equal_the_library(docs, odd_docs):
    for encoder, path in ((WordEncoder(WORD, most_words=500), WORD), (RankEncoder(BYTE), BYTE)):
        library = load(path)
        for _, text in texts(docs, odd_docs):
            got = np.frombuffer(encoder.encode(text.encode()), encoder.type).tolist()
            assert got == library.encode(text, add_special_tokens=False).ids, text[:200]


def test_every_latin_letter_equals_the_library():
    encoder, library = WordEncoder(WORD), load(WORD)
    for text in ["".join(map(chr, range(0x20, 0x7F))), "".join(map(chr, range(0xA1, 0x100))), *(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s" for c in range(1, 0x180))]:
        assert np.frombuffer(encoder.encode(text.encode()), encoder.type).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_hashes_follow_the_words():
    rows = [b"One two\ttwo  ONE", b"", b" \n ", b"x" * 40, b"a " * 1_500_000 + b"one", b"y" * 3_000_000 + b" two", "\u00e9t\u00e9 \u00c9T\u00c9".encode()]
    flat, counts = zip(*word_hashes(rows))
    flat, counts = np.concatenate(flat), np.concatenate(counts)
    words = [w for t in rows for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in rows] and len(flat) == len(words)
    by_word = {}
    for w, h in zip(words, flat.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_bpe_equals_library(docs, odd_docs):
    model, library = bpe.ForcedBoundaryBpe(WORD, most_kept=2000), load(WORD)
    for _, text in texts(docs, odd_docs):
        ids, decoded = model.encode(text.encode())
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == u32(want), text[:200]
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_forced_cuts_are_certain():
    model = bpe.ForcedBoundaryBpe(WORD)
    cuts = model.cut("zqxjk")
    assert "".join(cuts) == "zqxjk" and len(cuts) > 1
    assert all(a[-1] + b[0] not in token for a, b in zip(cuts, cuts[1:]) for token in model.ids)


def test_bpe_query(docs, odd_docs, empty_docs):
    library = load(WORD)
    for table in (docs, odd_docs):
        want = sorted((i or -1, len(ids), hashlib.sha256(u32(ids)).hexdigest()) for i, t in texts(table) for ids in [library.encode(t, add_special_tokens=False).ids])
        got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256) for r in bpe.encode_digests(table, WORD).collect())
        assert got == want
    assert bpe.encode_digests(empty_docs, WORD).count() == 0
    row = bpe.encode_column(odd_docs.filter("doc_id = 11"), WORD).collect()[0]
    assert row.ids == library.encode("one two").ids and row.decoded == "one</w> two</w>"


def test_token_files(docs, odd_docs, empty_docs):
    library = load(WORD)
    for table in (docs, odd_docs):
        rows = sorted(texts(table), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        start, want = 0, []
        for doc_id, text in rows:
            ids = library.encode(text, add_special_tokens=False).ids + [2]
            want.append((start, doc_id, len(ids), zlib.crc32(u32(ids))))
            start += len(ids)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_table(table, WORD).collect())
        assert got == want
    assert tokenfile.token_table(empty_docs, WORD).count() == 0


def test_token_file_random_access_and_checksums(tmp_path):
    path = f"file://{tmp_path}/x.zst"
    out = tokenfile.TokenFileWriter(path, "0")
    sets = [np.arange(n, dtype="<u2") for n in (5, 0, 40_000, 3)]
    for i, ids in enumerate(sets):
        out.add(i * 10, ids)
    out.close()
    file = tokenfile.TokenFile(path, 2)
    assert [file.doc_id(i) for i in range(4)] == [0, 10, 20, 30] and file.places(20) == [2]
    assert all((file.tokens(i) == ids).all() for i, ids in enumerate(sets))
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader((tmp_path / "x.zst").read_bytes(), read_across_frames=True).read()
    assert plain == b"".join(x.tobytes() for x in sets)  # any zstandard reader takes the file
    data = bytearray((tmp_path / "x.zst").read_bytes())
    data[int(file.starts[2]) + 20] ^= 1
    (tmp_path / "x.zst").write_bytes(data)
    with pytest.raises(Exception):
        tokenfile.TokenFile(path, 2).tokens(2)
    assert (tokenfile.TokenFile(path, 2).tokens(3) == sets[3]).all()


def test_packing_is_exact(docs, odd_docs, empty_docs):
    library = load(BYTE)
    for table, once in ((docs, True), (odd_docs.filter("doc_id not in (2)"), True), (odd_docs, False)):
        pieces = packing.pack_documents(table, BYTE, shard_docs=50).collect()
        by_sequence, by_doc = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_sequence[p.sequence_id].append((p.offset, p.length))
            by_doc[p.doc_id].append(p)
        padding = 0
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at and length > 0
                at += length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding == 0
        ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts(table) if i is not None}
        if once:
            for i, want in ids.items():
                at = 0
                for p in sorted(by_doc[i], key=lambda p: p.start):
                    assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
                    at += p.length
                assert at == len(want)
        else:
            assert sum(p.length for p in by_doc[2]) == 2 * len(ids[2])
    assert packing.pack_documents(empty_docs, BYTE).count() == 0


def test_shard_returns_lexical_neighbours():
    counts = np.full(1 << 18, 3)
    words = [np.array(x) for x in ([1, 2, 3, 4], [1, 2, 3, 9], [50, 51], [1, 60, 61])]
    shard = packing.Shard(words, (counts, 1000, 4000))
    assert shard.neighbours(0) == [1, 3] and shard.neighbours(2) == []


def test_long_words_and_many_specials_equal_the_library():
    library, model = load(WORD), bpe.ForcedBoundaryBpe(WORD)
    special = next(iter(library.get_added_tokens_decoder().values())).content
    for text in ["a" * 20_000, "abcabd" * 3_000, "é" * 2_000 + "x" * 5_000, special * 3_000, f"one{special}two {special}{special} <|start {special[:-1]}", "hello" * 2_000 + " end"]:
        want = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text.encode())[0] == u32(want), text[:40]


def test_long_merges_equal_short_ones():
    import random

    random.seed(2)
    model = bpe.ForcedBoundaryBpe(WORD)
    for _ in range(40):
        word = "".join(random.choice("etaoinshr") for _ in range(random.randint(2, 200)))
        assert bpe.merge_long([model.ids[x] for x in word], model.ranks, model.made) == model.merge(word, False), word


def test_long_white_space_equals_the_library(spark):
    encoder, library = RankEncoder(BYTE), load(BYTE)
    for run in (" " * 25_000, "\n" * 21_000, " \t\u2003" * 9_000, "\xa0" * 20_000):
        for text in (run, f"a{run}", f"{run}b", f"a b {run}c  d{run}{run}!", f"{run}\x1c{run}\n"):
            assert encoder.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, text[:3]
    # beyond what the splitters take at once: whole, in order, and the same as its parts
    text = "one " + " " * 1_000_000 + "two"
    ids = encoder.encode(text.encode()).tolist()
    assert library.decode(ids) == text
    pieces = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE).collect()
    assert sum(p.length for p in pieces) == len(ids) + 1


def test_long_words_and_runs_just_below_the_limit_take_their_length(docs):
    import random
    import time

    rng, encoder, library = random.Random(4), RankEncoder(BYTE), load(BYTE)
    text = ("x" + " " * 19_999) * 40 + "y" + " " * 20_001 + "z" + "\t\n" * 30
    began = time.time()
    got = encoder.encode(text.encode()).tolist()
    assert time.time() - began < 5
    assert got == library.encode(text, add_special_tokens=False).ids
    words = WordEncoder(WORD, most_words=50)
    model = bpe.ForcedBoundaryBpe(WORD, most_kept=50)
    many = " ".join("".join(rng.choice("abcxyz019+/") for _ in range(rng.randrange(30, 300))) for _ in range(300))
    ids = library_ids = load(WORD).encode(many, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(many.encode()), words.type).tolist() == ids
    assert np.frombuffer(model.encode(many.encode())[0], "<u4").tolist() == library_ids
    assert all(len(w) <= 48 for w in words.known) and all(len(w) <= 48 for w in model.words) and len(model.fragments) <= 50


def naive_weights(words, statistics):
    """BM25 by dictionaries."""
    counts, docs, total = statistics
    out = []
    for w in words:
        tf = defaultdict(int)
        for s in w.tolist():
            tf[s] += 1
        out.append({s: np.log1p(max(0.0, docs - max(1, counts[s]) + 0.5) / (max(1, counts[s]) + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) * docs / total)) for s, n in tf.items()})
    return out


def naive_order(sizes, neighbours, window):
    """The greedy filling, written out: documents in the order in which they are packed."""
    order, used, room = [], set(), window

    def put(i):
        nonlocal room
        used.add(i)
        order.append(i)
        over, room = sizes[i] > room, window - (window - room + sizes[i]) % window
        return over

    for first in range(len(sizes)):
        seed = None if first in used else first
        if seed is not None:
            put(seed)
        while seed is not None and room < window:
            here, seed = seed, None
            for near in neighbours(here):
                if near not in used:
                    over = put(near)
                    if room == window:
                        break
                    if over:
                        seed = near
                        break
    return order


def test_neighbours_and_filling_equal_a_naive_packer():
    import random

    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(120)]
    texts_ = [" ".join(rng.choice(vocabulary[topic * 20 : topic * 20 + 45]) for _ in range(rng.randrange(3, 60))).encode() for topic in [rng.randrange(4) for _ in range(70)]]
    words = list(packing.term_slots(texts_))
    counts, seen = np.zeros(packing._SLOTS, np.int64), np.zeros(packing._SLOTS, np.int64)
    for w in words:
        counts[packing.distinct(w, seen)] += 1
    statistics = (counts, len(words), sum(map(len, words)))
    weights, index = naive_weights(words, statistics), packing.Shard(words, statistics)
    asked = [set(x.tolist()) for x in index.terms]
    for mine, w in zip(asked, weights):
        assert len(mine) == min(12, len(w)) and all(w[a] >= w[b] - 1e-12 for a in mine for b in set(w) - mine)

    def neighbours(seed):
        scores = {i: sum(w.get(s, 0.0) for s in asked[seed]) for i, w in enumerate(weights) if i != seed}
        return sorted((i for i, x in scores.items() if x), key=lambda i: (-round(scores[i], 10), i))

    for seed in range(70):
        got, want = index.neighbours(seed), neighbours(seed)
        scores = {i: round(sum(weights[i].get(s, 0.0) for s in asked[seed]), 8) for i in want}
        assert set(got) == set(want) and [scores[i] for i in got] == [scores[i] for i in want]
    ids = [(i, np.arange(len(w) * 2 + 1, dtype=np.uint16)) for i, w in enumerate(words)]
    packer = packing.Packer(0, 128)
    packing._fill(packer, ids, words, statistics)
    packer.finish()
    assert [p[0] for p in packer.pieces if p[1] == 0] == naive_order([len(x) for _, x in ids], index.neighbours, 128)


def test_known_runs_between_white_space_are_not_cut_again(monkeypatch):
    encoder = WordEncoder(WORD, most_words=60)
    rng, parts = random.Random(4), ["it's", "''t", "'test", "We'll", "x1²y", "½", "Ünï", "ß", "\t", "\n", "\r", "a" * 60, "!?'s", "9", "ª«", "don't,", "  ", "-", "'LL", "\xad"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    for text in texts:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), encoder.type).tolist() == want and len(encoder.known) <= 60
    text = b"Well, it's (almost) done: 12 runs, don't you think?"
    ids, cut, plain = encoder.encode(text), [], encoder.splitter.plain
    monkeypatch.setattr(encoder.splitter, "plain", lambda run: cut.append(run) or plain(run))
    assert encoder.encode(text) == ids and not cut
