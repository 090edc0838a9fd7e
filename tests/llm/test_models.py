"""Language and toxicity: held-out accuracy, odd rows, empty tables."""

import random
import zlib

from quillmesh.llm import langid, toxicity


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.predict_language(docs).collect()
    assert len(got) == len(want) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    mine = [r for r in got if r.held_out]
    right = sum(r.lang_pred == want[r.doc_id] for r in mine) / len(mine)
    assert right >= 0.95, right
    assert langid.keep_known_languages(docs).count() >= 0.98 * len(want)


def test_language_of_odd_rows(odd_docs, empty_docs):
    got = {r.doc_id: r for r in langid.predict_language(odd_docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (3, 4, 5, 6))
    assert got[1].lang_pred == "en" and got[1].score == 1  # one language learned
    assert langid.predict_language(empty_docs).count() == 0
    kept = langid.keep_known_languages(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 6})


def test_nothing_learned_is_unknown(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.predict_language(rows).collect()[0].lang_pred == "und"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    mine = [(r.predicted, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    found = sum(p for p, y in mine if y) / max(1, sum(y for _, y in mine))
    wrong = sum(p for p, y in mine if not y) / max(1, sum(1 - y for _, y in mine))
    # some toxic marks of this table are on documents without an offending word
    assert found >= 0.9 and wrong <= 0.02, (found, wrong)


def test_toxic_sentences_are_located():
    model = toxicity.BagModel({"idiot": 9.0}, -6.0)
    text = "A fine day. You are an idiot! Good night."
    score, found = model.score(text)
    assert score > 0.9 and [text[x["start"] : x["end"]] for x in found] == [" You are an idiot"]
    assert model.score(None) == (0.0, []) and model.score("") == (0.0, [])


def test_long_clean_text_is_not_toxic_by_length():
    model = toxicity.BagModel({"idiot": 9.0}, -6.88)
    assert model.score("A fine day. " * 25_000) == (0.0, [])
    score, found = model.score("A fine day. " * 25_000 + "You idiot.")
    assert score > 0.8 and len(found) == 1


def test_long_clean_document_is_kept(spark):
    rows = [(i, f"A fine day in town {i % 7}. We walk home.\nThe sea is calm." + (" You idiot!" if i % 6 == 0 else "")) for i in range(240)]
    rows += [(1000, "The town is calm. We walk. " * 15_000), (1001, "The town is calm. We walk. " * 15_000 + "You idiot!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int")
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).select("doc_id").collect()}
    assert kept == {i for i in range(240) if i % 6} | {1000}


def test_rare_offence_counts_at_every_size(spark):
    """A word in 0.7% of the toxic documents, and in no clean one, is learned."""
    rows = [(i, "A fine day in town. " + ("" if i % 2 else "You wretch! " if i % 300 == 0 else "You idiot! ") + f"The sea is calm {'abcdefghij'[i % 10] * 6}.") for i in range(6000)]
    docs = spark.createDataFrame([*rows, (9001, "Go home, wretch."), (9002, "Go home, friend.")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(6000)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).filter("doc_id > 9000").collect()}
    assert got == {9001: 1, 9002: 0}


def test_toxicity_of_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(i, i % 2, None if i == 4 else int(i in (1, 11))) for i in (1, 2, 3, 4, 5, 6, 11, 12, 12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r.score == 0 for r in got if r.doc_id in (3, 4))
    assert toxicity.score_toxicity(empty_docs, labels).count() == 0
    none = toxicity.score_toxicity(odd_docs, labels.filter("toxic = 0")).collect()
    assert all(r.predicted == 0 and 0 <= r.score < 0.01 for r in none)
    assert toxicity.keep_clean(odd_docs, labels).columns == odd_docs.columns


def test_language_equals_brute_force(spark, docs):
    """Dictionaries put together row by row, and every text packed piece by piece with each of them."""
    import zstandard

    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(10**6 + i, f"{'lorem ipsum ' * 2000}{i}", "la") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    order = {r.doc_id: r.h for r in table.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    texts = {}
    for i, text, lang in sorted((r for r in rows if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: (max(4096, len(r[1])), order[r[0]])):
        mine = texts.setdefault(lang, [])
        if len(mine) < 64 and (not mine or sum(len(t) for _, t in mine) + len(text) <= 131_072):
            mine.append((i, text))
    packers = {}
    for lang, mine in texts.items():
        raw = zstandard.ZstdCompressionDict("\n".join(t for _, t in sorted(mine)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[lang] = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
    assert set(packers) >= {"la"}
    for r in langid.predict_language(table).collect():
        text = (dict((i, t) for i, t, _ in rows)[r.doc_id] or "").encode()
        if not any(c.isalpha() for c in text.decode()):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        sizes = sorted((sum(len(p.compress(text[at : at + 8192])) for at in range(0, len(text), 8192)), lang) for lang, p in packers.items())
        assert r.lang_pred == sizes[0][1] and abs(r.score - (1 - sizes[0][0] / sizes[1][0])) < 1e-12


def test_fit_follows_the_likelihood():
    """Noisy-or by hand: its value at the fitted weights is below that at the start, and flat around them."""
    import math
    import random
    from types import SimpleNamespace

    import numpy as np

    random.seed(8)
    bags = []
    for i in range(400):
        toxic = i % 4 == 0
        hits = [[0] for _ in range(toxic and random.random() < 0.9)] + [[1, 2] for _ in range(random.random() < (0.5 if toxic else 0.05))] + [[2] for _ in range(random.randint(0, 2))]
        bags.append(SimpleNamespace(toxic=int(toxic), hits=hits))
    share = {1: 400 / (2 * 100), 0: 400 / (2 * 300)}

    def loss(theta):
        *w, bias, leak = theta
        total = 0.0
        for b in bags:
            calm = 1 / (1 + math.exp(leak))
            for hits in b.hits:
                calm *= min(1.0, (1 + math.exp(bias)) / (1 + math.exp(bias + sum(w[f] for f in hits))))
            total -= share[b.toxic] * math.log(max(1e-12, 1 - calm if b.toxic else calm)) / len(bags)
        return total + 1e-5 / 2 * sum(x * x for x in w)

    start = np.array([2.0, 2.0, 2.0])
    weights, bias = toxicity._fit(bags, start, 1500)
    best = min(np.linspace(-8, 0, 81), key=lambda leak: loss([*weights, bias, leak]))
    at = [*weights, bias, best]
    assert loss(at) < loss([*start, -7.0, -3.0]) - 0.05
    for i in range(3):
        for step in (-0.3, 0.3):
            moved = list(at)
            moved[i] += step
            assert loss(moved) > loss(at) - 2e-3, (i, step)
    assert weights[0] + bias > 0 > weights[2] + bias


def test_sample_of_labels_is_bounded_and_spread(spark):
    rows = [(i, "You idiot! Bad day." if i % 2 else f"A fine day {i % 9}.") for i in range(4000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, docs_per_label=300)
    assert model.score("You idiot!")[0] > 0.5 > model.score("A fine day.")[0]


def test_choice_of_features_equals_brute_force(spark, docs):
    import math
    import re
    import zlib

    toxic_words = ["vilething", "nastyword"]
    rng = random.Random(9)
    clean = sorted({w for r in docs.limit(40).collect() for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())})[:300]
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [rng.choice(clean) for _ in range(40)] + ([rng.choice(toxic_words)] if bad and i % 3 else [])
        rows.append((i, " ".join(words).capitalize() + "."))
        marks.append((i, int(bad)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    known = [(set(re.findall(r"[^\W\d_]+", t.lower())), y) for (i, t), (_, y) in zip(rows, marks) if zlib.crc32(str(i).encode()) % 5]
    held = {}
    for words, y in known:
        for f in {f for w in words for f in toxicity.features(w)}:
            held.setdefault(f, [0, 0])[y] += 1
    n = [sum(1 - y for _, y in known), sum(y for _, y in known)]
    share, held = n[1] / sum(n), {f: c for f, c in held.items() if sum(c) >= 2}
    by_size = {}
    for c in held.values():
        by_size[sum(c)] = by_size.get(sum(c), 0) + 1
    least, evidence = math.log(toxicity._tests(by_size, share)), {}
    for f, (c, t) in held.items():
        odds = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        e = sum(x * math.log(x / ((c + t) * p)) for x, p in ((t, share), (c, 1 - share)) if x)
        if odds >= 2.5 and e >= least:
            evidence[f] = e
    model = toxicity.train(table, labels, steps=5)
    assert set(model.weights) == set(evidence) and {"vilething", "nastyword"} <= set(evidence)
    best = sorted(evidence, key=lambda f: (-round(evidence[f], 9), f))[:3]
    assert set(toxicity.train(table, labels, steps=5, most_features=3).weights) == set(best)
