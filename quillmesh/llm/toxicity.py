"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only its label is known. With z = bias + the weights of
the features in it, a sentence is calm with (1 + e^bias) / (1 + e^z), 1 at most: what it adds over
a sentence without features, which adds nothing however many there are. The document's score is
the noisy-or of its sentences, 1 - product(calm). Weights are fitted by gradient steps on the
likelihood of the documents' labels, with one chance for each document, not each sentence, that it
is toxic for no feature's sake; the sentences that carry the score are then located.

Features are words and word beginnings. Which of them count is decided on all labelled
documents, by odds and significance whatever the table's size; the weights are fitted on a bounded
sample of them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_batches
from .langid import held_out

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6, 7)
_FEW_LABELS = 500_000  # labels that may be broadcast: 6 MB


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in _BEGINNINGS if len(word) > n)]


def _flush(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"feature": pa.array(list(counts), pa.string()), "toxic": pa.array([x[1] for x in counts.values()], pa.int64()), "clean": pa.array([x[0] for x in counts.values()], pa.int64())})


def _count(batches):
    """Documents of each label that hold a feature, summed in this part as far as memory is set aside for it."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for f in {f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}:
                counts.setdefault(f, [0, 0])[label] += 1
            if len(counts) > 200_000:
                yield _flush(counts)
                counts = {}
    yield _flush(counts)


class BagModel:
    """Weights of features and the bias of a sentence; a bounded table of words and the features in them."""

    def __init__(self, weights: dict[str, float], bias: float, most_words: int = 200_000):
        self.weights, self.bias, self.most = weights, bias, most_words
        self.known: dict[str, list[str]] = {}

    def hits(self, words: set[str]) -> list[str]:
        """The weighted features of some words."""
        if len(self.known) > self.most:
            self.known.clear()
        out: list[str] = []
        for w in words:
            if (found := self.known.get(w)) is None:
                found = self.known[w] = [f for f in features(w) if f in self.weights]
            out += found
        return out

    def sentences(self, text: str) -> list[tuple[int, int, list[str]]]:
        """(start, end, features) of the sentences with a weighted feature."""
        if not self.hits(set(_WORD.findall(text.lower()))):
            return []
        return [(m.start(), m.end(), found) for m in _SENTENCE.finditer(text) if (found := self.hits(set(_WORD.findall(m[0].lower()))))]

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's score and its offending sentences, each with start, end and score."""
        calm, found, base = 0.0, [], np.logaddexp(0.0, self.bias)
        for start, end, hits in self.sentences(text or ""):
            z = self.bias + sum(self.weights[f] for f in hits)
            adds = max(0.0, np.logaddexp(0.0, z) - base)
            calm -= adds
            if (own := float(-np.expm1(-adds))) >= 0.5:
                found.append({"start": start, "end": end, "score": own})
        return max(0.0, float(-np.expm1(calm))), found


def _bags(names: list[str]):
    """(label, features of each sentence that has any) of each document."""

    def bags(batches):
        at = {f: i for i, f in enumerate(names)}
        model = BagModel(dict.fromkeys(names, 0.0), 0.0)
        for batch in batches:
            hits = [[[at[f] for f in x] for _, _, x in model.sentences(text or "")] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "hits": pa.array(hits, pa.list_(pa.list_(pa.int32())))})

    return bags


def _fit(bags: list, start: np.ndarray, steps: int, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that raise the likelihood of the bags' labels under noisy-or; Adam steps.

    A bag is calm with the product of its sentences' chances and of one leak, the same for every bag.
    The leak takes labels that no feature explains; it is fitted here and left out of the scores.
    """
    label = np.array([b.toxic for b in bags], float)
    bag = np.array([i for i, b in enumerate(bags) for _ in b.hits], np.int64)
    pairs = [(i, f) for i, x in enumerate(x for b in bags for x in b.hits) for f in x]
    row, col = np.array(pairs, np.int64).reshape(-1, 2).T
    theta = np.concatenate([start, [-7.0, -3.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = np.where(label == 1, len(label) / max(1.0, 2 * label.sum()), len(label) / max(1.0, 2 * (1 - label).sum()))
    for step in range(1, steps + 1):
        bias, leak = theta[-2:]
        z = bias + np.bincount(row, theta[col], len(bag))
        adds = z > bias
        calm = -np.bincount(bag, np.where(adds, np.logaddexp(0, z) - np.logaddexp(0, bias), 0.0), len(label)) - np.logaddexp(0, leak)
        calm = np.minimum(calm, -1e-12)
        # d(-log likelihood) / d(calm): 1 for toxic bags exp(calm) / (1 - exp(calm)), for clean ones -1
        slope = share * np.where(label == 1, np.exp(calm) / -np.expm1(calm), -1.0) / len(label)
        sig, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        up = -slope[bag] * adds
        per = up * sig
        grad = np.concatenate([np.bincount(col, per[row], len(start)), [(per - up * base).sum(), -slope.sum() / (1 + np.exp(-leak))]])
        grad[:-2] += decay * theta[:-2]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-2], float(theta[-2])


def _tests(held_by: dict[int, int], share: float) -> int:
    """How many features are tested: those in so many documents that they could pass (Tarone).

    ``held_by``: features by the number of documents that hold them. A feature of n documents, all
    toxic, has that by chance with share^n; it is no test if even this would not pass.
    """
    left = sum(held_by.values())
    for n in sorted(held_by):
        if left * share**n <= 1:
            break
        left -= held_by[n]
    return max(1, left)


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = 8000, steps: int = 400, most_features: int = 100_000) -> BagModel:
    """Fit on labelled rows that crc32 mod 5 does not hold out.

    Features: all that are far more often in toxic than in clean documents (odds of e^2.5), and so
    significantly that not one is expected to be chosen by chance; counted over all labelled rows. The model
    goes to the driver and to every worker, so it has ``most_features`` at most, those with the most evidence.
    Weights: from about ``docs_per_label`` documents of each label, by hashed doc_id, all if there are
    fewer; a feature outside of that sample keeps its odds. Repeated labels of a doc_id: the highest counts. Without toxic or
    without clean examples every score is 0.
    """
    spark = docs.sparkSession
    text_batches(spark)
    marks = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~held_out(5, 0) & F.col("text").isNotNull())
    # few labels go to the documents; of many, the labelled texts are gathered once and written
    scratch = Scratch(spark, "toxicity")
    marks = scratch.cut(marks, "marks")
    few = marks.count() <= _FEW_LABELS
    known = rows.join(marks.hint("broadcast" if few else "merge"), "doc_id")
    if not few:
        known = scratch.cut(known, "known")
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return BagModel({}, -40.0)
    counts = known.select("text", "toxic").mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (total[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (total[0] + 1.0))
    counts = scratch.cut(counts.withColumn("held", F.col("toxic") + F.col("clean")).filter("held >= 2"), "counts")
    share = total[1] / (total[0] + total[1])
    held_by = {r.held: r.n for r in counts.groupBy(F.least("held", F.lit(1000)).alias("held")).agg(F.count("*").alias("n")).collect()}
    # exp(-evidence) bounds the chance of so many toxic documents among those that hold the feature
    part = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col("held") * p))).otherwise(0.0)
    evidence = part("toxic", share) + part("clean", 1 - share)
    chosen = counts.withColumn("odds", odds).filter("odds >= 2.5").withColumn("evidence", evidence).filter(F.col("evidence") >= float(np.log(_tests(held_by, share)))).orderBy(F.desc("evidence"), "feature").limit(most_features).select("feature", "odds").collect()
    chosen.sort(key=lambda r: r.feature)
    names = [r.feature for r in chosen]
    if not names:
        return BagModel({}, -40.0)
    # a share of each label by hashed doc_id, so that no task has to see all documents of a label
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(draw < F.when(F.col("toxic") == 1, docs_per_label / total[1]).otherwise(docs_per_label / total[0])).select("toxic", "text")
    bags = sample.mapInArrow(_bags(names), "toxic int, hits array<array<int>>").collect()
    weights, bias = _fit(bags, np.array([min(6.0, r.odds) for r in chosen]), steps)
    return BagModel({f: float(w) for f, w in zip(names, weights)}, bias)


def _scoring(model: BagModel, keep_only: bool):
    def score(batches):
        for batch in batches:
            found = [model.score(x) for x in batch.column("text").to_pylist()]
            scores = np.array([min(1.0, max(0.0, s)) for s, _ in found])
            if keep_only:
                yield batch.filter(pa.array(scores < 0.5))
            else:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                own = {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "sentences": pa.array([x for _, x in found], kind)}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *own.values()], names=["doc_id", "held_out", *own])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences for every whole text.

    ``sentences``: start, end (characters) and score of each sentence that is toxic by itself.
    A null or empty text has no sentences and scores 0. Each row gets a result, repeated or
    not. An empty table gives no rows. Other columns are ignored.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(_scoring(model, False), "doc_id long, held_out boolean, score double, predicted int, sentences array<struct<start:long,end:long,score:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, repeated rows included.

    Null and empty texts stay. An empty table gives no rows.
    """
    return docs.mapInArrow(_scoring(train(docs, labels), True), docs.schema)
