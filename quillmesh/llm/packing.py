"""Lexical retrieval packing.

Documents that share words are brought together: each is dealt by the smallest hashes among its
words, in order, into shards of bounded size. A shard is a BM25 inverted index
of its documents. A window starts with a seed document and is filled greedily with the seed's
best unused neighbours; the last one is cut where the window ends, and its rest starts the next
window. So every window is full; only what is left at the end of a partition is not, and it
is dealt out in windows whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import RankEncoder
from .common import Scratch, column_bytes, sliced, text_batches, word_hashes

_SLOTS = 1 << 18
_K1, _B = 1.2, 0.75
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def term_slots(texts: list[bytes]):
    """For each text the term slots of its words."""
    for hashes, counts in word_hashes(texts):
        yield from np.split((hashes & np.uint64(_SLOTS - 1)).astype(np.int64), np.cumsum(counts)[:-1])


def distinct(slots: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The distinct slots of a text; ``seen`` is room for one number for each slot."""
    at = np.arange(len(slots))
    seen[slots] = at
    return slots[seen[slots] == at]


def _dealing(batches):
    """Documents with their place in the order, and, in rows of kind 1, documents by term slot.

    The order is by the three smallest hashes among a document's words: texts with the same words
    come to stand side by side. At slot -1 the documents are counted, at -2 their words.
    """
    counts, docs, words, seen = np.zeros(_SLOTS, np.int64), 0, 0, np.zeros(_SLOTS, np.int64)
    order = np.random.default_rng(7).permutation(_SLOTS)
    for batch in sliced(batches, 4096):
        keys = []
        for slots in term_slots(column_bytes(batch.column("text"))):
            some = distinct(slots, seen)
            counts[some] += 1
            docs, words = docs + 1, words + len(slots)
            least = order[some]
            least = np.sort(np.partition(least, 2)[:3] if len(least) > 3 else least)
            keys.append(sum(int(x) << 18 * (2 - i) for i, x in enumerate(least)) if len(least) else 1 << 60)
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(keys, pa.int64()), batch.column("doc_id"), batch.column("text")], names=["kind", "deal", "doc_id", "text"])
    some = np.flatnonzero(counts)
    slots, n = np.concatenate([some, [-1, -2]]), np.concatenate([counts[some], [docs, words]])
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(slots), np.int32)), pa.array(slots, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(slots), pa.string())], names=["kind", "deal", "doc_id", "text"])


class Shard:
    """A BM25 index of some documents, by corpus-wide statistics."""

    def __init__(self, words: list[np.ndarray], statistics, query_terms: int = 12):
        counts, docs, total = statistics
        mean = max(1.0, total / max(1, docs))
        self.n, self.terms = len(words), []
        lengths = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(self.n), lengths)
        key, tf = np.unique(owner * _SLOTS + np.concatenate([*words, np.zeros(0, np.int64)]), return_counts=True)
        owner, slot = key // _SLOTS, key % _SLOTS
        df = np.maximum(1, counts[slot])
        weight = np.log1p(np.maximum(0.0, docs - df + 0.5) / (df + 0.5)) * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * lengths[owner] / mean))
        for part in np.split(np.arange(len(key)), np.cumsum(np.bincount(owner, minlength=self.n))[:-1]) if self.n else []:
            top = part[np.argpartition(-weight[part], query_terms)[:query_terms]] if len(part) > query_terms else part
            self.terms.append(slot[top])
        order = np.argsort(slot, kind="stable")
        self.owners, self.weights = owner[order], weight[order]
        self.starts = np.searchsorted(slot[order], np.arange(_SLOTS + 1))

    def neighbours(self, seed: int) -> list[int]:
        """The other documents that share a query term with the seed, best first."""
        scores = np.zeros(self.n)
        for term in self.terms[seed]:
            a, b = self.starts[term], self.starts[term + 1]
            scores[self.owners[a:b]] += self.weights[a:b]
        scores[seed] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")].tolist()


class Packer:
    """Fills windows one after another and hands out pieces of documents."""

    def __init__(self, base: int, window: int):
        self.next, self.window = base, window
        self.pieces: list[tuple] = []
        self.held: list[tuple] = []  # pieces of the window being filled: doc_id, start, ids, doc_tokens
        self.room = window

    def _emit(self, parts: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in parts:
            self.pieces.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Put in a whole document; says whether the last window still has room."""
        at = 0
        while at < len(ids):
            take = min(self.room, len(ids) - at)
            self.held.append((doc_id, at, ids[at : at + take], len(ids)))
            at, self.room = at + take, self.room - take
            if not self.room:
                self._emit(self.held)
                self.held, self.room = [], self.window
        return bool(self.held)

    def finish(self) -> None:
        """Deal what is left out in windows whose lengths are powers of two."""
        left = self.window - self.room
        for bit in reversed(range(left.bit_length())):
            if not left >> bit & 1:
                continue
            need, parts = 1 << bit, []
            while need:
                doc_id, start, ids, total = self.held.pop(0)
                parts.append((doc_id, start, ids[:need], total))
                if len(ids) > need:
                    self.held.insert(0, (doc_id, start + need, ids[need:], total))
                need -= len(parts[-1][2])
            self._emit(parts)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.pieces)) or [[]] * 7
        self.pieces = []
        return pa.RecordBatch.from_pydict({n.split()[0]: pa.array(c, pa.int64()) for n, c in zip(_PIECE.split(", "), columns)})


def _fill(packer: Packer, ids: list[tuple], words: list[np.ndarray], statistics) -> None:
    """Pack the documents of one shard: a window's seed is the document that starts it, cut or whole."""
    index, used = Shard(words, statistics), np.zeros(len(ids), bool)
    for first in range(len(ids)):
        seed = None if used[first] else first
        if seed is not None:
            used[seed] = True
            if not packer.add(*ids[seed]):
                continue
        while seed is not None:
            next_seed = None
            for near in index.neighbours(seed):
                if not used[near]:
                    used[near] = True
                    if not packer.add(*ids[near]):
                        break
                    if near_full(packer):
                        next_seed = near
                        break
            seed = next_seed


def near_full(packer: Packer) -> bool:
    """A neighbour that went over the window's end starts the next window: it is its seed."""
    return len(packer.held) == 1 and packer.held[0][1] > 0


def _packing(statistics, tokenizer: str, end_id: int, window: int, shard_docs: int, shard_tokens: int):
    def pack(batches):
        encoder, known = RankEncoder(tokenizer), statistics.value
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        end, ids, words, tokens = np.array([end_id], encoder.type), [], [], 0
        for batch in sliced(batches):
            texts = column_bytes(batch.column("text"))
            for doc_id, text, slots in zip(batch.column("doc_id").to_pylist(), texts, term_slots(texts)):
                ids.append((doc_id, np.concatenate([encoder.encode(text), end])))
                words.append(slots)
                tokens += len(ids[-1][1])
                if len(ids) >= shard_docs or tokens >= shard_tokens:
                    _fill(packer, ids, words, known)
                    yield packer.take()
                    ids, words, tokens = [], [], 0
        _fill(packer, ids, words, known)
        packer.finish()
        yield packer.take()

    return pack


def corpus_statistics(counted: DataFrame) -> tuple[np.ndarray, int, int]:
    """(documents by term slot, documents, words) of all documents; a table of fixed size."""
    found = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most _SLOTS + 2 rows
    slot, n = found["slot"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    counts = np.zeros(_SLOTS, np.int64)
    counts[slot[slot >= 0]] = n[slot >= 0]
    return counts, int(n[slot == -1].sum()), int(n[slot == -2].sum())


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, shard_docs: int = 1024, shard_tokens: int = 1 << 21) -> DataFrame:
    """Pieces of documents in windows of at most ``window`` tokens.

    doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (in the sequence). Each id, the end id of each document included, lies in
    exactly one piece; a null text counts as empty. Each row is a document, repeated doc_ids
    included. Shards end at ``shard_docs`` documents or ``shard_tokens`` ids, and a range of many
    documents with equal words is split by doc_id, so no task gathers an unbounded group. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = Scratch(spark, "packing").cut(rows.mapInArrow(_dealing, "kind int, deal long, doc_id long, text string"), "dealt")
    counted = dealt.filter("kind = 1").select(F.col("deal").alias("slot"), F.col("doc_id").alias("n"))
    statistics = spark.sparkContext.broadcast(corpus_statistics(counted))
    texts = dealt.filter("kind = 0").drop("kind")
    ordered = texts.repartitionByRange("deal", "doc_id", F.xxhash64("text")).sortWithinPartitions("deal", "doc_id", "text")
    return ordered.mapInArrow(_packing(statistics, tokenizer, end_id, window, shard_docs, shard_tokens), _PIECE)
