"""BPE encoding by forced boundaries, and decoding.

Two bytes that never stand side by side inside any vocabulary token can't be joined by any
merge, so a word may be cut between them. The fragments are encoded one by one and their ids
put in a row. Fragments repeat far more often than words, so each worker keeps a bounded
table of the fragments and words it has met.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _KEPT_WORD, WordSplitter, byte_letters, load
from .common import column_bytes, sliced, text_batches


def merge_long(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The same merges for a long fragment: a heap of (rank, place) over a linked list."""
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
    heap = [rank << 32 | i for i in range(len(ids) - 1) if (rank := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), 1 << 32)
        j = after[i]
        if ids[i] < 0 or j < 0 or ranks.get(ids[i] << 32 | ids[j]) != rank:
            continue  # merged away since
        ids[i], ids[j] = made[rank], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (rank := ranks.get(ids[a] << 32 | ids[b])) is not None:
                heapq.heappush(heap, rank << 32 | a)
    return [x for x in ids if x >= 0]


class ForcedBoundaryBpe:
    """Encodes as the tokenizer file says: its normaliser and word splitter, then own fragments and merges."""

    def __init__(self, path: str, most_kept: int = 400_000):
        self.library, self.most = load(path), most_kept
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # a pair of ids to the rank of its rule, and the rank to the id it makes
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.inside = {word[i : i + 2] for token in self.ids for word in [token.removesuffix(self.suffix)] for i in range(len(word) - 1)}
        self.splitter = WordSplitter(self.library)
        self.names = {i: x for x, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def cut(self, word: str) -> list[str]:
        """The fragments of a word: cuts where two bytes are in no token side by side."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, fragment: str, ends_word: bool) -> list[int]:
        """Ids of one fragment: the earliest merge rule first, leftmost first."""
        letters = list(fragment)
        if ends_word:
            letters[-1] += self.suffix
        ids, rank_of, none = [self.ids[x] for x in letters if x in self.ids], self.ranks.get, 1 << 60
        if len(ids) > 200:
            return merge_long(ids, self.ranks, self.made)
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) != none:
            at = ranks.index(rank)
            ids[at : at + 2] = [self.made[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(ids[at] << 32 | ids[at + 1], none)
        return ids

    def encode_word(self, word: str) -> list[int]:
        cuts, out = self.cut(word), []
        for i, fragment in enumerate(cuts):
            key = (fragment, i == len(cuts) - 1)
            if (ids := self.fragments.get(key)) is None:
                ids = self.merge(*key)
                if len(fragment) <= _KEPT_WORD:
                    if len(self.fragments) >= self.most:
                        self.fragments.clear()
                    self.fragments[key] = ids
            out += ids
        return out

    def _word(self, word: str) -> tuple[bytes, str]:
        """(ids as bytes, the tokens with a space between) of one plain word."""
        if len(self.words) >= self.most:
            self.words.clear()
        ids = self.encode_word(byte_letters(word))
        found = self.words[word] = self._packed(ids)
        return found

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.names[i] for i in ids])

    def encode(self, text: bytes) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, the decoded text)."""
        string, found = text.decode(), []
        if self.splitter.is_plain(string):
            known = self.words
            for word in self.splitter.plain(string):
                x = known.get(word)
                found.append(self._word(word) if x is None else x)
        else:
            for word, special in self.splitter.other(string):
                found.append(self._packed([self.library.token_to_id(word)] if special else self.encode_word(word)))
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found if x])


def _encoding(path: str):
    def encode(batches):
        model = ForcedBoundaryBpe(path)
        for batch in sliced(batches):
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in column_bytes(batch.column("text")):
                ids, decoded = model.encode(text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())], names=["doc_id", *out])

    return encode


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; a null text counts as empty.

    The vocabulary must drop white space and end words with a suffix; without a decoder of its
    own, decoding puts one space between tokens. Each row gets a result, repeated or not; no
    row needs another, so nothing is shuffled. An empty table gives no rows. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoding(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded: the general form of ``encode_digests``.

    A null text counts as empty and has no ids. Each row gets a result, repeated or not. An empty
    table gives no rows. Other columns are ignored.
    """
    text_batches(docs.sparkSession)

    def encode(batches):
        model = ForcedBoundaryBpe(path)
        for batch in batches:
            found = [model.encode(x) for x in column_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded string")
