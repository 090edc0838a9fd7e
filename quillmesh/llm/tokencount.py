"""Token counts of whole texts without their ids.

A text is cut into pre-tokens, and its count is the sum of their pieces. A pre-token of the vocabulary is looked
up there. All others are counted once for each distinct one in the whole table: documents are
gathered in chunks of bounded size, a chunk lists its distinct pre-tokens and, for each document, how often
each occurs. The lists of all chunks are dealt and sorted by pre-token, the pieces go back to the chunks, and
there they are joined to the documents' frequencies and added up. A pre-token stands in a chunk's list
once, however many documents have it, so no pre-token is hot.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import RankEncoder, byte_letters_of, load
from .common import Scratch, column_bytes, sliced, text_batches

# Of these characters (Latin-1 without controls and odd spaces) letters, numbers and spaces are plain.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
# A pre-token always ends before a single space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PART = 1 << 20
#: Longer pre-tokens are merged by a heap.
_LONG_WORD = 512

_CHUNK = "chunk long, doc_ids array<long>, n_bytes array<long>, known array<long>, sizes array<int>, packed binary, words array<string>"


def _parts(text: str):
    """A text in parts of about ``_PART`` characters, cut where a pre-token ends."""
    at = 0
    while len(text) - at > _PART and (cut := _CUT.search(text, at + _PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class PieceCounter:
    """Pre-tokens as the library cuts them, and their number of pieces under a byte-level vocabulary."""

    def __init__(self, path: str):
        self.library, self.ranks = load(path), RankEncoder(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        cutter = file["pre_tokenizer"] or {}
        if file["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError(f"{path} is not a byte-level vocabulary without a normaliser")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in file["added_tokens"]):
            raise ValueError(f"{path} has special tokens that look at what stands beside them")
        specials = sorted((x["content"] for x in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.letters = {byte_letters_of(b): b for b in range(256)}
        #: Pieces of what the vocabulary holds: one each, unless no merges lead to it.
        self.known: dict[str, int] = {}
        for token in file["model"]["vocab"]:
            if token not in specials and (word := self._text(token)) is not None:
                self.known[word] = self.pieces(word)

    def _text(self, letters: str) -> str | None:
        try:
            return bytes(self.letters[x] for x in letters).decode()
        except (KeyError, UnicodeDecodeError):
            return None

    def pieces(self, word: str) -> int:
        if len(word) > _LONG_WORD:
            return len(self.ranks._merged(word.encode()))
        return len(self.ranks.ranks.encode_ordinary(word))

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text)
        return [self._text(word) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """(number of special tokens, how often each pre-token occurs)."""
        between = self.special.split(text)
        found: Counter = Counter()
        for segment in between:
            for part in _parts(segment):
                found.update(self.cut(part))
        return len(between) - 1, found


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One for each worker and file."""
    return PieceCounter(path)


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers with equal bytes side by side, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return plain.reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class _Chunk:
    def __init__(self):
        self.index: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.steps: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: bytes, counter: PieceCounter) -> None:
        known, found = counter.frequencies(text.decode())
        at, times, index, pieces = [], [], self.index, counter.known
        for word, n in found.items():
            if one := pieces.get(word):
                known += one * n
            else:
                at.append(index.setdefault(word, len(index)))
                times.append(n)
        order = np.argsort(places := np.array(at, np.int64))
        self.steps.append(np.diff(places[order], prepend=0))
        self.times.append(np.array(times, np.int64)[order])
        self.rows.append((doc_id, len(text), known, len(at)))
        self.size += len(text)

    def row(self, name: int) -> pa.RecordBatch:
        doc_ids, n_bytes, known, sizes = zip(*self.rows)
        lists = [pa.array([list(x)], pa.list_(kind)) for x, kind in ((doc_ids, pa.int64()), (n_bytes, pa.int64()), (known, pa.int64()), (sizes, pa.int32()))]
        packed = _pack(np.concatenate([*self.steps, *self.times]))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *lists, pa.array([packed], pa.binary()), pa.array([list(self.index)], pa.list_(pa.string()))], names=["chunk", "doc_ids", "n_bytes", "known", "sizes", "packed", "words"])


def _chunks(path: str, most_words: int, most_bytes: int, most_docs: int):
    def gather(batches):
        counter, name, chunk = piece_counter(path), TaskContext.get().partitionId() << 32, _Chunk()
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch.column("text"))):
                chunk.add(doc_id, text, counter)
                if len(chunk.index) >= most_words or chunk.size >= most_bytes or len(chunk.rows) >= most_docs:
                    yield chunk.row(name)
                    name, chunk = name + 1, _Chunk()
        if chunk.rows:
            yield chunk.row(name)

    return gather


def _counting(path: str, most: int):
    def count(batches):
        """Of sorted pre-tokens the pieces, counted where a new one begins; packed for each chunk that lists them."""
        counter, last, pieces, held, size = piece_counter(path), None, 0, [], 0

        def packed():
            of, at, n = map(np.concatenate, zip(*held))
            order = np.lexsort((at, of))
            of, at, n = of[order], at[order], n[order]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            rows = [_pack(np.concatenate([np.diff(at[a:b], prepend=0), n[a:b]])) for a, b in zip(starts, [*starts[1:], len(of)])]
            return pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array(rows, pa.binary())], names=["of", "pieces"])

        for batch in batches:
            found = np.empty(batch.num_rows, np.int64)
            for i, word in enumerate(batch.column("word").to_pylist()):
                if word != last:
                    last, pieces = word, counter.pieces(word)
                found[i] = pieces
            held.append((batch.column("of").to_numpy(), batch.column("at").to_numpy().astype(np.int64), found))
            size += len(found)
            if size >= most:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return count


def _adding(limit: int):
    def add(key, chunks: pa.Table, found: pa.Table) -> pa.Table:
        """The counts of a chunk's documents from the pieces of its pre-tokens."""
        parts = [np.split(_unpack(x), 2) for x in found.column("pieces").to_pylist()]
        pieces = np.zeros(sum(len(n) for _, n in parts), np.int64)
        for steps, n in parts:
            pieces[np.cumsum(steps)] = n
        out = []
        for i in range(chunks.num_rows):
            flat = lambda name: chunks.column(name)[i].values
            sizes = flat("sizes").to_numpy().astype(np.int64)
            steps, times = np.split(_unpack(chunks.column("packed")[i].as_py()), 2)
            ends = np.cumsum(sizes)
            places = np.concatenate([[0], np.cumsum(steps)])
            places = places[1:] - np.repeat(places[ends - sizes], sizes)
            sums = np.concatenate([[0], np.cumsum(pieces[places] * times)])
            n = flat("known").to_numpy() + sums[ends] - sums[ends - sizes]
            out.append(pa.table({"doc_id": flat("doc_ids"), "n_bytes": flat("n_bytes"), "n_tokens": n, "over_limit": pa.array(n > limit)}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "over_limit": pa.array([], pa.bool_())})

    return add


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk_words: int = 1 << 18, chunk_bytes: int = 16 << 20, chunk_docs: int = 8192, held_rows: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, as the vocabulary's library counts.

    ``path``: a byte-level vocabulary without a normaliser; its special tokens count one each where
    their strings stand in a text. A null text counts as empty: no bytes, no tokens. Each row gets a
    result, repeated or without doc_id or not. An empty table gives no rows. Other columns are ignored.
    A chunk is closed after the document with which it reaches ``chunk_words`` distinct
    pre-tokens, ``chunk_bytes`` of text or ``chunk_docs`` documents, and ``held_rows`` counted entries go back at a
    time; that changes the work, not the result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "token-counts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # written once: chunks must be the same ones for their lists and for their documents
    chunks = scratch.cut(rows.mapInArrow(_chunks(path, chunk_words, chunk_bytes, chunk_docs), _CHUNK), "chunks")
    listed = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("at", "word"))
    found = listed.repartition("word").sortWithinPartitions("word").mapInArrow(_counting(path, held_rows), "of long, pieces binary")
    return chunks.drop("words").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_adding(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
