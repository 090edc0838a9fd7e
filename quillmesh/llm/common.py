"""Shared pieces: the scratch area in the cluster's shared folder, and Arrow batch helpers."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_folder


class Scratch:
    """Tables written to the shared folder to cut lineage; readable after any executor is lost.

    What an operator returns reads them, so they go when the application ends, unless dropped before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self._made = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        # with its scheme, so that a path without one means the same store to Spark and to a worker's own reader
        self.root = files.makeQualified(path).toString()

    def folder(self, name: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, so that later plans start from files of known size."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Rows of whole texts are wide: no more than ``rows`` of them, or ``size`` bytes and one row, go to Python at a time from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def column_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 byte strings; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def sliced(batches, rows: int = 1024):
    """The batches in smaller slices, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), vectorised."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_REACH = 1 << 19


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_REACH, base, np.uint64)]))


_TABLES: list[np.ndarray] = []


def _hashed(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a run of bytes, A-Z as a-z: a polynomial over its bytes, by prefix sums."""
    if not _TABLES:
        values = np.arange(1, 257, dtype=np.uint64)
        values[65:91] = values[97:123]
        _TABLES.extend([mix(values, 0xBEEF), _powers(_BASE), _powers(_INVERSE)])
    values, up, down = _TABLES
    space = _SPACE[joined]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[joined] * up[: len(joined)])])
    return mix((sums[ends] - sums[starts]) * down[starts], 0xCAFE), starts


def word_hashes(texts: list[bytes]):
    """For groups of texts: (64-bit hashes of their words in order, number of words of each text).

    Words are runs without ASCII white space. No word is looked up: everything is array work.
    """
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at]) + 1
        while end < len(texts) and size + len(texts[end]) < _REACH:
            size += len(texts[end]) + 1
            end += 1
        if size <= _REACH:
            hashes, starts = _hashed(np.frombuffer(b" ".join(texts[at:end]), np.uint8))
            bounds = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
            yield hashes, np.diff(np.searchsorted(starts, bounds))
        else:  # one very long text, cut at white space where it can be
            found, text, left = [], texts[at], 0
            while left < len(text):
                right = min(len(text), left + _REACH)
                if right < len(text):
                    tail = np.flatnonzero(_SPACE[np.frombuffer(text[left:right], np.uint8)])
                    if not len(tail):  # a word longer than the reach: by a digest of it
                        right = next((i for i in range(right, len(text)) if text[i] in b"\t\n\x0b\x0c\r "), len(text))
                        found.append(np.frombuffer(hashlib.blake2b(text[left:right].lower(), digest_size=8).digest(), np.uint64))
                        left = right
                        continue
                    right = left + int(tail[-1]) + 1
                found.append(_hashed(np.frombuffer(text[left:right], np.uint8))[0])
                left = right
            yield np.concatenate(found), np.array([sum(map(len, found))])
        at = end
