"""Token ids in seekable zstandard files.

A file is a run of independent frames, one for each document, then two skippable frames: an
index of the documents (ids and token counts) and, last, the seek table of the public seekable
format with one checksum for each frame. A reader takes the tail and the frames it needs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import WordEncoder
from .common import Scratch, column_bytes, sliced, text_batches

# Fixed values of the seekable format.
_SKIPPABLE_INDEX = 0x184D2A50
_SKIPPABLE_SEEK = 0x184D2A5E
_SEEK_MAGIC = 0x8F92EAB1
_HAS_CHECKSUMS = 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_DOCUMENT = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n_tokens", "<i8")])

MANIFEST = "part int, seq int, path string, width int, n_docs long, n_tokens long, n_bytes long"


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store and the place in it of a qualified path as Hadoop writes it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


class TokenFileWriter:
    """Writes documents in the order given; the file appears under its name when it is closed."""

    def __init__(self, path: str, attempt: str, level: int = 3):
        self.fs, self.path = _place(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{attempt}.draft"
        self.out = self.fs.open_output_stream(self.draft)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int]] = []
        self.n_bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        plain = ids.tobytes()
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.documents.append((doc_id is not None, doc_id or 0, len(ids)))
        self.n_bytes += len(packed)

    def close(self) -> None:
        index = np.array(self.documents, _DOCUMENT).tobytes()
        table = np.array(self.entries, _ENTRY).tobytes() + _FOOTER.pack(len(self.entries), _HAS_CHECKSUMS, _SEEK_MAGIC)
        for magic, body in ((_SKIPPABLE_INDEX, index), (_SKIPPABLE_SEEK, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()
        if self.fs.get_file_info(self.path).type != pa.fs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an attempt that was lost after it had finished; the bytes are the same
        self.fs.move(self.draft, self.path)


class TokenFile:
    """Reads single documents of a file: the tail once, then only the frames asked for."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = _place(path)
        self.type = np.dtype("<u2" if width == 2 else "<u4")
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        n, flags, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != _SEEK_MAGIC or flags != _HAS_CHECKSUMS:
            raise ValueError(f"no seek table at the end of {path}")
        table = size - _FOOTER.size - n * _ENTRY.itemsize
        self.entries = np.frombuffer(self._read(table, n * _ENTRY.itemsize), _ENTRY)
        index = table - 8 - n * _DOCUMENT.itemsize
        self.documents = np.frombuffer(self._read(index, n * _DOCUMENT.itemsize), _DOCUMENT)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, at: int) -> int | None:
        known, doc_id, _ = self.documents[at]
        return int(doc_id) if known else None

    def places(self, doc_id: int) -> list[int]:
        """Where a document stands; several places if rows repeated its id."""
        return np.flatnonzero((self.documents["known"] == 1) & (self.documents["doc_id"] == doc_id)).tolist()

    def tokens(self, at: int) -> np.ndarray:
        """The ids of the document at one place, checked against its checksum."""
        packed = self._read(int(self.starts[at]), int(self.entries["packed"][at]))
        plain = self.unpacker.decompress(packed, max_output_size=int(self.entries["plain"][at])) if self.entries["plain"][at] else b""
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["check"][at]:
            raise ValueError(f"frame {at} of {self.path} does not match its checksum")
        return np.frombuffer(plain, self.type)


def _writing(folder: str, tokenizer: str, end_id: int, file_tokens: int):
    def write(batches):
        encoder, context = WordEncoder(tokenizer), TaskContext.get()
        part, attempt, seq, out, total = context.partitionId(), str(context.taskAttemptId()), 0, None, 0
        end = np.array([end_id], encoder.type)

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "width": pa.array([encoder.width], pa.int32()), "n_docs": [len(out.entries)], "n_tokens": [total], "n_bytes": [out.n_bytes]})

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch.column("text"))):
                if out is None:
                    path, total = f"{folder}/tokens-{part:06d}-{seq:04d}.zst", 0
                    out = TokenFileWriter(path, attempt)
                ids = np.concatenate([np.frombuffer(encoder.encode(text), encoder.type), end])
                out.add(doc_id, ids)
                total += len(ids)
                if total >= file_tokens:
                    yield closed()
                    seq, out = seq + 1, None
        if out is not None:
            yield closed()

    return write


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, file_tokens: int = 1 << 26) -> DataFrame:
    """Encode whole texts and write them to ``folder`` in ascending doc_id order (nulls first).

    Returns the files' manifest, ordered by (part, seq). A null text counts as empty, so each
    document has the end id at least. Rows that repeat a doc_id each get a frame, ordered by
    text. Files hold about ``file_tokens`` ids; a longer document has a frame of its own size.
    A retried task writes the same bytes under the same name, so a lost executor does no harm.
    An empty table gives an empty manifest. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_writing(folder, tokenizer, end_id, file_tokens), MANIFEST)


def _reading(batches):
    for batch in batches:
        for row in batch.to_pylist():
            file, start = TokenFile(row["path"], row["width"]), row["start"]
            for at in range(0, len(file), 4096):
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for i in range(at, min(at + 4096, len(file))):
                    ids = file.tokens(i)
                    for key, value in zip(out, (file.doc_id(i), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        out[key].append(value)
                    start += len(ids)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The manifest has a row for each file, so running totals over it are small.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = max(1, manifest.count())
    return placed.repartition(files, "path").mapInArrow(_reading, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents to token files in the shared folder and read them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = scratch.cut(write_tokens(docs, tokenizer, scratch.folder("files"), end_id), "manifest")
    return read_tokens(manifest)
