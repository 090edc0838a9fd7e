"""Vector code compression: product codes whose entries are found by a geometric tree.

Each component counts as floor(scale * x), a whole number, so all that follows is exact. Vectors
are cut into parts, each part position has a codebook, and a part is written as the index of its nearest
entry. The entries of a codebook stand in a geometric near-neighbour access tree (GNAT): a node holds
split points and, for each split point and each subtree, the least and greatest distance between them.
A query's distance to a split point then rules out whole subtrees without looking into them.

A round is one pass over the vectors with the codebooks at hand (16 entries of each part, whatever the
table) and one small sum; only the sums of entries, no vectors, come back to the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

_LIMB = 60
_HUGE = float(np.finfo(np.float64).max)
_MOST = (1 << 63) - 1
_FEW = 100_000  # sums by label that may be broadcast: under 3 MB

Books = list[list[list[int]]]


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers: of 64 bits where squares of their distances fit well, else Python's."""
    with np.errstate(over="ignore"):
        found = np.clip(np.floor(float(scale) * flat.astype(np.float64)), -_HUGE, _HUGE)
    return found.astype(np.int64) if np.abs(found).max(initial=0) < 1 << 28 else np.frompyfunc(int, 1, 1)(found)


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one entry."""
    apart = x - entry
    return (apart * apart).sum(axis=1) if x.shape[1] else np.zeros(len(x), np.int64)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below and above the roots; floats round, so one more on either side."""
    if squares.dtype == object:
        low = np.frompyfunc(math.isqrt, 1, 1)(squares)
        return low, low + 1
    low = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return low - 1, low + 2


class Gnat:
    """The entries of one codebook; finds for many rows at a time the nearest entry, ties to the lower index."""

    def __init__(self, entries: np.ndarray, splits: int = 4, leaf: int = 3):
        """``entries``: a row each, of whole numbers, all of one kind."""
        self.entries, self.splits, self.leaf = entries, splits, leaf
        #: Distances of rows to entries worked out, and those that a plain scan would have needed.
        self.worked, self.plain = 0, 0
        self.root = self._node(list(range(len(entries))))

    def _node(self, members: list[int]):
        """(split points, [(subtree, [range of distances to each split point])])."""
        if len(members) <= self.leaf:
            return members, []
        rows = self.entries[members]
        chosen, nearest = [0], _squares(rows, rows[0])
        while len(chosen) < self.splits:
            far = max(range(len(members)), key=lambda i: (nearest[i], -i))
            if far in chosen:
                far = next(i for i in range(len(members)) if i not in chosen)
            chosen.append(far)
            nearest = np.minimum(nearest, _squares(rows, rows[far]))
        squares = [_squares(rows, rows[i]) for i in chosen]
        below: list[list[int]] = [[] for _ in chosen]
        for i in range(len(members)):
            if i not in chosen:
                below[min(range(len(chosen)), key=lambda j: (squares[j][i], j))].append(i)
        children = []
        for some in filter(None, below):
            ranges = []
            for s in squares:
                low, high = _roots(s[some])
                ranges.append((low.min(), high.max()))
            children.append((self._node([members[i] for i in some]), ranges))
        return [members[i] for i in chosen], children

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of whole numbers."""
        n, most = len(x), max(int(np.abs(y).max(initial=0)) for y in (x, self.entries))
        wide = 4 * most * most * max(1, x.shape[1]) >= 1 << 62
        kind = object if wide or x.dtype == object or self.entries.dtype == object else np.int64
        self._x, self._e = x.astype(kind), self.entries.astype(kind)
        self.index, self.square = np.full(n, len(self.entries), np.int64), np.full(n, -1, kind)
        self.plain += n * len(self.entries)
        self._visit(self.root, np.arange(n))
        return self.index, self.square

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        splits, children = node
        bounds = []
        for i in splits:
            square = _squares(self._x[rows], self._e[i])
            self.worked += len(rows)
            best = self.square[rows]
            better = (best < 0) | (square < best) | ((square == best) & (i < self.index[rows]))
            better = better.astype(bool)
            self.index[rows[better]], self.square[rows[better]] = i, square[better]
            if children:
                bounds.append(_roots(square))
        for child, ranges in children:
            radius = _roots(self.square[rows])[1]
            out = np.zeros(len(rows), bool)
            for (low, high), (least, most) in zip(bounds, ranges):
                # every entry below is at least so far away: strictly beyond the best, it can't even tie
                out |= ((low - most > radius) | (least - high > radius)).astype(bool)
            self._visit(child, rows[~out])


def _matrix(column: pa.Array, parts: int, length: int, scale: int) -> np.ndarray:
    """Vectors as a row for each, of ``parts * length`` whole numbers; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = whole(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()], scale)
    if (sizes == parts * length).all():
        return flat.reshape(len(column), parts * length)
    out = np.zeros((len(column), parts * length), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _trees(books: Books) -> list[Gnat]:
    found = []
    for book in books:
        entries = np.array(book, dtype=object).reshape(len(book), len(book[0]))
        small = np.abs(entries).max(initial=0) < 1 << 31
        found.append(Gnat(entries.astype(np.int64) if small else entries))
    return found


def _summing(books: Books, length: int, scale: int):
    def sums(batches):
        """The sum and number of parts at each entry; sums in limbs, so that none is too large to add up."""
        trees, totals, counts = _trees(books), {}, {}
        for batch in batches:
            x = _matrix(batch.column("embedding"), len(books), length, scale)
            for part, tree in enumerate(trees):
                mine = x[:, part * length : (part + 1) * length]
                index, _ = tree.nearest(mine)
                for entry in np.unique(index).tolist():
                    some = mine[index == entry]
                    counts[part, entry] = counts.get((part, entry), 0) + len(some)
                    held = totals.setdefault((part, entry), [0] * length)
                    for at, s in enumerate(some.sum(axis=0).tolist()):
                        held[at] += s
        out = []
        for (part, entry), held in totals.items():
            for at, value in enumerate(held):
                limb = 0
                while True:
                    last = -(1 << 62) <= value < 1 << 62
                    out.append((part, entry, at, limb, value if last else value & ((1 << _LIMB) - 1), counts[part, entry]))
                    if last:
                        break
                    value, limb = value >> _LIMB, limb + 1
        columns = list(zip(*out)) or [[]] * 6
        kinds = (pa.int32(),) * 4 + (pa.int64(),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "entry", "at", "limb", "sum", "n"])

    return sums


def _coding(books: Books, length: int, scale: int):
    def code(batches):
        trees = _trees(books)
        for batch in batches:
            x = _matrix(batch.column("embedding"), len(books), length, scale)
            indices, errors = [], np.zeros(len(x), object)
            for part, tree in enumerate(trees):
                index, square = tree.nearest(x[:, part * length : (part + 1) * length])
                indices.append(index.astype(np.uint8))
                errors = errors + square
            codes = [row.tobytes().hex() for row in np.stack(indices, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array([min(e, _MOST) for e in errors.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return code


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the vectors that are not null and hold finite components only."""
    x = F.col("embedding")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, x.cast("array<double>").alias("embedding"))
    return kept.filter(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def train_codebooks(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Books:
    """The codebook of each part position, ``entries`` entries of whole numbers each, from ``usable_vectors``.

    A codebook starts as that part of the rows with the smallest vec_ids (nulls last; rows that repeat one in order of
    their components). In each round every part goes to its nearest entry, and an entry becomes
    floor(sum / count) of its parts; an entry without parts stays. Fewer rows give fewer entries, none
    gives none. A length that can't be cut into equal parts, and shorter vectors, are filled up with zeros.
    """
    width = kept.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return []
    length = -(-width // parts)
    first = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    rows = [whole(np.array([*r.embedding, *[0.0] * (parts * length - len(r.embedding))]), scale).tolist() for r in first]
    books = [[row[p * length : (p + 1) * length] for row in rows] for p in range(parts)]
    for _ in range(rounds):
        sums = kept.select("embedding").mapInArrow(_summing(books, length, scale), "part int, entry int, at int, limb int, sum long, n long")
        totals = sums.groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect()  # a row for each component of an entry
        found: dict[tuple, list[int]] = {}
        for r in totals:
            held = found.setdefault((r.part, r.entry, r["at"]), [0, 0])
            held[0] += int(r["sum"]) << _LIMB * r.limb
            held[1] = max(held[1], r.n)  # the first limb has all tasks' rows
        for (part, entry, at), (total, n) in found.items():
            books[part][entry][at] = total // n
    return books


def encode_vectors(kept: DataFrame, books: Books, scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances summed over parts)."""
    if not books:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(_coding(books, len(books[0][0]), scale), f"vec_id long, label {label}, code string, error long")


def reconstruct(codes: DataFrame, books: Books, scale: int = 4096) -> DataFrame:
    """vec_id and the vector that its code stands for."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(x / scale) for x in entry)) for entry in book)) for book in books))
    at = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(F.get(entries, p), F.conv(F.substring("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.select("vec_id", F.flatten(at).alias("embedding"))


def codebooks_digest(books: Books) -> str:
    """SHA-256 of all components, decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector, repeated or not.

    ``label_error``: the error summed over rows of an equal label, null ones together; without a
    column label all are null. Vectors that are null or hold null, NaN or infinite components are
    dropped; a null vec_id stays. Errors beyond a long count as the largest long. An empty table gives no rows.
    Other columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    kept = scratch.cut(usable_vectors(vectors), "kept")
    books = train_codebooks(kept, parts, entries, rounds, scale)
    codes = scratch.cut(encode_vectors(kept, books, scale), "codes")
    most = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = scratch.cut(codes.groupBy(F.col("label").alias("_label")).agg(most.alias("label_error")), "label-sums")
    few = sums.count() <= _FEW
    out = codes.join(sums.hint("broadcast" if few else "merge"), codes["label"].eqNullSafe(sums["_label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
