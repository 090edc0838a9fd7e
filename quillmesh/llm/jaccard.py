"""N-gram Jaccard join: grouped prefix join and connected components.

A document is the set of its distinct word shingles. All sets are put in one global order, common
shingles last as a count table of fixed size tells them; two sets that are similar enough share a shingle in their prefixes. Documents
with equal sets are one class; classes with identical prefixes and size are one group. Pairs
of groups that share a prefix shingle pass a size, a position and a bitmap filter, and only then
are their members' whole texts compared.

Only components are asked for, so members already known to hang together need no further
comparison. The join runs in rounds:

* Linking rounds: in each shingle's list a group sees two entries beside it and the weightiest, and
  takes those it sees most often. These few pairs are verified, and what links is contracted.
  A round costs as much as the lists are long, however alike their entries are.
* Remaining pairs of short lists, in different components: filtered, expanded, verified.
* Remaining long lists: their documents are few after contraction. All their shingles are counted
  exactly, and only those that stand in more than one component count as shared; prefixes are
  taken anew in order of these counts. A document of which too little stands elsewhere drops out
  here without being compared with anything. Linking rounds again, then all remaining pairs.

No list, group or class is capped: every pair that may link ends up verified or inside one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, mix, text_batches, word_hashes

_SLOTS = 1 << 20
_CHUNK = 1 << 14
_CHAIN = 4096
_SHORT = 64  # entries of a list whose pairs are written out; longer lists are ordered anew
_FEW = 200_000  # document ids that may be broadcast: 1.6 MB


class Shingler:
    """Sets of hashed word shingles."""

    def __init__(self, words: int):
        self.words = words

    def _rolled(self, h: np.ndarray, k: int) -> np.ndarray:
        """The hash of each run of k words, from the run's first word on."""
        out = np.full(max(0, len(h) - k + 1), k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)], 0x51ED27)
        return out

    def sets(self, texts: list[bytes]):
        """For each text its sorted distinct shingle hashes; empty for a text without words."""
        k = self.words
        for h, counts in word_hashes(texts):
            rolled, start = self._rolled(h, k), 0
            for n in counts.tolist():
                if n >= k:
                    yield np.unique(rolled[start : start + n - k + 1])
                else:
                    yield self._rolled(h[start : start + n], n) if n else h[:0]
                start += n


def _slot_counts(sets: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return np.bincount((every & np.uint64(_SLOTS - 1)).astype(np.int64), minlength=_SLOTS)


def _slots(words: int):
    def count(batches):
        """The count table of this part of the documents, of fixed size, in chunks."""
        shingler, counts = Shingler(words), np.zeros(_SLOTS, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for s in shingler.sets(column_bytes(batch.column("text"))):
                held.append(s)
                size += len(s)
                if size >= _SLOTS // 2:
                    counts += _slot_counts(held)
                    held, size = [], 0
        counts += _slot_counts(held)
        for chunk in range(_SLOTS // _CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": [counts[chunk * _CHUNK : (chunk + 1) * _CHUNK].tobytes()]})

    return count


def _summed(batches):
    """The same chunks of all parts added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def slot_counts(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles of the whole table by slot of their hash: a table of fixed size, by which shingles are ordered."""
    kinds = "chunk int, counts binary"
    chunks = texts.mapInArrow(_slots(words), kinds).repartition(_SLOTS // _CHUNK, "chunk").mapInArrow(_summed, kinds).collect()
    counts = np.zeros(_SLOTS, np.int64)
    for row in chunks:
        counts[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.counts, np.int64)
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap: its Hamming distance to another never exceeds the symmetric difference."""
    bits = min(1 << 17, max(64, 1 << int(len(s) - 1).bit_length()))
    at = (mix(s, 0xB17) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(s: np.ndarray) -> list[int]:
    """A parity bitmap of 256 bits as four integers, for a first filter inside a join."""
    bits = np.bincount((mix(s, 0xF01D) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.frombuffer(np.packbits(bits.astype(np.uint8)).tobytes(), "<i8").tolist()


def _signing(words: int, num: int, den: int, common):
    def sign(batches):
        shingler, weight = Shingler(words), common.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "set_a", "set_b", "prefix_a", "prefix_b", "bitmap", "folded", "prefix")}
            for s in shingler.sets(column_bytes(batch.column("text"))):
                first = s[:0]
                if len(s):
                    first = s[np.lexsort((s, weight[(s & np.uint64(_SLOTS - 1)).astype(np.int64)]))][: _prefix_length(len(s), num, den)]
                out["n"].append(len(s))
                for name, x in (("set", s), ("prefix", first)):
                    out[f"{name}_a"].append(int(mix(x, 0xA1).sum(dtype=np.uint64).astype(np.int64)))
                    out[f"{name}_b"].append(int(np.bitwise_xor.reduce(mix(x, 0xB2)).astype(np.int64)) if len(x) else 0)
                out["bitmap"].append(_bitmap(s) if len(s) else b"")
                out["folded"].append(_folded(s))
                out["prefix"].append(first.astype(np.int64))
            kinds = {"bitmap": pa.binary(), "folded": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}})

    return sign


def _close(num: int, den: int):
    def close(batches):
        """Pairs whose bitmaps leave room for the similarity asked for: 2 * overlap <= n_a + n_b - Hamming distance."""
        for batch in batches:
            a, b = (batch.column(f"{x}_bitmap").to_pylist() for x in "ab")
            n = sum(batch.column(f"{x}_n").to_numpy().astype(np.int64) for x in "ab")
            apart = np.empty(len(a), np.int64)
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                apart[i] = np.bitwise_count(x ^ y).sum()
            most = (n - apart) // 2  # of the overlap
            keep = den * most >= num * (n - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return close


def _verifying(words: int, num: int, den: int):
    def verify(batches):
        shingler = Shingler(words)
        for batch in batches:
            keep = []
            for a, b in zip(*(shingler.sets(column_bytes(batch.column(f"{x}_text"))) for x in "ab")):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and den * both >= num * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _stars(batches):
    """The edges of this part as stars: each node with the smallest node it reaches here."""
    parts = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches]
    nodes, ends = np.unique(np.concatenate([*parts, np.zeros((2, 0), np.int64)], axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[label[moved]], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, part: int = 500_000) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge a - b.

    Runs of about ``part`` edges become stars first, each in its own task. Then each round takes the
    smallest label among neighbours, then the label of that label, so chains from star to star
    shorten at twice the pace; labels stay in tables, only the count of changes is seen.
    """
    given = scratch.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    n = given.count()
    stars = given.coalesce(max(1, -(-n // part))).mapInArrow(_stars, "a long, b long")
    both = scratch.cut(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "stars")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    scratch.drop(given)
    while n > part:  # otherwise each star is a whole component
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        top = labels.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new = scratch.cut(moved.join(top.hint("merge"), "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("component")), "labels")
        ended = new.filter("old <> component").isEmpty()
        scratch.drop(labels)
        labels = new.drop("old")
        labels._scratch_path = new._scratch_path
        if ended:
            break
    scratch.drop(both)
    return labels


def _similar_sizes(num: int, den: int, a: str, b: str):
    return (F.col(a) * num <= F.col(b) * den) & (F.col(b) * num <= F.col(a) * den)


def least_overlap(num: int, den: int):
    """The overlap that a link between sets of x_n and y_n shingles needs at least."""
    return F.expr(f"((x_n + y_n) * {num} + {num + den - 1}) div {num + den}")


def _all_shingles(words: int):
    def listed(batches):
        shingler = Shingler(words)
        for batch in batches:
            sets = [x.astype(np.int64) for x in shingler.sets(column_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_pydict({"rep": batch.column("doc_id"), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return listed


def _runs(node: str, size: str):
    """Deals the entries of a list over runs of about _CHAIN."""
    return F.pmod(F.xxhash64(node), F.ceil(F.col(size) / _CHAIN).cast("long"))


class _Join:
    """The tables of one join: rows (doc_id, text), members (gid, first, rep, n, bitmap, folded), lists (shingle, gid, first, n, at, size), weights (gid, weight).

    ``first``: the smallest doc_id of a group, which stands for it where texts are compared.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch, words: int, num: int, den: int):
        self.rows, self.scratch, self.words, self.num, self.den = rows, scratch, words, num, den

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """doc_id, text of the documents in ``ids`` (doc_id), a written table."""
        return self.scratch.cut(self.rows.join(ids.hint("broadcast" if ids.count() <= _FEW else "merge"), "doc_id", "left_semi"), "texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs of members (a < b), those that link."""
        scratch = self.scratch
        sides = [self.members.select(F.col("rep").alias(x), F.col("n").alias(f"{x}_n"), F.col("bitmap").alias(f"{x}_bitmap")) for x in "ab"]
        near = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").mapInArrow(_close(self.num, self.den), "a long, b long")
        near = scratch.cut(near.distinct(), "near")
        ids = scratch.cut(near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
        texts = self.texts_of(ids)
        sides = [texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab"]
        met = near.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").select("a", "b", "a_text", "b_text")
        found = scratch.cut(met.mapInArrow(_verifying(self.words, self.num, self.den), "a long, b long"), "links")
        scratch.drop(near, ids, texts)
        return found

    def contracted(self, placed: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
        """``placed`` (gid, rep, n, component) after these links have joined components, and whether there are any."""
        if links.isEmpty():
            return placed, False
        ends = [placed.select(F.col("rep").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"]
        edges = links.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        tops = components(edges, self.scratch).select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = placed.join(tops.hint("merge"), "component", "left").select("gid", "rep", "n", F.coalesce("top", "component").alias("component"))
        return self.scratch.cut(new, "placed"), True

    def inside(self, placed: DataFrame) -> DataFrame:
        """gid, the lowest and highest component of its members, and their number."""
        return self.scratch.cut(placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")), "inside")

    def likely(self, entries: DataFrame, key: str, turn: int) -> DataFrame:
        """For each node of ``entries`` (key, run, node, n, component, weight) at most three partners worth verifying.

        In each list a node sees the two entries that stand before it by size, and the weightiest one
        of about its size: in a crowd of near copies most link to the one with the most common text.
        Of each of the three kinds, the partner it sees most often is taken.
        """
        step = float(np.log(self.den / self.num)) or 1.0
        entries = entries.withColumn("bucket", F.floor(F.log("n") / step))
        order = Window.partitionBy(key, "run").orderBy("n", F.xxhash64("node", F.lit(turn)), "node")
        first = Window.partitionBy(key, "run", "bucket").orderBy(F.desc("weight"), "node")
        names = ("node", "n", "component")
        beside = [F.struct(*(F.lag(c, i).over(order).alias(c) for c in names), F.lit(i).alias("kind")) for i in (1, 2)]
        weightiest = F.struct(*(F.first(c).over(first).alias(c) for c in names), F.lit(3).alias("kind"))
        may = lambda y: (F.col("node") != y["node"]) & (F.col("component") != y["component"]) & (F.col("n") * self.num <= y["n"] * self.den) & (y["n"] * self.num <= F.col("n") * self.den)
        seen = entries.select(*names, F.array(*beside, weightiest).alias("y")).select("node", F.explode(F.filter("y", may)).alias("y"))
        met = seen.groupBy("node", F.col("y.node").alias("y_node"), F.col("y.kind").alias("kind")).agg(F.count("*").alias("times"))
        best = [F.expr(f"max_by(y_node, struct(times, -y_node)) filter (where kind = {i})") for i in (1, 2, 3)]
        chosen = met.groupBy(F.col("node").alias("x")).agg(F.array(*best).alias("y")).select("x", F.explode("y").alias("y")).filter("y is not null")
        return chosen.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def linking_round(self, placed: DataFrame, turn: int) -> DataFrame:
        """Pairs of members worth verifying, by the lists of groups and within groups."""
        inside = self.inside(placed)
        listed = self.lists.join(inside.select("gid", F.col("low").alias("component")).join(self.weights.hint("merge"), "gid").hint("merge"), "gid")
        listed = listed.select("shingle", F.col("first").alias("node"), "n", "component", "weight", _runs("gid", "size").alias("run"))
        crowded = placed.join(inside.filter("low <> high").select("gid", "members").hint("merge"), "gid")
        crowded = crowded.select("gid", F.col("rep").alias("node"), "n", "component", F.lit(0.0).alias("weight"), _runs("rep", "members").alias("run"))
        return self.likely(listed, "shingle", turn).union(self.likely(crowded, "gid", turn)).distinct()

    def open_lists(self, placed: DataFrame, inside: DataFrame) -> DataFrame:
        """The lists that hold more than one component, with what the filters need."""
        # bits: the folded bitmap of a group with a single member
        bits = [F.when(F.col("members") == 1, F.get("folded", F.lit(i))).alias(f"bits{i}") for i in range(4)]
        known = inside.join(self.members.filter("first = rep").dropDuplicates(["gid"]).select("gid", "folded").hint("merge"), "gid").select("gid", "low", "high", *bits)
        listed = self.lists.drop("size", "first").join(known.hint("merge"), "gid")
        mixed = listed.groupBy("shingle").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("size")).filter("least <> most").select("shingle", "size")
        return self.scratch.cut(listed.join(mixed.hint("merge"), "shingle"), "open-lists")

    def in_short_lists(self, placed: DataFrame, inside: DataFrame, listed: DataFrame) -> DataFrame:
        """Every pair of members in different components whose groups share a short list, or a group, and that may link."""
        num, den = self.num, self.den
        x, y = (listed.filter(F.col("size") <= _SHORT).select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("gid", "n", "at", "low", "high", "bits0", "bits1", "bits2", "bits3"))) for s in "xy")
        distance = sum(F.bit_count(F.col(f"x_bits{i}").bitwiseXOR(F.col(f"y_bits{i}"))) for i in range(4))
        near = F.coalesce(F.col("x_n") + F.col("y_n") - 2 * least_overlap(num, den) >= distance, F.lit(True))
        room = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
        apart = F.least("x_low", "y_low") != F.greatest("x_high", "y_high")
        met = x.join(y.hint("merge"), (x["shingle"] == y["shingle"]) & (F.col("x_gid") < F.col("y_gid")) & apart & _similar_sizes(num, den, "x_n", "y_n") & (room >= least_overlap(num, den)) & near)
        several = inside.filter("low <> high").select(F.col("gid").alias("x_gid"), F.col("gid").alias("y_gid"))
        group_pairs = self.scratch.cut(met.select("x_gid", "y_gid").distinct().union(several), "group-pairs")
        ends = [placed.select(F.col("gid").alias(f"{s}_gid"), F.col("rep").alias(f"{s}_rep"), F.col("component").alias(f"{s}_component"), F.col("n").alias(f"{s}_n")) for s in "xy"]
        opened = group_pairs.join(ends[0].hint("merge"), "x_gid").join(ends[1].hint("merge"), "y_gid")
        opened = opened.filter((F.col("x_component") != F.col("y_component")) & ((F.col("x_gid") != F.col("y_gid")) | (F.col("x_rep") < F.col("y_rep"))))
        return opened.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()

    def reordered(self, some: DataFrame) -> DataFrame:
        """Prefixes of ``some`` members by exact counts: shingle, node, n, at, weight, size.

        Of their shingles only those count that stand in more than one component; all others come
        before them in the order, so they push them out of the prefixes.
        """
        scratch = self.scratch
        some = scratch.cut(some.select("rep", "n", "component").distinct(), "some")
        texts = self.texts_of(some.select(F.col("rep").alias("doc_id")).distinct())
        # a doc_id that is repeated with other texts is one node with several sets
        sets = texts.mapInArrow(_all_shingles(self.words), "rep long, shingles array<long>").withColumn("set", F.xxhash64("shingles"))
        sets = scratch.cut(sets.dropDuplicates(["rep", "set"]).withColumn("n", F.size("shingles").cast("long")), "sets")
        sets = sets.join(some.hint("merge"), ["rep", "n"])
        every = scratch.cut(sets.select("rep", "set", "n", "component", F.explode("shingles").alias("shingle")), "shingles")
        shared = every.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low <> high").select("shingle", "size")
        own = Window.partitionBy("rep", "set")
        at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("size", "shingle")) - 1
        crossing = every.join(shared.hint("merge"), "shingle").withColumn("at", at).withColumn("weight", F.sum("size").over(own) / F.col("n"))
        prefixes = crossing.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * self.num / self.den))
        return scratch.cut(prefixes.select("shingle", F.col("rep").alias("node"), "n", "at", "weight", "size"), "prefixes")

    def placed_prefixes(self, prefixes: DataFrame, placed: DataFrame) -> DataFrame:
        return prefixes.join(placed.select(F.col("rep").alias("node"), "component").distinct().hint("merge"), "node")

    def in_prefixes(self, entries: DataFrame) -> DataFrame:
        """Every pair in different components that shares a shingle of its prefixes and may link."""
        num, den = self.num, self.den
        x, y = (entries.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "at", "component"))) for s in "xy")
        room = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
        met = x.join(y.hint("merge"), (x["shingle"] == y["shingle"]) & (F.col("x_node") < F.col("y_node")) & (F.col("x_component") != F.col("y_component")) & _similar_sizes(num, den, "x_n", "y_n") & (room >= least_overlap(num, den)))
        return met.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()

    def components(self, rounds: int, linked: DataFrame) -> DataFrame:
        """``members`` with their component, after all that may link is linked; ``linked``: links known before (a, b)."""
        placed, _ = self.contracted(self.members.select("gid", "rep", "n", F.col("rep").alias("component")), linked)
        for turn in range(rounds):
            placed, found = self.contracted(placed, self.verified(self.linking_round(placed, turn)))
            if not found:
                break
        inside = self.inside(placed)
        listed = self.open_lists(placed, inside)
        wide = self.scratch.cut(listed.filter(F.col("size") > _SHORT).select("gid").distinct(), "wide")
        placed, _ = self.contracted(placed, self.verified(self.in_short_lists(placed, inside, listed)))
        if wide.isEmpty():
            return placed
        prefixes = self.reordered(placed.join(wide.hint("merge"), "gid", "left_semi"))
        for turn in range(rounds):
            entries = self.placed_prefixes(prefixes, placed).withColumn("run", _runs("node", "size"))
            placed, found = self.contracted(placed, self.verified(self.likely(entries, "shingle", turn).distinct()))
            if not found:
                break
        return self.contracted(placed, self.verified(self.in_prefixes(self.placed_prefixes(prefixes, placed))))[0]


def near_duplicates(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A-Z count as a-z; a word is a run without ASCII white space. A set is the distinct shingles of
    ``words`` words; a shorter text is one shingle; without words, the set is empty and links with
    nothing. Two documents link when den * overlap >= num * union. component_id is the smallest
    doc_id reachable by links, the document's own included. Shingles are told apart by 64-bit
    hashes. Rows that repeat a doc_id are one node: their links are pooled. Rows without doc_id
    link with nothing (component_id null). An empty table gives no rows. Other columns are ignored.
    ``rounds``: linking rounds before all remaining pairs are verified; it changes the work, not
    the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = spark.sparkContext.broadcast(slot_counts(rows.select("text"), words))  # 4 MB, whatever the table
    signed = scratch.cut(rows.mapInArrow(_signing(words, num, den, common), "doc_id long, n long, set_a long, set_b long, prefix_a long, prefix_b long, bitmap binary, folded array<long>, prefix array<long>"), "signed")

    known = signed.filter("n > 0 and doc_id is not null")
    key = ["n", "set_a", "set_b"]
    classes = scratch.cut(known.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    ids = scratch.cut(signed.select("doc_id", *key).join(classes.hint("merge"), key, "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "ids")
    reps = known.drop("prefix").join(classes.select(*key, F.col("rep").alias("doc_id")).hint("merge"), [*key, "doc_id"], "left_semi")
    reps = reps.dropDuplicates(["doc_id", "set_a", "set_b"])
    # a group has a name of its own: a doc_id that is repeated with other texts may come first in several groups
    begun = ["n", "prefix_a", "prefix_b"]
    groups = scratch.cut(reps.groupBy(*begun).agg(F.min("doc_id").alias("first")).withColumn("gid", F.monotonically_increasing_id()), "groups")
    join = _Join(rows, scratch, words, num, den)
    join.members = scratch.cut(reps.join(groups.hint("merge"), begun).select("gid", "first", F.col("doc_id").alias("rep"), "n", "bitmap", "folded"), "members")

    # of each group, the prefix of its first member; shingles that stand in one group's prefix only link nothing
    first = signed.select(F.col("doc_id").alias("first"), *begun, "prefix").join(groups.hint("merge"), [*begun, "first"]).dropDuplicates([*begun, "first"])
    listed = first.select("gid", "first", "n", F.posexplode("prefix").alias("at", "shingle"))
    shared = listed.groupBy("shingle").agg(F.count("*").alias("size")).filter("size > 1")
    join.lists = scratch.cut(listed.join(shared.hint("merge"), "shingle"), "lists")

    join.weights = scratch.cut(join.lists.groupBy("gid").agg((F.sum("size") / F.max("n")).alias("weight")), "weights")
    # rows that repeat a doc_id with other texts hang together: each set's first document with the first of all
    pooled = ids.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_last")).filter("a <> _last").select("doc_id", "a")
    pooled = ids.join(pooled.hint("merge"), "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    placed = join.components(rounds, scratch.cut(pooled, "pooled"))

    out = ids.join(placed.select("rep", "component").distinct().hint("merge"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near duplicates: of each component, the one that gives it its name.

    Texts without words and rows without doc_id all stay, as do rows that repeat the doc_id that stays.
    An empty table gives no rows.
    """
    found = near_duplicates(docs.select("doc_id", "text"), words, num, den)
    gone = Scratch(docs.sparkSession, "near").cut(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_id")), "gone")
    few = gone.count() <= _FEW
    out = docs.join(gone.hint("broadcast" if few else "merge"), docs["doc_id"] == gone["_id"], "left_anti")
    return out
