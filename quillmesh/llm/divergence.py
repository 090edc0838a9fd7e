"""How the sources of a language differ from each other and from the language, term by term.

A source's share of a term is a smoothed whole number p, and two shares differ by
f(p, q) = floor((p - q)^2 / (p + q)). The sum over all terms for a pair of sources is taken apart: as if
neither had any term, plus what changes where one has it, plus a correction where both have it.
The corrections come from a frequent-pattern tree. A term is a row of the sources that have it, in
order, with their shares; rows go into the tree with their multiplicity, and rows with a common beginning share
its nodes. A correction is worked out once for each node and each of its ancestors, and counts
as often as rows pass through the node. Trees are built over sorted runs of bounded size, so each run's shared
beginnings meet in one tree; multiplicities add up over trees.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, sliced, text_batches

# Bytes of terms (letters of ASCII as small ones, all of other characters); all else parts them.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PART = 1 << 20
_FEW = 50_000  # groups that may be broadcast: a few MB
ONE = 1_000_000_000


def _split(text: bytes):
    """Terms of a text, a part at a time."""
    plain, at = text.translate(_TERM_BYTES), 0
    while len(plain) - at > _PART:
        end = plain.find(b" ", at + _PART)
        if end < 0:
            break
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


def _counting(most: int):
    def count(batches):
        """Occurrences of terms and documents that hold them, for each group; each group once without a term."""
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size, groups = 0, set()

        def rows():
            for (lang, source), (times, in_docs) in held.items():
                for terms in ([None] if (lang, source) not in groups else []), list(times):
                    for at in range(0, len(terms), 1 << 16):
                        some = terms[at : at + (1 << 16)]
                        n = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([times[t] for t in some], pa.int64()), pa.array([in_docs[t] for t in some], pa.int64())],
                            names=["lang", "source", "term", "n", "docs"],
                        )
                groups.add((lang, source))

        for batch in sliced(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), column_bytes(batch.column("text"))):
                times, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(times), set()
                for terms in _split(text):
                    times.update(terms)
                    own.update(terms)
                in_docs.update(own)
                size += len(times) - before
                if size >= most:
                    yield from rows()
                    held.clear()
                    size = 0
        yield from rows()

    return count


def share(n: Column, total: Column, kinds: Column) -> Column:
    """p of a term that occurs ``n`` times among ``total`` of ``kinds`` kept terms."""
    return F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * kinds).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PatternTree:
    """Sorted rows of one language as a tree: its nodes by depth, each with a row that passes through and a multiplicity."""

    def __init__(self, offsets: np.ndarray, sources: np.ndarray, shares: np.ndarray, zeros: np.ndarray, times: np.ndarray):
        """Row i has the items offsets[i] to offsets[i + 1]; ``zeros``: the share of a term that the item's source lacks."""
        self.offsets, self.sources, self.shares, self.zeros, self.times = offsets, sources, shares, zeros, times

    def levels(self):
        """(depth, rows, multiplicities): the nodes of each depth, each by the first row that made it."""
        starts, sizes = self.offsets[:-1], np.diff(self.offsets)
        same = np.zeros(len(sizes), bool)  # whether a row has shared all nodes so far with the row before it
        same[1:] = True
        deep = np.arange(len(sizes))
        depth = 0
        while len(deep := deep[sizes[deep] > depth]):
            mine, other = starts[deep] + depth, starts[deep - 1] + depth
            # a row before that ends here shares no node at this depth
            longer = same[deep] & (sizes[deep - 1] > depth)
            other = np.where(longer, other, mine)
            same[deep] = longer & (self.sources[mine] == self.sources[other]) & (self.shares[mine] == self.shares[other])
            new = np.flatnonzero(~same[deep])
            yield depth, deep[new], np.add.reduceat(self.times[deep], new)
            depth += 1

    def corrections(self, block: int = 1 << 20):
        """(source above, source below, value) summed over all pairs of a node and an ancestor."""
        for depth, rows, times in self.levels():
            if not depth:
                continue
            step = max(1, block // depth)
            for at in range(0, len(rows), step):
                first = self.offsets[rows[at : at + step]]
                above, below = first[:, None] + np.arange(depth), (first + depth)[:, None]
                p, zp, q, zq = self.shares[above], self.zeros[above], self.shares[below], self.zeros[below]
                value = (_f(p, q) - _f(p, zq) - _f(zp, q) + _f(zp, zq)) * times[at : at + step, None]
                key = self.sources[above] << 32 | self.sources[below]
                keys, inverse = np.unique(key, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, inverse.ravel(), value.ravel())
                yield keys >> 32, keys & 0xFFFFFFFF, sums


def _trees(most: int):
    def corrected(batches):
        def built(table: pa.Table):
            langs = table.column("lang").combine_chunks().to_pylist()
            edges = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
            for a, b in zip(edges, edges[1:]):
                rows = table.slice(a, b - a)
                path = rows.column("path").combine_chunks()
                items = path.flatten()
                names = items.field("source").dictionary_encode()
                offsets = np.concatenate([[0], np.cumsum(np.diff(path.offsets.to_numpy()))])
                tree = PatternTree(offsets, names.indices.to_numpy().astype(np.int64), items.field("p").to_numpy(), items.field("z").to_numpy(), rows.column("times").to_numpy())
                word = names.dictionary
                for above, below, value in tree.corrections():
                    yield pa.RecordBatch.from_arrays([pa.array([langs[a]] * len(value), pa.string()), word.take(pa.array(above)), word.take(pa.array(below)), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("path").flatten())
            if size >= most:
                yield from built(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from built(pa.Table.from_batches(held))

    return corrected


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, held_terms: int = 300_000, tree_items: int = 1 << 18) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group (lang, source) is from the others.

    Null text, lang and source count as empty. Terms: runs of ASCII letters (A-Z as a-z) and of
    characters beyond ASCII. A lang keeps the terms of at least ``least`` of its documents. With V kept
    terms, of which N occurrences are in a group or lang, a term with n of them has the share
    p = 1 + floor(1000000000 * (n + 2) / (N + 2 * V)). Part ``pair``: each other source of the
    lang, f of both shares summed over all kept terms (0 without any). Part ``term``: the ``top`` kept terms that the
    group has and whose share is above that of the lang, with f of the two. Ranks from 1, value descending, item
    ascending. Each row of the table counts as a document, repeated or not; doc_id is not read. An
    empty table gives no rows. Other columns are ignored. The result has a row for each
    pair of sources of a lang, which the contract asks for. ``held_terms``, ``tree_items``: what a
    worker holds before it passes it on; they change the work, not the result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "divergence")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*named, "text").mapInArrow(_counting(held_terms), "lang string, source string, term string, n long, docs long")
    sums = scratch.cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "sums")

    kept = sums.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("items"))
    kept = scratch.cut(kept.filter(F.col("docs") >= least).drop("docs"), "kept")
    items = kept.select("lang", "term", "all_n", F.inline("items"))
    totals = items.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all_n").alias("all_total"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = sums.filter("term is null").select("lang", "source").join(totals.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left").select("lang", "source", none("total"), none("kinds"), none("all_total"))
    zero = F.when(F.col("kinds") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")))
    groups = scratch.cut(groups.withColumn("z", zero), "groups")
    few = groups.count() <= _FEW

    placed = items.join(groups.hint("broadcast" if few else "merge"), ["lang", "source"])
    placed = scratch.cut(placed.select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), "z", share(F.col("all_n"), F.col("all_total"), F.col("kinds")).alias("q")), "placed")

    # both have it: by the trees
    paths = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "z"))).alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times"))
    paths = scratch.cut(paths.filter(F.size("path") > 1), "paths")
    trees = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(_trees(tree_items), "lang string, a string, b string, value long")
    both = trees.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    # neither has it, one has it
    a, b = groups.select("lang", "source", "kinds", F.col("z").alias("za")), groups.select("lang", F.col("source").alias("other"), F.col("z").alias("zb"))
    pairs = scratch.cut(a.join(b.hint("merge"), "lang").filter("source <> other"), "pairs")
    neither = pairs.select("lang", "source", "other", F.when(F.col("kinds") > 0, F.col("kinds") * apart(F.col("za"), F.col("zb"))).otherwise(F.lit(0).cast("long")).alias("value"))
    shares = scratch.cut(placed.groupBy("lang", "source", "p").agg(F.count("*").alias("times")), "shares")
    changed = F.sum(F.col("times") * (apart(F.col("p"), F.col("zb")) - apart(F.col("za"), F.col("zb"))))
    one = shares.join(pairs.hint("merge"), ["lang", "source"]).groupBy("lang", "source", "other").agg(changed.alias("value"))
    turned = lambda df, x, y: df.select("lang", F.col(x).alias("source"), F.col(y).alias("other"), "value")
    every = neither.unionByName(one).unionByName(turned(one, "other", "source")).unionByName(turned(both, "a", "b")).unionByName(turned(both, "b", "a"))
    pair = every.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    term = placed.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pair.select("*", rank).unionByName(term.select("*", rank).filter(F.col("rank") <= top))
