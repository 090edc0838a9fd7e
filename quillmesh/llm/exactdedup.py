"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted, and a block's
rank is its integer name; then adjacent names are paired, the distinct pairs sorted and named
by rank again, until each document has a single name. Names differ wherever content differs, so
equal identity means equal text, with no reliance on hashes: blocks are sorted by hash first and
then by content, so that the text itself goes through one shuffle only and blocks that share a hash
are told apart. Names follow from the contents alone, however the table lies in files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import global_rank
from .common import Scratch


def _occurrences(docs: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """A row for each block: row_id, doc_id, sha (with the first block), n_blocks, at, block, key."""
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    rows = rows.select("row_id", "doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("bytes"))
    rows = rows.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.length("bytes") / block_bytes)).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda i: F.substr("bytes", (i * block_bytes + 1).cast("int"), F.lit(block_bytes)))
    out = rows.select("row_id", "doc_id", "sha", "n_blocks", F.posexplode(blocks).alias("at", "block"))
    key = F.shiftrightunsigned(F.xxhash64("block"), 64 - hash_bits) if hash_bits < 64 else F.xxhash64("block")
    return out.select("row_id", "doc_id", F.when(F.col("at") == 0, F.col("sha")).alias("sha"), "n_blocks", F.col("at").cast("long").alias("at"), "block", key.alias("key"))


def _named_blocks(docs: DataFrame, scratch: Scratch, block_bytes: int, hash_bits: int) -> DataFrame:
    """Occurrences with the name of their block. The text is shuffled once, after combining equal blocks."""
    blocks = _occurrences(docs, block_bytes, hash_bits)
    distinct = blocks.groupBy("key", "block").agg(F.lit(1).alias("one"))
    keys = scratch.cut(distinct.groupBy("key").agg(F.count("*").alias("contents")), "keys")
    if keys.filter("contents > 1").isEmpty():
        names = scratch.cut(global_rank(keys.select("key"), "name", F.asc("key")), "names")
        return blocks.drop("block").join(names.hint("merge"), "key").drop("key")
    # hashes collide: both branches below must see the same row numbers, so the occurrences are written first
    blocks = scratch.cut(blocks, "occurrences")
    distinct = blocks.groupBy("key", "block").agg(F.lit(1).alias("one"))
    # of keys with several contents, the contents in their order
    several = distinct.join(keys.filter("contents > 1").select("key").hint("merge"), "key", "left_semi")
    several = scratch.cut(several.select("key", "block", F.row_number().over(Window.partitionBy("key").orderBy("block")).alias("content")), "several")
    every = keys.filter("contents = 1").select("key", F.lit(0).alias("content")).unionByName(several.select("key", "content"))
    names = scratch.cut(global_rank(every, "name", F.asc("key"), F.asc("content")), "names")
    one = blocks.drop("block").join(names.filter("content = 0").drop("content").hint("merge"), "key")
    more = blocks.join(several.join(names.hint("merge"), ["key", "content"]).drop("content").hint("merge"), ["key", "block"]).drop("block")
    return one.unionByName(more).drop("key")


def identities(docs: DataFrame, block_bytes: int = 4096, hash_bits: int = 64) -> tuple[DataFrame, Scratch]:
    """row_id, doc_id, sha, n_blocks, name: rows have equal text where (n_blocks, name) are equal."""
    scratch = Scratch(docs.sparkSession, "naming")
    level = scratch.cut(_named_blocks(docs, scratch, block_bytes, hash_bits).withColumn("left_over", F.col("n_blocks")), "level")
    done = []
    while True:
        done.append(level.filter("left_over = 1").select("row_id", "doc_id", "sha", "n_blocks", "name"))
        rest = level.filter("left_over > 1")
        if rest.isEmpty():
            break
        half = F.col("at") % 2
        pairs = rest.groupBy("row_id", "doc_id", "n_blocks", "left_over", F.expr("at div 2").alias("at")).agg(
            F.min(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.min(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right"), F.min("sha").alias("sha")
        )
        pairs = scratch.cut(pairs.withColumn("left_over", F.ceil(F.col("left_over") / 2)), "pairs")
        names = scratch.cut(global_rank(pairs.select("left", "right").distinct(), "name", F.asc("left"), F.asc("right")), "names")
        level = scratch.cut(pairs.join(names.hint("merge"), ["left", "right"]).drop("left", "right"), "level")
        scratch.drop(pairs, names)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, scratch


def exact_duplicates(docs: DataFrame, block_bytes: int = 4096, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are compared as they are, null as empty. Of equal texts the row with the largest doc_id
    stays (null doc_ids come first); of rows that repeat both doc_id and text, one is kept. An
    empty table gives no rows. Other columns are ignored. ``hash_bits`` below 64 makes hashes
    collide, for tests. A group's size and its row that stays come from combined aggregates,
    and are joined back on the written identities, where large groups can be split.
    """
    found, scratch = identities(docs, block_bytes, hash_bits)
    found = scratch.cut(found, "identities")
    last = F.max(F.struct("doc_id", "row_id"))
    groups = scratch.cut(found.groupBy("n_blocks", "name").agg(last.alias("last"), F.count("*").alias("group_size")), "groups")
    out = found.join(groups.hint("merge"), ["n_blocks", "name"])
    return out.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("last.row_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat doc_id and text, one.

    Null texts count as empty, null doc_ids come first. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.cut(exact_duplicates(docs.select("doc_id", "text")), "found")
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == kept["_sha"])
    out = docs.join(kept.hint("merge"), same, "left_semi")
    repeated = not found.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
