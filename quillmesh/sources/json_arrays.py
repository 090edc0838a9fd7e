"""One JSON array of any size, read by several tasks.

The file is read in pieces that end with a closing brace, so its blocks go to different tasks. Whether a block starts
inside a string, and how many braces are open there, follows from the blocks before it: each block tells how it changes both, the
changes are added up over the blocks of a file (a row each), and then every block knows where its records
begin and end. Records that cross blocks are put together from their fragments.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written

_MARK = re.compile(r'\\.|["{]', re.DOTALL)
_BLOCKS = 200_000  # of all files together: under 20 MB where they are sent to every task


def _after(piece: str, inside: bool) -> tuple[bool, int]:
    """(inside a string at the end, braces opened less closed) of a piece and the brace that follows it."""
    opened = 0
    for mark in _MARK.findall(piece):
        if mark == '"':
            inside = not inside
        elif mark == "{" and not inside:
            opened += 1
    return inside, opened - (not inside)


def _rows(batch):
    return zip(*(batch.column(c).to_pylist() for c in batch.schema.names))


def _changes(batches):
    """path, start, flips, outside, inside: how each block changes the state, for either state before it."""
    key, state, out = None, None, []
    for batch in batches:
        for piece, path, start in _rows(batch):
            if (path, start) != key:
                if key:
                    out.append((*key, *state))
                key, state, ends = (path, start), None, [False, True]
                depths = [0, 0]
            for i in (0, 1):
                ends[i], opened = _after(piece, ends[i])
                depths[i] += opened
            state = (ends[0], *depths)
    if key:
        out.append((*key, *state))
    columns = list(zip(*out)) or [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "start", "flips", "outside", "inside"])


def _records(batches):
    """path, start, at, begins, ends, text: records, or their fragments where they cross blocks."""
    key, inside, depth, held, at, begins = None, False, 0, [], 0, True

    def row(ends):
        return (*key, at, begins, ends, "".join(held))

    for batch in batches:
        out = []
        for piece, path, start, in_string, opened in _rows(batch):
            if (path, start) != key:
                if held:
                    out.append(row(False))
                key, inside, depth, held, at, begins = (path, start), in_string, opened, [], 0, not opened
            if not depth:
                first = piece.find("{")
                if first < 0:  # between records, or after the last one
                    continue
                piece, begins, held = piece[first:], True, []
            inside, change = _after(piece, inside)
            depth += change
            held.append(piece + "}")
            if depth <= 0:
                out.append(row(True))
                depth, held, at, begins = 0, [], at + 1, True
        columns = list(zip(*out)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "start", "at", "begins", "ends", "text"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(False), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()))], names=["path", "start", "at", "begins", "ends", "text"])


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the arrays in the files under ``path``, in columns of ``schema``; unknown keys are dropped.

    Objects may be nested and strings may hold braces, quotes and escapes. A broken object is a row of nulls. Files of
    more than ``_BLOCKS`` blocks together are an error: read them folder by folder.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    changes = written(raw.mapInArrow(_changes, "path string, start long, flips boolean, outside long, inside long"), "blocks")
    if (n := changes.count()) > _BLOCKS:
        raise ValueError(f"{n} blocks, more than {_BLOCKS}")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = changes.withColumn("_in", F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1)
    states = states.withColumn("_open", F.coalesce(F.sum(F.when(F.col("_in"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    states = written(states.select("path", "start", "_in", F.greatest("_open", F.lit(0).cast("long")).alias("_open")), "states")
    found = raw.join(F.broadcast(states), ["path", "start"]).select("value", "path", "start", "_in", "_open")  # counted above
    found = written(found.mapInArrow(_records, "path string, start long, at int, begins boolean, ends boolean, text string"), "records")
    parts = found.filter("not (begins and ends)").withColumn("_id", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("path").orderBy("start", "at")))
    joined = parts.groupBy("path", "_id").agg(F.array_sort(F.collect_list(F.struct("start", "at", "text"))).alias("_p")).select(F.array_join(F.col("_p.text"), "").alias("text"))
    every = found.filter("begins and ends").select("text").unionByName(joined)
    return every.select(F.from_json("text", schema).alias("x")).select("x.*")
