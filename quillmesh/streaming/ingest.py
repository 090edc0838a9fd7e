"""Ingest without repeats: a record is new if neither its DOI nor its title has arrived within a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import norm_doi, norm_title


class _FirstOfKey(StatefulProcessor):
    """Lets the first record of a key through; the key is forgotten ``keep_ms`` after it was last seen (0: never)."""

    def __init__(self, schema: T.StructType, order: str, keep_ms: int):
        self.columns, self.order, self.keep_ms = schema.fieldNames(), order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("times", T.LongType())]), **({"ttlDurationMs": self.keep_ms} if self.keep_ms else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, count, first = self.seen.get() if self.seen.exists() else None, 0, None
        for frame in rows:  # only the first row so far is kept, however many a hot key has
            count += len(frame)
            best = frame.sort_values(self.order, kind="stable").head(1)
            if first is None or best[self.order].iloc[0] < first[self.order].iloc[0]:
                first = best
        self.seen.update(((before[0] if before else 0) + count,))
        yield first[self.columns] if before is None and first is not None else pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def _firsts(order: str):
    """Of the rows of a task the first one of each key; merged whenever as many rows wait as are kept."""

    def first(rows: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(rows).combine_chunks()
        table = table.take(pc.sort_indices(table, [(order, "ascending")]))
        keys = table.column("_key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return table.take(pa.array(np.unique(keys, return_index=True)[1]))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, waiting = [], 0, 0
        for batch in batches:
            kept.append(batch)
            waiting += batch.num_rows
            if waiting > size + 10_000:
                kept = first(kept).to_batches()
                size, waiting = sum(b.num_rows for b in kept), 0
        if kept:
            yield from first(kept).to_batches()

    return reduce


def _first_of(stream: DataFrame, key: Column, order: str, keep_ms: int) -> DataFrame:
    """The first record of each key; rows without a key pass by it, dealt by a key of their own.

    Keys that are kept for ever: the tasks reduce a batch to the first row of each key, and Spark's own stateful
    ``dropDuplicates`` says which keys are new, without a call to Python for each. Keys that are forgotten: ``_FirstOfKey``.
    """
    schema = T.StructType(stream.schema.fields)
    keyed = stream.withColumn("_key", F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("n"), F.col(order).cast("string"))))
    if keep_ms:
        return keyed.groupBy("_key").transformWithStateInPandas(_FirstOfKey(schema, order, keep_ms), schema, "Append", "ProcessingTime")
    return keyed.repartition("_key").mapInArrow(_firsts(order), keyed.schema).dropDuplicates(["_key"]).select(*schema.fieldNames())


def distinct_arrivals(stream: DataFrame, order: str, keep_ms: int = 0) -> DataFrame:
    """``stream`` without records whose DOI, or else whose title, has arrived before.

    Reads doi, title and ``order`` (a number unique to each record; the smallest of a batch comes first).
    Two keyed states, one after the other: what the DOI lets through is looked up by title. A task holds the keys of its share of one batch. Blank keys match nothing. As in the batch
    form (two passes of ``keys.first_wins``), a record that only its title stops has used up its DOI. ``keep_ms``: how long a key is
    remembered after it was last seen; 0 for ever. Needs the RocksDB state store.
    """
    by_doi = _first_of(stream, norm_doi(F.col("doi")), order, keep_ms)
    title = F.nullif(norm_title(F.col("title")), F.lit(""))
    return _first_of(by_doi, title, order, keep_ms)
