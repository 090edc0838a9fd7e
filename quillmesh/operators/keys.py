"""Windows by key: first and last wins, ranks, samples, batches, resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def first_wins(df: DataFrame, keys: list[str], *order, blank_exempt: bool = True) -> DataFrame:
    """One row of each key, the first in order; rows with a null key are all kept unless told otherwise.

    Null keys may be many: they don't go through the window. For the rest a key's first row is found
    before and after the shuffle, so a hot key sends one row from each task.
    """
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if not blank_exempt:
        return df.withColumn("_at", at).filter("_at = 1").drop("_at")
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.filter(~null).withColumn("_at", at).filter("_at = 1").drop("_at").unionByName(df.filter(null))


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """The last state of each key: the row that stands first by descending order."""
    return first_wins(df, [key], *order, blank_exempt=False)


def stratified_sample(df: DataFrame, stratum: str, key: str, rate: float, seed: str) -> DataFrame:
    """Of each stratum max(1, half-even round(size * rate)) rows, by hash order: the same rows on any engine."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)))
    # a stratum may be a third of the table: ranks come from one sort of all rows, not from a window by stratum
    ranked = written(global_rank(df.withColumn("_draw", draw), "_at", F.asc(stratum), F.asc("_draw"), F.asc(key)), "ranked")
    sizes = ranked.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    chosen = ranked.join(sizes.hint("merge"), F.col(stratum).eqNullSafe(F.col("_stratum")))
    return chosen.filter(F.col("_at") - F.col("_first") < F.greatest(F.lit(1), F.bround(F.col("_n") * rate))).select(*df.columns)


def simple_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed))), key).limit(n)


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """1..n in a total order without gathering all rows in one task.

    Rows are range-partitioned and sorted; each partition's number of rows, one small row for
    each partition, gives the others' offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(before.drop("_n")), "_part")  # a row for each partition
    return placed.withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_id", "_part", "_in", "_before")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch_no: rows in order of a column, ``size`` to a batch. Ranks go with the key alone, the rest is joined on."""
    ranked = global_rank(df.select(order), "_rank", F.asc(order))
    return df.join(ranked.hint("merge"), order).withColumn("batch_no", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def pending(todo: DataFrame, done: DataFrame, key: str, decision: str) -> DataFrame:
    """What is still to do: rows without a decision that is neither blank nor an error."""
    valid = done.filter((F.coalesce(F.btrim(decision), F.lit("")) != "") & (F.upper(decision) != "ERROR")).select(key)
    return todo.join(valid, key, "left_anti")
