"""Exact top-k search by a three-phase uniform threshold.

A vector is cut into ``slices`` runs of components; every (query, slice) pair has a list of
partial scores over all rows, and the lists of different slices are held by different tasks.
Phase 1 gathers the k best entries of each list and resolves their exact totals; the k-th best
of a query's totals is a safe cutoff. Phase 2 sends the cutoff to the lists: an entry whose every
partial score is below cutoff / slices has a total below the cutoff, so a list gives up only the
entries that reach that share. Phase 3 resolves the missing partial scores of these exactly and ranks.

Queries and rows are laid out on a grid: cell (a, b) holds one shard of the queries and one
shard of the rows, both of bounded size, so no task sees all queries or all rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_BLOCK = "block long, slice int, dims int, n int, ids binary, data binary"
_LOW = np.iinfo(np.int64).min
_HUGE = float(np.finfo(np.float64).max)


def _packed(rows: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of two integer types, or as the doubles they are; the length tells which."""
    most = np.abs(rows).max(initial=0.0)
    return rows.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64).tobytes()


def _blocks_of(size: int, slices: int):
    def blocks(batches):
        """Vectors to blocks of at most ``size`` rows of equal length, a row for each slice; scaled to whole numbers."""
        base, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def emit(dims, parts):
            nonlocal made
            ids, rows = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            for at in range(0, len(ids), size):
                made += 1
                some = ids[at : at + size]
                for i, part in enumerate(np.array_split(rows[at : at + size], slices, axis=1)):
                    yield pa.RecordBatch.from_pydict({"block": [base + made], "slice": pa.array([i], pa.int32()), "dims": pa.array([dims], pa.int32()), "n": pa.array([len(some)], pa.int32()), "ids": [some.tobytes()], "data": [_packed(part)]})

        for batch in batches:
            vectors = batch.column("embedding")
            lengths = np.diff(vectors.offsets.to_numpy())
            with np.errstate(over="ignore"):
                flat = np.floor(64.0 * vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].astype(np.float64))
            flat = np.clip(flat, -_HUGE, _HUGE)
            ids, starts = batch.column("vec_id").to_numpy(), np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                mine = np.flatnonzero(lengths == dims)
                held.setdefault(int(dims), []).append((ids[mine], flat[starts[mine][:, None] + np.arange(dims)]))
                if sum(len(x[0]) for x in held[int(dims)]) >= size:
                    yield from emit(int(dims), held.pop(int(dims)))
        for dims, parts in held.items():
            yield from emit(dims, parts)

    return blocks


def _exact(q: np.ndarray, r: np.ndarray, multiply) -> np.ndarray:
    """A product of whole numbers: in floats where every sum is exact in them, else in Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, q.shape[-1])
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return multiply(q.astype(kind), r.astype(kind)).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return multiply(whole(q), whole(r)) if q.shape[-1] else np.zeros(multiply(q, r).shape, np.int64)


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; what is beyond them counts as the nearest (the lowest one is kept for "none")."""
    return scores if scores.dtype == np.int64 else np.minimum(np.maximum(scores, _LOW + 1), -(_LOW + 1)).astype(np.int64)


def _sides(table: pa.Table):
    """A cell's query blocks and row blocks: {(is_query, block): (dims, ids, {slice: matrix})}."""
    found: dict = {}
    for row in table.to_pylist():
        n, data = row["n"], row["data"]
        width = len(data) // n
        cells = max(1, len(np.array_split(np.empty(row["dims"]), row["slices"])[row["slice"]]))
        kind = {2: np.int16, 4: np.int32}.get(width // cells, np.float64)
        entry = found.setdefault((row["is_query"], row["block"]), (row["dims"], np.frombuffer(row["ids"], np.int64), {}))
        entry[2][row["slice"]] = np.frombuffer(data, kind).reshape(n, -1) if data else np.zeros((n, 0))
    return found


def _pairs(found: dict):
    """Query blocks with the row blocks of as many components."""
    rows = [(block, x) for (is_query, block), x in found.items() if not is_query]
    for (is_query, q_block), (dims, q_ids, q) in found.items():
        if is_query:
            yield q_block, q_ids, q, [(block, ids, r) for block, (d, ids, r) in rows if d == dims]


def _best(q: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Indices of each q's k highest scores, ties to the smaller."""
    order = np.lexsort((tie, ~score, q))
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _gather(k: int):
    def gather(key, table):
        """Phase 1: the k best entries of this cell's part of each list."""
        out = defaultdict(list)
        for q_block, q_ids, q, others in _pairs(_sides(table)):
            found = []
            for block, ids, r in others:
                (i,) = q
                p = _held(_exact(q[i], r[i].T, np.matmul))
                p[q_ids[:, None] == ids[None, :]] = _LOW
                take = min(k, len(ids))
                at = np.argpartition(~p, take - 1, axis=1)[:, :take].ravel()
                q_at = np.repeat(np.arange(len(q_ids)), take)
                some = p[q_at, at]
                keep = some != _LOW
                found.append((q_at[keep], np.full(keep.sum(), block), at[keep], some[keep]))
            if found:
                q_at, blocks, at, some = map(np.concatenate, zip(*found))
                top = _best(q_at, some, at, k)
                for name, x in zip(("q_at", "block", "at", "part"), (q_at, blocks, at, some)):
                    out[name].append(x[top])
                out["q_block"].append(np.full(len(top), q_block))
        columns = {n: np.concatenate([*out[n], np.zeros(0, np.int64)]).astype(np.int64) for n in ("q_block", "q_at", "block", "at", "part")}
        return pa.table({"cell": pa.array([key[0].as_py()] * len(columns["at"]), pa.int64()), "slice": pa.array([key[1].as_py()] * len(columns["at"]), pa.int32()), **columns})

    return gather


def _reaching(slices: int):
    def reach(key, table, cutoffs):
        """Phase 2: of this cell's part of each list, the entries that reach the cutoff's share."""
        least = {x["q_block"]: dict(zip(x["q_ats"], x["cutoffs"])) for x in cutoffs.to_pylist()}
        out = []
        for q_block, q_ids, q, others in _pairs(_sides(table)):
            known = least.get(q_block, {})
            cutoff = np.array([known.get(i, _LOW // slices) for i in range(len(q_ids))])
            for block, ids, r in others:
                (i,) = q
                p = _exact(q[i], r[i].T, np.matmul)
                share = -(-cutoff // slices)  # p * slices >= cutoff
                q_at, at = np.nonzero((p >= share[:, None]).astype(bool) & (q_ids[:, None] != ids[None, :]))
                if len(at):
                    out.append((q_block, block, q_at, at))
        kind = pa.list_(pa.int32())
        return pa.table({"cell": pa.array([key[0].as_py()] * len(out), pa.int64()), "q_block": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int64()), "q_ats": pa.array([x[2] for x in out], kind), "ats": pa.array([x[3] for x in out], kind)})

    return reach


def _resolve(k: int):
    def resolve(key, table, wanted):
        """Exact totals of the entries wanted; of each query the k best in this cell."""
        found, asked = _sides(table), defaultdict(list)
        lists = [wanted.column(n).combine_chunks() for n in ("q_ats", "ats")]
        for i, pair in enumerate(zip(wanted.column("q_block").to_pylist(), wanted.column("block").to_pylist())):
            asked[pair].append(tuple(x[i].values.to_numpy().astype(np.int64) for x in lists))
        out = defaultdict(list)
        for (q_block, block), parts in asked.items():
            _, q_ids, q = found[True, q_block]
            _, ids, r = found[False, block]
            q_at, at = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            q_at, at = np.divmod(np.unique(q_at * len(ids) + at), len(ids))
            total = _held(sum(_exact(q[i][q_at], r[i][at], lambda x, y: (x * y).sum(axis=1)) for i in q))
            top = _best(q_at, total, ids[at], k)
            for name, x in zip(("q_at", "query_id", "vec_id", "score"), (q_at, q_ids[q_at], ids[at], total)):
                out[name].append(x[top])
            out["q_block"].append(np.full(len(top), q_block))
        return pa.table({n: np.concatenate([*out[n], np.zeros(0, np.int64)]).astype(np.int64) for n in ("q_block", "q_at", "query_id", "vec_id", "score")})

    return resolve


def _grid(queries: DataFrame, rows: DataFrame, slices: int, query_blocks: int, row_blocks: int, lanes: int):
    """Blocks in their cells, and the columns (shard of a query block, all cells of it, cell of a pair)."""
    n_queries, n_rows = (max(1, x.filter("slice = 0").count()) for x in (queries, rows))
    across = -(-n_queries // query_blocks)
    down = max(-(-n_rows // row_blocks), min(n_rows, -(-lanes // across)))
    shard = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pair = shard("q_block", across) * down + shard("block", down)
    cells_of = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")), lambda b: shard(c, across) * down + b)
    columns = ("block", "slice", "dims", "n", "ids", "data")
    mine = queries.select(F.explode(cells_of("block")).alias("cell"), F.lit(True).alias("is_query"), *columns)
    theirs = rows.select(every(across).alias("a"), F.lit(False).alias("is_query"), *columns).select((F.col("a") * down + shard("block", down)).alias("cell"), "is_query", *columns)
    return mine.unionByName(theirs).withColumn("slices", F.lit(slices)), cells_of, pair


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, slices: int = 2, query_rows: int = 256, block_rows: int = 4096, query_blocks: int = 64, row_blocks: int = 16) -> DataFrame:
    """For each vector whose ``vec_id`` is divisible by ``query_every``: its ``k`` best others.

    ``vectors``: vec_id, embedding (array of numbers); other columns are ignored. Components
    count as floor(64 * x). Result: query_id, rank, vec_id, score; ties go to the smaller vec_id.
    Vectors that are null, or hold null, NaN or infinite components, and rows without vec_id take
    no part; empty vectors score 0 with each other. Vectors are compared with those of equal
    length only. Of rows that repeat a vec_id each is a candidate, and all that are queries share one
    ranking. Scores beyond a long count as the nearest long. An empty table gives no rows. A cell
    holds ``query_blocks`` blocks of ``query_rows`` queries and ``row_blocks`` blocks of ``block_rows``
    rows, or about so many: what a task holds does not grow with the table.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    clean = vectors.select("vec_id", x.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # written once: all phases must see the same queries in the same blocks, also after a retry
    scratch = Scratch(spark, "topk")
    rows = scratch.cut(clean.mapInArrow(_blocks_of(block_rows, slices), _BLOCK), "rows")
    queries = scratch.cut(clean.filter(F.col("vec_id") % query_every == 0).mapInArrow(_blocks_of(query_rows, slices), _BLOCK), "queries")
    grid, cells_of, pair = _grid(queries, rows, slices, query_blocks, row_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))

    entry = "cell long, slice int, q_block long, q_at long, block long, at long, part long"
    totals = "q_block long, q_at long, query_id long, vec_id long, score long"
    local = grid.groupBy("cell", "slice").applyInArrow(_gather(k), entry)
    best = Window.partitionBy("q_block", "q_at", "slice").orderBy(F.desc("part"), "block", "at")
    some = local.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= k)
    some = some.groupBy("cell", "q_block", "block").agg(F.collect_list(F.col("q_at").cast("int")).alias("q_ats"), F.collect_list(F.col("at").cast("int")).alias("ats"))
    first = grid.groupBy("cell").cogroup(some.groupBy("cell")).applyInArrow(_resolve(k), totals)
    by_score = Window.partitionBy("q_block", "q_at").orderBy(F.desc("score"), "vec_id")
    cutoffs = first.withColumn("_at", F.row_number().over(by_score)).filter(F.col("_at") == k)
    cutoffs = scratch.cut(cutoffs.groupBy("q_block").agg(F.collect_list(F.col("q_at").cast("int")).alias("q_ats"), F.collect_list("score").alias("cutoffs")), "cutoffs")

    sent = cutoffs.select(F.explode(cells_of("q_block")).alias("cell"), "q_block", "q_ats", "cutoffs").select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "cell", "q_block", "q_ats", "cutoffs")
    reached = grid.groupBy("cell", "slice").cogroup(sent.groupBy("cell", "slice")).applyInArrow(_reaching(slices), "cell long, q_block long, block long, q_ats array<int>, ats array<int>")
    found = grid.groupBy("cell").cogroup(reached.groupBy("cell")).applyInArrow(_resolve(k), totals)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
