"""Exact top-k inner products by block-at-a-time pruning.

Rows are first made distinct by id and quantised vector. Vectors are range-sorted by their nearest pivot and id and cut into blocks of ``BLOCK`` rows. A block
keeps its forward index (the quantised rows) and the smallest and largest value of each term. The sum over
terms of the query's weight times the extreme that suits its sign bounds every score inside. Per query,
blocks are scored in falling order of that bound until it drops below the k-th best score.

Queries and blocks meet in cells of at most ``QUERIES`` queries and ``ROWS`` rows. A first pass scores only
the best block of each query and cell; the k-th score over all cells is the threshold with which
the second pass starts, so most blocks are never scored. Pivots only make the bounds tight; results are
exact whatever they are.

Defined cases: rows without id or vector, and vectors with null or non-finite components, take no part.
Repeated rows count once; a row never meets rows of its own id. Shorter vectors are padded with zeros.
Equal scores go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm import tables
from notemill.scale import cut

SCALE = 256
BLOCK = 128
QUERIES = 1024  # queries of a cell at most
ROWS = 4096  # rows of a cell, by hash of their block
PIVOTS = 64
LARGEST = 1 << 62
NONE = -np.iinfo(np.int64).max  # below every score; its negative still fits

BLOCKS_DDL = "block long, ids binary, matrix binary, width int"
BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("width", pa.int32())])
FOUND_DDL = "query_id long, version long, vec_id long, score long"
FOUND = pa.schema([(n, pa.int64()) for n in ("query_id", "version", "vec_id", "score")])


def quantised(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(256 x) of every component, as one matrix padded with zeros."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), max(size.max(initial=0), width or 0)), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, column] = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of integers: by floats while every sum stays below 2^53."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("x")
    )


def distinct(rows: DataFrame) -> DataFrame:
    """Rows that differ in id or quantised vector, trailing zeros aside; ``x`` becomes a multiple of 1 / SCALE.

    The aggregation is partial first, so a hot row reaches the shuffle once a task.
    """
    bound = F.lit(float(LARGEST))
    step = lambda v: F.floor(F.greatest(F.least(v * SCALE, bound), -bound)).cast("double") / SCALE
    exact = rows.select("vec_id", F.transform("x", step).alias("x"))
    last = F.array_position(F.reverse(F.transform("x", lambda v: v != 0)), F.lit(True))
    size = F.when(last > 0, F.size("x") - last + 1).otherwise(F.lit(0)).cast("int")
    return exact.select("vec_id", F.slice("x", F.lit(1), size).alias("x")).distinct()


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose id is divisible by ``every``."""
    rows = cut(distinct(valid(vectors, vec_id, embedding)))
    blocks = cut(index_blocks(rows))
    queries = cut(
        rows.where(F.col("vec_id") % every == 0)
        .select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("version"), "x")
        .dropDuplicates(["query_id", "version"])
    )
    query_cells = max(1, math.ceil(queries.count() / QUERIES))
    row_cells = max(1, math.ceil(blocks.count() * BLOCK / ROWS))
    asked = queries.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(query_cells)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(row_cells - 1)))
    )
    held = blocks.withColumn("b", F.pmod(F.xxhash64("block"), F.lit(row_cells)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1)))
    )
    none = asked.withColumn("least", F.lit(None).cast("long"))
    first = meet(none, held, k, only_best=True)
    # The k-th best of a query, or null where it has fewer: a score that its final k-th cannot fall below.
    kth = (
        ranked(first, k).groupBy("query_id", "version").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    )
    known = asked.join(cut(kth), ["query_id", "version"], "left")
    return ranked(meet(known, held, k, only_best=False), k).select("query_id", "rank", "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id", "version").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def index_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the range-sorted rows: ids and forward index."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("x").collect()
    width = max((len(r["x"]) for r in sample), default=0)
    pivots = quantised(pa.array([r["x"] for r in sample], pa.list_(pa.float64())), width) if sample else np.zeros((1, 0), np.int64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pivot", pa.int32()), ("vec_id", pa.int64()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            x = quantised(batch.column("x"), width)[:, :width]
            pivot = product(x, pivots).argmax(axis=1) if width else np.zeros(len(x))
            yield tables.record(schema, [pivot.astype(np.int32), batch.column("vec_id"), batch.column("x")])

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table])
            while left.num_rows > 2 * BLOCK:
                yield block_of(left.slice(0, BLOCK))
                left = left.slice(BLOCK)
        while left is not None and left.num_rows:
            yield block_of(left.slice(0, BLOCK))
            left = left.slice(BLOCK)

    spread = rows.mapInArrow(nearest, "pivot int, vec_id long, x array<double>")
    ordered = spread.repartitionByRange(tables.shuffle_partitions(rows), "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
    return ordered.mapInArrow(cut_blocks, BLOCKS_DDL)


def block_of(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    ids = np.ascontiguousarray(table.column("vec_id").to_numpy())
    matrix = quantised(table.column("x").chunk(0))
    small = matrix.astype(np.int16)
    packed = small if (small == matrix).all() else np.ascontiguousarray(matrix)
    return tables.record(BLOCKS, [[int(ids[0])], [ids.tobytes()], [packed.tobytes()], [packed.shape[1]]])


def meet(asked: DataFrame, held: DataFrame, k: int, only_best: bool) -> DataFrame:
    """Candidates of every query among the blocks of each cell."""

    def search(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not queries.num_rows or not blocks.num_rows:
            return FOUND.empty_table()
        return search_cell(queries, blocks, k, only_best)

    return asked.groupBy("q", "b").cogroup(held.groupBy("q", "b")).applyInArrow(search, FOUND_DDL)


def search_cell(queries: pa.Table, blocks: pa.Table, k: int, only_best: bool) -> pa.Table:
    queries = queries.combine_chunks()
    query_id, version = queries.column("query_id").to_numpy(), queries.column("version").to_numpy()
    least = queries.column("least").fill_null(NONE).to_numpy()
    ids, matrices = [], []
    for raw, packed, width in zip(*(blocks.column(c).to_pylist() for c in ("ids", "matrix", "width")), strict=True):
        ids.append(np.frombuffer(raw, np.int64))
        kind = np.int16 if len(packed) == 2 * width * len(ids[-1]) else np.int64
        matrices.append(np.frombuffer(packed, kind).reshape(len(ids[-1]), width).astype(np.int64))
    q = quantised(queries.column("x").chunk(0))
    width = max(q.shape[1], *(m.shape[1] for m in matrices))
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    q, matrices = pad(q), [pad(m) for m in matrices]
    low, high = np.stack([m.min(axis=0) for m in matrices]), np.stack([m.max(axis=0) for m in matrices])
    bound = product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    scores = np.full((len(q), k), NONE)
    names = np.full((len(q), k), np.iinfo(np.int64).max)
    every = np.arange(len(q))
    for turn in range(1 if only_best else len(matrices)):
        block = order[:, turn]
        reach = np.maximum(scores[:, -1], least)
        live = bound[every, block] >= reach
        if not live.any():
            break
        for b in np.unique(block[live]):
            rows = np.flatnonzero(live & (block == b))
            score = product(q[rows], matrices[b])
            score[ids[b][None, :] == query_id[rows, None]] = NONE
            useful = (score >= np.maximum(reach[rows, None], NONE + 1)).any(axis=1)
            rows, score = rows[useful], score[useful]
            if len(rows):
                merged = np.hstack([scores[rows], score])
                merged_ids = np.hstack([names[rows], np.broadcast_to(ids[b], score.shape)])
                best = np.lexsort((merged_ids, -merged), axis=1)[:, :k]
                scores[rows] = np.take_along_axis(merged, best, 1)
                names[rows] = np.take_along_axis(merged_ids, best, 1)
    row, place = np.nonzero((scores > NONE) & (scores >= least[:, None]))
    return pa.table([pa.array(a) for a in (query_id[row], version[row], names[row, place], scores[row, place])], schema=FOUND)


TOP_K_SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
