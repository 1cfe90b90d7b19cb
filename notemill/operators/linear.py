"""Linear machines on the squared hinge loss, with an L2 or an L1 penalty, by quasi-Newton steps.

The objective is ``penalty(w) + C * sum(weight * max(0, 1 - y * w.x) ** 2)`` with ``0.5 * |w|^2`` or
``|w|_1`` as penalty; the intercept is one more weight, of a feature that is always 1, and is penalised
like the others. Rows are packed into numeric blocks once. Every evaluation is one pass over the blocks:
a task adds up the loss and the gradient of its blocks and returns one vector, and there are as many
tasks as cores. The driver holds a few vectors as long as the vocabulary, never rows.

Steps are limited-memory BFGS; for L1 they stay inside the orthant that the pseudo-gradient points to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096
MEMORY = 10  # steps whose curvature is remembered
HALVINGS = 30
LOSS = -1  # stands for the loss among the features' sums
BLOCKS = pa.schema([(n, pa.binary()) for n in ("y", "c", "ends", "found", "place", "value")])
BLOCKS_DDL = "y binary, c binary, ends binary, found binary, place binary, value binary"
SUMS = pa.schema([("sums", pa.binary())])
SUMS_DDL = "sums binary"


def sparse_rows(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, indices and values of vectors as Arrow holds them; a dense one lists all its places."""
    values, indices = vectors.field("values"), vectors.field("indices")
    counts = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts, dtype=np.int64)
    if indices.null_count == 0:
        index = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        listed = [np.arange(n) if i is None else np.asarray(i) for n, i in zip(counts, indices.to_pylist())]
        index = np.concatenate([*listed, np.zeros(0)]).astype(np.int64)
    return ends, index, values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            ends, index, value = sparse_rows(part.column("features"))
            found, place = np.unique(index, return_inverse=True)
            y = np.where(part.column("label").to_numpy() > 0, 1.0, -1.0)
            c = part.column("weight").to_numpy().astype(np.float64)
            arrays = y, c, ends, found.astype(np.int32), place.astype(np.int32), value
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], schema=BLOCKS)


def margins(w: np.ndarray, ends: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Products of the rows and the weights, the last of which is the intercept."""
    running = np.concatenate([[0.0], np.cumsum(w[index] * value)])
    return np.diff(running[np.concatenate([[0], ends])]) + w[-1]


def block_sums(w: np.ndarray, row: dict[str, pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
    """(features, sums): the block's loss under LOSS, and its gradient by feature.

    The block's features are numbered when it is packed, so no pass sorts them again.
    """
    y, c, value = (np.frombuffer(row[n], np.float64) for n in ("y", "c", "value"))
    ends = np.frombuffer(row["ends"], np.int64)
    found, place = (np.frombuffer(row[n], np.int32) for n in ("found", "place"))
    short = np.maximum(0.0, 1.0 - y * margins(np.append(w[found], w[-1]), ends, place, value))
    slope = -2.0 * c * y * short
    each = np.bincount(place, np.repeat(slope, np.diff(ends, prepend=0)) * value, len(found))
    return np.concatenate([[LOSS, len(w) - 1], found]), np.concatenate([[(c * short * short).sum(), slope.sum()], each])


@dataclass(frozen=True)
class LinearModel:
    """Weights of the features and, last, the intercept; predicts 1 where the margin is positive."""

    weights: np.ndarray
    objectives: tuple[float, ...] = field(default=())

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.weights[:-1])

    @property
    def intercept(self) -> float:
        return float(self.weights[-1])

    def transform(self, docs: DataFrame) -> DataFrame:
        weights = docs.sparkSession.sparkContext.broadcast(self.weights)
        held = [c for c in docs.columns if c not in ("rawPrediction", "prediction", "_margin")]

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = margins(weights.value, *sparse_rows(batch.column("features")))
                yield pa.RecordBatch.from_arrays([batch.column("_rest"), pa.array(made)], names=["_rest", "_margin"])

        rest = [c for c in held if c != "features"]
        rows = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"), "features")
        schema = T.StructType([rows.schema["_rest"], T.StructField("_margin", T.DoubleType())])
        out = rows.mapInArrow(judged, schema).select(*[F.col(f"_rest.`{c}`").alias(c) for c in rest], "_margin")
        return out.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin")))).select(
            *rest, "rawPrediction", (F.col("_margin") > 0).cast("double").alias("prediction")
        )


@dataclass(frozen=True)
class SquaredHinge:
    """Estimator over ``features``, ``label`` and, if named, a weight column."""

    C: float = 1.0
    penalty: str = "l2"
    tol: float = 1e-4
    max_iter: int = 100
    weight: str | None = None

    def __post_init__(self) -> None:
        if self.penalty not in ("l1", "l2"):
            raise ValueError(f"unknown penalty {self.penalty!r}")

    def fit(self, docs: DataFrame) -> LinearModel:
        weight = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        rows = docs.select("features", F.col("label").cast("double").alias("label"), (weight * self.C).alias("weight"))
        cores = docs.sparkSession.sparkContext.defaultParallelism
        # Kept, not written: blocks are as large as the vectors, and are let go of before the next fit packs its own.
        blocks = rows.coalesce(cores).mapInArrow(packed, BLOCKS_DDL).persist()
        first = docs.select("features").first()
        size = (first["features"].size if first is not None else 0) + 1

        def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
            return summed(blocks, w)

        try:
            w, values = minimise(evaluate, size, self.penalty == "l1", self.tol, self.max_iter)
        finally:
            blocks.unpersist()
        return LinearModel(w, tuple(values))


def summed(blocks: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all blocks."""
    spark = blocks.sparkSession
    held = spark.sparkContext.broadcast(w)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value) + 1)  # the loss stands before the features
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_buffer() for n in BLOCKS.names}
                index, sums = block_sums(held.value, row)
                total[index - LOSS] += sums  # a block has each feature once
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=SUMS)

    # One vector a task reaches the driver, and there are as many tasks as cores.
    total = np.zeros(len(w) + 1)
    for part in blocks.mapInArrow(partial, SUMS_DDL).toArrow().column("sums"):
        total += np.frombuffer(part.as_buffer(), np.float64)
    held.unpersist()
    return float(total[0]), total[1:]


def pseudo_gradient(w: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """The gradient of loss and L1 norm where there is one, else its smallest one-sided slope."""
    at_zero = np.where(gradient + 1 < 0, gradient + 1, np.where(gradient - 1 > 0, gradient - 1, 0.0))
    return np.where(w > 0, gradient + 1, np.where(w < 0, gradient - 1, at_zero))


def minimise(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, l1: bool, tol: float, max_iter: int
) -> tuple[np.ndarray, list[float]]:
    """The weights of least loss and penalty, and the objective after every step."""

    def objective(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient = evaluate(w)
        if l1:
            return loss + np.abs(w).sum(), gradient, pseudo_gradient(w, gradient)
        return loss + 0.5 * (w @ w), gradient + w, gradient + w

    w = np.zeros(size)
    value, gradient, slope = objective(w)
    start = np.abs(slope).max(initial=0.0)
    values, steps = [value], []
    for _ in range(max_iter):
        if np.abs(slope).max(initial=0.0) <= tol * max(1.0, start):
            break
        direction = -two_loops(slope, steps)
        if l1:
            direction[direction * slope >= 0] = 0.0
        if direction @ slope >= 0:
            direction, steps = -slope, []
        rate = 1.0 if steps else 1.0 / max(1.0, np.abs(slope).sum())
        orthant = np.where(w != 0, np.sign(w), -np.sign(slope))
        for _ in range(HALVINGS):
            tried = w + rate * direction
            if l1:
                tried[tried * orthant < 0] = 0.0
            new, new_gradient, new_slope = objective(tried)
            if new <= value + 1e-4 * (slope @ (tried - w)):
                break
            rate /= 2
        else:
            break
        moved, turned = tried - w, new_gradient - gradient
        if moved @ turned > 1e-12 * (turned @ turned):
            steps = [*steps, (moved, turned)][-MEMORY:]
        w, value, gradient, slope = tried, new, new_gradient, new_slope
        values.append(value)
    return w, values


def two_loops(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse curvature that the remembered steps imply."""
    out, kept = slope.copy(), []
    for moved, turned in reversed(steps):
        share = (moved @ out) / (moved @ turned)
        out -= share * turned
        kept.append(share)
    if steps:
        moved, turned = steps[-1]
        out *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(steps, reversed(kept), strict=True):
        out += (share - (turned @ out) / (moved @ turned)) * moved
    return out
