"""Random forests over sparse rows: trees grow level by level from histograms of the values that rows hold.

A row costs its filled places, not the vocabulary. Thresholds of a feature come from a bounded sample of the rows, as
in Spark's forest. Rows are packed once into blocks that hold the bin of every value whose feature has a threshold.
Every pass splits as many nodes as fit ``CELLS`` sums: a task adds up its blocks and sends the sums that are not
zero, by part of the features; each part is added up by one task, which finds its best split of every node. What a
feature's values leave of a node's sum belongs to the bin of zero. The driver holds trees, thresholds and the best splits.

A tree sees every row Poisson(1) times; a node chooses among ``max_features`` of all features, its split has the
largest gain of Gini impurity, ties to the smaller feature. Sibling leaves of equal prediction become one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions.text import let
from notemill.operators.linear import sparse_rows
from notemill.scale import cut

BLOCK_ROWS = 4096
BINS = 32
SAMPLE_ROWS = 10_000  # rows that thresholds are taken from
CELLS = 1 << 23  # sums a task holds in a pass
ROOT = 1  # a node's children are 2n (at most the threshold) and 2n + 1
SEEDS = 1 << 63

BLOCKS = pa.schema([(n, pa.binary()) for n in ("draw", "y", "c", "ends", "slot")])
BLOCKS_DDL = "draw binary, y binary, c binary, ends binary, slot binary"
SUMS = pa.schema([("part", pa.int32()), ("gaps", pa.binary()), ("sums", pa.binary())])
SUMS_DDL = "part int, gaps binary, sums binary"
BEST_DDL = "node int, gain double, slot long, left binary"


@dataclass
class Tree:
    """Splits (feature, threshold) and class sums of the nodes. While it grows, its splits are (place in ``Bins``, slot)."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)

    def pruned(self) -> Tree:
        """Without splits whose two sides are leaves of one prediction."""
        splits = dict(self.splits)
        for n in sorted(splits, reverse=True):
            sides = 2 * n, 2 * n + 1
            if not any(s in splits for s in sides) and self.sums[sides[0]].argmax() == self.sums[sides[1]].argmax():
                del splits[n]
        held = {ROOT, *(s for n in splits for s in (2 * n, 2 * n + 1))}
        return Tree(splits, {n: self.sums[n] for n in sorted(held)})


@dataclass(frozen=True)
class Bins:
    """Bins of the features with thresholds; their slots are numbered through, in the order of the features."""

    features: np.ndarray
    ends: np.ndarray  # of each feature's thresholds
    thresholds: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The first slot of each feature, and the number of slots; there is a slot more than thresholds."""
        return np.concatenate([[0], self.ends + np.arange(1, len(self.ends) + 1)])

    def slots(self, which: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Slots of values of the features at the places ``which``: how many of the thresholds lie below."""
        start = np.concatenate([[0], self.ends])[which]
        low, high = start.copy(), self.ends[which]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            above = open_ & (value > self.thresholds[np.minimum(middle, len(self.thresholds) - 1)])
            high = np.where(open_ & ~above, middle, high)
            low = np.where(above, middle + 1, low)
        return self.first[which] + low - start

    def zeros(self) -> np.ndarray:
        return self.slots(np.arange(len(self.features)), np.zeros(len(self.features)))

    def threshold(self, which: int, slot: int) -> tuple[int, float]:
        """(feature, threshold) between a slot and the next."""
        return int(self.features[which]), float(self.thresholds[slot - which])


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> list[float]:
    """Thresholds of one feature from its ascending distinct values and their weights."""
    if len(values) <= bins:
        return ((values[:-1] + values[1:]) / 2).tolist()
    stride = weights.sum() / bins
    out, target, seen = [], stride, weights[0]
    for i in range(1, len(values)):
        before, seen = seen, seen + weights[i]
        if abs(before - target) < abs(seen - target):
            out.append(float(values[i - 1] + values[i]) / 2)
            target += stride
    return out


def find_bins(rows: DataFrame, count: int, weight: float, seed: int) -> Bins:
    """Thresholds of the features that have two values or more in a sample of bounded size.

    A feature's zeros make up the weight that the sample should have, so that it is read once and not written.
    """
    share = min(1.0, SAMPLE_ROWS / count)
    sample, total = rows if share == 1.0 else rows.sample(fraction=share, seed=seed), share * weight
    held = F.unwrap_udt("features")
    places = F.coalesce(held["indices"], F.transform(held["values"], lambda _, i: i))
    sample = sample.select("weight", F.arrays_zip(places.alias("index"), held["values"].alias("value")).alias("held"))
    bins = min(BINS, count)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                values, weights = (np.array([pair[n] for pair in row["held"]]) for n in ("value", "weight"))
                empty = total - weights.sum()
                if empty > 1e-9 * total:
                    at = np.searchsorted(values, 0.0)
                    values, weights = np.insert(values, at, 0.0), np.insert(weights, at, empty)
                out.append(cut_points(values, weights, bins))
            yield pa.RecordBatch.from_arrays([batch.column("index"), pa.array(out, pa.list_(pa.float64()))], names=["index", "points"])

    found = (
        sample.select("weight", F.inline("held")).where("value <> 0").groupBy("index", "value").agg(F.sum("weight").alias("weight"))
        .groupBy("index").agg(F.sort_array(F.collect_list(F.struct("value", "weight"))).alias("held"))
        .mapInArrow(points, "index int, points array<double>").where("size(points) > 0")
    )
    # No more thresholds than the sample has values.
    told = found.toArrow().sort_by("index").combine_chunks()
    lists = told.column("points").to_pylist()
    return Bins(
        np.asarray(told.column("index"), np.int64),
        np.cumsum([len(p) for p in lists], dtype=np.int64),
        np.array([x for p in lists for x in p], np.float64),
    )


def routed(rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, trees: Sequence[Tree], zeros: np.ndarray) -> np.ndarray:
    """The node of each tree that each row comes to, by its filled places; ``zeros`` are each feature's values elsewhere."""
    node = np.full((len(trees), rows), ROOT, np.int64)
    used = np.array(sorted({f for t in trees for f, _ in t.splits.values()}), np.int64)
    if not len(used):
        return node
    known = np.zeros(len(zeros), bool)
    known[used] = True
    held = known[feature]
    row, feature, value = row[held], feature[held], value[held]
    order = np.argsort(feature, kind="stable")
    row, feature, value = row[order], feature[order], value[order]
    for at, tree in zip(node, trees, strict=True):
        for n in sorted(tree.splits):
            f, threshold = tree.splits[n]
            left = np.full(rows, zeros[f] <= threshold)
            a, b = np.searchsorted(feature, [f, f + 1])
            left[row[a:b]] = value[a:b] <= threshold
            here = at == n
            at[here] = 2 * n + ~left[here]
    return node


@dataclass(frozen=True)
class ForestModel:
    trees: tuple[Tree, ...]
    classes: int
    size: int

    def transform(self, docs: DataFrame) -> DataFrame:
        trees = docs.sparkSession.sparkContext.broadcast(self.trees)
        made = ("rawPrediction", "probability", "prediction", "_votes")
        rest = [c for c in docs.columns if c != "features" and c not in made]
        classes, size = self.classes, self.size

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            zeros = np.zeros(size)
            for batch in batches:
                ends, index, value = sparse_rows(batch.column("features"))
                node = routed(len(ends), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), index, value, trees.value, zeros)
                votes = np.zeros((len(ends), classes))
                for at, tree in zip(node, trees.value, strict=True):
                    names = np.array(sorted(tree.sums))
                    shares = np.array([tree.sums[n] / (tree.sums[n].sum() or 1.0) for n in names])  # a tree may have drawn no row
                    votes += shares[np.searchsorted(names, at)]
                starts = pa.array(np.arange(len(ends) + 1) * classes, pa.int32())
                lists = pa.ListArray.from_arrays(starts, pa.array(votes.ravel()))
                best = pa.array(votes.argmax(axis=1).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("_rest"), lists, best], names=["_rest", "_votes", "prediction"])

        rows = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"), "features")
        schema = T.StructType(
            [rows.schema["_rest"], T.StructField("_votes", T.ArrayType(T.DoubleType())), T.StructField("prediction", T.DoubleType())]
        )
        votes = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
        return rows.mapInArrow(judged, schema).select(
            *[F.col(f"_rest.`{c}`").alias(c) for c in rest],
            array_to_vector("_votes").alias("rawPrediction"),
            array_to_vector(let(votes, lambda n: F.transform("_votes", lambda v: F.when(n > 0, v / n).otherwise(v)))).alias("probability"),
            "prediction",
        )


def chosen_features(max_features: str, trees: int, size: int) -> int:
    """How many features a node chooses among, by the names that Spark gives."""
    if max_features == "auto":
        max_features = "all" if trees == 1 else "sqrt"
    named = {"all": size, "sqrt": math.ceil(math.sqrt(size)), "log2": max(1, math.ceil(math.log2(size))), "onethird": math.ceil(size / 3)}
    if max_features in named:
        return named[max_features]
    if max_features.isdigit() and int(max_features) > 0:
        return min(int(max_features), size)
    share = float(max_features)
    if not 0 < share <= 1:
        raise ValueError(f"max_features {max_features!r}")
    return math.ceil(share * size)


@dataclass(frozen=True)
class SparseForest:
    """Estimator over ``features``, ``label`` and, if named, a weight column."""

    trees: int = 20
    max_depth: int = 5
    max_features: str = "auto"
    seed: int = 0
    weight: str | None = None
    bootstrap: bool = True

    def fit(self, docs: DataFrame) -> ForestModel:
        weight = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        rows = docs.select("features", F.col("label").cast("double").alias("label"), weight.alias("weight"))
        held = F.unwrap_udt("features")
        wrong = F.col("label").isNull() | (F.col("label") < 0) | (F.col("label") != F.floor("label")) | F.col("features").isNull()
        told = rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(wrong).alias("wrong"),
            F.max("label").alias("label"),
            F.sum("weight").alias("weight"),
            F.max(F.coalesce(held["size"], F.size(held["values"]))).alias("size"),
        ).first()
        if told["wrong"] or not told["rows"]:
            raise ValueError(f"{told['rows']} rows, {told['wrong']} of them without a vector or a class from 0 on")
        size, classes = told["size"], int(told["label"]) + 1
        bins = find_bins(rows, told["rows"], told["weight"], self.seed)
        cores = docs.sparkSession.sparkContext.defaultParallelism
        blocks = cut(rows.coalesce(cores).mapInArrow(packer(bins, size), BLOCKS_DDL))
        grower = Grower(blocks, bins, size, classes, self, min(cores, max(1, len(bins.features))))
        return ForestModel(tuple(t.pruned() for t in grower.grown()), classes, size)


def packer(bins: Bins, size: int):
    """Rows to blocks, with the slots of the values whose feature has thresholds."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.full(size, -1, np.int64)
        which[bins.features] = np.arange(len(bins.features))
        partition, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                ends, index, value = sparse_rows(part.column("features"))
                held = (which[index] >= 0) & (value != 0)
                ends = np.concatenate([[0], np.cumsum(held)])[ends].astype(np.int32)
                slot = bins.slots(which[index[held]], value[held]).astype(np.int32)
                y = part.column("label").to_numpy().astype(np.int32)
                c = part.column("weight").to_numpy().astype(np.float64)
                draw = np.array([partition, number], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (draw, y, c, ends, slot)], schema=BLOCKS)
                number += 1

    return packed


@dataclass(frozen=True)
class Grower:
    """Grows the trees of a forest over packed blocks."""

    blocks: DataFrame
    bins: Bins
    size: int
    classes: int
    forest: SparseForest
    parts: int

    def grown(self) -> list[Tree]:
        trees = [Tree(sums={ROOT: sums}) for sums in self.root_sums()]
        slots, depth = int(self.bins.first[-1]), self.forest.max_depth
        open_ = lambda t, n: n.bit_length() <= depth and (trees[t].sums[n] > 0).sum() > 1
        waiting = [(t, ROOT) for t in range(len(trees)) if slots and open_(t, ROOT)]
        most = max(1, CELLS // max(1, self.classes * slots))
        while waiting:
            now, waiting = sorted(waiting[:most]), waiting[most:]
            for (t, n), (slot, left) in self.best_splits(trees, now).items():
                tree, right = trees[t], trees[t].sums[n] - left
                tree.splits[n] = int(np.searchsorted(self.bins.first, slot, "right")) - 1, slot
                tree.sums[2 * n], tree.sums[2 * n + 1] = left, np.where(right > 1e-9 * tree.sums[n], right, 0.0)
                waiting += [(t, s) for s in (2 * n, 2 * n + 1) if open_(t, s)]
        return [Tree({n: self.bins.threshold(*s) for n, s in t.splits.items()}, t.sums) for t in trees]

    def root_sums(self) -> np.ndarray:
        """Class sums of each tree's rows."""
        forest, classes = self.forest, self.classes

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((forest.trees, classes))
            for batch in batches:
                for row in batch.to_pylist():
                    y = np.frombuffer(row["y"], np.int32)
                    for t in range(forest.trees):
                        total[t] += np.bincount(y, times(forest, t, row), classes)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        # One small table a task reaches the driver.
        parts = self.blocks.mapInArrow(partial, "sums binary").toArrow().column("sums")
        return sum(np.frombuffer(p.as_buffer()).reshape(-1, classes) for p in parts)

    def best_splits(self, trees: Sequence[Tree], now: Sequence[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
        """(slot, class sums of the left side) of the best split of each node that has one."""
        spark = self.blocks.sparkSession
        first, zeros, classes, size, forest = self.bins.first, self.bins.zeros(), self.classes, self.size, self.forest
        slots = int(first[-1])
        # Parts of about as many slots, cut between features.
        edges = first[np.searchsorted(first, np.linspace(0, slots, self.parts + 1).astype(np.int64))]
        growing = {t: np.array([n for u, n in now if u == t]) for t in dict.fromkeys(t for t, _ in now)}
        sums = np.array([trees[t].sums[n] for t, n in now])
        held = spark.sparkContext.broadcast((self.bins.features, first, zeros, [trees[t] for t in growing]))
        choice = chosen_features(forest.max_features, forest.trees, size)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, first, zeros, grown = held.value
            which = np.repeat(np.arange(len(features)), np.diff(first))
            total = np.zeros((len(now), classes, slots))
            for batch in batches:
                for packed in batch.to_pylist():
                    y, ends, slot = (np.frombuffer(packed[n], np.int32) for n in ("y", "ends", "slot"))
                    row = np.repeat(np.arange(len(y)), np.diff(ends, prepend=0))
                    node = routed(len(y), row, which[slot], slot, grown, zeros)
                    done = 0
                    for (t, wanted), at in zip(growing.items(), node, strict=True):
                        c = times(forest, t, packed)
                        place = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
                        code = np.where((wanted[place] == at) & (c > 0), place * classes + y, -1)[row]
                        kept = code >= 0
                        found = np.bincount(code[kept] * slots + slot[kept], c[row[kept]], len(wanted) * classes * slots)
                        total[done : done + len(wanted)] += found.reshape(len(wanted), classes, slots)
                        done += len(wanted)
            if choice < size:
                for (t, n), own in zip(now, total, strict=True):
                    chosen = np.zeros(size, bool)
                    chosen[np.random.default_rng([forest.seed % SEEDS, t, n]).choice(size, choice, replace=False)] = True
                    own[:, ~chosen[features[which]]] = 0.0
            for part, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                own = total[:, :, lo:hi].ravel()
                cell = np.flatnonzero(own)
                if len(cell):
                    columns = [pa.array([part], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (np.diff(cell, prepend=0).astype(np.int32), own[cell])]]
                    yield pa.RecordBatch.from_arrays(columns, schema=SUMS)

        def best(table: pa.Table) -> pa.Table:
            _, first, zeros, _ = held.value
            part = table.column("part")[0].as_py()
            lo, hi = edges[part], edges[part + 1]
            total = np.zeros(len(now) * classes * (hi - lo))
            for gaps, own in zip(table.column("gaps"), table.column("sums"), strict=True):
                total[np.cumsum(np.frombuffer(gaps.as_buffer(), np.int32), dtype=np.int64)] += np.frombuffer(own.as_buffer())
            total = total.reshape(len(now), classes, hi - lo)
            a, b = np.searchsorted(first, [lo, hi])
            starts = first[a:b] - lo
            # Rows without the feature are in the bin of zero.
            empty = sums[:, :, None] - np.add.reduceat(total, starts, axis=2)
            total[:, :, zeros[a:b] - lo] += np.where(empty > 1e-9 * sums.sum(axis=1)[:, None, None], empty, 0.0)
            running = np.cumsum(total, axis=2)
            left = running - np.repeat(running[:, :, starts] - total[:, :, starts], np.diff(first[a : b + 1]), axis=2)
            right = sums[:, :, None] - left
            n_left, n_right, n = left.sum(axis=1), right.sum(axis=1), sums.sum(axis=1)[:, None]
            two = (n_left > 1e-9 * n) & (n_right > 1e-9 * n)
            with np.errstate(divide="ignore", invalid="ignore"):
                pure = ((left**2).sum(axis=1) / n_left + (right**2).sum(axis=1) / n_right) / n
            gain = np.where(two, pure - (sums**2).sum(axis=1)[:, None] / n**2, -1.0)
            slot = gain.argmax(axis=1)
            each = np.arange(len(now))
            return pa.table(
                {
                    "node": pa.array(each, pa.int32()),
                    "gain": pa.array(gain[each, slot]),
                    "slot": pa.array(lo + slot, pa.int64()),
                    "left": pa.array([x.tobytes() for x in left[each, :, slot]], pa.binary()),
                }
            )

        # One row a node and part reaches the driver.
        rows = self.blocks.mapInArrow(partial, SUMS_DDL).groupBy("part").applyInArrow(best, BEST_DDL).where("gain > 1e-12").collect()
        held.unpersist()
        out: dict[int, object] = {}
        for r in sorted(rows, key=lambda r: (-r["gain"], r["slot"])):
            out.setdefault(r["node"], r)
        return {now[i]: (r["slot"], np.frombuffer(r["left"])) for i, r in out.items()}


def times(forest: SparseForest, tree: int, block: Mapping[str, bytes]) -> np.ndarray:
    """How much each row of a block counts in a tree; a block is written once, so reruns draw the same."""
    c = np.frombuffer(block["c"])
    if not forest.bootstrap:
        return c
    return c * np.random.default_rng([forest.seed % SEEDS, tree, *np.frombuffer(block["draw"], np.int64)]).poisson(1.0, len(c))
