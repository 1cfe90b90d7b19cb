"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, not clean. With the class
prior p, the risk of a scorer is p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)): the unlabelled
risk corrected for the toxic share inside it, and never below zero. A numpy logistic model over word and
word-prefix features minimises it with Adam; where the corrected part turns negative, the step goes
against it.

The model is fitted on a bounded sample: at most ``positives`` toxic and ``unlabelled`` other rows, in
seeded hash order. The prior is counted over all labelled rows. Every document is scored from its whole
text by a lookup of its words, in the task that reads it; nothing is shuffled.

Defined cases: null and empty texts score as texts without features. Rows without a doc_id are scored
but never learned from. Of several labels of one document the highest counts; an id learns one of its
texts. Without a positive label, every score is the prior. Repeated rows and ties get equal scores; very
long texts are scored whole; an empty table gives an empty one. Columns named score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm import tables, words
from notemill.scale import cut, seeded_hash

POSITIVES = 4000  # bound of the sample of toxic documents
UNLABELLED = 12000  # bound of the sample of unlabelled documents
FEATURES = 1000  # features the model keeps
PREFIXES = (4, 5)  # bytes of a word that also count as a feature
LEAST_POSITIVES = 5  # documents that must hold a feature
LEAST_Z = 5.0  # standard errors by which a feature must be more frequent in toxic than in unlabelled ones
STEPS = 400
RATE = 0.05
DECAY = 1e-4
SEED = 5
THRESHOLD = 0.3

MADE = ("score",)


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        document, place, value = known_features(texts, self.features)
        margin = np.full(len(texts), self.bias)
        np.add.at(margin, document, self.weights[place] * value)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def held_out(doc_id: str) -> Column:
    """The quarter of the documents whose labels nobody may learn."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def feature_hashes(found: words.Words) -> Iterator[np.ndarray]:
    """One hash per word for the word itself, then for each prefix; zero where the word is too short."""
    yield found.hashes(1)
    length = found.ends - found.starts
    head = words.byte_steps(found.data)[found.starts] if len(found) else np.zeros(0, np.uint64)
    for size in PREFIXES:
        mask = np.uint64((1 << (8 * size)) - 1)
        prefix = words.scramble((head & mask) ^ np.uint64(size << 56))
        yield np.where(length >= size, prefix, np.uint64(0))


def known_features(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature number, log of one plus its count) for the features that occur."""
    found = words.split(texts, words.ALPHANUMERIC, lower=True)
    if not len(features) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    mask = np.uint64(0xFFFFF)
    filled = np.zeros(1 << 20, dtype=bool)
    filled[features & mask] = True
    keys = []
    for h in feature_hashes(found):
        at = np.flatnonzero(filled[h & mask])
        place = np.minimum(np.searchsorted(features, h[at]), len(features) - 1)
        equal = features[place] == h[at]
        document = np.searchsorted(found.first, at[equal], side="right") - 1
        keys.append(document * len(features) + place[equal])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // len(features), key % len(features), np.log1p(count)


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(doc_id, text, toxic): the bounded learning sample; ``toxic`` is false for unlabelled rows."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id")
    order = [seeded_hash(SEED, "doc_id"), F.col("doc_id")]
    chosen = (
        toxic.join(ids.distinct(), "doc_id", "left_semi").distinct().orderBy(*order).limit(positives).withColumn("toxic", F.lit(True))
        .union(ids.distinct().orderBy(*order).limit(unlabelled).withColumn("toxic", F.lit(False)))
    )
    # At most positives + unlabelled ids. An id learns one text, the one of smallest digest, so copies of
    # an id shrink where they are read and no more rows than ids reach the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min_by("text", F.struct(F.md5("text"), "text")).alias("text")
    return rows.groupBy("doc_id", "toxic").agg(one).select("doc_id", "text", "toxic")


def fit(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES
) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and the toxic rows of ``labels`` (doc_id, toxic) outside the held-out quarter."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0

    rows = cut(sample(docs, labels, positives, unlabelled).mapInArrow(extract, "toxic boolean, features binary"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bias = float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    chosen = np.zeros(0, np.uint64)
    if len(sizes) == 2:
        chosen = np.array([r["feature"] for r in choose(rows, sizes, features).collect()], np.int64).view(np.uint64)
    if not len(chosen):
        return ToxicityModel(chosen, np.zeros(0), bias)
    chosen = np.sort(chosen)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.bool_()), ("place", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
        for batch in batches:
            places, counts = [], []
            for packed in batch.column("features").to_pylist():
                hashes, count = np.frombuffer(packed, np.uint64).reshape(2, -1)
                place = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
                held = chosen[place] == hashes
                places.append(place[held])
                counts.append(count[held])
            yield tables.record(schema, [batch.column("toxic"), places, counts])

    learned = rows.mapInArrow(project, "toxic boolean, place array<int>, n array<int>").collect()
    x = np.zeros((len(learned), len(chosen)), dtype=np.float32)
    for row, r in enumerate(learned):
        x[row, r["place"]] = np.log1p(r["n"])
    toxic = np.array([r["toxic"] for r in learned])
    weights, bias = non_negative_pu(x[toxic], x[~toxic], prior)
    return ToxicityModel(chosen, weights, bias)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct feature hashes of each text and their counts, packed."""
    schema = pa.schema([("toxic", pa.bool_()), ("features", pa.binary())])
    for batch in batches:
        for row in range(batch.num_rows):
            found = words.split(batch.column("text").slice(row, 1), words.ALPHANUMERIC, lower=True)
            hashes, count = np.unique(np.concatenate([*feature_hashes(found)]), return_counts=True)
            packed = np.stack([hashes, count.astype(np.uint64)]).tobytes()
            yield tables.record(schema, [batch.column("toxic").slice(row, 1), [packed]])


def choose(rows: DataFrame, sizes: dict[bool, int], features: int) -> DataFrame:
    """The features that toxic documents hold far more often, those with the largest gain first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feature", pa.int64()), ("pos", pa.int64()), ("unl", pa.int64())])
        for batch in batches:
            packed = [np.frombuffer(p, np.uint64).reshape(2, -1)[0] for p in batch.column("features").to_pylist()]
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), [len(h) for h in packed])
            names, inverse = np.unique(np.concatenate(packed), return_inverse=True)
            pos = np.bincount(inverse, toxic, len(names)).astype(np.int64)
            yield tables.record(schema, [names.view(np.int64), pos, np.bincount(inverse, minlength=len(names)) - pos])

    p, u = F.lit(float(sizes[True])), F.lit(float(sizes[False]))
    mean = (F.col("pos") + F.col("unl")) / (p + u)
    error = F.sqrt(mean * (1 - mean) * (1 / p + 1 / u))
    in_toxic, in_other = F.col("pos") / p, F.col("unl") / u
    return (
        rows.mapInArrow(count, "feature long, pos long, unl long")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
        .where(F.col("feature") != 0)
        .where((F.col("pos") >= LEAST_POSITIVES) & (in_toxic - in_other > LEAST_Z * error))
        .orderBy((in_toxic * F.log((in_toxic + 1e-6) / (in_other + 1e-6))).desc(), "feature")
        .limit(features)
        .select("feature")
    )


def risks(margin_pos: np.ndarray, margin_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk under the logistic loss: p R_pos(+), and R_unl(-) - p R_pos(-)."""
    plus = np.logaddexp(0, -margin_pos).mean()
    minus = np.logaddexp(0, margin_unl).mean() - prior * np.logaddexp(0, margin_pos).mean()
    return prior * plus, minus


def non_negative_pu(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    weights, bias = np.zeros(pos.shape[1], np.float32), float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(m, -500, 500)))
    for step in range(1, STEPS + 1):
        a, b = pos @ weights + bias, unl @ weights + bias
        _, corrected = risks(a, b, prior)
        # Gradients of the losses by margin; their means give those by weight.
        plus, minus_pos, minus_unl = sigmoid(a) - 1, sigmoid(a), sigmoid(b)
        if corrected >= 0:
            by_pos, by_unl = prior * plus - prior * minus_pos, minus_unl
        else:
            by_pos, by_unl = prior * minus_pos, -minus_unl
        by_pos, by_unl = (by_pos / len(pos)).astype(np.float32), (by_unl / len(unl)).astype(np.float32)
        gradient = np.append(by_pos @ pos + by_unl @ unl + DECAY * weights, by_pos.sum() + by_unl.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = (weights - move[:-1]).astype(np.float32), bias - move[-1]
    return weights.astype(np.float64), float(bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that a document is toxic."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_text"), pa.array(known.value.scores(part.column("_text")))],
                    names=["_row", "_text", "score"],
                )

    rows = tables.carried(docs, text, MADE)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return tables.restored(rows.mapInArrow(mark, schema), docs, text, MADE)
