"""Language identification by hierarchical discrimination.

Texts become frequencies of hashed byte n-grams. One linear support vector machine per family (against
the rest) predicts the family; inside it, one machine per pair of languages votes for the language.
The machines are trained in numpy on the squared hinge loss from a bounded sample: at most
``per_language`` documents of each language in seeded hash order, and ``sample`` in all. Every document
is judged from its whole text in the task that reads it.

Defined cases: a null text, or one without any letter, is ``und`` with score 0. Rows without doc_id or
lang are judged but never learned from. A language that no family lists is a family of its own. Without
any labelled row, or with one language only, that language (or ``und``) is predicted. Of equal votes
the larger sum of certainties counts; repeated rows get equal results; very long texts are judged whole;
an empty table gives an empty one. Columns that carry an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm import tables, words
from notemill.llm.toxicity import held_out

PER_LANGUAGE = 400  # bound of the learning sample, by language
SAMPLE = 4000  # bound of the learning sample
BITS = 12  # n-grams are hashed to 2^BITS features
ROWS = 256  # documents whose features are held at once
SLICE_BYTES = 2 << 20
STEPS = 300
RATE = 0.5
DECAY = 1e-5
SEED = 8
MADE = ("lang_pred", "score")

# Which languages are close relatives.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg"),
}

_LETTER = np.zeros(256, dtype=np.uint8)  # letters and bytes of longer characters; all else is a blank
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def frequencies(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of the hashed two- and three-byte n-grams of each document, times a hundred."""
    rows = len(offsets) - 1
    text = _LETTER[raw].astype(np.uint64)
    document = np.repeat(np.arange(rows), np.diff(offsets))
    out = np.zeros(rows << BITS, dtype=np.float32)
    key = text
    for n in (2, 3):
        if len(text) < n:
            break
        key = (key[:-1] << np.uint64(8)) | text[n - 1 :]
        inside = (document[n - 1 :] == document[: len(key)]) & (text[1 : len(key) + 1] > 0)
        place = (key[inside] * words._MULTIPLIER) >> np.uint64(64 - BITS)
        out += np.bincount(
            (document[: len(key)][inside] << BITS) + place.astype(np.int64), minlength=len(out)
        ).astype(np.float32)
    out = out.reshape(rows, 1 << BITS)
    return 100 * out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear machine for labels +1 and -1; both classes weigh the same."""
    weights, bias = np.zeros(x.shape[1], np.float32), np.float32(0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    first, second = np.zeros(len(weights) + 1, np.float32), np.zeros(len(weights) + 1, np.float32)
    for step in range(1, STEPS + 1):
        slack = np.maximum(0, 1 - y * (x @ weights + bias)).astype(np.float32)
        pull = -2 * share * y * slack
        gradient = np.append(pull @ x + DECAY * weights, pull.sum()).astype(np.float32)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = RATE / np.sqrt(step) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    return np.append(weights, bias).astype(np.float32)


@dataclass
class LanguageModel:
    families: list[list[str]]  # languages of each family
    family: np.ndarray  # one machine per family, empty for a single one
    pairs: list[tuple[str, str]]
    pair: np.ndarray  # one machine per pair

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        if not self.families:
            return np.full(n, "und", dtype=object), np.zeros(n)
        x = np.hstack([x, np.ones((n, 1), np.float32)])
        sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(2 * m.astype(np.float64), -500, 500)))
        if len(self.families) > 1:
            margin = x @ self.family.T
            chosen, certain = margin.argmax(axis=1), sigmoid(margin.max(axis=1))
        else:
            chosen, certain = np.zeros(n, np.int64), np.ones(n)
        out, score = np.empty(n, dtype=object), certain.astype(np.float64)
        margin = x @ self.pair.T if self.pairs else np.zeros((n, 0))
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            votes, sums = (np.zeros((len(rows), len(languages))) for _ in range(2))
            for p, (a, b) in enumerate(self.pairs):
                if a in languages:
                    i, j, m = languages.index(a), languages.index(b), margin[rows, p]
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    sums[:, i] += sigmoid(m)
                    sums[:, j] += sigmoid(-m)
            best = np.argmax(votes + 1e-3 * sums, axis=1)
            out[rows] = np.array(languages, dtype=object)[best]
            if len(languages) > 1:
                score[rows] *= sums[np.arange(len(rows)), best] / (len(languages) - 1)
        return out, score


def learn(x: np.ndarray, y: np.ndarray, families: Mapping[str, tuple[str, ...]]) -> LanguageModel:
    of = {language: name for name, members in families.items() for language in members}
    groups: dict[str, list[str]] = {}
    for language in sorted(set(y.tolist())):
        groups.setdefault(of.get(language, f"only {language}"), []).append(language)
    members = [groups[g] for g in sorted(groups)]
    sign = lambda a: np.where(a, 1, -1).astype(np.float32)
    family = [svm(x, sign(np.isin(y, m))) for m in members] if len(members) > 1 else []
    pairs = [p for m in members for p in combinations(m, 2)]
    pair = []
    for a, b in pairs:
        rows = (y == a) | (y == b)
        pair.append(svm(x[rows], sign(y[rows] == a)))
    return LanguageModel(members, np.array(family), pairs, np.array(pair))


def fit(
    docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, families: Mapping[str, tuple[str, ...]] = FAMILIES
) -> LanguageModel:
    """Learn from the (doc_id, text, lang) rows outside the held-out quarter."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros(0), [], np.zeros(0))
    bound = max(1, min(per_language, sample // len(counts)))
    # Rows whose hash lies low enough for twice the bound, copies once, and of these the lowest ``bound``.
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 40)).cast("double") / (1 << 40)
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, 2.0 * bound / n + 20 / n)])
    low = known.withColumn("place", place).where(F.col("place") < F.element_at(rate, F.col("lang")))
    lowest = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    chosen = low.distinct().withColumn("_r", F.row_number().over(lowest)).where(F.col("_r") <= bound).drop("_r")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("place", pa.float64()), ("x", pa.binary())])
        for batch in batches:
            for part in parts(batch, "text"):
                x = frequencies(*words.bytes_of(part.column("text"))).astype(np.float16)
                yield tables.record(schema, [part.column("lang"), part.column("place"), [v.tobytes() for v in x]])

    rows = chosen.mapInArrow(extract, "lang string, place double, x binary").collect()
    kept = sorted(rows, key=lambda r: (r["place"], r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in kept]).astype(np.float32)
    return learn(x, np.array([r["lang"] for r in kept], dtype=object), families)


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in words.slices(batch, column, SLICE_BYTES):
        for start in range(0, part.num_rows, ROWS):
            yield part.slice(start, ROWS)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                language, score = known.value.judge(frequencies(*words.bytes_of(part.column("_text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("_text"), pa.array(language, pa.string()), pa.array(score, pa.float64())],
                    names=["_row", "_text", *MADE],
                )

    rows = tables.carried(docs, text, MADE)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("lang_pred string, score double")])
    judged = rows.mapInArrow(mark, schema)
    letters = F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False))
    judged = judged.withColumn("score", F.when(letters, F.col("score")).otherwise(0.0)).withColumn(
        "lang_pred", F.when(letters, F.col("lang_pred")).otherwise("und")
    )
    return tables.restored(judged, docs, text, MADE)
