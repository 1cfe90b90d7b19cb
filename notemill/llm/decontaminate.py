"""Benchmark decontamination with one FM-index per shard of the training texts.

A shard is a slice of the documents inside a task. Its words are numbered by the benchmark's vocabulary;
words outside it cannot be part of a test phrase, so they only separate runs, and runs shorter than the
shortest phrase are left out. The index over the remaining runs is a suffix array by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix position. All test phrases are
searched backwards at once; the rows of the surviving ranges walk to a sampled position, and the covered
words are merged into removal spans. Documents never leave their task, so there is no shuffle.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` (or one item). Each block is broadcast to a
pass of its own over the same rows; the passes follow each other in one stage.

Defined cases: null and empty texts have no words and no hits; items without words are never found. An
item without item_id marks words but is not listed. Repeated items and item_ids count once; repeated
documents get equal results. Words are compared by two 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm import tables, words

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 8  # every eighth suffix position is kept
FILTER_BITS = 20
END, GAP, FIRST = 0, 1, 2  # symbols: end of the shard, gap between runs, first word

MADE = ("n_words", "spans", "items")
SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])


@dataclass
class Phrases:
    """Windows of the benchmark: right-aligned word numbers, zero where a phrase is shorter."""

    vocabulary: np.ndarray  # sorted hashes; word number FIRST + i
    second: np.ndarray  # the same words' second hashes
    windows: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray  # item numbers, window after window
    owned: np.ndarray  # bounds of a window's owners
    names: list[str | None]


def phrases_of(items: list[tuple[object, str | None]], window: int) -> Phrases:
    found = words.split(pa.array([t for _, t in items], pa.string()), words.ALPHANUMERIC, lower=True)
    one, two = found.hashes(1), found.hashes(2)
    vocabulary, where = np.unique(one, return_index=True)
    number = np.searchsorted(vocabulary, one).astype(np.int32) + FIRST
    owners: dict[bytes, set[int]] = {}
    for item in range(len(items)):
        own = number[found.first[item] : found.first[item + 1]]
        for i in range(max(len(own) - window + 1, min(len(own), 1))):
            owners.setdefault(own[i : i + window].tobytes(), set()).add(item)
    keys = list(owners)
    windows = np.zeros((len(keys), window), dtype=np.int32)
    for i, key in enumerate(keys):
        phrase = np.frombuffer(key, dtype=np.int32)
        windows[i, window - len(phrase) :] = phrase
    return Phrases(
        vocabulary,
        two[where],
        windows,
        np.array([len(k) // 4 for k in keys], dtype=np.int64),
        np.array([o for k in keys for o in sorted(owners[k])], dtype=np.int64),
        np.cumsum([0, *[len(owners[k]) for k in keys]]),
        [None if name is None else str(name) for name, _ in items],
    )


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, from the highest bit down."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``."""
        origin = np.zeros(len(at), dtype=np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.depth - 1 - level)) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            origin = np.where(bit, zeros + ones[origin], origin - ones[origin])
        return at - origin

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol = np.zeros(len(at), dtype=np.int64)
        origin = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = (ones[at + 1] - ones[at]).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            origin = np.where(bit, zeros + ones[origin], origin - ones[origin])
            symbol = symbol << 1 | bit
        return symbol, at - origin


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each round doubles the number of symbols that are compared."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    width = 1
    key = sequence.astype(np.int64)
    while True:
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        width *= 2


class FmIndex:
    def __init__(self, sequence: np.ndarray, symbols: int):
        """``sequence`` ends in its only END."""
        order = suffix_array(sequence)
        self.matrix = WaveletMatrix(sequence[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.size = len(sequence)

    def ranges(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and the first and last-but-one row of each."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size, np.int64)
        for column in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, column].astype(np.int64)
            going = symbol >= FIRST
            at = alive[going]
            symbol = symbol[going]
            low[at] = self.before[symbol] + self.matrix.rank(symbol, low[at])
            high[at] = self.before[symbol] + self.matrix.rank(symbol, high[at])
            alive = alive[low[alive] < high[alive]]
        return alive, low[alive], high[alive]

    def positions(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        steps = 0
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            symbol, rank = self.matrix.symbol_and_rank(rows)
            rows = self.before[symbol] + rank
            steps += 1
        return out


def numbered(found: words.Words, phrases: Phrases) -> np.ndarray:
    """Word numbers of the benchmark's vocabulary; zero for all other words."""
    one = found.hashes(1)
    mask = np.uint64((1 << FILTER_BITS) - 1)
    filled = np.zeros(1 << FILTER_BITS, dtype=bool)
    filled[phrases.vocabulary & mask] = True
    at = np.flatnonzero(filled[one & mask])
    place = np.minimum(np.searchsorted(phrases.vocabulary, one[at]), len(phrases.vocabulary) - 1)
    equal = phrases.vocabulary[place] == one[at]
    out = np.zeros(len(one), dtype=np.int32)
    out[at[equal]] = place[equal] + FIRST
    return out


def occurrences(found: words.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of every place in the shard where a window of the benchmark stands."""
    none = np.zeros(0, dtype=np.int64)
    if not len(phrases.windows) or not len(found):
        return none, none
    number = numbered(found, phrases)
    known = number > 0
    heads = np.zeros(len(found) + 1, dtype=bool)
    heads[found.first] = True
    heads = heads[:-1]
    begin = known.copy()
    begin[1:] &= ~known[:-1] | heads[1:]
    end = known.copy()
    end[:-1] &= ~known[1:] | heads[1:]
    begin, size = np.flatnonzero(begin), np.flatnonzero(end)
    size = size + 1 - begin
    long = size >= phrases.lengths.min()
    begin, size = begin[long], size[long]
    if not len(begin):
        return none, none
    word = words.ranges(begin, size)
    chosen = words.Words(found.data, found.starts[word], found.ends[word], found.first)
    same = phrases.second[number[word] - FIRST] == chosen.hashes(2)
    symbols = np.where(same, number[word], GAP)
    # Each run is followed by a gap, the last one by the end.
    target = np.arange(len(word)) + np.repeat(np.arange(len(size)), size)
    sequence = np.full(len(word) + len(size) + 1, GAP, dtype=np.int64)
    sequence[target] = symbols
    sequence[-1] = END
    origin = np.full(len(sequence), -1, dtype=np.int64)
    origin[target] = word
    index = FmIndex(sequence, FIRST + len(phrases.vocabulary))
    window, low, high = index.ranges(phrases.windows)
    rows = words.ranges(low, high - low)
    return np.repeat(window, high - low), origin[index.positions(rows)]


def search(part: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
    """Add the hits of one block of the benchmark to what earlier blocks have found."""
    found = words.split(part.column("_text"), words.ALPHANUMERIC, lower=True)
    documents = part.num_rows
    window, start = occurrences(found, phrases)
    stop = start + phrases.lengths[window] if len(window) else start
    earlier = part.column("spans")
    if earlier.null_count < len(earlier):
        flat, owner = earlier.flatten(), np.repeat(np.arange(documents), np.diff(earlier.offsets.to_numpy()))
        start = np.concatenate([start, flat.field("start").to_numpy() + found.first[owner]])
        stop = np.concatenate([stop, flat.field("stop").to_numpy() + found.first[owner]])
    change = np.zeros(len(found) + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    hit = np.cumsum(change)[:-1] > 0
    head = np.zeros(len(found) + 1, dtype=bool)
    head[found.first] = True
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | head[1:-1]
    end[:-1] &= ~hit[1:] | head[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    owner = np.searchsorted(found.first, begin, side="right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((x - found.first[owner]).astype(np.int32)) for x in (begin, end)], fields=list(SPAN)
    )
    items = part.column("items").to_pylist()
    if len(window):
        document = np.searchsorted(found.first, start[: len(window)], side="right") - 1
        pairs = np.unique(np.stack([document, window]), axis=1)
        count = np.diff(phrases.owned)[pairs[1]]
        item = phrases.owners[words.ranges(phrases.owned[:-1][pairs[1]], count)]
        for d, i in zip(np.repeat(pairs[0], count).tolist(), item.tolist(), strict=True):
            if phrases.names[i] is not None:
                items[d] = {*(items[d] or ()), phrases.names[i]}
    return pa.RecordBatch.from_arrays(
        [
            part.column("_row"),
            part.column("_text"),
            pa.array(found.per_document.astype(np.int64)),
            tables.lists(spans, np.bincount(owner, minlength=documents)),
            pa.array([sorted(x or ()) for x in items], pa.list_(pa.string())),
        ],
        names=["_row", "_text", *MADE],
    )


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's rows in blocks, each of which fits the driver and a broadcast."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block
        yield [(r["i"], r["t"]) for r in rows.where(mine).collect()]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, ``spans`` (merged word ranges) and ``items`` (sorted ids of the found items)."""
    schema = T.StructType.fromDDL("n_words long, spans array<struct<start: int, stop: int>>, items array<string>")
    out = tables.carried(docs, text, MADE).select(
        "_row", "_text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )
    # A slice of 4 MB of text stays one shard whatever the number of rows in it.
    for block in blocks_of(benchmark, item_id, item_text, block_bytes):
        known = docs.sparkSession.sparkContext.broadcast(phrases_of(block, window))

        def mark(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in words.slices(batch, "_text", SHARD_BYTES):
                    yield search(part, known.value)

        out = out.mapInArrow(mark, T.StructType([*out.schema.fields[:2], *schema.fields]))
    return tables.restored(out, docs, text, MADE)


def without_spans(marked: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Cut each span from its text, from the first covered word to the end of the last one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "_text"):
                found = words.split(part.column("_text"), words.ALPHANUMERIC, lower=True)
                texts = part.column("_text").to_pylist()
                base = 0
                for d, own in enumerate(part.column("_row").field(spans).to_pylist()):
                    size = len((texts[d] or "").encode())
                    if own:
                        raw, done, kept = texts[d].encode(), 0, []
                        for s in own:
                            first, last = found.first[d] + s["start"], found.first[d] + s["stop"] - 1
                            kept.append(raw[done : found.starts[first] - base])
                            done = found.ends[last] - base
                        texts[d] = b"".join([*kept, raw[done:]]).decode()
                    base += size
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], names=["_row", "_text"])

    rows = tables.carried(marked, text, ())
    return tables.restored(rows.mapInArrow(cut, rows.schema), marked, text, ())
