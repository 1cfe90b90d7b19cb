"""Alignment of two tokenizers' tokens by the bytes they cover.

Both tokenizers cut the same bytes, so their tokens are intervals. All tokens of both sides are sorted
by their start, the running maximum of their ends is kept, and a group ends where a start reaches it:
there both sides have a token border. Inside a group the overlapping pairs are expanded; a link is a
pair that overlaps (``links="overlap"``) or that also ends at the same byte (``links="end"``).

* A text is cut at single blanks between printable characters, where neither tokenizer has a token
  across; a slice of documents encodes and aligns each distinct part once (many of them as one text) and
  holds its documents as sequences of parts. If a tokenizer could join such parts, texts are not cut.
* Links are counted by id pair inside the slice, then over all slices by partial sums. A slice looks
  up its own distinct pairs; pairs that almost all slices hold take a broadcast of bounded size.
* Slices are written to the checkpoint folder before anything is counted, so reruns see the same ones.
* The tokenizers' files are read on the driver and broadcast (their size is that of a vocabulary).

Defined cases: null and empty texts, and texts whose joined tokens of either side are not the blank and
the text byte for byte, have no tokens: zeros and no groups. Every row counts for itself, so repeated
rows count as often as they stand there, and repeated or null ids do not matter. Ties of a pair's count
are all best. A very long text is one slice, in memory proportional to it. An empty table gives no
rows. Columns of the input that carry an output's name are replaced, all others are kept.
"""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm import tables, words
from notemill.scale import cut, lookup_join

SLICE_BYTES = 8 << 20
PARTS_AT_ONCE = 4096
MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
LINKS = ("end", "overlap")
# Fixed value: the piece mark that stands for a blank.
MARK = "▁"
# A single blank between characters that are no blanks for either tokenizer.
BETWEEN = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
EDGES = re.compile("[!-~À-ɏ](?:.*[!-~À-ɏ])?\\Z", re.DOTALL)

IDS = T.ArrayType(T.IntegerType())
GROUPS = T.ArrayType(T.StructType([T.StructField("a", IDS), T.StructField("b", IDS)]))


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, a: str, b: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        config = json.loads(a)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in config["added_tokens"]}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            whole = token in added or any(c not in letters for c in token)
            self.a_bytes[number] = token.encode() if whole else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        before = config["pre_tokenizer"] or {}
        by_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not config["normalizer"]
        joins = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.cuts = by_words and not joins and self.b.normalize("x y") == f"{MARK}x{MARK}y"

    def parts(self, text: str) -> list[str]:
        return BETWEEN.split(text) if self.cuts else [text]

    def joinable(self, part: str) -> bool:
        """Whether both tokenizers cut between this part and a neighbour of the same kind with a blank between."""
        return self.cuts and bool(EDGES.match(part))

    def encode_joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of joinable parts, encoded as one text; none if tokens and bytes do not meet at every part's end."""
        text = " ".join(parts)
        ids = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        size = np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts))
        out = []
        for one, table, sizes in zip(ids, (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes), strict=True):
            tokens = np.array(one, dtype=np.int32)
            ends, borders = np.cumsum(sizes[tokens]), np.cumsum(size)
            at = np.searchsorted(ends, borders)
            if b"".join([table[t] for t in one]) != f" {text}".encode() or not np.array_equal(ends[at], borders):
                return None
            out.append(tokens)
        return out[0], out[1]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in parts], add_special_tokens=False)]
        return a, self.b.encode(parts, num_threads=1)


_LOADED: dict[int, Tokenizers] = {}


def loaded(files: Broadcast) -> Tokenizers:
    """The worker's tokenizers for the broadcast files."""
    key = hash(files.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(*files.value)
    return _LOADED[key]


@dataclass
class Aligned:
    """Parts one after another: ids of both sides, tokens of each side by group, groups and links by part."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    part_groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    part_links: np.ndarray


def coalesce(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, sizes: np.ndarray, links: str) -> Aligned:
    """Align the tokens of parts of ``sizes`` bytes; both sides cover all bytes of all parts."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    a_start, b_start = a_end - a_size, b_end - b_size
    start = np.concatenate([a_start, b_start])
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(a), len(b)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(np.concatenate([a_end, b_end])[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.cumsum(breaks) - 1
    n_groups = int(group[-1]) + 1 if len(group) else 0
    of_a = side[order] == 0
    group_a, group_b = (np.bincount(group[chosen], minlength=n_groups) for chosen in (of_a, ~of_a))
    part_ends = np.cumsum(sizes)
    by_part = lambda at: np.bincount(np.searchsorted(part_ends, at, side="right"), minlength=len(sizes))
    # Overlaps of a token lie inside its group: from the first other token that ends behind its start.
    first = np.searchsorted(b_end, a_start, side="right")
    count = np.searchsorted(b_start, a_end, side="left") - first
    left, right = np.repeat(np.arange(len(a)), count), words.ranges(first, count)
    if links == "end":
        together = a_end[left] == b_end[right]
        left, right = left[together], right[together]
    return Aligned(
        a, b, group_a, group_b, by_part(start[order][breaks]), a[left], b[right], by_part(a_start[left])
    )


def align_parts(parts: list[str], n_joinable: int, pair: Tokenizers, links: str) -> tuple[Aligned, np.ndarray]:
    """The alignment of all parts, and which of them both sides give back byte for byte.

    The first ``n_joinable`` parts are encoded many at a time, all others one by one.
    """
    whole = np.ones(len(parts), dtype=bool)
    sizes = np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts))
    sides: tuple[list, list] = ([], [])
    bounds = [*range(0, n_joinable, PARTS_AT_ONCE), *range(n_joinable, len(parts), PARTS_AT_ONCE), len(parts)]
    for lo, hi in pairwise(bounds):
        some = parts[lo:hi]
        ids = pair.encode_joined(some) if lo < n_joinable else None
        if ids is None:
            encoded = pair.encode(some)
            kept = [
                b"".join([pair.a_bytes[t] for t in a]) == b" " + p.encode() == b"".join([pair.b_bytes[t] for t in b])
                for p, a, b in zip(some, *encoded, strict=True)
            ]
            whole[lo:hi] = kept
            ids = [np.fromiter(chain.from_iterable(compress(one, kept)), np.int32) for one in encoded]
        for held, one in zip(sides, ids, strict=True):
            held.append(one)
    sizes[~whole] = 0
    flat = [np.concatenate([*s, np.zeros(0, dtype=np.int32)]) for s in sides]
    tokens = [sizes_of[ids] for sizes_of, ids in zip((pair.a_sizes, pair.b_sizes), flat, strict=True)]
    return coalesce(flat[0], tokens[0], flat[1], tokens[1], sizes, links), whole


def bundle(**arrays: np.ndarray) -> bytes:
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    return tables.pack(raw.getvalue())


def unbundle(packed: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(tables.unpack(packed))))


def sliced(part: pa.RecordBatch, number: int, pair: Tokenizers, links: str, names: list[str]) -> pa.RecordBatch:
    """One row for a slice: its rows, its documents as sequences of aligned parts, its id pairs with counts."""
    numbers: dict[str, int] = {}
    sequences = []
    for text in part.column("_text"):
        cuts = pair.parts(text.as_py()) if text.as_py() else []
        sequences.append(np.array([numbers.setdefault(p, len(numbers)) for p in cuts], dtype=np.int32))
    parts = list(numbers)
    joinable = np.fromiter(map(pair.joinable, parts), bool, len(parts))
    order = np.argsort(~joinable, kind="stable")
    aligned, whole = align_parts([parts[i] for i in order.tolist()], int(joinable.sum()), pair, links)
    place = np.empty(len(parts), dtype=np.int32)
    place[order] = np.arange(len(parts), dtype=np.int32)
    sequences = [place[s] for s in sequences]
    sequences = [s if whole[s].all() else s[:0] for s in sequences]
    sequence = np.concatenate([*sequences, np.zeros(0, dtype=np.int32)])
    key = aligned.link_a.astype(np.int64) * len(pair.b_bytes) + aligned.link_b
    used = np.repeat(np.bincount(sequence, minlength=len(numbers)), aligned.part_links)
    keys, place = np.unique(key, return_inverse=True)
    counts = np.bincount(place, used, len(keys)).astype(np.int64)
    body = bundle(
        sequence=sequence, lengths=np.fromiter(map(len, sequences), np.int32, len(sequences)),
        a=aligned.a, b=aligned.b, group_a=aligned.group_a.astype(np.int32), group_b=aligned.group_b.astype(np.int32),
        part_groups=aligned.part_groups.astype(np.int32), part_links=aligned.part_links.astype(np.int32), link=place.astype(np.int32),
    )
    found = counts > 0
    columns = [
        pa.array([number], pa.int64()), tables.lists(part.column("_row"), [part.num_rows]), pa.array([body], pa.binary()),
        tables.lists(pa.array(keys), [len(keys)]), tables.lists(pa.array(keys[found]), [found.sum()]),
        tables.lists(pa.array(counts[found]), [found.sum()]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def finished(slices: pa.Table, pairs: pa.Table, names: list[str]) -> pa.Table:
    """The documents of a slice with their groups and the sums over their links."""
    batches = [b for one in slices.to_batches() for b in (one.slice(i, 1) for i in range(one.num_rows))]
    key = pairs.column("key").to_numpy()
    order = np.argsort(key)
    out = []
    for one in batches:
        held = unbundle(one.column("body")[0].as_py())
        own = one.column("keys").flatten().to_numpy()
        # Pairs of parts that only documents without tokens hold were not counted, nor are they used.
        at = order[np.minimum(np.searchsorted(key, own, sorter=order), max(len(key) - 1, 0))] if len(key) else np.zeros(len(own), np.int64)
        total = pairs.column("total").to_numpy()[at] if len(key) else np.zeros(len(own), np.int64)
        best = pc.cast(pairs.column("best"), pa.int64()).to_numpy()[at] if len(key) else total
        rows = one.column("rows").flatten()
        out.append(pa.RecordBatch.from_arrays([rows, *document_sums(held, total, best)], names=names))
        words.give_back()
    return pa.Table.from_batches(out)


def document_sums(held: dict[str, np.ndarray], total: np.ndarray, best: np.ndarray) -> list[pa.Array]:
    sequence, lengths = held["sequence"], held["lengths"]
    bounds = np.concatenate([[0], np.cumsum(lengths)])

    def by_document(of_part: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(of_part[sequence])])
        return running[bounds[1:]] - running[bounds[:-1]]

    def by_part(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(counts)
        return running[ends] - running[ends - counts]

    groups, links, link = (held[n].astype(np.int64) for n in ("part_groups", "part_links", "link"))
    sums = [
        by_document(x)
        for x in (
            by_part(held["group_a"], groups), by_part(held["group_b"], groups), groups,
            links, by_part(best[link], links), by_part(total[link], links),
        )
    ]
    place = words.ranges((np.cumsum(groups) - groups)[sequence], groups[sequence])
    sides = []
    for ids, size in ((held["a"], held["group_a"].astype(np.int64)), (held["b"], held["group_b"].astype(np.int64))):
        first = np.cumsum(size) - size
        sides.append(tables.lists(pa.array(ids[words.ranges(first[place], size[place])]), size[place]))
    nested = tables.lists(pa.StructArray.from_arrays(sides, names=["a", "b"]), sums[2])
    return [*(pa.array(s.astype(np.int64)) for s in sums), nested]


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", links: str = "end") -> DataFrame:
    """The columns of ``docs`` but the text, with the alignment of its tokens by the two tokenizers.

    ``groups`` holds the ids of both sides between neighbouring shared borders. ``n_links`` counts the
    linked pairs of tokens, ``count_sum`` adds up how often each link's id pair is linked in all of
    ``docs``, and ``n_best`` counts the links whose id pair is the most frequent one of its B id.
    """
    if links not in LINKS:
        raise ValueError(f"unknown links {links!r}")
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        content = (a_file.read(), b_file.read())
    n_b = len(Tokenizers(*content).b_bytes)
    files = docs.sparkSession.sparkContext.broadcast(content)
    rows = tables.carried(docs, text, MADE)
    kept = [c for c in docs.columns if c != text and c not in MADE]
    row = rows.schema["_row"].dataType
    long_list = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("slice", T.LongType()), T.StructField("rows", T.ArrayType(row)), T.StructField("body", T.BinaryType()),
         *[T.StructField(n, long_list) for n in ("keys", "counted", "counts")]]
    )

    def slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words.slices(batch, "_text", SLICE_BYTES):
                yield sliced(part, number, loaded(files), links, schema.names)
                number += 1

    written = cut(rows.mapInArrow(slice_batches, schema))
    pairs = written.select("slice", F.inline(F.arrays_zip("counted", "counts"))).withColumnRenamed("counted", "key")
    totals = pairs.groupBy("key").agg(F.sum("counts").alias("total"), F.count(F.lit(1)).alias("slices"))
    # A B id has at most as many pairs as the other vocabulary has ids.
    of_b = Window.partitionBy(F.col("key") % n_b)
    totals = cut(totals.withColumn("best", F.col("total") == F.max("total").over(of_b)))
    looked = lookup_join(pairs.select("slice", "key"), totals, "key", ["slice"], "inner", frequency="slices")
    out = T.StructType(
        [T.StructField("_row", row), *[T.StructField(n, T.LongType()) for n in MADE[:-1]], T.StructField("groups", GROUPS)]
    )

    def finish(slices: pa.Table, found: pa.Table) -> pa.Table:
        return finished(slices, found, out.names)

    joined = (
        written.select("slice", "rows", "body", "keys").groupBy("slice")
        .cogroup(looked.select(F.col("slice").alias("of"), "key", "total", "best").groupBy("of"))
        .applyInArrow(finish, out)
    )
    return joined.select(*[f"_row.`{c}`" for c in kept], *MADE)
