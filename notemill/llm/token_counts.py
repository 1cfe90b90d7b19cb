"""Token counts of byte-level BPE, from pieces counted once per distinct pre-token.

A tokenizer splits a text into pre-tokens and each of them into pieces, so a document's tokens are the
sum over its distinct pre-tokens of frequency times pieces. Tasks turn slices of documents into
per-document frequencies, held as posting lists per pre-token; these are dealt by pre-token into
buckets, where each pre-token is encoded once and joined to all its postings; a sum by document
follows. Token ids are never gathered.

* A pre-token in over 1/``OFTEN`` of a slice's documents is dealt by pre-token and slice, so the posting
  lists of frequent ones spread over all buckets.
* A slice sends its list of documents once. Buckets return partial sums by the documents' places in the
  slice, and the slice adds them up, so neither texts nor ids travel with the numbers.
* A slice is named by its task and turn. All its rows carry a mark of its contents, so a rerun over input
  in another order fails instead of mixing two slices.

Pre-tokens follow the byte-level pattern; texts with characters from U+0530 on are split by the
tokenizer itself, whose Unicode tables may be older. Special strings of the file's added tokens count
as one token wherever they stand, which is the library's default.

Defined cases: null and empty texts have no bytes and no tokens; every row is counted for itself, so rows
of one or of no doc_id, and repeated rows, each get their own count.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import tables, words

SLICE_BYTES = 8 << 20
OFTEN = 16
# The byte-level pattern of the tokenizer, and the first byte of characters from U+0530 on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATER_BYTE = 0xD4

PACKED = pa.schema(
    [("bucket", pa.int64()), ("slice", pa.int64()), ("mark", pa.int64()), ("ids", pa.list_(pa.int64())),
     ("n_bytes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("sizes", pa.binary()), ("postings", pa.binary()),
     ("documents", pa.binary()), ("counts", pa.binary())]
)
PACKED_DDL = (
    "bucket long, slice long, mark long, ids array<long>, n_bytes array<long>, tokens binary, sizes binary, "
    "postings binary, documents binary, counts binary"
)
SUMS = pa.schema(
    [("slice", pa.int64()), ("mark", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
     ("documents", pa.binary()), ("sums", pa.binary())]
)
SUMS_DDL = "slice long, mark long, ids array<long>, n_bytes array<long>, documents binary, sums binary"
TOTALS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class PreTokens:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(definition)
        before = config["pre_tokenizer"] or {}
        flags = ("single_word", "lstrip", "rstrip")
        if config["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without normalizer and prefix blank are supported")
        if any(t[f] for t in config["added_tokens"] for f in flags):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        special = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.markers = set(special)
        self.pattern = regex.compile(PATTERN)

    def split(self, text: str, own: bool) -> list[str]:
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1 and not own:
            return self.pattern.findall(text)
        out: list[str] = []
        for part in parts:
            if part in self.markers:
                out.append(part)
            elif own:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            else:
                out += self.pattern.findall(part)
        return out

    def pieces(self, tokens: list[str]) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)
        return np.fromiter(map(len, encoded), np.int64, len(tokens))


_LOADED: dict[int, PreTokens] = {}


def loaded(definition) -> PreTokens:
    """The worker's tokenizer for a broadcast definition."""
    key = hash(definition.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PreTokens(definition.value)
    return _LOADED[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    PreTokens(content)  # refuse an unsupported file here
    definition = docs.sparkSession.sparkContext.broadcast(content)
    buckets = tables.shuffle_partitions(docs)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                yield from frequencies(part, loaded(definition), buckets, turn)
                turn += 1

    def join(table: pa.Table) -> pa.Table:
        sums = partial_sums(table, loaded(definition))
        words.give_back()
        return sums

    return (
        keyed.mapInArrow(split, PACKED_DDL)
        .groupBy("bucket")
        .applyInArrow(join, SUMS_DDL)
        .groupBy("slice")
        .applyInArrow(totals, "doc_id long, n_bytes long, n_tokens long")
    )


def frequencies(part: pa.RecordBatch, pre: PreTokens, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """The slice's documents, and for each bucket its pre-tokens with the documents that hold them and how often."""
    column = part.column("text")
    raw, offsets = words.bytes_of(column)
    mark = xxhash.xxh64_intdigest(raw, len(offsets)) ^ xxhash.xxh64_intdigest(offsets.tobytes())
    mark = (mark & (2**63 - 1)) - 2**62
    home = int(words.scramble(np.array([turn], np.uint64))[0] % np.uint64(buckets))
    ids, n_bytes = (tables.lists(a, [part.num_rows]) for a in (part.column("doc"), pa.array(np.diff(offsets))))
    yield tables.record(PACKED, [[home], [turn], [mark], ids, n_bytes, *[[None]] * 5])
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return
    highest = np.maximum.reduceat(raw, offsets[filled])
    numbers: dict[str, int] = {}
    keys = []
    for row, high in zip(filled.tolist(), highest.tolist(), strict=True):
        tokens = pre.split(column[row].as_py(), high >= LATER_BYTE)
        own = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
        keys.append(own * part.num_rows + row)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    del keys
    token, document = np.divmod(key, part.num_rows)
    n = np.bincount(token, minlength=len(numbers))
    names = [t.encode() for t in numbers]
    size = np.fromiter(map(len, names), np.int32, len(names))
    found = words.split_bytes(
        np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum(size)]), np.ones(256, dtype=bool)
    )
    h = found.hashes(9)
    own = words.scramble(np.array([turn + 1], np.uint64))[0]
    h = np.where(n * OFTEN > part.num_rows, words.scramble(h ^ own), h)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.cumsum(n) - n
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        chosen = order[lo:hi]
        at = words.ranges(first[chosen], n[chosen])
        columns = [
            b"".join([names[i] for i in chosen.tolist()]),
            size[chosen].tobytes(),
            n[chosen].astype(np.int32).tobytes(),
            document[at].astype(np.int32).tobytes(),
            count[at].astype(np.int32).tobytes(),
        ]
        yield tables.record(
            PACKED, [[int(bucket[chosen[0]])], [turn], [mark], [None], [None], *[[tables.pack(c)] for c in columns]]
        )


def partial_sums(table: pa.Table, pre: PreTokens) -> pa.Table:
    """Encode each pre-token of a bucket once and sum its pieces over the documents of each slice."""
    lists_only = table.filter(pc.is_null(table.column("tokens"))).select(["slice", "mark", "ids", "n_bytes"])
    numbers: dict[bytes, int] = {}
    slices = []
    for r in table.filter(pc.is_valid(table.column("tokens"))).select(["slice", "mark", *PACKED.names[5:]]).to_pylist():
        text, size, n, document, count = (tables.unpack(r[c]) for c in PACKED.names[5:])
        ends = np.cumsum(np.frombuffer(size, np.int32)).tolist()
        own = np.fromiter(
            (numbers.setdefault(text[a:b], len(numbers)) for a, b in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(ends)
        )
        slices.append((r["slice"], r["mark"], own, *(np.frombuffer(x, np.int32) for x in (n, document, count))))
    pieces = pre.pieces([t.decode() for t in numbers])
    rows = []
    for turn, mark, own, n, document, count in slices:
        sums = np.bincount(document, np.repeat(pieces[own], n) * count).astype(np.int64)
        some = np.flatnonzero(sums)
        rows.append((turn, mark, tables.pack(some.astype(np.int32).tobytes()), tables.pack(sums[some].tobytes())))
    columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
    none = [None] * len(rows)
    given = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in lists_only.columns]
    parts = [
        [*given, pa.nulls(len(lists_only), pa.binary()), pa.nulls(len(lists_only), pa.binary())],
        [columns[0], columns[1], none, none, columns[2], columns[3]],
    ]
    return pa.Table.from_batches([tables.record(SUMS, p) for p in parts], schema=SUMS)


def totals(table: pa.Table) -> pa.Table:
    """Add up what the buckets returned for one slice."""
    if len(pc.unique(table.column("mark"))) > 1:
        raise ValueError("the documents came in another order when a task was repeated; read them from written files")
    rows = table.to_pylist()
    documents = next(r for r in rows if r["ids"] is not None)
    sums = np.zeros(len(documents["ids"]), dtype=np.int64)
    for r in rows:
        if r["ids"] is None:
            sums[np.frombuffer(tables.unpack(r["documents"]), np.int32)] += np.frombuffer(tables.unpack(r["sums"]), np.int64)
    return pa.Table.from_arrays(
        [pa.array(documents["ids"], pa.int64()), pa.array(documents["n_bytes"], pa.int64()), pa.array(sums)], schema=TOTALS
    )
