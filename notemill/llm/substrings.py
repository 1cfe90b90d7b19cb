"""Substring deduplication over super-k-mers.

Every window of ``window`` words belongs to the bucket of its minimiser: the smallest hash among the
``gram``-word sequences inside it. Neighbouring windows mostly share the minimiser, so they travel as
one string of words (a super-k-mer) and not as ``window`` copies of every word. A bucket sorts its
windows and finds the smallest doc_id of each distinct one.

* A slice of the input sends each distinct super-k-mer once, with the smallest and the largest doc_id
  that hold it there. Where it occurs stays with the slice: the slice's list of places goes to the slice's
  own group, and buckets answer with the smallest documents of the windows that some place loses. So a
  passage in any number of documents costs a bucket one entry a slice.
* A minimiser that alone would fill a bucket is hot. There are fewer hot ones than buckets, so their
  list can be broadcast; their windows travel singly to the bucket of the whole window. The number of
  buckets follows the bytes of all texts.
* Windows are sorted by a 64-bit hash and each run of equal hashes is compared byte by byte.
* Spans go back to rows by doc_id and a 128-bit digest of the text, so rows of one doc_id never mix.
* A slice is named by its task and turn, and its rows carry a mark of its contents: a rerun over input
  in another order fails instead of mixing two slices. Files come in one order.

Defined cases: a null or empty text has no words. A null doc_id counts as larger than all others: it
loses windows to them and takes none from them. Rows of one doc_id never take windows from each
other; repeated rows get equal results. A very long text is one slice, in memory proportional to it.
Ties need no rule: windows are equal or not. An empty table gives an empty one. Input columns that
carry an output's name are replaced, all others are kept.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm import tables, words
from notemill.scale import cut

WINDOW = 13
GRAM = 2
SLICE_BYTES = 4 << 20  # text per slice: larger slices share more equal super-k-mers and compress better
LONGEST_RUN = 64  # windows of one super-k-mer at most; a longer run is cut into several
BUCKETS_PER_PARTITION = 4
BUCKET_BYTES = 16 << 20  # text per bucket at most, on average
MADE = ("kept", "n_words", "n_removed")
OUT = (pa.string(), pa.string(), pa.int64(), pa.int64())
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
DIGEST = 16

# A bucket's strings with the documents at both ends, or (home) the places of a whole slice.
PIECES = pa.schema(
    [("bucket", pa.int64()), ("slice", pa.int64()), ("mark", pa.int64()), ("first", pa.int64()), ("packed", pa.binary()),
     ("least", pa.binary()), ("most", pa.binary()), ("home", pa.binary())]
)
PIECES_DDL = "bucket long, slice long, mark long, first long, packed binary, least binary, most binary, home binary"
FOUND = pa.schema(
    [("slice", pa.int64()), ("mark", pa.int64()), ("piece", pa.binary()), ("windows", pa.binary()), ("least", pa.binary()),
     ("home", pa.binary())]
)
FOUND_DDL = "slice long, mark long, piece binary, windows binary, least binary, home binary"
SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
SPANS = pa.schema([("doc", pa.int64()), ("version", pa.binary()), ("spans", pa.list_(SPAN))])
SPANS_DDL = "doc long, version binary, spans array<struct<start:int,stop:int>>"


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``docs`` with ``kept`` (remaining words joined by one blank), ``n_words`` and ``n_removed``.

    A word goes when a window of words that covers it also starts in a document of smaller doc_id.
    """
    if not 1 <= gram <= window or window < 2:
        raise ValueError("1 <= gram <= window and window >= 2 are required")
    digest = lambda c: F.unhex(F.md5(c))
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), digest(text).alias("version"))
    n_bytes = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS_PER_PARTITION * tables.shuffle_partitions(docs), -(-n_bytes // BUCKET_BYTES))
    spans = repeated_spans(keyed, window, gram, buckets)
    rows = tables.carried(docs, text, MADE).select(
        F.col(f"_row.`{doc_id}`").cast("long").alias("_doc"), digest("_text").alias("_version"), "_text", "_row"
    )
    # Texts cross the exchange compressed: the exchange's own codec hardly shrinks them.
    packed = T.StructType([T.StructField("_text", T.BinaryType()) if f.name == "_text" else f for f in rows.schema])
    rows = rows.mapInArrow(pack_texts, packed)
    # Equal rows have equal spans, one of them is enough.
    removed = spans.groupBy("doc", "version").agg(F.min("spans").alias("_spans"))
    joined = rows.join(
        removed, rows["_doc"].eqNullSafe(removed["doc"]) & (rows["_version"] == removed["version"]), "left"
    ).select("_row", "_text", "_spans")
    out = T.StructType([joined.schema["_row"], *T.StructType.fromDDL("_text string, kept string, n_words long, n_removed long")])
    return tables.restored(joined.mapInArrow(remove_spans, out), docs, text, MADE)


def repeated_spans(keyed: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """(doc, version, spans): word ranges that windows of smaller documents cover, for each row that has some."""
    hot = hot_minimisers(keyed, window, gram, buckets)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words.slices(batch, "text", SLICE_BYTES):
                yield from super_kmers(part, window, gram, buckets, hot, turn)
                turn += 1

    def solve(table: pa.Table) -> pa.Table:
        found = resolve_bucket(table, window)
        words.give_back()
        return found

    def place(table: pa.Table) -> pa.Table:
        spans = slice_spans(table, window)
        words.give_back()
        return spans

    found = keyed.mapInArrow(pieces, PIECES_DDL).groupBy("bucket").applyInArrow(solve, FOUND_DDL)
    return found.groupBy("slice").applyInArrow(place, SPANS_DDL)


def hot_minimisers(keyed: DataFrame, window: int, gram: int, buckets: int) -> np.ndarray:
    """Minimisers of more than ``1/buckets`` of all windows: fewer than ``buckets`` numbers.

    A slice reports those above an eighth of that share in itself, so the sums fall short of the true
    count by an eighth of the share at most, and the limit is lowered by as much.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("minimiser", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for part in words.slices(batch, "text"):
                _, at, smallest = minimised(part.column("text"), window, gram)
                values, n = np.unique(smallest, return_counts=True)
                often = n * 8 * buckets > len(at)
                yield tables.record(schema, [values[often].view(np.int64), n[often]])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(at)])], schema=schema)

    counts = (
        keyed.select("text").mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    )
    counts = cut(counts)
    total = counts.where("minimiser IS NULL").first()
    if total is None:
        return np.zeros(0, dtype=np.uint64)
    # Fewer than 2 * buckets numbers can pass.
    rows = counts.where(F.col("minimiser").isNotNull() & (F.col("n") * 8 * buckets > 7 * total["n"])).collect()
    return np.sort(np.array([r["minimiser"] for r in rows], dtype=np.int64).view(np.uint64))


def minimised(texts: pa.Array, window: int, gram: int) -> tuple[words.Words, np.ndarray, np.ndarray]:
    """The words, the positions at which windows start, and the windows' minimisers."""
    found = words.split(texts)
    at = found.same_document(window)
    smallest = words.sliding_min(words.grams(found.hashes(), gram), window - gram + 1) if len(at) else np.zeros(0, np.uint64)
    return found, at, smallest[at]


def super_kmers(
    part: pa.RecordBatch, window: int, gram: int, buckets: int, hot: np.ndarray, turn: int
) -> Iterator[pa.RecordBatch]:
    """One row per bucket with its distinct super-k-mers as one compressed string, and one with all their places."""
    found, at, smallest = minimised(part.column("text"), window, gram)
    if not len(at):
        return
    is_hot = np.isin(smallest, hot) if len(hot) else np.zeros(len(at), dtype=bool)
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (np.diff(at) != 1) | (smallest[1:] != smallest[:-1]) | is_hot[1:] | is_hot[:-1]
    begins = np.flatnonzero(fresh)
    lengths = np.diff(np.append(begins, len(at)))
    extra = (lengths - 1) // LONGEST_RUN
    begins = np.repeat(begins, extra + 1) + LONGEST_RUN * words.ranges(np.zeros(len(extra), np.int64), extra + 1)
    ends = np.append(begins[1:], len(at)) - 1
    key = smallest[begins]
    single = is_hot[begins]
    if single.any():
        key = key.copy()
        key[single] = words.scramble(words.grams(found.hashes(1), window)[at[begins[single]]])
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    text, offsets = found.joined()
    left, right = offsets[at[begins]], offsets[at[ends] + window] - 1
    order = np.argsort(bucket, kind="stable")
    document = np.searchsorted(found.first, at[begins], side="right") - 1
    docs = part.column("doc").fill_null(LAST).to_numpy(zero_copy_only=False)
    ids = docs[document]
    mark = xxhash.xxh64_intdigest(found.first.tobytes(), xxhash.xxh32_intdigest(found.data)) - (1 << 63)
    piece = np.zeros(len(begins), dtype=np.int32)
    first = 0
    bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        chosen = order[lo:hi]
        seen: dict[bytes, int] = {}
        number = np.array(
            [seen.setdefault(text[a:b], len(seen)) for a, b in zip(left[chosen].tolist(), right[chosen].tolist(), strict=True)]
        )
        least, most = np.full(len(seen), LAST), np.full(len(seen), np.iinfo(np.int64).min)
        np.minimum.at(least, number, ids[chosen])
        np.maximum.at(most, number, ids[chosen])
        piece[chosen] = first + number
        packed = [tables.pack(b"\n".join(seen)), least.tobytes(), most.tobytes()]
        yield tables.record(PIECES, [[int(bucket[chosen[0]])], [turn], [mark], [first], *[[p] for p in packed], [None]])
        first += len(seen)
    by_place = np.lexsort((at[begins], document))
    version = b"".join(v if v is not None else bytes(DIGEST) for v in part.column("version").to_pylist())
    position = (at[begins] - found.first[document]).astype(np.int32)
    home = bundle(
        doc=docs, version=np.frombuffer(version, np.uint8), pieces=np.array([first]), piece=piece[by_place],
        document=document[by_place].astype(np.int32), position=position[by_place],
    )
    own = int(words.scramble(np.array([turn], np.uint64))[0] % np.uint64(buckets))
    yield tables.record(PIECES, [[own], [turn], [mark], [0], *[[None]] * 3, [home]])


def bundle(**arrays: np.ndarray) -> bytes:
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    return tables.pack(raw.getvalue())


def resolve_bucket(table: pa.Table, window: int) -> pa.Table:
    """Sort the windows of one bucket and answer each slice that holds a window of a smaller document."""
    homes = table.filter(pc.is_valid(table.column("home")))
    none = pa.nulls(len(homes), pa.binary())
    columns = {n: homes.column(n).combine_chunks() for n in ("slice", "mark", "home")}
    parts = [tables.record(FOUND, [columns["slice"], columns["mark"], none, none, none, columns["home"]])]
    given = table.filter(pc.is_valid(table.column("packed")))
    if len(given):
        parts.append(answers(given, window))
    return pa.Table.from_batches(parts, schema=FOUND)


def answers(given: pa.Table, window: int) -> pa.RecordBatch:
    blobs = [tables.unpack(p) for p in given.column("packed").to_pylist()]
    counts = np.array([b.count(b"\n") + 1 for b in blobs])
    raw = np.frombuffer(b"\n".join(blobs), dtype=np.uint8)
    del blobs
    least_doc = np.frombuffer(b"".join(given.column("least").to_pylist()), np.int64)
    most_doc = np.frombuffer(b"".join(given.column("most").to_pylist()), np.int64)
    offsets = np.concatenate([[0], np.flatnonzero(raw == 0x0A) + 1, [len(raw)]])
    found = words.split_bytes(raw, offsets, words.NOT_BLANK)
    at = found.same_document(window)
    owner = np.searchsorted(found.first, at, side="right") - 1
    least = least_document(found, at, window, least_doc[owner])
    first_window = np.searchsorted(owner, np.arange(len(offsets)))
    losing = np.flatnonzero(np.minimum.reduceat(least, first_window[:-1]) < most_doc)
    windows = np.diff(first_window)
    ends = np.cumsum(counts)
    rows = []
    slices, marks, firsts = (given.column(n).to_pylist() for n in ("slice", "mark", "first"))
    for row, (lo, hi) in enumerate(zip(np.searchsorted(losing, ends - counts), np.searchsorted(losing, ends), strict=True)):
        if lo == hi:
            continue
        some = losing[lo:hi]
        held = least[words.ranges(first_window[some], windows[some])]
        piece = some - (ends[row] - counts[row]) + firsts[row]
        packed = [tables.pack(x.tobytes()) for x in (piece.astype(np.int32), windows[some].astype(np.int32), held)]
        rows.append((slices[row], marks[row], *packed, None))
    return tables.record(FOUND, [list(c) for c in zip(*rows, strict=True)] or [[]] * len(FOUND))


def slice_spans(table: pa.Table, window: int) -> pa.Table:
    """The spans of a slice's documents, from its places and the buckets' answers."""
    if len(pc.unique(table.column("mark"))) > 1:
        raise ValueError("the documents came in another order when a task was repeated; read them from written files")
    (packed,) = table.column("home").drop_null().to_pylist()
    home = np.load(io.BytesIO(tables.unpack(packed)))
    answered = table.filter(pc.is_valid(table.column("piece")))
    lists = [
        np.concatenate([np.frombuffer(tables.unpack(p), kind) for p in answered.column(name).to_pylist()] or [np.zeros(0, kind)])
        for name, kind in (("piece", np.int32), ("windows", np.int32), ("least", np.int64))
    ]
    piece, windows, least = lists
    first, count = np.zeros((2, int(home["pieces"][0])), dtype=np.int64)
    first[piece], count[piece] = np.cumsum(windows) - windows, windows
    doc, own, document, position = home["doc"], home["piece"], home["document"], home["position"]
    chosen = np.flatnonzero(count[own])
    n = count[own[chosen]]
    row = np.repeat(np.arange(len(chosen)), n)
    number = words.ranges(np.zeros(len(chosen), np.int64), n)
    hit = least[first[own[chosen]][row] + number] < doc[document[chosen]][row]
    row, number = row[hit], number[hit]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(row))[: len(begin)] - 1
    source = chosen[row[begin]]
    start = (position[source] + number[begin]).astype(np.int32)
    stop = (position[source] + number[end] + window).astype(np.int32)
    # Places stand in the order of the documents, so each document's spans stand together.
    holders, sizes = np.unique(document[source], return_counts=True)
    version = home["version"].tobytes()
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], fields=list(SPAN))
    columns = [
        pa.array(doc[holders], mask=doc[holders] == LAST),
        pa.array([version[DIGEST * h : DIGEST * (h + 1)] for h in holders.tolist()], pa.binary()),
        tables.lists(spans, sizes),
    ]
    return pa.Table.from_arrays(columns, schema=SPANS)


def least_document(found: words.Words, at: np.ndarray, window: int, doc: np.ndarray) -> np.ndarray:
    """For every window the smallest document among the windows of the same words."""
    key = words.grams(found.hashes(), window)[at]
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = np.diff(key[order]) != 0
    begin = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    head = at[order[begin]][group]
    tail = at[order]
    size = found.ends[tail + window - 1] - found.starts[tail]
    other = np.flatnonzero(~fresh)
    same = found.ends[head + window - 1] - found.starts[head] == size
    same[other] &= equal_bytes(found.data, found.starts[head[other]], found.starts[tail[other]], size[other])
    if not same.all():  # two texts under one hash: number the windows by their bytes
        names: dict[bytes, int] = {}
        data = found.data
        exact = [
            names.setdefault(data[a:b].tobytes(), len(names))
            for a, b in zip(found.starts[at].tolist(), found.ends[at + window - 1].tolist(), strict=True)
        ]
        group = np.array(exact)
        out = np.full(len(names), LAST)
        np.minimum.at(out, group, doc)
        return out[group]
    out = np.empty(len(at), dtype=np.int64)
    out[order] = np.minimum.reduceat(doc[order], begin)[group]
    return out


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` and from ``b`` on are equal; lengths are equal already."""
    view = words.byte_steps(data)
    out = np.ones(len(a), dtype=bool)
    left = np.arange(len(a))
    step = 0
    while len(left):
        mask = words._MASKS[np.minimum(size[left] - step, 8)]
        at_a = np.minimum(a[left] + step, len(view) - 1)
        at_b = np.minimum(b[left] + step, len(view) - 1)
        out[left] &= (view[at_a] & mask) == (view[at_b] & mask)
        step += 8
        left = left[(size[left] > step) & out[left]]
    return out


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "_text"):
            kept, total, gone = [], [], []
            texts = [None if t is None else tables.unpack(t) for t in part.column("_text").to_pylist()]
            for text, ranges in zip(texts, part.column("_spans").to_pylist(), strict=True):
                parts = (text or b"").split()  # at the six ASCII blanks, as words do
                out = np.zeros(len(parts), dtype=bool)
                for r in ranges or ():
                    out[r["start"] : r["stop"]] = True
                removed = int(out.sum())
                total.append(len(parts))
                gone.append(removed)
                if removed:
                    parts = [w for w, x in zip(parts, out.tolist(), strict=True) if not x]
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), *(pa.array(x, k) for x, k in zip((texts, kept, total, gone), OUT, strict=True))],
                names=["_row", "_text", *MADE],
            )


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "_text"):
            texts = [None if t is None else tables.pack(t.encode()) for t in part.column("_text").to_pylist()]
            yield part.set_column(part.schema.get_field_index("_text"), "_text", pa.array(texts, pa.binary()))
