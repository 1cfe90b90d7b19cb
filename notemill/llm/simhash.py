"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits becomes 32 counts: the bits set in each segment of two. The Manhattan distance
of two count vectors is a lower bound of their bit distance. The segments are dealt into ``GROUPS``
groups; at most ``max_bits`` groups of two near vectors differ, so with ``max_bits + 2`` groups some
two groups agree in all their counts. Each pair of groups is therefore one grid, its cell the counts of
those groups, and near fingerprints share a cell of some grid. Inside a cell the Manhattan distance of
the eight-bit segment counts filters and the exact bit distance decides.

* Only distinct fingerprints enter the grids, so copies never form pairs.
* A cell of more than ``CELL`` fingerprints is dealt into blocks by hash and joined block by block.
* A cell returns links that span its connected parts, not all pairs, so large groups stay linear.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other. A
null doc_id takes part; a component of such rows alone has a null component_id. Rows that share a
doc_id keep their own fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm import tables, words
from notemill.llm.components import components
from notemill.scale import cut, lookup_join

SHINGLE = 4
MAX_BITS = 4
SEED = 42
CELL = 4096
BITS_BYTES = 1 << 20  # text per slice: a shingle takes 64 bytes while its bits are counted
SEGMENT_BITS = 0x5555555555555555  # every second bit

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, version, fingerprint, component_id, root) for every row of ``docs``.

    ``version`` is the hash of the text, which tells rows of one doc_id apart; component_id is the
    smallest doc_id reachable over links of at most ``max_bits`` differing bits, and ``root`` names the
    component by one of its fingerprints, which also holds where ids are null or repeated.
    """
    marked = cut(fingerprints(docs, doc_id, text, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(distinct.select("fp"), max_bits))
    of_fp = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    least = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(of_fp.join(least, "root").select("fp", "component_id", "root", "n"))
    return lookup_join(marked, by_fp, "fp", spread=("doc_id", "version"), frequency="n").select(
        "doc_id", "version", hex16("fp").alias("fingerprint"), "component_id", hex16("root").alias("root")
    )


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: smallest doc_id, then smallest version of the text."""
    near = near_duplicates(docs, doc_id, text, **options)
    # Nulls last: a component keeps a row without an id only if it has no other.
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")
    keep = (
        near.groupBy("root")
        .agg(F.min(rank).alias("k"))
        .select(F.col("k.doc_id").alias("_kept_id"), F.col("k.version").alias("_kept_version"))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    carried = docs.select(F.col(doc_id).cast("long").alias("_doc"), tables.version(text).alias("_version"), row)
    # Equal rows both match; number them within the id, which the join has brought together.
    once = Window.partitionBy("_doc", "_version").orderBy(F.lit(0))
    return (
        carried.join(
            keep, carried["_doc"].eqNullSafe(keep["_kept_id"]) & (carried["_version"] == keep["_kept_version"])
        )
        .withColumn("_nth", F.row_number().over(once))
        .where("_nth = 1")
        .select("_row.*")
    )


def hex16(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("fp", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", BITS_BYTES):
                fp = simhash(part.column("text"), shingle).view(np.int64)
                yield tables.record(schema, [part.column("doc_id"), part.column("version"), fp])

    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), tables.version(text).alias("version"), F.col(text).alias("text")
    ).mapInArrow(mark, "doc_id long, version long, fp long")


def simhash(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set if more than half of the shingles' XXH64 values set it."""
    found = words.split(texts, words.NOT_BLANK, lower=True)
    text, offsets = found.joined()
    n = found.per_document
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = words.ranges(found.first[:-1], count)
    width = np.repeat(np.minimum(n, shingle), count)
    left, right = offsets[begin], offsets[begin + width] - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(text[a:b], SEED) for a, b in zip(left.tolist(), right.tolist(), strict=True)), np.uint64, len(begin)
    )
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > count[some, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def grid_masks(max_bits: int) -> list[int]:
    """For every pair of groups, the bits that hold their segment counts."""
    groups = max_bits + 2
    members = [sum(0b11 << (2 * s) for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    return [a | b for a, b in combinations(members, 2)]


def near_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that span every connected part of the near fingerprints in ``distinct`` (fp)."""
    low = F.lit(SEGMENT_BITS)
    # The sum of two bits, written without an addition that could overflow.
    even, odd = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    counts = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    signed = [m - (1 << 64) if m >> 63 else m for m in grid_masks(max_bits)]
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), counts.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(signed)])
    members = distinct.select("fp", F.explode(cells).alias("c")).select("fp", "c.grid", "c.cell")
    # A cell's size gives its number of blocks; a member goes to every pair of blocks with its own.
    large = members.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL)
    dealt = (
        members.join(cut(large), ["grid", "cell"], "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("size") / CELL), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "fp",
            F.xxhash64("grid", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        )
    )
    bucket = F.pmod(F.col("cell"), F.lit(8 * tables.shuffle_partitions(distinct)))

    def link(table: pa.Table) -> pa.Table:
        links = cell_links(table, max_bits)
        words.give_back()
        return links

    return dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(link, "a long, b long").distinct()


def cell_links(table: pa.Table, max_bits: int) -> pa.Table:
    cell = table.column("cell").to_numpy()
    fp = table.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order]
    coarse = fp[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(8)) & np.uint64(0xFF)
    counts = np.bitwise_count(coarse).astype(np.int16)
    bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo > 1:
            left, right = spanning_links(fp[lo:hi], counts[lo:hi], max_bits)
            a.append(left)
            b.append(right)
    return pa.Table.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=LINKS)


def spanning_links(fp: np.ndarray, counts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Search each connected part breadth first; every step looks at the members not yet reached."""
    rest = np.arange(len(fp))
    queue: list[int] = []
    a, b = [], []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        at = queue.pop()
        bound = np.abs(counts[rest] - counts[at]).sum(axis=1)  # Manhattan: never above the bit distance
        near = np.flatnonzero(bound <= max_bits)
        near = near[np.bitwise_count(fp[rest[near]] ^ fp[at]) <= max_bits]
        if len(near):
            found = rest[near]
            a.append(np.full(len(found), fp[at]))
            b.append(fp[found])
            queue.extend(found.tolist())
            rest = np.delete(rest, near)
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)
