"""Merkle manifest of a dataset: a tree of hashes per group, one root above all, and proofs of rows.

A row's leaf is the hash of its fields; the leaves of a group stand in the order of an id. While a
level has several nodes, every two consecutive ones become the hash of both (a last single one its
own hash). What remains is the group's subroot, and the subroots in group order give the root.

Checkpoint and recompute: of the levels only every ``STRIDE``-th is written to the checkpoint folder,
as rows of an aligned subtree's nodes. Building turns each such row into the one node above it. Proofs
are extracted from the top down: a row regenerates the levels between from its stored nodes, emits
every node's siblings in front of those of the subtree's top, and drops the levels again.

* Places come from range blocks with lifted row numbers, so no group is sorted by one task, and equal
  rows are told apart by their place in the scan.
* A subtree holds 2 ** STRIDE nodes at most, whatever the size of the group; groups are not keys of
  any shuffle. The subroots form a tree of the same kind, so there may be many groups.
* Only leaves and ids are shuffled, never texts. The driver sees the height of the tallest tree.

Defined cases: a null field is written ``-``, an empty text ``0:``. A null id stands before all others
and is never tampered with; rows of equal id stand in the order of their leaves, so repeated rows
have neighbouring places. A group of one row has its leaf as subroot; with one group the subroot is
the root, and a lone row has no siblings. A null group is a group of its own, the first. An empty table
gives no rows. Very long texts are hashed where they are read. Other columns of the input are ignored,
so no name can clash. An error is raised when ``order`` or ``group`` is not a field.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import let
from notemill.scale import cut, running_totals

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STRIDE = 5  # levels between two stored ones: subtrees of 32 nodes
NO_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


def over(nodes: Column) -> Column:
    """The level above an array of nodes."""
    places = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2))
    return F.transform(places, lambda i: digest(F.get(nodes, i), F.coalesce(F.get(nodes, i + 1), F.lit(""))))


def top(nodes: Column, steps: Column) -> Column:
    """The node ``steps`` levels above an aligned run of nodes."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(STRIDE - 1)), nodes, lambda level, k: F.when(k < steps, over(level)).otherwise(level))[0]


def levels(nodes: Column) -> Column:
    """The nodes and the STRIDE - 1 levels above them."""
    start = F.array(nodes)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STRIDE - 1)), start, lambda made, _: F.concat(made, F.array(over(F.element_at(made, -1)))))


def path(regenerated: Column, place: Column, steps: Column) -> Column:
    """The siblings of the node at ``place`` in each of the first ``steps`` levels, beside left and right."""

    def step(k: Column) -> Column:
        at = F.call_function("shiftright", place, k)
        level = F.get(regenerated, k)
        odd = at.bitwiseAND(1) == 1
        left = F.when(odd, F.get(level, at - 1))
        right = F.when(~odd, F.get(level, at + 1))
        return F.struct(F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))

    all_steps = F.transform(F.sequence(F.lit(0), F.lit(STRIDE - 1)), step)
    return F.slice(all_steps, F.lit(1), steps)


def fold(node: Column, proof: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(proof, node, lambda below, s: digest(s["left"], below, s["right"]))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings, level by level and left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"]))), 256)


class Forest:
    """The stored levels of several trees over placed nodes: (tree, place, height, node, payload).

    Places count from 0; ``height`` is the number of levels above the nodes of the tree.
    """

    def __init__(self, nodes: DataFrame):
        self.stored: list[DataFrame] = []
        level = nodes
        tallest = None
        while True:
            rows = cut(self._subtrees(level))
            self.stored.append(rows)
            if tallest is None:
                tallest = rows.agg(F.max("height")).first()[0] or 0
            built = rows.select(
                "tree", F.col("subtree").alias("place"), (F.col("height") - F.col("steps")).alias("height"),
                top(F.col("nodes.node"), F.col("steps")).alias("node"),
            )
            tallest -= min(STRIDE, tallest)
            if not tallest:
                self.tops = cut(built)
                break
            level = built.withColumn("payload", F.lit(None).cast("int"))

    @staticmethod
    def _subtrees(level: DataFrame) -> DataFrame:
        """One row per aligned subtree: its nodes in order, and the levels to climb to its top."""
        steps = F.least(F.lit(STRIDE), "height").cast("int")
        return (
            level.groupBy("tree", "height", F.call_function("shiftright", F.col("place"), F.lit(STRIDE)).alias("subtree"))
            .agg(F.array_sort(F.collect_list(F.struct("place", "node", "payload"))).alias("nodes"))
            .select("tree", "height", "subtree", steps.alias("steps"), "nodes")
        )

    def roots(self) -> DataFrame:
        """(tree, node): what remains of each tree. Lower trees are carried up unchanged."""
        return self.tops.select("tree", "node")

    def proofs(self, above: DataFrame) -> DataFrame:
        """(tree, node, payload, proof) of every node of the lowest level.

        ``above`` (tree, proof) holds the siblings of each tree's own root.
        """
        upper = above.select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_subtree"), F.col("proof").alias("_proof"))
        for rows in reversed(self.stored):
            joined = rows.join(upper, rows["tree"].eqNullSafe(F.col("_tree")) & (rows["subtree"] == F.col("_subtree")))

            def emitted(regenerated: Column) -> Column:
                return F.transform(
                    "nodes",
                    lambda n, i: F.struct(
                        n["place"].alias("place"), n["node"].alias("node"), n["payload"].alias("payload"),
                        F.concat(path(regenerated, i, F.col("steps")), F.col("_proof")).alias("proof"),
                    ),
                )

            out = joined.select("tree", F.inline(let(levels(F.col("nodes.node")), emitted)))
            upper = out.select(F.col("tree").alias("_tree"), F.col("place").alias("_subtree"), F.col("proof").alias("_proof"))
        return out.select("tree", "node", "payload", "proof")


def placed(leaves: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``place`` (from 0) within ``keys`` and the ``height`` of the key's tree."""
    numbered = running_totals(leaves.withColumn("_one", F.lit(1)), keys, order, {"_rank": "_one"}).drop("_one")
    numbered = cut(numbered.withColumn("place", (F.col("_rank") - 1).cast("long")))
    sizes = numbered.groupBy(*keys).agg(F.max("_rank").alias("_n"))
    # 2 ** height is the first power of two that is not below the number of nodes.
    height = F.length(F.regexp_replace(F.bin(F.col("_n") - 1), "^0$", "")).cast("int")
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], height.alias("height"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    return numbered.join(sizes, same).select(*leaves.columns, "place", "height")


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", tampered: str = "n_chars"
) -> DataFrame:
    """(order column, leaf, subroot, root, proof, folded_root) for every row of ``docs``.

    ``proof`` lists one step per level from the leaf to the root: the sibling to the left and to the
    right, empty where there is none. ``folded_root`` is recomputed from the original siblings and the
    leaf, which is a tampered one (1 more in ``tampered``) where 7 divides the CRC-32 of the id.
    """
    if group not in fields or order not in fields:
        raise ValueError("group and order must be fields")
    plain = [F.col(f"`{f}`") for f in fields]
    changed = [F.col(f"`{f}`") + 1 if f == tampered else F.col(f"`{f}`") for f in fields]
    hit = F.crc32(F.col(f"`{order}`").cast("string")) % 7 == 0
    leaves = docs.select(
        F.col(f"`{group}`").alias("tree"),
        F.col(f"`{order}`").alias("ident"),
        leaf(plain).alias("node"),
        F.when(hit, leaf(changed)).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = placed(leaves, ["tree"], [F.col("ident"), F.col("node"), F.col("row")])
    forest = Forest(leaves.select("tree", "place", "height", "node", F.struct("ident", "changed").alias("payload")))
    # The subroots are the nodes of one more tree.
    subroots = forest.roots().select(F.lit(0).alias("one"), F.col("tree").alias("subtree_of"), "node")
    subroots = placed(subroots, ["one"], [F.col("subtree_of")])
    upper = Forest(
        subroots.select(F.col("one").alias("tree"), "place", "height", "node", F.col("subtree_of").alias("payload"))
    )
    root = upper.roots().select("node").scalar()
    nothing = upper.roots().select("tree", F.array().cast(NO_STEPS).alias("proof"))
    by_tree = cut(upper.proofs(nothing).select(F.col("payload").alias("tree"), F.col("node").alias("subroot"), "proof"))
    proven = forest.proofs(by_tree.select("tree", "proof"))
    subroot_of = by_tree.select(F.col("tree").alias("_tree"), "subroot")
    return proven.join(subroot_of, proven["tree"].eqNullSafe(F.col("_tree"))).select(
        F.col("payload.ident").alias(order),
        F.col("node").alias("leaf"),
        "subroot",
        root.alias("root"),
        "proof",
        fold(F.coalesce("payload.changed", "node"), F.col("proof")).alias("folded_root"),
    )


MANIFEST_SQL = r"""WITH RECURSIVE
src AS (
  SELECT doc_id, lang, [COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), COALESCE(strlen(source) || ':' || source, '-'),
    COALESCE(strlen(lang) || ':' || lang, '-')] AS head, n_chars, COALESCE(strlen(text) || ':' || text, '-') AS tail,
    -- CRC-32 of the decimal id, bit by bit.
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(array_to_string(head, '') || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(array_to_string(head, '') || COALESCE(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS bad
  FROM src),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS level, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 1) // 2
  FROM tree WHERE n > 1 GROUP BY lang, level, place // 2),
subroots AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, place, node, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 1) // 2
  FROM upper_tree WHERE n > 1 GROUP BY level, place // 2),
tops AS (SELECT s.lang, s.node AS subroot, s.place AS upper_place, r.node AS root FROM subroots s, upper_tree r WHERE r.n = 1),
steps AS (
  SELECT p.lang, p.place, t.level, (p.place >> t.level) % 2 AS odd, COALESCE(s.node, '') AS sibling
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = t.level AND s.place = xor(p.place >> t.level, 1)
  UNION ALL
  SELECT p.lang, p.place, 100 + t.level, (r.upper_place >> t.level) % 2, COALESCE(s.node, '')
  FROM placed p JOIN tops r ON r.lang IS NOT DISTINCT FROM p.lang, (SELECT DISTINCT level FROM upper_tree WHERE n > 1) t
  LEFT JOIN upper_tree s ON s.level = t.level AND s.place = xor(r.upper_place >> t.level, 1)),
proofs AS (
  SELECT lang, place, list({'odd': odd, 'node': sibling} ORDER BY level) AS proof FROM steps GROUP BY lang, place)
SELECT p.doc_id, p.leaf, r.subroot, r.root, sha256(COALESCE(array_to_string(list_transform(f.proof, lambda s: s.node), ''), '')) AS proof_sha256,
  list_reduce(list_prepend(COALESCE(p.bad, p.leaf), list_transform(COALESCE(f.proof, []), lambda s: s.odd || s.node)),
    lambda below, s: sha256(CASE WHEN s[1] = '1' THEN s[2:] || below ELSE below || s[2:] END)) AS folded_root,
  folded_root = r.root AS verified
FROM placed p JOIN tops r ON r.lang IS NOT DISTINCT FROM p.lang
LEFT JOIN proofs f ON f.lang IS NOT DISTINCT FROM p.lang AND f.place = p.place
"""
