"""Connected components of a link table, by smallest-label rounds with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.scale import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``links`` (a, b).

    A round hands every node the smallest root of its neighbours, then follows the root's own root, so
    chains shorten by half. Each round is written to the checkpoint folder; the driver sees one count.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a <> b").distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root")))
    while True:
        seen = (
            both.join(roots, both["b"] == roots["node"])
            .groupBy(both["a"])
            .agg(F.min("root").alias("near"))
        )
        nearer = roots.join(seen, roots["node"] == seen["a"]).select(
            "node", F.col("root").alias("before"), F.least("root", "near").alias("root")
        )
        over = nearer.select(F.col("node").alias("via"), F.col("root").alias("next"))
        jumped = cut(
            nearer.join(over, nearer["root"] == over["via"]).select(
                "node", "before", F.least("root", "next").alias("root")
            )
        )
        changed = jumped.where("root <> before").limit(1).count()
        roots = jumped.select("node", "root")
        if not changed:
            return roots
