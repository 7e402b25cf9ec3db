"""Connected components of a list of links, by contraction: every node hooks to its smallest neighbour, chains are halved, links are
renamed to roots and deduplicated, until none is left. All steps are grouped minima and joins; nothing goes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every node that has a link; root is the smallest node of its component."""
    e = cut(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    named = None
    while not e.isEmpty():
        up = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
        up = cut(nodes.join(up, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
        while True:  # root = root of root, till nothing moves
            r = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = cut(up.join(r, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            up = new.drop("moved")
            if not moved:
                break
        ra, rb = (up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        e = cut(e.join(ra, "a").join(rb, "b").where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if named is None:
            named = up
        else:
            m = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            named = named.join(m, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if named is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return cut(named)
