"""Connected components by contraction: links shrink with every round, and nothing meets on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakframe.llm.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows these hooks
    to their end, and keeps links between different trees only. A node that
    links to very many others is counted before it moves.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stored(pairs)
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        while True:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stored(hooks.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = hooks
        else:
            # Earlier trees keep nodes of their own; where their root has a new root, they follow.
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            roots = stored(roots.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root")))
        end = lambda side: hooks.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        left = stored(
            left.join(end("a"), "a").join(end("b"), "b").where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()
        )
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
