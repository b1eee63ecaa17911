"""Connected components by alternating stars, in DataFrame operations.

Each round points every node's larger neighbours at the least node it knows (large star), then every node's
smaller neighbours and itself (small star). Rounds grow with the logarithm of a component's size, not its
width. Each round's edges are a written table, so lineage stays short and no executor holds the only copy;
the driver sees a count and a checksum. A node with a third of all edges is one row on the side of the minima,
and its edges on the other side are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import removed, written


def _star(edges: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """Edges with their node's minimum. The minima are dealt anew, so that the join's two sides are shuffled for it alone and
    the edges of a hot node can be split."""
    return edges.join(least.hint("rebalance"), node)


def connected_components(edges: DataFrame, max_rounds: int = 100, at: list[str] | None = None, about: int | None = None) -> DataFrame:
    """``node`` and ``component`` (its least node) for all nodes of ``edges(a, b)`` in components of two or more.

    Loops, repeated edges and edges with a null end count for nothing. No edges: an empty result. The result reads a written table whose
    path is added to ``at``; tables of earlier rounds are deleted. ``about`` is a guess at the number of edges, for the size of files.
    """
    spark, kept = edges.sparkSession, []

    def sound(pairs: DataFrame) -> DataFrame:
        """Distinct edges (u, v) with u > v."""
        return pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1] or 0

    now = written(sound(edges.select("a", "b")), "edges", kept, None if about is None else 16 * about)
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _star(both, "u", least).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = sound(large)
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(down, "u", least)
        pairs = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        before = kept[:]
        kept.clear()
        now = written(sound(pairs), "edges", kept, 16 * seen[0])
        removed(spark, before)
        found = mark(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if at is not None:
        at.extend(kept)
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(
        F.col("u").alias("node"), F.col("v").alias("component")
    ).unionByName(tops.select("node", F.col("node").alias("component")))
