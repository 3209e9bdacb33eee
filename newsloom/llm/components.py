"""Connected components of a graph of long ids, by alternating star contractions.

Each round hangs every node's neighbours on its smallest neighbour, first the larger ones,
then the smaller ones; after about log(n) rounds every component is a star around its
smallest node.  Minima are pre-aggregated before the shuffle, and the joins that hand them
to the edges of a node with very many neighbours are split by adaptive execution.  Every
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored


def _hung(edges: DataFrame, both_ways: bool) -> DataFrame:
    """``edges`` has a > b.  Large star: a node's larger neighbours go to the smallest of
    its neighbours and itself.  Small star: its smaller neighbours and itself do."""
    down = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if both_ways:
        up = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        links = down.unionByName(up)
    else:
        links = down
    low = links.groupBy(F.col("node").alias("hub")).agg(
        F.least(F.min("other"), F.first("node")).alias("low")
    )
    # Written, so that the join reads plain shuffles, which are split for such a node.
    low = stored(low, "minima")
    if both_ways:
        links = up.join(low, F.col("node") == F.col("hub"))
        moved = links.select(F.col("other").alias("a"), F.col("low").alias("b"))
    else:
        links = down.join(low, F.col("node") == F.col("hub"))
        kept = links.select(F.col("other").alias("a"), F.col("low").alias("b"))
        moved = kept.unionByName(low.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that has a link to another; root is
    the component's smallest node, which also has a row."""
    ordered = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(ordered.distinct(), "links")
    before = _sum(edges)
    while True:
        edges = stored(_hung(_hung(edges, True), False), "stars")
        now = _sum(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots)
