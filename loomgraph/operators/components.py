"""Connected components of a link table, in the cluster alone."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stage


def _doubled(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) of every node of (a, b) links; component is its smallest node.

    Alternating large-star and small-star steps: each links the neighbours of a node to the
    smallest of them, so the number of links never grows and the depth of trees falls by
    squares; a few rounds do for any data met here. Minima are grouped sums with partial
    aggregation and the links of a hot node meet it in a join, so no task gathers a node's
    neighbours. Every round is written to the shared folder.
    """
    now = stage.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links-0")
    k, before = 0, None
    while True:
        k += 1
        # Large star: neighbours larger than a node go to the smallest of its neighbourhood.
        both = _doubled(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(
            joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        new = stage.write(small, f"links-{k}")
        mark = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        stage.drop(f"links-{k - 1}")
        now = new
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def spanning(a, b) -> list[int]:
    """Positions of a spanning forest of the links (a[i], b[i]): those that join two trees."""
    parent: dict = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x], x = root, p
        return root

    kept = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept
