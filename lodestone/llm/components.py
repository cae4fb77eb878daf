"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import discard, materialise


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Each round is a few shuffles over the links that are left, written to the shared folder; the driver sees
    only counts. Rounds grow with the logarithm of the number of nodes.
    """
    now = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    said = None
    for _ in range(most_rounds):
        count, mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count or (count, mark) == said:
            break
        said = (count, mark)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialise(small.unionByName(least.withColumnRenamed("m", "b")).filter("a != b").distinct(), "links")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    centres = now.select(F.col("b").alias("node")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return stars.unionByName(centres.select("node", F.col("node").alias("root")))
