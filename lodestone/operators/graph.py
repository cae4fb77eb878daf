"""Graph traversal with set semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import scratch_path


def transitive_closure(edges: DataFrame, seeds: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node): all nodes reachable from the seeds (node) over edges (src, dst), the seeds included.

    Each round joins the frontier only and drops what has been reached, as a recursive UNION does, so that cycles
    end. Rounds are written to the shared folder, which cuts the lineage; null nodes and edges reach nothing.
    """
    spark = seeds.sparkSession
    known = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    base = scratch_path(spark, "reached")
    kind = seeds.schema["node"].dataType.simpleString()

    def written(nodes: DataFrame, number: int) -> DataFrame:
        nodes.write.parquet(f"{base}/round={number}")
        return spark.read.schema(f"node {kind}").parquet(f"{base}/round={number}")

    frontier = written(seeds.select("node").filter("node is not null").distinct(), 0)
    for number in range(1, most_rounds + 1):
        reached = spark.read.schema(f"node {kind}, round int").parquet(base).select("node")
        step = frontier.join(known, frontier.node == known.src).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(reached, "node", "left_anti"), number)
        if frontier.isEmpty():
            return reached
    raise RuntimeError(f"the closure did not end within {most_rounds} rounds")


def dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes from which a seed is reachable."""
    return transitive_closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)
