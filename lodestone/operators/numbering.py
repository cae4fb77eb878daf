"""Consecutive numbers over an order without one task seeing all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise


def numbered(df: DataFrame, order: str, name: str, start: int = 1) -> DataFrame:
    """df with a column `name`: start, start + 1, ... by `order`, whose ties are numbered in any order.

    Rows are dealt by ranges and sorted there; the driver sees one count a range.
    """
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    ranges = df.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_range"), place.alias("_place"))
    held = materialise(ranges, "numbered")
    counts = sorted((r._range, r.n) for r in held.groupBy("_range").agg(F.count("*").alias("n")).collect())
    firsts = [0, *accumulate(n for _, n in counts)]
    table = df.sparkSession.createDataFrame([(k, a) for (k, _), a in zip(counts, firsts)], "_range int, _first bigint")
    return held.join(F.broadcast(table), "_range").withColumn(name, F.col("_first") + F.col("_place") + start).drop("_range", "_place", "_first")
