"""Fixed aggregates over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import table


def report_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter("lang is not null").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("file_count")).orderBy("language")


QUERIES = {"report_languages": report_languages}
ORACLES = {"report_languages": "SELECT lang AS language, count(*) AS file_count FROM documents WHERE lang IS NOT NULL GROUP BY lang"}
