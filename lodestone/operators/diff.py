"""Snapshots compared: changes, manifests and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status): Added, Modified or Deleted, of two (path, content_hash); what is equal is left out."""
    a, b = stored.select("path", F.col("content_hash").alias("old")), current.select("path", F.col("content_hash").alias("new"))
    status = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").when(F.col("old") != F.col("new"), "Modified")
    return a.join(b, "path", "full").select("path", status.alias("status")).filter("status is not null")


def manifest_hash(files: DataFrame) -> DataFrame:
    """(manifest_hash): SHA-256 over `path NUL hash LF` by path; the same in any order of rows.

    Files are digested in ranges of their hash prefix first, and the ranges' digests by prefix, so that no task
    gathers all paths; a range of 1/4096 of the files is the largest group.
    """
    line = F.concat("path", F.lit("\x00"), "content_hash", F.lit("\n"))
    group = F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 3)
    parts = files.select(group.alias("g"), line.alias("line")).groupBy("g").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "").cast("binary"), 256).alias("d"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: F.concat(x.g, F.lit(":"), x.d)), "\n")
    return parts.agg(F.sha2(whole.cast("binary"), 256).alias("manifest_hash"))


def after_update(stored: DataFrame, upserts: DataFrame, deleted: DataFrame) -> DataFrame:
    """The manifest (path, content_hash) after an update: stored without what is touched, and the upserts."""
    touched = upserts.select("path").unionByName(deleted.select("path"))
    return stored.select("path", "content_hash").join(touched, "path", "left_anti").unionByName(upserts.select("path", "content_hash"))


def counts(changes: DataFrame, discovered: int) -> dict[str, int]:
    found = {r.status: r.n for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    added, modified, deleted = (found.get(k, 0) for k in ("Added", "Modified", "Deleted"))
    return {"added": added, "modified": modified, "deleted": deleted, "unchanged": discovered - added - modified}
