"""Verification and repair of records against the files they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(expected: DataFrame, found: DataFrame, key: str, full: bool = False) -> DataFrame:
    """Rows (key, status) for each expected file: unmodified, modified, removed, or new for files that nobody expects.

    Both sides have ``key, size, hash``. Without ``full`` a hash counts only where
    the size differs or is unknown.
    """
    e, f = expected.alias("e"), found.alias("f")
    changed = ~F.col("e.size").eqNullSafe(F.col("f.size"))
    differs = ~F.col("e.hash").eqNullSafe(F.col("f.hash"))
    changed = differs if full else changed & differs
    joined = e.join(f, F.col(f"e.{key}") == F.col(f"f.{key}"), "full")
    status = F.when(F.col(f"f.{key}").isNull(), "removed").when(F.col(f"e.{key}").isNull(), "new").when(changed, "modified").otherwise("unmodified")
    return joined.select(F.coalesce(f"e.{key}", f"f.{key}").alias(key), status.alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def repair(leaves: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records that agree with the file leaves (key, hash): stubs for missing ones, the leaf's hash where it differs."""
    known = records.select(key, F.col("hash").alias("own_hash"))
    action = F.when(F.col("own_hash").isNull(), "insert").when(F.col("own_hash") != F.col("hash"), "fix").otherwise("keep")
    return leaves.join(known, key, "left").select(key, "hash", action.alias("action"))


def orphans(stored: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return stored.join(known.select(key), key, "left_anti")


def import_summary(results: DataFrame, status: str, size: str) -> DataFrame:
    """Added, skipped and failed imports with the size of what was added."""
    added = F.col(status) == "success"
    return results.agg(
        F.count_if(added).alias("added"), F.count_if(F.col(status) == "skipped").alias("skipped"), F.count_if(F.col(status) == "failure").alias("failed"),
        F.count("*").alias("processed"), F.coalesce(F.sum(F.when(added, F.col(size))), F.lit(0)).alias("total_size"),
    ).withColumn("average_size", F.coalesce(F.floor(F.try_divide("total_size", "added")), F.lit(0)).cast("long"))


def invalid_media(df: DataFrame, size: str, width: str, height: str) -> DataFrame:
    """Records of empty files or without positive dimensions."""
    bad = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    return df.filter(bad(size) | bad(width) | bad(height))


def check_complete(missing: DataFrame, what: str) -> None:
    """Raise if any row is left in ``missing``."""
    row = missing.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")
