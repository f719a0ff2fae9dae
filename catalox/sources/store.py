"""A collection as Parquet snapshots partitioned by shard; versions switch by name.

Files hold key ranges of a shard, so a large shard is written by many tasks and a
lookup skips files by their bounds. A version is whole (``v<n>``) or holds only the
shards that differ from the version before (``d<n>``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalox.functions.records import SHARDS, shard_of
from catalox.sources.scratch import delete


def write_version(records: DataFrame, path: str, version: int, key: str, shards: int = SHARDS) -> None:
    """Write all records as one version, in place of what a failed attempt left of it. A version is complete once Spark has written its success mark."""
    records.withColumn("shard", shard_of(F.col(key), shards)).repartitionByRange("shard", key).sortWithinPartitions("shard", key).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(f"{path}/v{version}")


def write_shards(records: DataFrame, path: str, version: int, key: str) -> None:
    """Write the version as that before it with the shards that ``records`` holds, each with all its records."""
    records.repartitionByRange("shard", key).sortWithinPartitions("shard", key).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(f"{path}/d{version}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, kind) of the complete versions in order."""
    found = [(int(n[1:]), n[0]) for n in _folders(spark, path) if n[:1] in ("v", "d") and n[1:].isdigit()]
    return sorted((n, kind) for n, kind in found if "_SUCCESS" in _folders(spark, f"{path}/{kind}{n}"))


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest complete version."""
    return max((n for n, _ in _versions(spark, path)), default=None)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, the newest by default: each shard from the last folder that holds it."""
    found = [x for x in _versions(spark, path) if version is None or x[0] <= version]
    if not any(kind == "v" for _, kind in found) or version not in (None, found[-1][0]):
        raise ValueError(f"{path} has no complete version" + ("" if version is None else f" {version}"))
    whole = max(n for n, kind in found if kind == "v")
    out, newer = None, []
    for n in sorted((n for n, kind in found if kind == "d" and n > whole), reverse=True):
        own = [int(x.removeprefix("shard=")) for x in _folders(spark, f"{path}/d{n}") if x.startswith("shard=")]
        part = spark.read.parquet(f"{path}/d{n}").filter(F.col("shard").isin([x for x in own if x not in newer])) if own else None
        out = part if out is None else out if part is None else out.unionByName(part)
        newer += own
    rest = spark.read.parquet(f"{path}/v{whole}").filter(~F.col("shard").isin(newer))
    return rest if out is None else out.unionByName(rest)


def point_lookup(records: DataFrame, key: str, value, shards: int = SHARDS) -> DataFrame:
    """The record of one key. The shard predicate prunes the scan to one partition."""
    wanted = F.lit(value)
    return records.filter((F.col("shard") == shard_of(wanted, shards)) & (F.col(key) == wanted))


def shard_page(records: DataFrame, shard: int) -> DataFrame:
    return records.filter(F.col("shard") == shard)


def collections(spark: SparkSession, path: str) -> list[str]:
    """Names of the collections in a database's folder that have a complete version."""
    return sorted(n for n in _folders(spark, path) if latest(spark, f"{path}/{n}") is not None)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a collection with all its versions."""
    delete(spark, path)
