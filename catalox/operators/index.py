"""Lookups, ranges and pages in the order of one field."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalox.sources.scratch import delete, materialize

PAGE = 1000
#: Pages that lie together in one part of a kept index.
LEAF_PAGES = 16


def find_by_value(df: DataFrame, field: str, value) -> DataFrame:
    return df.filter(F.col(field) == F.lit(value))


def find_by_range(df: DataFrame, field: str, low=None, high=None, low_in: bool = True, high_in: bool = True) -> DataFrame:
    """Records in value order between the bounds; one bound may be absent."""
    if low is None and high is None:
        raise ValueError("a range needs a bound")
    c = F.col(field)
    found = df.filter(c.isNotNull())
    if low is not None:
        found = found.filter(c >= F.lit(low) if low_in else c > F.lit(low))
    if high is not None:
        found = found.filter(c <= F.lit(high) if high_in else c < F.lit(high))
    return found


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with the place of each row in a total order, from 0, without gathering rows in one task.

    Rows are dealt by ranges of the order and written once; a row's place is its
    range's start and its place there. Only one count per range is combined.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("own_place", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")
    part = F.shiftright("own_place", 33)
    sizes = ranged.groupBy(part.alias("range")).agg(F.count("*").alias("n"))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = ranged.withColumn("range", part).join(F.broadcast(starts), "range")  # a row for each partition at most
    return placed.withColumn(name, F.col("start") + F.col("own_place").bitwiseAND((1 << 33) - 1)).drop("range", "start", "own_place")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = PAGE) -> DataFrame:
    """One page of a numbered order, with the total of pages and entries."""
    placed = numbered(df, order)
    total = df.count()
    return placed.filter(F.floor(F.col("position") / size) == number).withColumns({"total_entries": F.lit(total).cast("long"), "total_pages": F.lit(-(-total // size)).cast("long")})


def page_after(df: DataFrame, order: Sequence[Column], after: Column | None, size: int = PAGE) -> DataFrame:
    """The next ``size`` rows for which ``after`` holds: the page that follows a known last row."""
    return (df if after is None else df.filter(after)).orderBy(*order).limit(size)


def page_stats(df: DataFrame, order: Sequence[Column], size: int = PAGE) -> DataFrame:
    pages = numbered(df, order).groupBy(F.floor(F.col("position") / size).alias("page")).agg(F.count("*").alias("n"))
    return pages.agg(F.count("*").alias("pages"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("average"))


def build(df: DataFrame, path: str, name: str, order: Sequence[Column], size: int = PAGE, leaf_pages: int = LEAF_PAGES) -> None:
    """Keep ``df`` in an order as Parquet below ``path``, in place of an index of that name: a page is read without the others."""
    placed = numbered(df, order).withColumn("page", F.floor(F.col("position") / size).cast("long"))
    leaf = F.floor(F.col("page") / leaf_pages).cast("long")
    placed = placed.withColumn("leaf", leaf).repartitionByRange("leaf").sortWithinPartitions("leaf", "position")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("leaf").parquet(f"{path}/{name}/entries")
    kept = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/{name}/entries")
    total = kept.agg(F.count("*").alias("total_entries")).select("total_entries", F.ceil(F.col("total_entries") / size).cast("long").alias("total_pages"), F.lit(leaf_pages).alias("leaf_pages"), F.lit(placed.schema.json()).alias("schema"))
    total.coalesce(1).write.mode("overwrite").json(f"{path}/{name}/totals")


def _totals(spark: SparkSession, path: str, name: str) -> Row:
    return spark.read.schema("total_entries long, total_pages long, leaf_pages int, schema string").json(f"{path}/{name}/totals").first()


def _leaves(spark: SparkSession, path: str, name: str, totals: Row, start: int, stop: int) -> DataFrame:
    """The entries of the leaves from ``start`` up to ``stop``; the folders of others are not even listed."""
    root = f"{path}/{name}/entries"
    last = -(-totals["total_pages"] // totals["leaf_pages"])
    schema = StructType.fromJson(json.loads(totals["schema"]))
    found = [f"{root}/leaf={n}" for n in range(max(start, 0), min(stop, last))]
    entries = spark.read.schema(schema).option("basePath", root).parquet(*found) if found else spark.createDataFrame([], schema)
    return entries.filter(F.col("leaf").between(start, stop - 1))


def read_page(spark: SparkSession, path: str, name: str, number: int) -> DataFrame:
    """One page of a kept index in its order, with the totals; only the leaf that holds it is scanned."""
    totals = _totals(spark, path, name)
    if not totals["total_entries"]:
        raise ValueError(f"the index {name} has no entries")
    leaf = number // totals["leaf_pages"]
    found = _leaves(spark, path, name, totals, leaf, leaf + 1).filter(F.col("page") == number)
    return found.withColumns({c: F.lit(totals[c]).cast("long") for c in ("total_entries", "total_pages")})


def pages(spark: SparkSession, path: str, name: str, token: int | None = None, leaves: int = 1) -> tuple[DataFrame, int | None]:
    """The entries of the next ``leaves`` leaves from a token (none at first), and the token to go on with; none at the end."""
    totals = _totals(spark, path, name)
    start = token or 0
    stop = start + leaves
    return _leaves(spark, path, name, totals, start, stop), stop if stop * totals["leaf_pages"] < totals["total_pages"] else None


def scan(spark: SparkSession, path: str, name: str, leaves: int = 1) -> DataFrame:
    """All entries in order, each with the ``token`` by which :func:`pages` gives it (0 for the first call's).

    One read, however many leaves there are: a union of the calls' results has a
    scan for each, and each of its tasks reports on all of them.
    """
    entries = spark.read.schema(StructType.fromJson(json.loads(_totals(spark, path, name)["schema"]))).parquet(f"{path}/{name}/entries")
    return entries.withColumn("token", F.col("leaf") - F.col("leaf") % leaves).orderBy("position")


def names(spark: SparkSession, path: str) -> list[str]:
    """The indexes kept below ``path``, in order of name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def drop(spark: SparkSession, path: str, name: str) -> None:
    delete(spark, f"{path}/{name}")
