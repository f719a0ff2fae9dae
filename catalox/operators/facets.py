"""Facets, clusters, duplicates and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalox.functions.places import grid_cell


def years(df: DataFrame, dates: Sequence[Column]) -> DataFrame:
    """Distinct years over several dates, with the records of each."""
    found = df.select(F.explode(F.array_distinct(F.array_compact(F.array(*[F.year(d) for d in dates])))).alias("year"))
    return found.groupBy("year").agg(F.count("*").alias("n"))


def place_names(df: DataFrame, location: Column) -> DataFrame:
    """Distinct last and last-but-one comma parts."""
    parts = F.transform(F.split(location, ","), lambda x: F.trim(x))
    ends = F.array_compact(F.array(F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))))
    return df.filter(location.isNotNull()).select(F.explode(F.array_distinct(ends)).alias("place")).groupBy("place").agg(F.count("*").alias("n"))


def clusters(df: DataFrame, lat: str, lng: str, zoom: int) -> DataFrame:
    """Map cells with the mean place and the number of their records; records without a place are left out."""
    cells = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(grid_cell(F.col(lat), zoom).alias("cell_y"), grid_cell(F.col(lng), zoom).alias("cell_x"))
    return cells.agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"), F.count("*").alias("n"))


def collisions(df: DataFrame, hash_: str, key: str) -> DataFrame:
    """Hashes of several records: hash, n, first key."""
    return df.groupBy(hash_).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).filter("n > 1")


def duplicates(df: DataFrame, hash_: str, size: str) -> DataFrame:
    """Groups of equal hash and size among the hashes of several records."""
    by_size = df.groupBy(hash_, size).agg(F.count("*").alias("n"))
    return by_size.withColumn("records", F.sum("n").over(Window.partitionBy(hash_))).filter("records > 1").drop("records")


def duplicate_verdict(df: DataFrame, hash_: str, size: str) -> DataFrame:
    """How many shared hashes have one size (true duplicates) and how many several (collisions)."""
    sizes = duplicates(df, hash_, size).groupBy(hash_).agg(F.count("*").alias("sizes"))
    return sizes.agg(F.count_if(F.col("sizes") == 1).alias("true_duplicates"), F.count_if(F.col("sizes") > 1).alias("collisions"))


def later_copies(df: DataFrame, hash_: str, key: str) -> DataFrame:
    """All records of a hash but the first, for removal."""
    first = df.groupBy(hash_).agg(F.min(key).alias("first_key"), F.count("*").alias("n")).filter("n > 1")
    return df.join(first.select(hash_, "first_key"), hash_).filter(F.col(key) > F.col("first_key"))


def summary(df: DataFrame, size: str, hash_: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("records"), F.sum(size).alias("total_size"), F.countDistinct(hash_).alias("contents"),
        F.floor(F.try_divide(F.sum(size), F.count("*"))).cast("long").alias("average_size"))


def top_values(df: DataFrame, value: str, n: int) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def navigation(groups: DataFrame, upper: str, lower: str, position: str) -> DataFrame:
    """The menu: each upper heading with its lower ones in listing order."""
    first = groups.groupBy(upper, lower).agg(F.min(position).alias("at"))
    kept = first.groupBy(upper).agg(F.sort_array(F.collect_list(F.struct("at", lower))).alias("x"))
    return kept.select(upper, F.col(f"x.{lower}").alias("entries"))
