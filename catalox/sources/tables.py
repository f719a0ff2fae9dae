"""Driver tables and the catalogue records derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as media records: asset_id, file_name, content_type, photo_date, labels, hash, size.

    ``labels`` is null for unspecified and empty for low priority.
    """
    return as_assets(load(spark, sf_dir, "orders"))


def as_assets(orders: DataFrame) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = F.lower(F.split_part(priority, F.lit("-"), F.lit(2)))
    suffix = F.when(status == "F", "jpg").when(status == "O", "png").otherwise("mp4")
    return orders.select(
        F.col("o_orderkey").alias("asset_id"),
        F.concat(F.replace(kind, F.lit(" "), F.lit("_")), F.lit("-"), F.col("o_orderkey").cast("string"), F.lit("."), suffix).alias("file_name"),
        F.when(status == "F", "image/jpeg").when(status == "O", "image/png").otherwise("video/mp4").alias("content_type"),
        F.col("o_orderdate").alias("photo_date"),
        F.when(priority == "4-NOT SPECIFIED", F.lit(None)).when(priority == "5-LOW", F.array().cast("array<string>")).otherwise(F.array(priority, status)).alias("labels"),
        F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), status), 256).alias("hash"),
        F.round("o_totalprice").cast("long").alias("size"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as placed records: item_id, file_name, location, lat, lng.

    Every fifth segment has no place. Coordinates are arithmetic on the key.
    """
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    city = F.concat(F.lit("City "), (F.col("c_custkey") % 40).cast("string"))
    placed = F.col("c_mktsegment") != "FURNITURE"
    return joined.select(
        F.col("c_custkey").alias("item_id"), F.col("c_name").alias("file_name"),
        F.when(placed, F.concat_ws(", ", city, F.col("n_name"), F.col("r_name"))).alias("location"),
        F.when(placed, (F.col("c_custkey") * 37 % 17900) / 100.0 - 89.5).alias("lat"),
        F.when(placed, (F.col("c_custkey") * 53 % 35900) / 100.0 - 179.5).alias("lng"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a collection: (key, status, priority, price, ts, hash) of a local and an origin database.

    The local one lacks pending records; the origin lacks low priorities and has
    edited the status of the urgent ones later.
    """
    o = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    hashed = lambda d: d.withColumn("hash", F.sha2(F.concat_ws("|", "key", "status", "priority", "price"), 256))
    edited = F.col("priority") == "1-URGENT"
    origin = o.filter("priority <> '5-LOW'").withColumn("status", F.when(edited, F.concat("status", F.lit("*"))).otherwise(F.col("status"))).withColumn(
        "ts", F.when(edited, F.col("ts") + 60).otherwise(F.col("ts")))
    return hashed(o.filter("status <> 'P'")), hashed(origin)
