"""Comparing two versions of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalox.operators.index import numbered


def by_name(a: DataFrame, b: DataFrame, name: str, hash_: str) -> DataFrame:
    """Rows (name, status): only_a, only_b or modified; equal ones are left out."""
    x, y = a.select(F.col(name).alias("a_name"), F.col(hash_).alias("a_hash")), b.select(F.col(name).alias("b_name"), F.col(hash_).alias("b_hash"))
    status = F.when(F.col("b_name").isNull(), "only_a").when(F.col("a_name").isNull(), "only_b").otherwise("modified")
    joined = x.join(y, F.col("a_name") == F.col("b_name"), "full").filter("a_name is null or b_name is null or not (a_hash <=> b_hash)")
    return joined.select(F.coalesce("a_name", "b_name").alias(name), status.alias("status"))


def unmatched(a: DataFrame, b: DataFrame, name: str, hash_: str) -> DataFrame:
    """Rows (side, name, hash) of either side ("a", "b") whose hashes exceed those of the other in number; of equal hashes the last names stay.

    Only counts of hashes meet, so no pairs are made; names are ordered only where
    both sides hold a hash and one of them more often. A null hash matches nothing.
    """
    every = a.select(F.lit("a").alias("side"), name, hash_).unionByName(b.select(F.lit("b").alias("side"), name, hash_))
    mine = F.col("side") == "a"
    counts = every.groupBy(hash_).agg(F.count_if(mine).alias("n_a"), F.count_if(~mine).alias("n_b"))
    rows = every.join(counts, hash_).withColumns({"own": F.when(mine, F.col("n_a")).otherwise(F.col("n_b")), "held": F.when(mine, F.col("n_b")).otherwise(F.col("n_a"))})
    placed = numbered(rows.filter("held > 0 and own > held").select("side", name, hash_, "held"), [F.col("side"), F.col(hash_), F.col(name)])
    starts = placed.groupBy("side", hash_).agg(F.min("position").alias("start"))
    more = placed.join(starts, ["side", hash_]).filter("position - start >= held")
    return more.select("side", name, hash_).unionByName(rows.filter("held = 0").select("side", name, hash_)).unionByName(every.filter(F.col(hash_).isNull()))


def by_content(a: DataFrame, b: DataFrame, name: str, hash_: str) -> DataFrame:
    """Rows (name, status) of the difference by content: names unmatched on both sides are modified."""
    sides = unmatched(a, b, name, hash_).groupBy(name).agg(F.collect_set("side").alias("sides"))
    status = F.when(F.size("sides") == 2, "modified").when(F.array_contains("sides", "a"), "only_a").otherwise("only_b")
    return sides.select(name, status.alias("status"))


def replicate_plan(source: DataFrame, target: DataFrame, name: str, hash_: str) -> DataFrame:
    """Rows (name, action) that make the target equal the source: copy or prune."""
    return by_name(source, target, name, hash_).select(name, F.when(F.col("status") == "only_b", "prune").otherwise("copy").alias("action"))


def differing_shards(a: DataFrame, b: DataFrame) -> list[int]:
    """Shards whose roots (shard, root) differ; a collection has a fixed number of shards."""
    joined = a.select("shard", F.col("root").alias("x")).join(b.select("shard", F.col("root").alias("y")), "shard", "full")
    return sorted(r["shard"] for r in joined.filter("not (x <=> y)").select("shard").collect())


def without(leaves: DataFrame, name: str, prefixes: Sequence[str]) -> DataFrame:
    """Leaves whose name is none of the prefixes nor below one."""
    gone = F.lit(False)
    for p in prefixes:
        gone = gone | (F.col(name) == p) | F.col(name).startswith(p.rstrip("/") + "/")
    return leaves.filter(~gone)
