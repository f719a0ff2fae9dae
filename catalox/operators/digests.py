"""Merkle digests of ordered leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalox.operators.index import numbered
from catalox.sources.scratch import materialize

#: Leaves that one task folds at a time, a power of two.
FAN = 4096


def join_nodes(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()


def fold(nodes: Sequence[bytes]) -> list[tuple[int, bytes]]:
    """Perfect subtrees (height, digest) of the nodes, tallest first: one per set bit of their number."""
    peaks: list[tuple[int, bytes]] = []
    for node in nodes:
        height = 0
        while peaks and peaks[-1][0] == height:
            node, height = join_nodes(peaks.pop()[1], node), height + 1
        peaks.append((height, node))
    return peaks


def root_of(peaks: Sequence[bytes]) -> bytes | None:
    """The root of perfect subtrees, tallest first; each shorter one joins on the right."""
    peaks = list(peaks)
    if not peaks:
        return None
    root = peaks[0]
    for peak in peaks[1:]:
        root = join_nodes(root, peak)
    return root


def group_roots(leaves: DataFrame, group: str, order: Sequence[Column], digest: str, fan: int = FAN) -> DataFrame:
    """Rows (group, n, root): the root of each group's leaves in their order. ``digest`` holds hex SHA-256 texts.

    Blocks of ``fan`` leaves fold to one node each and these fold again, so a pass
    shrinks the rows by ``fan`` and no task sees more than a block of a group. An
    unfinished block leaves its perfect subtrees, which join at the end.
    """
    kind = leaves.schema[group].dataType.simpleString()
    keys = [F.col(f"k{i}") for i in range(len(order))]
    placed = numbered(leaves.select(F.col(group).alias("group"), F.col(digest).alias("digest"), *[c.alias(f"k{i}") for i, c in enumerate(order)]), [F.col("group"), *keys])
    sizes = materialize(placed.groupBy("group").agg(F.min("position").alias("start"), F.count("*").alias("n")), "digest-sizes")
    nodes = placed.join(sizes, "group").select("group", (F.col("position") - F.col("start")).alias("place"), "digest")
    schema = f"group {kind}, place long, part int, digest string"

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        peaks = [d.hex() for _, d in fold([bytes.fromhex(d) for d in rows.sort_values("place")["digest"]])]
        whole = len(rows) == fan
        parts = pd.array([None] if whole else list(range(len(peaks))), dtype="Int32")
        return pd.DataFrame({"group": [key[0]] * len(peaks), "place": [key[1]] * len(peaks), "part": parts, "digest": peaks})

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        peaks = rows.sort_values(["level", "part"], ascending=[False, True])["digest"]
        return pd.DataFrame({"group": [key[0]], "root": [root_of([bytes.fromhex(d) for d in peaks]).hex()]})

    left, level, peaks = sizes.agg(F.max("n")).first()[0] or 0, 0, None
    while left:
        folded = materialize(nodes.groupBy("group", F.floor(F.col("place") / fan).alias("block")).applyInPandas(block, schema), "digest-blocks")
        own = folded.filter("part is not null").select("group", F.lit(level).alias("level"), "part", "digest")
        peaks = own if peaks is None else peaks.union(own)
        nodes, left, level = folded.filter("part is null"), left // fan, level + 1
    if peaks is None:
        return leaves.sparkSession.createDataFrame([], f"{group} {kind}, n long, root string")
    roots = peaks.groupBy("group").applyInPandas(finish, f"group {kind}, root string")
    return sizes.join(roots, "group").select(F.col("group").alias(group), "n", "root")


def merkle_root(leaves: DataFrame, order: Sequence[Column], digest: str, fan: int = FAN) -> str | None:
    """The root (hex) of all leaves in an order; null without leaves."""
    row = group_roots(leaves.select("*", F.lit(0).alias("digest_group")), "digest_group", order, digest, fan).first()
    return row["root"] if row else None


def shard_roots(leaves: DataFrame, shard: str, key: str, digest: str) -> DataFrame:
    """Rows (shard, n, root): one root per shard over its leaves by key."""
    found = group_roots(leaves, shard, [F.col(key)], digest)
    return found.select(F.col(shard).cast("long").alias("shard"), "n", "root")


def collection_root(roots: DataFrame) -> str | None:
    """The root over a collection's shard roots, in order of shard."""
    rows = roots.orderBy("shard").collect()  # one row per shard, a fixed number
    root = root_of([d for _, d in fold([bytes.fromhex(r["root"]) for r in rows])])
    return root.hex() if root else None
