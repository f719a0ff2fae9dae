"""Exact deduplication by an extendible-hash index on shared files.

The 64-bit key of a normalised text picks a directory slot by its leading bits.
Overfull buckets split, and the directory doubles when a bucket as deep as the
directory must split. Directory and buckets are tables: a bucket's headers, one
per key, lie together. Owner tasks take ranges of buckets, chain the rows of each
key and compare their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalox.llm.common import materialize, scratch

WHITE = r"[\x20\x09-\x0D]+"
#: Rows a bucket may hold before it splits; a key counts with at most ``OWNER_ROWS``.
BUCKET_ROWS = 4096
#: Rows of one key that a single owner task chains; more are dealt to owners of as many rows each as there are owners.
OWNER_ROWS = 64
#: Key bits by which the histogram of an overfull prefix is refined at a time.
STEP_BITS = 8


def normalised(text) -> F.col:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _prefix(h, depth: int):
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """The directory over ``keys(h, weight)``: rows (slot, depth, bucket) and its global depth.

    A bucket covers the keys whose ``depth`` leading bits agree and is named by its
    first slot, so buckets in order are key ranges in order. Each round counts the
    keys below the overfull prefixes ``STEP_BITS`` bits deeper and splits until a
    bucket fits or those bits are used up; the counts stay in Spark. Keys agree in
    all 64 bits only if they are equal, so the last depth ends it.
    """
    spark = keys.sparkSession
    full = spark.createDataFrame([(0, 0)], "depth int, prefix long")
    found, depth = [], 0
    while True:
        deeper = min(64, depth + STEP_BITS)
        below = keys.withColumn("prefix", _prefix(F.col("h"), depth)).join(full.select("prefix"), "prefix", "left_semi") if depth else keys
        fine = below.groupBy(_prefix(F.col("h"), deeper).alias("slot")).agg(F.sum("weight").alias("n"))
        levels = F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth")
        sums = fine.select("slot", "n", levels).groupBy("depth", F.expr(f"shiftrightunsigned(slot, {deeper} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
        # A prefix is a bucket if it fits and the one above it does not; below the first prefix that fits nothing splits.
        over = sums.filter(F.col("n") > capacity).select("depth", "prefix")
        parent = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1) + 1)).alias("prefix"))
        tops = full.select("depth", "prefix").union(parent.filter(F.col("depth") <= deeper))
        step = materialize(tops.join(over.withColumn("over", F.lit(True)), ["depth", "prefix"], "left"), "exact-directory")
        last = F.col("depth") == 64
        found.append(step.filter(F.col("over").isNull() | last).select("depth", "prefix"))
        full = step.filter((F.col("depth") == deeper) & F.col("over") & ~last).select("depth", "prefix")
        depth = deeper
        if not full.limit(1).count():
            break
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.union(more)
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    low = F.expr(f"shiftleft(prefix, {depth} - depth)")
    slots = buckets.select(F.explode(F.sequence(low, low + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("slot"), "depth", low.alias("bucket"))
    return slots, depth


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (bucket, part, h, id): chain the distinct texts of a key's part and name each row's first equal."""
    now, heads = None, []
    for batch in batches:
        buckets, parts, hs, ids, splits, texts = (batch.column(i) for i in range(6))
        keep, sha, head_text = [], [], []
        raw = texts.cast(pa.binary())
        for i, key in enumerate(zip(buckets.to_pylist(), parts.to_pylist(), hs.to_pylist(), strict=True)):
            if key != now:
                now, heads = key, []
            text = raw[i].as_py()
            found = next((k for k in heads if k[2] == text), None)
            new = found is None
            if new:
                found = (ids[i].as_py(), hashlib.sha256(text).hexdigest(), text)
                heads.append(found)
            keep.append(found[0])
            sha.append(found[1])
            head_text.append(text.decode() if new and splits[i].as_py() > 1 else None)
        yield pa.RecordBatch.from_arrays([buckets, hs, ids, pa.array(sha, pa.string()), pa.array(keep, pa.int64()), pa.array(head_text, pa.string())], names=["bucket", "h", "id", "sha", "head", "norm"])


_CHAINED = "bucket long, h long, id long, sha string, head long, norm string"


def _owned(rows: DataFrame) -> DataFrame:
    """``rows(bucket, part, h, id, splits, norm)`` chained by owners of key ranges; the parts of a hot key are ranges of their own."""
    rows = materialize(rows, "exact-owned")
    return rows.repartitionByRange("bucket", "part", "h").sortWithinPartitions("bucket", "part", "h", "id").mapInArrow(_chain, _CHAINED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after :func:`normalised`; the smallest id of a
    group stays. A null text counts as empty. Rows without an id take no part and
    are left out; rows that repeat an id are each returned and count each, by
    their own text: an id may stay for one text and go for another. An empty table
    gives an empty result. Other columns are ignored, whatever their names. Texts
    of any length are compared whole.
    """
    with scratch(docs.sparkSession):
        texts = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm")).filter("id is not null").withColumn("h", F.xxhash64("norm"))
        base = materialize(texts.select("id", "h", F.sha2("norm", 256).alias("sha")), "exact-keys")
        headers = materialize(base.groupBy("h").agg(F.count("*").alias("rows")), "exact-headers")
        weighed = headers.select("h", F.least("rows", F.lit(owner_rows)).alias("weight"))
        slots, depth = directory(weighed, capacity)
        slots = materialize(slots, "exact-slots")
        # Bucket files: the headers of a bucket lie together, buckets in order.
        index = headers.withColumn("slot", _prefix(F.col("h"), depth)).join(slots, "slot").select("bucket", "h", "rows")
        index = materialize(index.repartitionByRange("bucket").sortWithinPartitions("bucket", "h"), "exact-index")

        shared = index.filter("rows > 1").select("bucket", "h", F.ceil(F.col("rows") / F.greatest(F.lit(owner_rows), F.sqrt("rows"))).cast("int").alias("splits"))
        rows = texts.join(shared.hint("shuffle_hash"), "h").select("bucket", F.pmod(F.hash("id"), "splits").alias("part"), "h", "id", "splits", "norm")
        first = materialize(_owned(rows), "exact-chains")
        heads = first.filter("norm is not null").select("bucket", F.lit(0).alias("part"), "h", F.col("head").alias("id"), F.lit(1).alias("splits"), "norm")
        second = _owned(heads).select("h", F.col("id").alias("head"), "sha", F.col("head").alias("root")).distinct()
        # Sizes are summed over heads first, so no group's rows meet in one task.
        sized = first.groupBy("h", "head", "sha").agg(F.count("*").alias("n")).join(second, ["h", "head", "sha"], "left").withColumn("root", F.coalesce("root", "head"))
        sized = materialize(sized, "exact-sized")
        total = sized.groupBy("h", "root", "sha").agg(F.sum("n").alias("group_size"))
        decided = sized.join(total, ["h", "root", "sha"]).select("h", "head", "sha", F.col("root").alias("keep_id"), "group_size")
        decided = first.select("h", "id", "sha", "head").distinct().join(decided, ["h", "head", "sha"]).select("id", "h", "sha", "keep_id", "group_size")
        return materialize(base.join(decided, ["id", "h", "sha"], "left").select(
            F.col("id").alias(id_col),
            F.coalesce("keep_id", "id").alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.coalesce("keep_id", "id") == F.col("id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        ), "exact-result", keep=True)
