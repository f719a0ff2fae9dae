"""Streaming ingest: imports without known contents, and change logs folded into versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from catalox.functions.records import SHARDS, shard_of
from catalox.operators.edits import apply_ops
from catalox.sources.store import read_version, write_shards, write_version

#: Every so many versions a whole one is written, so that a reader follows few folders.
WHOLE_EVERY = 20


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def import_stream(stream: DataFrame, path: str, checkpoint: str, hash_: str = "hash", order: str = "path", trigger: dict | None = None) -> StreamingQuery:
    """Append records of contents that the table at ``path`` lacks; of equal contents in a batch the first by ``order`` comes in.

    Each micro-batch has a partition of its own which a replay overwrites, so a
    failed batch leaves neither gaps nor copies. A batch is compared with the
    partitions of the batches before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(hash_).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if latest_batch(spark, path) is not None:
            known = spark.read.parquet(path).filter(F.col("batch") < number).select(hash_)
            first = first.join(known, hash_, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_batch(spark: SparkSession, path: str) -> int | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return max((int(n[6:]) for n in names if n.startswith("batch=")), default=None)


def change_stream(ops: DataFrame, path: str, checkpoint: str, key: str, scalar: Sequence[str], array: str, trigger: dict | None = None) -> StreamingQuery:
    """Fold a stream ``ops(key, seq, kind, field, value)`` into the versioned store at ``path``.

    Version 0 is where the log starts; batch n makes version n + 1 from version n, and
    a replay makes it again. Only the shards of the batch's keys are read and written.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.select(shard_of(F.col(key))).distinct().collect()]  # SHARDS at most
        before = read_version(spark, path, number)
        after = apply_ops(before.filter(F.col("shard").isin(touched)).drop("shard"), batch, key, scalar, array)
        if (number + 1) % WHOLE_EVERY:
            write_shards(after.withColumn("shard", shard_of(F.col(key), SHARDS)), path, number + 1, key)
        else:
            write_version(after.unionByName(before.filter(~F.col("shard").isin(touched)).drop("shard")), path, number + 1, key)

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def view_stream(records: DataFrame, path: str, checkpoint: str, order: Sequence[Column], trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a sorted view: each micro-batch is one sorted run, and what is there is not sorted again.

    Files of a run hold ranges of the order, so a reader of the first entries skips
    most files by their bounds. A replay overwrites its run.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/run={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
