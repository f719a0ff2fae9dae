"""Stored files of a collection: writing with verification, copies, moves and listings.

Tasks write through the file system of the target's URI; what was written is read
again by Spark and compared, so a lost or half-written file shows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalox.operators.checks import check_complete
from catalox.sources.scratch import delete, materialize


def relative(path, folder: str):
    """The part of a path below ``folder``, with either form of a file URI."""
    tail = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.substring_index(path, f"{tail}/", -1)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (name, length, hash) of the files below ``folder``, but for empty ones, which Spark's scan passes over; each file is read where it is hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(relative(F.col("path"), folder).alias("name"), "length", F.sha2("content", 256).alias("hash"))


def write_assets(contents: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's bytes as a file and return (name, length, hash) of what is stored.

    A file is written under a name of its attempt and then renamed, so a task that
    runs again leaves whole files only. Raises if any file with bytes is missing or differs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystems.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        for batch in batches:
            names, raw = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
            for at, data in zip(names, raw, strict=True):
                path = f"{root}/{at}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{path}.part") as out:
                    out.write(data)
                store.move(f"{path}.part", path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])], names=["name", "length", "hash"])

    rows = contents.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    sent = materialize(rows.mapInArrow(run, "name string, length long, hash string"), "assets-sent")
    check_complete(sent.filter("length > 0").join(stored(contents.sparkSession, folder), ["name", "length", "hash"], "left_anti").select("name"), "not stored as sent")
    return sent


def copy_assets(spark: SparkSession, source: str, target: str, names: DataFrame | None = None) -> DataFrame:
    """Copy the files below ``source`` (those in ``names(name)``) to ``target`` and return what is stored there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select(relative(F.col("path"), source).alias("name"), "content")
    return write_assets(files if names is None else files.join(names, "name", "left_semi"), target)


def move_assets(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy all files, and only when each is verified delete the source. Raises, and deletes nothing, where some files are empty."""
    moved = copy_assets(spark, source, target)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getFileCount()
    if files != moved.count():
        raise ValueError(f"{source} has files without bytes")
    delete(spark, source)
    return moved
