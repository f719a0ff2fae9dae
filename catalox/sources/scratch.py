"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables of the innermost open :func:`scratch`: those it deletes when it closes, and those it leaves to the one around it.
_open: ContextVar[tuple[list[str], list[str]] | None] = ContextVar("_open", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder (local) or one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        local = context.master.startswith("local")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="catalox-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir().rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/catalox/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet and read again, which cuts its lineage at a copy that outlives executors.

    Inside :func:`scratch` the table goes when that closes, unless ``keep`` says
    that the result still reads it. Kept tables go with a scratch around this one, or
    stay until :func:`drop_tables`.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (inside := _open.get()) is not None:
        inside[keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables materialised inside it, but for those kept."""
    gone, kept = [], []
    before = _open.set((gone, kept))
    try:
        yield
    finally:
        _open.reset(before)
        if (around := _open.get()) is not None:
            around[0].extend(kept)
        for path in gone:
            delete(spark, path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that this application has left in the shared folder."""
    delete(spark, tables_dir(spark))
