"""Edits of a collection as snapshot in, snapshot out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalox.operators.checks import check_complete


def insert_new(records: DataFrame, added: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Records and the added ones of new keys; ``strict`` raises on a key that is there."""
    if strict:
        check_complete(added.join(records.select(key), key, "left_semi").select(key), "already present")
    return records.unionByName(added.join(records.select(key), key, "left_anti"))


def patch(records: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], upsert: bool = False) -> DataFrame:
    """Records with the present fields of ``changes``; absent (null) ones stay. With ``upsert`` unknown keys are added."""
    joined = records.alias("r").join(changes.alias("c"), F.col(f"r.{key}") == F.col(f"c.{key}"), "full" if upsert else "left")
    return joined.select(
        F.coalesce(f"r.{key}", f"c.{key}").alias(key),
        *[F.coalesce(f"c.{n}", f"r.{n}").alias(n) if n in fields else F.col(f"r.{n}") for n in records.columns if n != key])


def replace(records: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Records with whole ones replaced or added."""
    return records.join(added.select(key), key, "left_anti").unionByName(added)


def delete(records: DataFrame, gone: DataFrame, key: str, strict: bool = False) -> DataFrame:
    if strict:
        check_complete(gone.join(records.select(key), key, "left_anti").select(key), "not present")
    return records.join(gone.select(key), key, "left_anti")


def soft_delete(records: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Records with ``deleted`` true for the named keys."""
    named = gone.select(key).distinct().withColumn("named", F.lit(True))
    return records.join(named, key, "left").withColumn("deleted", F.coalesce("named", F.lit(False))).drop("named")


def list_edits(edits: DataFrame, key: str) -> DataFrame:
    """Rows (key, pulled, added) of a log of push and pull: values that were ever pulled, and those pushed since, in order of that push.

    Of each record and value only its last pull and its first push after that
    matter, so a record's log is never gathered, only its distinct values.
    """
    pulls = edits.groupBy(key, "value").agg(F.max(F.when(F.col("kind") == "pull", F.col("seq"))).alias("last_pull"))
    pushes = edits.filter("kind = 'push'").join(pulls, [key, "value"]).filter("last_pull is null or seq > last_pull").groupBy(key, "value").agg(F.min("seq").alias("first_push"))
    both = pulls.join(pushes, [key, "value"], "left")
    added = F.array_sort(F.collect_list(F.when(F.col("first_push").isNotNull(), F.struct("first_push", "value"))))
    return both.groupBy(key).agg(F.collect_set(F.when(F.col("last_pull").isNotNull(), F.col("value"))).alias("pulled"), F.transform(added, lambda x: x["value"]).alias("added"))


def edited(values: Column, pulled: Column, added: Column) -> Column:
    """The list after its edits: what was never pulled stays, and what was pushed and is not there follows."""
    stay = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: ~F.array_contains(pulled, x))
    return F.concat(stay, F.array_except(added, stay))


def last_set(ops: DataFrame, key: str, field: str) -> DataFrame:
    """Rows (key, field, value): the last value set for each record and field."""
    return ops.filter("kind = 'set'").groupBy(key, field).agg(F.max_by("value", "seq").alias("value"))


def apply_ops(records: DataFrame, ops: DataFrame, key: str, scalar: Sequence[str], array: str, strict: bool = True) -> DataFrame:
    """Records after a log ``ops(key, seq, kind, field, value)`` of set, push and pull.

    ``set`` of an unknown key adds a record; push and pull of one raise (``strict``)
    or are passed over. ``array`` is the field that push and pull edit.
    """
    edits = ops.filter(F.col("field") == array).filter("kind in ('push', 'pull')")
    if strict:
        known = records.select(key).union(ops.filter("kind = 'set'").select(key))
        check_complete(edits.join(known, key, "left_anti").select(key), "push or pull without a record")
    sets = last_set(ops.filter(F.col("field").isin(list(scalar))), key, "field").groupBy(key).pivot("field", list(scalar)).agg(F.first("value"))
    lists = list_edits(edits, key)
    named = sets.select(key, *[F.col(f).alias(f"new_{f}") for f in scalar])
    joined = records.join(named, key, "full").join(lists, key, "left")
    columns = [F.coalesce(F.col(f"new_{n}").cast(records.schema[n].dataType), F.col(n)).alias(n) if n in scalar else F.when(F.col("added").isNull(), F.col(n)).otherwise(edited(F.col(n), F.col("pulled"), F.col("added"))).alias(n) if n == array else F.col(n) for n in records.columns]
    return joined.select(*columns)


def apply_routed(records: DataFrame, ops: DataFrame, database: str, collection: str, supported: str, key: str, scalar: Sequence[str], array: str) -> DataFrame:
    """Records of many databases after a log whose entries name their database and collection.

    An entry goes to the record of its key in its own database; one for another
    collection than ``supported`` raises before anything is applied.
    """
    check_complete(ops.filter(~F.coalesce(F.col(collection) == supported, F.lit(False))).select(collection), "a collection that takes no edits")
    named = lambda df: df.withColumn("target", F.struct(database, key)).drop(database, key)
    done = apply_ops(named(records), named(ops.drop(collection)), "target", scalar, array)
    return done.select(f"target.{database}", f"target.{key}", *[c for c in done.columns if c != "target"])


def latest_per_key(log: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last entry of each key in a change log."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
