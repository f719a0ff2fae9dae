"""Last-writer-wins merging of two versions of a collection."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newer(a: Column, b: Column, a_ts: Column, b_ts: Column) -> Column:
    """The value of the later side; an absent value loses whatever its time; on a tie ``b`` stays."""
    return F.when(a.isNull(), b).when(b.isNull(), a).when(F.coalesce(a_ts, F.lit(0)) > F.coalesce(b_ts, F.lit(0)), a).otherwise(b)


def merge(source: DataFrame, target: DataFrame, key: str, fields: Sequence[str], ts: str = "ts", tombstones: DataFrame | None = None) -> DataFrame:
    """Rows (key, fields, ts) after a pull of ``source`` into ``target``.

    Records of both sides merge field by field; those of one side stay, unless only
    the source has them and ``tombstones(key)`` names them. The merged record's time
    is the smaller one, so later pulls still see newer fields.
    """
    gone = F.lit(False)
    if tombstones is not None:
        source = source.join(tombstones.select(key).distinct().withColumn("is_gone", F.lit(True)), key, "left")
        gone = F.coalesce("s.is_gone", F.lit(False)) & F.col(f"t.{key}").isNull()
    s, t = source.alias("s"), target.alias("t")
    joined = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full").filter(~gone)
    merged = [newer(F.col(f"s.{f}"), F.col(f"t.{f}"), F.col(f"s.{ts}"), F.col(f"t.{ts}")).alias(f) for f in fields]
    return joined.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), *merged, F.least(f"s.{ts}", f"t.{ts}").alias(ts))


def merge_fields(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Records ``(key, fields, times, ts)`` merged field by field, each field by its own time.

    ``fields`` and ``times`` are maps by field name; a field without a time has its
    record's ``ts``. The later value wins, a tie leaves the target's, and a field that one
    side lacks comes from the other whatever its time. A name that only has a time
    was deleted. The merged ``ts`` is the smaller one, so ``times`` keeps what is later than that.
    Records of one side stay as they are.
    """
    joined = source.select(key, F.struct("fields", "times", "ts").alias("s")).join(target.select(key, F.struct("fields", "times", "ts").alias("t")), key, "full")
    none = {"fields": F.create_map().cast("map<string,string>"), "times": F.create_map().cast("map<string,bigint>")}
    part = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), none[name])
    names = F.array_distinct(F.flatten(F.array(*[F.map_keys(part(side, name)) for side in "st" for name in ("fields", "times")])))

    def one(name: Column) -> Column:
        value, time = ({x: F.try_element_at(part(x, kind), name) for x in "st"} for kind in ("fields", "times"))
        time = {x: F.coalesce(time[x], F.col(f"{x}.ts"), F.lit(0)) for x in "st"}
        mine = value["s"].isNotNull() & (value["t"].isNull() | (time["s"] > time["t"]))
        return F.struct(name.alias("name"), F.when(mine, value["s"]).otherwise(value["t"]).alias("value"), F.when(mine, time["s"]).otherwise(time["t"]).alias("time"))

    ts = F.least(F.coalesce("s.ts", F.lit(0)), F.coalesce("t.ts", F.lit(0)))
    as_map = lambda items, field: F.map_from_entries(F.transform(items, lambda x: F.struct(x["name"], x[field])))
    merged = joined.filter("s is not null and t is not null").withColumn("m", F.transform(names, one)).select(
        key,
        as_map(F.filter("m", lambda x: x["value"].isNotNull()), "value").alias("fields"),
        as_map(F.filter("m", lambda x: x["time"] > ts), "time").alias("times"),
        ts.alias("ts"))
    single = joined.filter("s is null or t is null").select(key, *[F.coalesce(f"s.{n}", f"t.{n}").alias(n) for n in ("fields", "times", "ts")])
    return merged.unionByName(single)


def synced(one: DataFrame, two: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides after a pull of ``two`` into ``one`` and a push back; where two values have one time each side keeps its own."""
    pulled = merge_fields(two, one, key)
    return pulled, merge_fields(pulled, two, key)


def update_times(ts: Column, times: Column, before: Column, changes: Column, at: Column) -> Column:
    """``times`` by dotted path after ``changes`` (path to new value, null for a deletion) at time ``at``.

    A changed path takes the time ``at`` in place of those below it, unless its record
    or a path above it bears that time or a later one. Values that do not change leave theirs.
    """
    held = F.coalesce(times, F.create_map().cast("map<string,bigint>"))
    above = lambda path: F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(path, r"\.")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split(path, r"\."), F.lit(1), n), "."))
    blocked = lambda path: F.exists(above(path), lambda p: (p != path) & F.coalesce(F.try_element_at(held, p) >= at, F.lit(False)))
    fresh = F.map_filter(changes, lambda p, v: (v.isNull() | ~v.eqNullSafe(F.try_element_at(before, p))) & ~blocked(p))
    names = F.map_keys(fresh)
    kept = F.map_filter(held, lambda p, t: ~F.exists(names, lambda n: (p == n) | p.startswith(F.concat(n, F.lit(".")))))
    return F.when((ts >= at) | (F.size(changes) == 0), held).otherwise(F.map_concat(kept, F.transform_values(fresh, lambda p, v: at)))


def changes(before: DataFrame, after: DataFrame, key: str, hash_: str) -> DataFrame:
    """Records of ``after`` that are new or differ, for writing."""
    return after.join(before.select(key, F.col(hash_).alias("own")), key, "left").filter(f"not (own <=> {hash_})").drop("own")


def merge_values(a, b, a_meta: Mapping | None, b_meta: Mapping | None, a_ts: int = 0, b_ts: int = 0):
    """(value, meta) of two nested values. ``meta`` is {"timestamp", "fields"}; a part without a time has its parent's.

    Objects merge by field; lists and plain values are taken whole. None stands for
    an absent part, which loses against a present one.
    """
    a_meta, b_meta = a_meta or {}, b_meta or {}
    a_ts, b_ts = a_meta.get("timestamp", a_ts), b_meta.get("timestamp", b_ts)
    if not (isinstance(a, dict) and isinstance(b, dict)):
        if a is None or b is None:
            return (b, b_ts) if a is None else (a, a_ts)
        return (a, a_ts) if a_ts > b_ts else (b, b_ts)
    base, value, fields = min(a_ts, b_ts), {}, {}
    a_fields, b_fields = a_meta.get("fields", {}), b_meta.get("fields", {})
    for name in sorted({*a, *b, *a_fields, *b_fields}):
        part, meta = merge_values(a.get(name), b.get(name), a_fields.get(name), b_fields.get(name), a_ts, b_ts)
        if part is not None:
            value[name] = part
        if isinstance(meta, dict):
            if meta.get("fields") or meta["timestamp"] > base:
                fields[name] = meta
        elif meta > base:
            fields[name] = {"timestamp": meta}
    return value, {"timestamp": base, **({"fields": fields} if fields else {})}


def merge_json(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Nested records as JSON: both sides have (key, fields, meta) as texts, and so has the result."""
    joined = source.select(F.col(key), F.col("fields").alias("a"), F.col("meta").alias("a_meta")).join(
        target.select(F.col(key), F.col("fields").alias("b"), F.col("meta").alias("b_meta")), key, "full")
    both = "a is not null and b is not null"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            merged = [merge_values(*(json.loads(x) if x else {} for x in r)) for r in rows[["a", "b", "a_meta", "b_meta"]].itertuples(index=False)]
            yield pd.DataFrame({key: rows[key], "fields": [json.dumps(v, sort_keys=True) for v, _ in merged], "meta": [json.dumps(m, sort_keys=True) for _, m in merged]})

    kind = source.schema[key].dataType.simpleString()
    one = joined.filter(f"not ({both})").select(key, F.coalesce("a", "b").alias("fields"), F.coalesce("a_meta", "b_meta").alias("meta"))
    return joined.filter(both).mapInPandas(run, f"{key} {kind}, fields string, meta string").unionByName(one)
