"""Keys, shards and digests of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 100


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    """The first 32 bits of the key's MD5, modulo the shards."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def uuid_bytes(text: Column) -> Column:
    """The 16 bytes of a canonical id; null where it is none."""
    plain = F.replace(F.lower(text), F.lit("-"), F.lit(""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.unhex(plain))


def uuid_text(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(raw)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def record_hash(*names: str) -> Column:
    """SHA-256 of the JSON object of the fields in order of name; absent (null) fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def classify_input(text: Column) -> Column:
    """``asset_id``, ``hash`` or ``path`` by the form of the text."""
    return (
        F.when(F.lower(text).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "asset_id")
        .when(F.lower(text).rlike("^[0-9a-f]{64}$"), "hash")
        .otherwise("path"))


def stamped(field_ts: Column, names: list[str], ts: Column) -> Column:
    """``field_ts`` (map of path to time) after the fields were changed at ``ts``; older changes leave it."""
    fresh = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[ts] * len(names)))
    kept = F.map_filter(F.coalesce(field_ts, F.create_map().cast("map<string,bigint>")), lambda k, v: ~k.isin(names) | (v >= ts))
    return F.map_concat(kept, F.map_filter(fresh, lambda k, v: ~F.array_contains(F.map_keys(kept), k)))
