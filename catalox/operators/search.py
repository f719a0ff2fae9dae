"""Search filters as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fields that a search without a field name covers.
DEFAULT_FIELDS = ["_id", "hash", "location", "description", "labels", "origFileName", "origPath", "contentType"]
TERM = re.compile(r'(?:"[^"]*"?|[^ "])+')


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def value_matches(df: DataFrame, name: str, text: str) -> Column:
    """Text fields and lists of texts that hold ``text`` in any case; other types never match."""
    kind, wanted = df.schema[name].dataType, text.lower()
    if isinstance(kind, StringType):
        return F.coalesce(F.lower(F.col(name)).contains(wanted), F.lit(False))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return F.coalesce(F.exists(F.col(name), lambda x: F.lower(x).contains(wanted)), F.lit(False))
    return F.lit(False)


def label_matches(labels: Column, pattern: str) -> Column:
    """``-``: no labels; ``a&b``: each pattern is within some label; ``a|b``: one of them is. ``&`` comes first."""
    if pattern == "-":
        return labels.isNull() | (F.size(labels) == 0)
    within = lambda p: F.coalesce(F.exists(labels, lambda x: F.lower(x).contains(p.strip().strip('"').lower())), F.lit(False))
    if "&" in pattern:
        return _all([within(p) for p in pattern.split("&")])
    return _any([within(p) for p in pattern.split("|")])


def text_filter(df: DataFrame, query: str, fields: Sequence[str] = DEFAULT_FIELDS, labels: str = "labels") -> Column:
    """All terms must match; quotes protect spaces.

    ``.name=value`` looks in the fields whose names hold ``name``, and so do the plain
    terms after it until another scope is set. ``.labels=value`` has the patterns of
    :func:`label_matches` and sets the scope back to ``fields``. A scope without
    exactly one ``=`` says nothing and changes nothing; an empty value is part of any text.
    """
    conditions, scope = [], list(fields)
    for term in (t.strip() for t in TERM.findall(query.strip())):
        if term.startswith("."):
            parts = [x.strip() for x in term[1:].split("=")]
            if len(parts) != 2:
                continue
            name, term = parts
            if name.lower() == labels.lower():
                conditions.append(label_matches(F.col(labels), term) if labels in df.columns else F.lit(term == "-"))
                scope = list(fields)
                continue
            scope = [name]
        if term or scope != list(fields):
            chosen = [c for c in df.columns if any(f.lower() in c.lower() for f in scope)]
            conditions.append(_any([value_matches(df, c, term.strip('"')) for c in chosen]))
    return _all(conditions)


def asset_filter(
    name: Column, location: Column, kind: Column, date: Column, query: str | None = None, content_type: str | None = None,
    date_from: str | None = None, date_to: str | None = None,
) -> Column:
    """Text in name or place, prefix of the media type, inclusive dates. A record without a date goes only if a date is asked for.

    ``date`` is a date or time; the bounds take its type, so they reach the scan.
    """
    conditions = []
    if query:
        conditions.append(_any([F.lower(c).contains(query.lower()) for c in (name, location)]))
    if content_type:
        conditions.append(F.lower(kind).startswith(content_type.lower()))
    if date_from:
        conditions.append(date >= F.lit(date_from))
    if date_to:
        conditions.append(date <= F.lit(date_to))
    return _all(conditions)


def under_path(path: Column, prefix: str) -> Column:
    """The path itself or anything below it."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def in_partial_replica(path: Column) -> Column:
    """Files that a partial replica holds: thumbnails and those of the top folder."""
    return path.startswith("thumb/") | ~path.contains("/")


def geo_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def not_deleted(flag: Column) -> Column:
    return ~F.coalesce(flag, F.lit(False))
