"""Text and file-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a file size.
UNITS = ["B", "KB", "MB", "GB", "TB"]


def fuzzy_match(query: Column, candidate: Column) -> Column:
    """True within an edit distance of max(3, length / 4), equal texts excluded; letters compare in lower case."""
    q, c = F.lower(query), F.lower(candidate)
    distance = F.levenshtein(q, c)
    return (distance > 0) & (distance <= F.greatest(F.lit(3), F.floor(F.length(q) / 4).cast("int")))


def file_size(size: Column) -> Column:
    """A size in the largest unit of at least one, two decimals at most."""
    out = F.lit(None).cast("string")
    for i in range(len(UNITS) - 1, -1, -1):
        value = F.round(size / float(1024**i), 2)
        shown = F.concat(F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", ""), F.lit(f" {UNITS[i]}"))
        known = (size >= 1024**i) & (size < 1024 ** (i + 1)) if i < len(UNITS) - 1 else size >= 1024**i
        out = F.when(known, shown).otherwise(out)
    return F.when(size == 0, "0 B").otherwise(out)


def folder_labels(path: Column) -> Column:
    """The folder names of a path as labels."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def nested_get(json: Column, path: str, kind: str) -> Column:
    """A value inside a JSON text by dotted path; null where it is absent or of another type."""
    return F.try_variant_get(F.try_parse_json(json), "$." + path, kind)


def custom_labels(labels: Column) -> Column:
    """All labels but the built-in ones, each once."""
    return F.array_except(labels, F.array(F.lit("starred"), F.lit("flagged")))


def pushed(values: Column, value: Column) -> Column:
    """``values`` with ``value`` at the end unless it is there; null counts as empty."""
    values = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def pulled(values: Column, value: Column) -> Column:
    return F.array_remove(values, value)


def moved_to_end(values: Column, value: Column) -> Column:
    return F.array_append(F.array_remove(values, value), value)


def base64_of(raw: Column) -> Column:
    """Base64 in one line, whatever the session breaks lines at."""
    return F.regexp_replace(F.base64(raw), r"\s", "")
