"""Dates of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A time from ISO text; null where it is none."""
    return text.try_cast("timestamp")


def exif_date(*fields: Column) -> Column:
    """The last field present, in the form ``2024:03:01 10:20:30`` (UTC)."""
    return F.coalesce(*[F.try_to_timestamp(f, F.lit("yyyy:MM:dd HH:mm:ss")) for f in reversed(fields)])


def sidecar_date(json: Column) -> Column:
    """The time that a sidecar file tells in Unix seconds under ``photoTakenTime.timestamp``; null where it tells none."""
    return F.timestamp_seconds(F.get_json_object(json, "$.photoTakenTime.timestamp").try_cast("long"))


def month_group(ts: Column) -> Column:
    """[year, month name], or [Undated]."""
    return F.when(ts.isNull(), F.array(F.lit("Undated"))).otherwise(F.array(F.date_format(ts, "yyyy"), F.date_format(ts, "MMMM")))


def built_date(year: Column, month: Column | None = None) -> Column:
    """The first instant of a year (or decade), or of a month."""
    return F.make_timestamp(year, F.lit(1) if month is None else month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
