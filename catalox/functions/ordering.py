"""Sort keys with the catalogue's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(text: Column) -> Column:
    """Names order by their numbers, of any length: each digit run follows its own length, without leading zeros."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    plain = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(plain(p)).cast("string"), 10, "0"), plain(p))).otherwise(p)), "")


def string_key(text: Column) -> Column:
    """Language order: letters before their capitals."""
    return F.collate(text, "UNICODE")


def number_key(value: Column, ascending: bool = True) -> list[Column]:
    """Numbers with not-a-number smallest and null as zero."""
    number = F.coalesce(value.cast("double"), F.lit(0.0))
    real = ~F.isnan(number)
    return [real.asc(), number.asc()] if ascending else [real.desc(), number.desc()]


def place_key(location: Column) -> Column:
    """The last three comma parts, widest first; null for none."""
    parts = F.transform(F.split(location, ","), lambda x: F.trim(x))
    return F.when(F.length(location) > 0, F.slice(F.reverse(parts), 1, 3))


def reverse_time_key(ts: Column, sequence: Column) -> Column:
    """A text that ascends as time descends (until the year 3000), with a sequence number."""
    left = F.unix_millis(F.lit("3000-01-01 00:00:00").cast("timestamp")) - F.unix_millis(ts)
    return F.concat(F.lpad(left.cast("string"), 20, "0"), F.lit("-"), F.lpad(sequence.cast("string"), 3, "0"))
